"""Bit-sliced bitmaps for ranges and NOT (X1, X2), over ids of any type.

Rows are numbered in the order of their ids (an id dictionary), so text and negative ids have bits too; a
column's distinct values are numbered in their order (its codes).  Per column and bit of the code there are two
bitmaps over the rows, those with the bit and those without, cut into buckets of 32768 rows.  A set of codes is
a union of runs that share leading bits, and each run is an AND of as many bitmaps, so a range reads a few
bitmaps per bucket whatever its number of values.

Predicates follow SQL's logic: each has the rows where it is true and those where it is false, and a null value
is in neither, so NOT of a comparison leaves nulls out as a plain filter does.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.operators.relational import broadcast_if_small
from tidepool.operators.running import row_numbers
from tidepool.session import cut_lineage

BUCKET = 32_768


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return Every((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Some((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class Range(Predicate):
    """``low`` <= column < ``high``; either may be None (no bound); ``closed`` takes ``high`` in."""

    column: str
    low: object = None
    high: object = None
    closed: bool = False


@dataclass(frozen=True)
class In(Predicate):
    column: str
    values: tuple


@dataclass(frozen=True)
class IsNull(Predicate):
    column: str


@dataclass(frozen=True)
class Every(Predicate):
    parts: tuple


@dataclass(frozen=True)
class Some(Predicate):
    parts: tuple


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate


@dataclass
class SlicedIndex:
    ids: DataFrame                    # pos, id
    codes: dict[str, DataFrame]       # per column: value, code
    sizes: dict[str, int]             # per column: number of codes
    slices: DataFrame                 # column, slice, bit, bucket, bitmap; slice -1: rows with (bit 1) and without (0) a value


def _numbered(df: DataFrame, col: str, name: str) -> DataFrame:
    """Distinct values of a column by rank, from 0; ranked in slices, not in one task."""
    own = cut_lineage(df.select(F.col(col).alias("value")).where("value IS NOT NULL").distinct(), "values")
    return cut_lineage(row_numbers(own, [], ["value"], "_n").select("value", (F.col("_n") - 1).alias(name)), "codes")


def _slices(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """The bitmaps of one column from (bucket, place, code).  A bucket's rows are brought together first and all its
    bitmaps are built side by side, a null place being passed over: no row is repeated per bit, and no
    unfinished bitmap is shuffled."""
    has = [F.col("code").isNull(), F.col("code").isNotNull()]
    sets = {(-1, b): has[b] for b in (0, 1)}
    sets.update({(s, b): F.expr(f"(shiftright(code, {s}) & 1) = {b}") for s in range(bits) for b in (0, 1)})
    wide = rows.repartition("bucket").groupBy("bucket").agg(
        *[F.bitmap_construct_agg(F.when(cond, F.col("place"))).alias(f"m{i}") for i, cond in enumerate(sets.values())])
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("slice"), F.lit(b).alias("bit"), F.col(f"m{i}").alias("bitmap")) for i, (s, b) in enumerate(sets)]))
    return wide.select("bucket", each.alias("m")).where(F.bitmap_count("m.bitmap") > 0).select(
        F.lit(column).alias("column"), "m.slice", "m.bit", "bucket", "m.bitmap")


def build_sliced_index(df: DataFrame, cols: list[str], id_col: str) -> SlicedIndex:
    """Index ``cols`` of rows told apart by ``id_col`` (of any type that has an order; not null, not repeated)."""
    ids = _numbered(df, id_col, "pos").withColumnRenamed("value", "id")
    if ids.count() != df.count():
        raise ValueError(f"{id_col} is null or repeated: its rows cannot be told apart in an index")
    rows = cut_lineage(df.select(id_col, *cols).join(broadcast_if_small(ids.withColumnRenamed("id", id_col)), id_col).select("pos", *cols), "rows")
    codes, sizes, parts = {}, {}, []
    at = [F.expr(f"pos div {BUCKET}").alias("bucket"), F.expr(f"cast(pos % {BUCKET} as int)").alias("place")]
    for c in cols:
        codes[c] = _numbered(df, c, "code")
        sizes[c] = codes[c].count()
        own = rows.select("pos", F.col(c).alias("value")).join(broadcast_if_small(codes[c]), "value", "left")
        parts.append(_slices(own.select(*at, "code"), c, max(sizes[c] - 1, 0).bit_length()))
    slices = reduce(lambda a, b: a.unionByName(b), parts)
    return SlicedIndex(ids, codes, sizes, cut_lineage(slices, "slices"))


def _runs(first: int, last: int, bits: int) -> list[tuple[int, int]]:
    """The codes ``first`` to ``last`` as runs of codes that share their leading bits: (leading bits' value, how many low bits are free)."""
    out = []
    while first <= last:
        free = 0
        while free < bits and first % (2 << free) == 0 and first + (2 << free) - 1 <= last:
            free += 1
        out.append((first >> free, free))
        first += 1 << free
    return out


def _code_ranges(ix: SlicedIndex, p: Predicate) -> list[tuple[int, int]]:
    """The codes for which a comparison is true, as ranges."""
    codes = ix.codes[p.column]
    if isinstance(p, In):
        wanted = [v for v in p.values if v is not None]
        found = sorted(r["code"] for r in codes.where(F.col("value").isin(wanted)).collect()) if wanted else []  # as many as were asked for
        return [(c, c) for c in found]
    cond = F.lit(True)
    if p.low is not None:
        cond = cond & (F.col("value") >= F.lit(p.low))
    if p.high is not None:
        cond = cond & ((F.col("value") <= F.lit(p.high)) if p.closed else (F.col("value") < F.lit(p.high)))
    r = codes.where(cond).agg(F.min("code").alias("a"), F.max("code").alias("b")).first()
    return [] if r["a"] is None else [(r["a"], r["b"])]


def _others(ranges: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    out, at = [], 0
    for a, b in ranges:
        if a > at:
            out.append((at, a - 1))
        at = b + 1
    return [*out, (at, n - 1)] if at < n else out


def _of_codes(ix: SlicedIndex, column: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """(bucket, bitmap) of the rows whose code lies in one of the ranges."""
    bits = max(ix.sizes[column] - 1, 0).bit_length()
    runs = [r for a, b in ranges for r in _runs(a, b, bits)]
    needs = []
    for k, (lead, free) in enumerate(runs):
        own = [(s, (lead >> (s - free)) & 1) for s in range(free, bits)] or [(-1, 1)]
        needs += [(k, s, b, len(own)) for s, b in own]
    spark = ix.slices.sparkSession
    wanted = spark.createDataFrame(needs, "run int, slice int, bit int, n int")  # at most 2 x bits rows for each range
    hit = ix.slices.where(F.col("column") == column).join(broadcast_if_small(wanted), ["slice", "bit"])
    each = hit.groupBy("run", "bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("met"), F.max("n").alias("n")).where("met = n")
    return each.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def _any(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("bucket").agg(
        F.bitmap_and_agg("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(parts)).drop("n")


def rows_where(ix: SlicedIndex, p: Predicate, truth: bool = True) -> DataFrame:
    """(bucket, bitmap) of the rows for which the predicate is true, or with ``truth`` False is false."""
    if isinstance(p, Not):
        return rows_where(ix, p.part, not truth)
    if isinstance(p, (Every, Some)):
        parts = [rows_where(ix, q, truth) for q in p.parts]
        return _all(parts) if isinstance(p, Every) == truth else _any(parts)
    if isinstance(p, IsNull):
        return ix.slices.where((F.col("column") == p.column) & (F.col("slice") == -1) & (F.col("bit") == (0 if truth else 1))).select("bucket", "bitmap")
    if isinstance(p, In) and any(v is None for v in p.values) and not truth:
        return ix.slices.where("false").select("bucket", "bitmap")  # NOT IN a list with a null is never true
    found = _code_ranges(ix, p)
    return _of_codes(ix, p.column, found if truth else _others(found, ix.sizes[p.column]))


def count_where(ix: SlicedIndex, p: Predicate) -> DataFrame:
    """(rows): how many rows satisfy the predicate."""
    return rows_where(ix, p).agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).cast("bigint").alias("rows"))


def set_bits(bitmap: Column) -> Column:
    """The places of a bitmap's set bits."""
    digits = F.split(F.hex(bitmap), "")
    nibble = F.transform(F.filter(F.transform(digits, lambda d, i: F.struct(i.alias("i"), F.conv(d, 16, 10).cast("int").alias("v"))), lambda s: s["v"] > 0),
                         lambda s: F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda b: F.call_function("getbit", s["v"], b) == 1),
                                               # of a byte's two digits the first holds its high bits
                                               lambda b: s["i"].bitwiseXOR(F.lit(1)) * 4 + b))
    return F.flatten(nibble)


def ids_where(ix: SlicedIndex, p: Predicate) -> DataFrame:
    """(id): the ids of the rows that satisfy the predicate."""
    at = rows_where(ix, p).select("bucket", F.explode(set_bits(F.col("bitmap"))).alias("place"))
    pos = at.select((F.col("bucket") * BUCKET + F.col("place")).alias("pos"))
    return ix.ids.join(pos, "pos").select("id")
