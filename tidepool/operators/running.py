"""Skew-safe ordered windows per key: running sums, running "last non-null", row numbers.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task; a key holding a
third of the rows would be a third of the job in one task.  Here every row gets a slice id:
the bucket of its first order value among quantile bounds of that column over the whole
input (``approxQuantile`` sketches, for strings a sample of a fixed size per slice).  Quantiles follow the data,
so a hot key - or a burst of one key in a short time - is cut into many slices.  The window
runs per (key, slice); each slice adds a carry computed from one summary row per earlier
slice of the same key, a table bounded by keys x slices, not by rows.  Slice ids are a
deterministic expression of the row (literal bounds), so every branch of the plan agrees.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _norm_order(order) -> list[tuple[Column, bool]]:
    """-> [(column, descending)]; items are names, Columns (ascending) or (name|Column, 'ASC'|'DESC')."""
    out = []
    for o in order:
        if isinstance(o, (tuple, list)):
            c, d = o
            out.append((F.col(c) if isinstance(c, str) else c, str(d).upper() == "DESC"))
        else:
            out.append((F.col(o) if isinstance(o, str) else o, False))
    return out


def _sort_cols(order: list[tuple[Column, bool]]) -> list[Column]:
    return [c.desc_nulls_last() if d else c.asc_nulls_first() for c, d in order]


def _numeric(c: Column, dtype: T.DataType) -> Column | None:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    return None


#: values a slice that the bounds of a string column are taken from
SAMPLE_PER_SLICE = 100


def _sampled_bounds(probe: DataFrame, slices: int) -> list:
    """Bounds of a string or binary column ``_o`` from a random sample of about
    ``SAMPLE_PER_SLICE`` values a slice: whole values are compared with them, so a prefix that
    all values share costs nothing.  Results do not depend on the bounds, only the balance does."""
    vals = probe.where(F.col("_o").isNotNull())
    n = vals.count()
    if not n:
        return []
    got = [r["_o"] for r in vals.sample(min(1.0, 1.2 * SAMPLE_PER_SLICE * slices / n), seed=11).collect()]
    got = sorted(bytes(v) if isinstance(v, bytearray) else v for v in got)
    return [got[len(got) * i // slices] for i in range(1, slices)] if got else []


def _bounds_passed(x: Column, bounds: list, base: int = 0) -> Column:
    """How many of the sorted bounds are at most ``x``, as a balanced tree of comparisons."""
    if not bounds:
        return F.lit(base)
    mid = len(bounds) // 2
    return F.when(x < F.lit(bounds[mid]), _bounds_passed(x, bounds[:mid], base)).otherwise(
        _bounds_passed(x, bounds[mid + 1:], base + mid + 1))


def default_slices(df: DataFrame) -> int:
    """Slice count: ``tidepool.window.slices`` when set (size it so a (key, slice) group is
    about a task's worth of data), else the shuffle partition count."""
    conf = df.sparkSession.conf
    return int(conf.get("tidepool.window.slices", None) or conf.get("spark.sql.shuffle.partitions"))


def slice_bounds(df: DataFrame, order, slices: int | None = None, also: dict[str, Column] | None = None) -> tuple[list, dict]:
    """(bounds of the slices, values of ``also``): quantiles of the first order column, and further aggregates of the
    rows, from one pass over ``df``.  Passes over the same rows in the same order may share the bounds; results do not
    depend on them.  No bounds (one slice, the plain per-key window) for a column that is neither a
    number, a time nor a string."""
    n = slices or default_slices(df)
    (first, _), = _norm_order(order)[:1]
    probe = df.select(first.alias("_o"))
    dtype = probe.schema["_o"].dataType
    aggs = [c.alias(k) for k, c in (also or {}).items()]
    sketch = n > 1 and _numeric(F.col("_o"), dtype) is not None
    if sketch:
        aggs.append(F.percentile_approx(_numeric(first, dtype), [i / n for i in range(1, n)], 10 * n).alias("_bounds"))
    got = df.agg(*aggs).first().asDict() if aggs else {}
    bounds = got.pop("_bounds", None) or []
    if n > 1 and isinstance(dtype, (T.StringType, T.BinaryType)):
        bounds = _sampled_bounds(probe, n)
    return sorted(set(bounds)), got


def with_slices(df: DataFrame, order, slices: int, name: str = "_b", bounds: list | None = None) -> DataFrame:
    """Add the slice id of every row: the number of quantile bounds of the first order column
    that its value has passed (a tree of native comparisons, in which NaN is the greatest value as
    in Spark's order), in the order's direction; NULLs get their own end slice."""
    (first, desc), = _norm_order(order)[:1]
    bounds = slice_bounds(df, order, slices)[0] if bounds is None else bounds
    if not bounds:
        return df.withColumn(name, F.lit(0))
    dtype = df.select(first.alias("_o")).schema["_o"].dataType
    x = _numeric(first, dtype)
    passed = _bounds_passed(first if x is None else x, bounds)
    own = F.lit(len(bounds)) - passed if desc else passed
    return df.withColumn(name, F.when(first.isNull(), F.lit(len(bounds) + 1 if desc else -1)).otherwise(own))


#: binary orders of magnitude that one limb of an exact sum covers
LIMB_BITS = 32


def _limb_unit(limb: int) -> tuple[float, float]:
    """2 to the limb's lowest bit as two factors (a power of two of a double's whole range needs both)."""
    low = LIMB_BITS * limb - 54
    return math.ldexp(1.0, low // 2), math.ldexp(1.0, low - low // 2)


def _finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) != float("inf")) & (v != 0)


def _limb(v: Column) -> Column:
    return F.floor(F.log2(F.abs(v)) / LIMB_BITS)


def limbs_of(value: Column) -> Column:
    """An aggregate for :func:`slice_bounds`: the ranges of magnitude that doubles fall in, 66 at most."""
    v = value.cast("double")
    return F.collect_set(F.when(_finite(v), _limb(v)))


def exact_split(df: DataFrame, value: Column, also: tuple[float, ...] = (), limbs: list | None = None) -> Callable[[Column], dict[str, Column]]:
    """A function that takes a column of the values of ``value``, their negatives, 0 and ``also`` to parts whose
    running sums, and differences of them, are exact; ``whole`` gives the value of summed parts.

    Integers and DECIMALs are one DECIMAL part ``s``.  Doubles are split by magnitude: a part for
    each range of ``LIMB_BITS`` binary orders that occurs (one aggregate finds them; two or three as a
    rule; ``limbs`` are those that :func:`limbs_of` found, if a pass has), in which a value is a whole number of the range's unit of at most 87 bits, so that
    5e11 rows add up exactly in a DECIMAL and no value, however large, takes digits from another;
    and counters ``x`` of NaN, ``p`` and ``q`` of the infinities.
    """
    dtype = df.select(value.alias("_v")).schema["_v"].dataType
    if isinstance(dtype, T.IntegralType):
        return lambda c: {"s": F.coalesce(c, F.lit(0)).cast("decimal(38,0)")}
    if isinstance(dtype, T.DecimalType):
        # spare digits: each sum of two DECIMALs of 38 digits gives one of its scale up
        return lambda c: {"s": F.coalesce(c, F.lit(0)).cast(f"decimal(38,{min(dtype.scale + 3, 37)})")}
    found = set(df.agg(limbs_of(value)).first()[0] if limbs is None else limbs)
    limbs = sorted(found | {math.floor(math.log2(abs(x)) / LIMB_BITS) for x in also} or {0})
    wide = "decimal(38,0)"
    half = float(1 << 43)

    def parts(c: Column) -> dict[str, Column]:
        d = c.cast("double")
        out = {}
        for n in limbs:
            one, two = _limb_unit(n)
            units = d / F.lit(one) / F.lit(two)
            high = F.floor(units / half)
            low = F.floor(units - high.cast("double") * half)  # a whole number; a cast would refuse other limbs' values
            out[f"s{n + 40}"] = F.when(_finite(d) & (_limb(d) == n), (high.cast(wide) * F.lit(1 << 43).cast("decimal(14,0)")).cast(wide) + low.cast(wide)).otherwise(
                F.lit(0)).cast(wide)
        flag = lambda x: F.coalesce(x, F.lit(False)).cast("bigint")
        return {**out, "x": flag(F.isnan(d)), "p": flag(d == float("inf")), "q": flag(d == float("-inf"))}
    return parts


def whole(parts: dict[str, Column]) -> Column:
    """The double that summed parts of :func:`exact_split` stand for."""
    if "x" not in parts:
        return parts["s"].cast("double")
    limbs = sorted((int(n[1:]) - 40 for n in parts if n[0] == "s"), reverse=True)
    s = None
    for n in limbs:
        one, two = _limb_unit(n)
        own = parts[f"s{n + 40}"].cast("double") * F.lit(one) * F.lit(two)
        s = own if s is None else s + own
    return (F.when((parts["x"] > 0) | ((parts["p"] > 0) & (parts["q"] > 0)), F.lit(float("nan")))
            .when(parts["p"] > 0, F.lit(float("inf"))).when(parts["q"] > 0, F.lit(float("-inf"))).otherwise(s))


def running(df: DataFrame, keys: list[str], order, sums: dict | None = None, lasts: dict | None = None,
            exclusive_lasts: bool = False, slices: int | None = None, bounds: list | None = None) -> DataFrame:
    """Add, per row, in ``order`` (a total order within ``keys``; ``bounds`` as in :func:`slice_bounds`):

    * ``sums[name] = col``: running sum of ``col`` up to and including the row;
    * ``lasts[name] = col``: the last non-null ``col`` up to the row (inclusive), or before
      the row when ``exclusive_lasts``.
    """
    sums, lasts = sums or {}, lasts or {}
    n = slices or default_slices(df)
    norm = _norm_order(order)
    oc = _sort_cols(norm)
    src = with_slices(df, order, n, bounds=bounds)
    for name, c in {**sums, **lasts}.items():
        src = src.withColumn(f"_v_{name}", c)

    pre = src
    part = [*keys, "_b"]
    w = Window.partitionBy(*part).orderBy(*oc)
    w_in = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_ex = w.rowsBetween(Window.unboundedPreceding, -1)
    src = src.withColumn("_rn", F.row_number().over(w))
    for name in sums:
        src = src.withColumn(f"_in_{name}", F.sum(f"_v_{name}").over(w_in))
    for name in lasts:
        src = src.withColumn(f"_in_{name}", F.last(f"_v_{name}", ignorenulls=True).over(w_ex if exclusive_lasts else w_in))

    # one summary row per (key, slice); carry = aggregate over strictly earlier slices.
    # Sums, and for ascending orders the last non-null value (max_by over the order as a
    # struct), are partial aggregates of the unwindowed rows: the summary shuffles one row
    # per (key, slice) per task instead of the rows.  A descending order needs the in-slice
    # row number, i.e. the windowed rows.
    ascending = all(not d for _, d in norm)
    rank_of = F.struct(*[c for c, _ in norm]) if ascending else F.col("_rn")
    base = pre if ascending else src
    aggs = [F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums]
    aggs += [F.max_by(F.col(f"_v_{name}"), F.when(F.col(f"_v_{name}").isNotNull(), rank_of)).alias(f"_t_{name}")
             for name in lasts]
    summ = base.groupBy(*part).agg(*aggs)
    w_c = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = summ.select(*part, *[F.sum(f"_t_{name}").over(w_c).alias(f"_c_{name}") for name in sums],
                        *[F.last(f"_t_{name}", ignorenulls=True).over(w_c).alias(f"_c_{name}") for name in lasts])
    cond = F.lit(True)
    for k in part:
        cond = cond & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    out = src.alias("l").join(carry.alias("r"), cond, "left").select(
        "l.*", *[F.col(f"r._c_{name}") for name in {**sums, **lasts}])
    for name in sums:
        out = out.withColumn(name, F.coalesce(F.col(f"_c_{name}"), F.lit(0)) + F.col(f"_in_{name}"))
    for name in lasts:
        out = out.withColumn(name, F.coalesce(F.col(f"_in_{name}"), F.col(f"_c_{name}")))
    drop = ["_b", "_rn"] + [f"_{p}_{name}" for name in {**sums, **lasts} for p in ("v", "in", "c")]
    return out.drop(*drop)


def row_numbers(df: DataFrame, keys: list[str], order, name: str = "row_number", slices: int | None = None) -> DataFrame:
    """``row_number()`` per key over a total order, without a per-key task."""
    return running(df, keys, order, sums={name: F.lit(1).cast("bigint")}, slices=slices)


def ranks(df: DataFrame, keys: list[str], order, tiebreak=(), slices: int | None = None) -> DataFrame:
    """Add ``row_number`` (order + tie-break), ``rank`` and ``dense_rank`` (order only) and the
    key's row count ``_total``, per key, in one sliced pass.

    Peers (equal order values) share their first order value, hence their slice, so in-slice
    rank and dense_rank plus a carry (rows, distinct peer groups of earlier slices) are exact.
    """
    n = slices or default_slices(df)
    norm, tb = _norm_order(order), _norm_order(tiebreak)
    pre = with_slices(df, order, n)
    part = [*keys, "_b"]
    w_row = Window.partitionBy(*part).orderBy(*_sort_cols(norm + tb))
    w_peer = Window.partitionBy(*part).orderBy(*_sort_cols(norm))
    src = pre.withColumn("_rn", F.row_number().over(w_row)).withColumn("_rk", F.rank().over(w_peer)) \
        .withColumn("_drk", F.dense_rank().over(w_peer))
    # the windowed rows already lie by (key, slice): the summary needs no further shuffle
    summ = src.groupBy(*part).agg(F.count(F.lit(1)).alias("_cnt"), F.max("_drk").alias("_dcnt"))
    w_c = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = summ.select(*part, F.sum("_cnt").over(w_c).alias("_c_cnt"), F.sum("_dcnt").over(w_c).alias("_c_dcnt"),
                        F.sum("_cnt").over(Window.partitionBy(*keys)).alias("_total"))
    cond = F.lit(True)
    for k in part:
        cond = cond & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    out = src.alias("l").join(carry.alias("r"), cond, "left").select("l.*", "r._c_cnt", "r._c_dcnt", "r._total")
    c_cnt, c_dcnt = F.coalesce(F.col("_c_cnt"), F.lit(0)), F.coalesce(F.col("_c_dcnt"), F.lit(0))
    return out.select(*df.columns, (c_cnt + F.col("_rn")).cast("bigint").alias("row_number"),
                      (c_cnt + F.col("_rk")).cast("bigint").alias("rank"),
                      (c_dcnt + F.col("_drk")).cast("bigint").alias("dense_rank"),
                      F.col("_total").cast("bigint").alias("_total"))
