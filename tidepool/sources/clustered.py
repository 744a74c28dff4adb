"""Tables laid out for lookups (S4, L21, X3): rows sorted along a curve through some columns, a manifest with
each file's value ranges, and Parquet bloom filters.

Files are cut along the Z-order of the columns' ranks, so each column's values lie in few files; a
lookup finds the files whose ranges can hold its values in the manifest, one row per file, and reads only those.
Within a file, row-group statistics and bloom filters (for equality) skip further.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators.index import recommend_layout
from tidepool.sources import loading

#: bits of a column's rank that take part in the curve
BITS = 10


def _rank(df: DataFrame, cols: list[str]) -> DataFrame:
    """(cols, _z): the place along the Z-order of the columns' quantile ranks.  Ranks come from hashed ranges of the
    sorted distinct bounds (one sketch per column), nulls are rank 0; the curve steers only the layout."""
    probes, kinds = [], dict(df.dtypes)
    for c in cols:
        numeric = kinds[c] not in ("string", "binary", "boolean") and not kinds[c].startswith("timestamp") and kinds[c] != "date"
        x = F.col(c).cast("double") if numeric else F.unix_micros(F.col(c).cast("timestamp")).cast("double") if kinds[c] not in (
            "string", "binary", "boolean") else _text_number(F.col(c))
        probes.append(x)
    steps = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    got = df.select(*[p.alias(f"p{i}") for i, p in enumerate(probes)]).agg(
        *[F.percentile_approx(f"p{i}", steps, 4 << BITS).alias(f"b{i}") for i in range(len(cols))]).first()
    z = F.lit(0).cast("long")
    for i, p in enumerate(probes):
        bounds = sorted(set(got[f"b{i}"] or []))
        rank = _bounds_passed(p, bounds)
        for b in range(BITS):
            bit = F.call_function("shiftright", rank, F.lit(b)).bitwiseAND(F.lit(1)).cast("long")
            z = z.bitwiseOR(F.call_function("shiftleft", bit, F.lit(b * len(cols) + i)))
    return df.withColumn("_z", z)


def _text_number(c: Column) -> Column:
    """The first six bytes as a number, which keeps the order."""
    return F.conv(F.rpad(F.substring(F.hex(c.cast("binary")), 1, 12), 12, "0"), 16, 10).cast("double")


def _bounds_passed(x: Column, bounds: list, base: int = 0) -> Column:
    """How many of the sorted bounds are at most ``x``: a lookup in a literal array by halves."""
    if not bounds:
        return F.lit(base)
    held = F.array(*map(F.lit, bounds))
    steps = F.sequence(F.lit(len(bounds).bit_length() - 1), F.lit(0), F.lit(-1))
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when(
        F.coalesce(F.get(held, at + F.call_function("shiftleft", F.lit(1), s) - 1) <= x, F.lit(False)), at + F.call_function("shiftleft", F.lit(1), s)).otherwise(at))
    return found + F.lit(base)


def write_clustered(df: DataFrame, path: str, cols: list[str], files: int | None = None, bloom: list[str] | None = None) -> None:
    """Write ``df`` sorted along the curve through ``cols`` as about ``files`` files (the shuffle partitions by default), with
    bloom filters on ``bloom`` (``cols`` by default), and the manifest of the files' ranges beside them."""
    spark = df.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = _rank(df, cols)
    # rows of one place on the curve are told apart by the columns themselves
    order = ["_z", *cols]
    w = ranked.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_z").write.mode("overwrite")
    for c in cols if bloom is None else bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    w.parquet(f"{path}/data")
    kept = spark.read.parquet(f"{path}/data").select(F.col("_metadata.file_name").alias("file"), *cols)
    ranges = [F.struct(F.min(c).alias("low"), F.max(c).alias("high"), F.max(F.col(c).isNull()).alias("nulls")).alias(c) for c in cols]
    kept.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), *ranges).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    loading.write_layout(spark, path, {"cols": cols})


def files_for(spark: SparkSession, path: str, equals: dict | None = None, ranges: dict | None = None) -> list[str]:
    """The files that can hold rows with the given values: ``equals`` column -> value or list, ``ranges`` column -> (low, high),
    low <= value < high, either may be None.  Columns that the table is not clustered by do not narrow."""
    own = loading.read_layout(spark, path)["cols"]
    m = spark.read.parquet(f"{path}/manifest")
    for c, v in (equals or {}).items():
        if c in own:
            vals = list(v) if isinstance(v, (list, tuple, set)) else [v]
            cond = F.lit(False)
            for x in vals:
                cond = cond | ((F.col(f"{c}.low") <= F.lit(x)) & (F.col(f"{c}.high") >= F.lit(x)))
            m = m.where(cond)
    for c, (low, high) in (ranges or {}).items():
        if c in own:
            m = m.where(F.lit(True) if low is None else F.col(f"{c}.high") >= F.lit(low))
            m = m.where(F.lit(True) if high is None else F.col(f"{c}.low") < F.lit(high))
    return [os.path.join(path, "data", r["file"]) for r in m.select("file").collect()]  # names of the files to read


def read_clustered(spark: SparkSession, path: str, equals: dict | None = None, ranges: dict | None = None) -> DataFrame:
    """The rows with the given values (see :func:`files_for`), from the files that can hold them."""
    files = files_for(spark, path, equals, ranges)
    whole = spark.read.parquet(f"{path}/data")
    df = spark.read.schema(whole.schema).parquet(*files) if files else whole.where("false")
    for c, v in (equals or {}).items():
        df = df.where(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == F.lit(v))
    for c, (low, high) in (ranges or {}).items():
        df = df.where((F.lit(True) if low is None else F.col(c) >= F.lit(low)) & (F.lit(True) if high is None else F.col(c) < F.lit(high)))
    return df


def advised_columns(df: DataFrame, most: int = 3) -> list[str]:
    """X3 applied: the columns to cluster by - a time column first, then those advised as bucket keys, then bitmap ones,
    of the most distinct values."""
    rows = {r["column"]: (r["advice"], r["ndv"]) for r in recommend_layout(df).collect()}  # a row per column
    rank = {"partition": 0, "bucket": 1, "bitmap": 2}
    own = sorted((rank[a], -n, c) for c, (a, n) in rows.items() if a in rank and n > 1)
    return [c for _, _, c in own][:most]


def write_advised(df: DataFrame, path: str, most: int = 3, files: int | None = None) -> list[str]:
    """Write ``df`` clustered by the columns that X3 advises; returns them."""
    cols = advised_columns(df, most)
    if not cols:
        raise ValueError("no column is worth clustering by")
    write_clustered(df, path, cols, files)
    return cols
