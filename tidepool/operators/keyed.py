"""Key models of a load (L12-L16): duplicate, aggregate, unique, primary key, merge condition.

Every merge is one ``groupBy`` on the keys with mergeable aggregates (``sum``, ``max_by``)
so hot keys are combined map-side before the shuffle; the outer-join forms reduce the
batch to one row per key first and then join once.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER_COL = "_load_order"
AGG_TYPES = ("sum", "replace", "min", "max", "none")


def _ordered(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Target rows come before batch rows; within each the caller's sequence column decides."""
    return target.withColumn(ORDER_COL, F.lit(0)).unionByName(batch.withColumn(ORDER_COL, F.lit(1)))


def _seq_key(seq) -> Column:
    seqs = [seq] if isinstance(seq, str) else list(seq)
    return F.struct(F.col(ORDER_COL), *[F.col(s) for s in seqs])


def load_duplicate(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Append; every row is kept."""
    return target.unionByName(batch)


def load_aggregate(target: DataFrame, batch: DataFrame, keys: list[str], aggs: dict[str, str], seq) -> DataFrame:
    """Merge the rows of a key per column: SUM, REPLACE (last loaded), MIN, MAX.

    Columns not named in ``aggs`` and not keys are refused, as the key model requires.
    """
    rest = [c for c in target.columns if c not in keys]
    missing = [c for c in rest if c not in aggs]
    if missing:
        raise ValueError(f"columns {missing} need an aggregation type")
    both = _ordered(target, batch)
    order = _seq_key(seq)
    out = []
    for c in rest:
        kind = aggs[c].lower()
        if kind == "sum":
            out.append(F.sum(c).alias(c))
        elif kind == "replace":
            out.append(F.max_by(F.col(c), order).alias(c))
        elif kind == "min":
            out.append(F.min(c).alias(c))
        elif kind == "max":
            out.append(F.max(c).alias(c))
        else:
            raise ValueError(f"aggregation type of {c} must be one of {AGG_TYPES[:-1]}")
    return both.groupBy(*keys).agg(*out)


def load_unique(target: DataFrame, batch: DataFrame, keys: list[str], seq) -> DataFrame:
    """The last row per key wins (batch after target, then by ``seq``)."""
    both = _ordered(target, batch)
    cols = [c for c in target.columns if c not in keys]
    last = F.max_by(F.struct(*[F.col(c) for c in cols]), _seq_key(seq)).alias("_row")
    return both.groupBy(*keys).agg(last).select(*keys, *[F.col("_row")[c].alias(c) for c in cols])


def _not_null_keys(df: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def load_primary(target: DataFrame, batch: DataFrame, keys: list[str], seq, cols: list[str] | None = None) -> DataFrame:
    """Primary-key load. Keys must be NOT NULL (such batch rows are not loaded).

    Without ``cols`` it equals L14.  With ``cols`` only those columns are updated for
    existing keys; new keys get NULL in the other columns.
    """
    batch = batch.where(_not_null_keys(batch, keys))
    if cols is None:
        return load_unique(target, batch, keys, seq)
    seqs = [seq] if isinstance(seq, str) else list(seq)
    upd = [c for c in cols if c not in keys]
    keep = [c for c in target.columns if c not in keys]
    # reduce the batch to its last row per key, then one full outer join
    last = F.max_by(F.struct(*[F.col(c) for c in upd]), F.struct(*[F.col(s) for s in seqs])).alias("_new")
    b = batch.groupBy(*keys).agg(last)
    t = target.select(*keys, F.struct(*[F.col(c) for c in keep]).alias("_old"))
    j = t.join(b, on=keys, how="full_outer")
    out = []
    for c in keep:
        if c in upd:
            out.append(F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col("_old")[c]).alias(c))
        else:
            out.append(F.col("_old")[c].alias(c))
    return j.select(*keys, *out)


def merge_condition(target: DataFrame, batch: DataFrame, keys: list[str], col: str, seq) -> DataFrame:
    """A batch row replaces the stored row only when ``new.col >= old.col``.

    Several batch rows of a key are reduced first to the one with the greatest ``col``
    (ties: the last by ``seq``); then one full outer join decides per key.
    """
    seqs = [seq] if isinstance(seq, str) else list(seq)
    cols = [c for c in target.columns if c not in keys]
    b = batch.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(F.col(col), *[F.col(s) for s in seqs])).alias("_new"))
    t = target.select(*keys, F.struct(*[F.col(c) for c in cols]).alias("_old"))
    j = t.join(b, on=keys, how="full_outer")
    take_new = F.col("_old").isNull() | (F.col("_new").isNotNull() & (F.col("_new")[col] >= F.col("_old")[col]))
    row = F.when(take_new, F.col("_new")).otherwise(F.col("_old"))
    return j.select(*keys, row.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in cols])


# ---------------------------------------------------------------- merges that touch only changed key buckets

KEY_BUCKET = "_key_bucket"


def key_bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(int(n))).cast("int")


def upsert(path: str, batch: DataFrame, keys: list[str], seq, model: str = "unique", n_buckets: int | None = None,
           cols: list[str] | None = None, col: str | None = None) -> list[int]:
    """L14-L16 on a stored table without rewriting it whole.

    The table at ``path`` is partitioned by a key bucket.  A batch touches only the buckets
    of its keys (at most ``n_buckets`` numbers go to the driver); those partitions are read
    (partition pruning), merged with the batch under the key model (``unique``, ``primary``
    with optional partial ``cols``, or ``condition`` on ``col``), materialised in the shared
    folder, and written back with dynamic partition overwrite - every other bucket stays as
    it is.  The first load stores the bucket count (``n_buckets``, 64 unless given) and the keys
    beside the table, before any data, so that a load that dies leaves a table that can be loaded
    again; later loads take them from there and another count or other keys are
    refused, since rows of one key would come to lie in two buckets.  Returns the touched
    buckets."""
    from tidepool.session import cut_lineage
    from tidepool.sources.loading import _children, _exists, read_layout, write_layout

    spark = batch.sparkSession
    empty = not any(n.startswith(f"{KEY_BUCKET}=") for n in _children(spark, path))
    if not empty or _exists(spark, os.path.join(path, "_layout")):
        layout = read_layout(spark, path)
        if layout["keys"] != list(keys) or n_buckets not in (None, layout["buckets"]):
            raise ValueError(f"the table has keys {layout['keys']} in {layout['buckets']} buckets, not {list(keys)} in {n_buckets}")
        n_buckets = layout["buckets"]
    elif model not in ("unique", "primary", "condition"):
        raise ValueError("model must be unique, primary or condition")
    else:
        n_buckets = n_buckets or 64
        write_layout(spark, path, {"keys": list(keys), "buckets": int(n_buckets)})
    b = batch.withColumn(KEY_BUCKET, key_bucket(keys, n_buckets))
    touched = sorted(r[0] for r in b.select(KEY_BUCKET).distinct().collect())
    target = spark.createDataFrame([], b.schema) if empty else \
        spark.read.parquet(path).where(F.col(KEY_BUCKET).isin(touched))
    t, bb = target.drop(KEY_BUCKET), b.drop(KEY_BUCKET)
    if model == "unique":
        merged = load_unique(t, bb, keys, seq)
    elif model == "primary":
        merged = load_primary(t, bb, keys, seq, cols)
    elif model == "condition":
        merged = merge_condition(t, bb, keys, col, seq)
    else:
        raise ValueError("model must be unique, primary or condition")
    merged = cut_lineage(merged.withColumn(KEY_BUCKET, key_bucket(keys, n_buckets)), "upsert")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(KEY_BUCKET).parquet(path)
    return touched
