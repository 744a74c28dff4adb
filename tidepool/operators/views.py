"""Materialized views on plain parquet (V1-V3, V5; V4 lives in ``streaming``).

A view is a defining aggregate over a base table.  Full refresh writes a new version and
switches the pointer (readers never see a half-written view).  Incremental refresh keeps
mergeable partial states (sum, count, min, max, HLL sketch) so appended rows are folded in
without rereading the base; averages are finalised as sum / count.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.session import spread_for_write
from tidepool.sources import loading

MERGEABLE = ("sum", "count", "min", "max", "avg", "approx_distinct", "quantile")
#: k of the quantile sketches: ranks within 0.5% (99%)
SKETCH_K = 900


@dataclass(frozen=True)
class Measure:
    name: str
    kind: str          # sum | count | min | max | avg | approx_distinct | quantile | count_distinct (refused)
    col: str | None = None
    q: float = 0.5     # which quantile


def _check(measures: list[Measure]) -> None:
    for m in measures:
        if m.kind not in MERGEABLE:
            raise ValueError(f"measure {m.name}: {m.kind} is not mergeable; use approx_distinct (HLL sketch)")


def states(df: DataFrame, keys: list[str], measures: list[Measure]) -> DataFrame:
    """Partial states of the view over ``df`` (the stored form of an incremental view)."""
    _check(measures)
    aggs = []
    for m in measures:
        c = F.col(m.col) if m.col else F.lit(1)
        if m.kind == "sum":
            aggs.append(F.sum(c).alias(f"{m.name}__sum"))
        elif m.kind == "count":
            aggs.append(F.count(c).alias(f"{m.name}__count"))
        elif m.kind == "min":
            aggs.append(F.min(c).alias(f"{m.name}__min"))
        elif m.kind == "max":
            aggs.append(F.max(c).alias(f"{m.name}__max"))
        elif m.kind == "avg":
            aggs += [F.sum(c).alias(f"{m.name}__sum"), F.count(c).alias(f"{m.name}__count")]
        elif m.kind == "approx_distinct":
            aggs.append(F.hll_sketch_agg(c).alias(f"{m.name}__hll"))
        elif m.kind == "quantile":
            d = c.cast("double")
            aggs.append(F.call_function("kll_sketch_agg_double", F.when(~F.isnan(d), d), F.lit(SKETCH_K)).alias(f"{m.name}__kll"))
    return df.groupBy(*keys).agg(*aggs)


def merge_states(a: DataFrame, b: DataFrame, keys: list[str], measures: list[Measure]) -> DataFrame:
    """V2: fold new partial states into stored ones: union, then re-aggregate by the keys."""
    _check(measures)
    aggs = []
    for m in measures:
        if m.kind in ("sum", "avg"):
            aggs.append(F.sum(f"{m.name}__sum").alias(f"{m.name}__sum"))
        if m.kind in ("count", "avg"):
            aggs.append(F.sum(f"{m.name}__count").alias(f"{m.name}__count"))
        if m.kind == "min":
            aggs.append(F.min(f"{m.name}__min").alias(f"{m.name}__min"))
        if m.kind == "max":
            aggs.append(F.max(f"{m.name}__max").alias(f"{m.name}__max"))
        if m.kind == "approx_distinct":
            aggs.append(F.hll_union_agg(f"{m.name}__hll").alias(f"{m.name}__hll"))
        if m.kind == "quantile":
            aggs.append(F.call_function("kll_merge_agg_double", F.col(f"{m.name}__kll")).alias(f"{m.name}__kll"))
    return a.unionByName(b).groupBy(*keys).agg(*aggs)


def finalize(st: DataFrame, keys: list[str], measures: list[Measure]) -> DataFrame:
    cols = []
    for m in measures:
        if m.kind == "sum":
            cols.append(F.col(f"{m.name}__sum").alias(m.name))
        elif m.kind == "count":
            cols.append(F.col(f"{m.name}__count").cast("bigint").alias(m.name))
        elif m.kind == "min":
            cols.append(F.col(f"{m.name}__min").alias(m.name))
        elif m.kind == "max":
            cols.append(F.col(f"{m.name}__max").alias(m.name))
        elif m.kind == "avg":
            cols.append((F.col(f"{m.name}__sum") / F.col(f"{m.name}__count")).alias(m.name))
        elif m.kind == "approx_distinct":
            cols.append(F.hll_sketch_estimate(f"{m.name}__hll").alias(m.name))
        elif m.kind == "quantile":
            own = F.col(f"{m.name}__kll")
            cols.append(F.when(F.call_function("kll_sketch_get_n_double", own) > 0,
                               F.call_function("kll_sketch_get_quantile_double", own, F.lit(float(m.q)))).alias(m.name))
    return st.select(*keys, *cols)


def view_query(df: DataFrame, keys: list[str], measures: list[Measure]) -> DataFrame:
    """V1: the defining query (what a full refresh computes)."""
    return finalize(states(df, keys, measures), keys, measures)


# ---------------------------------------------------------------- refresh jobs

def refresh_full(spark: SparkSession, root: str, name: str, query: DataFrame) -> str:
    """V1: write the defining query as a new version, then switch the pointer; refused if another refresh was
    published since it was begun (its rows may not be in this query's)."""
    if not name or query is None:
        raise ValueError("a view needs a name and a query")
    base = loading.current_version(spark, os.path.join(root, name))[0]
    done = progress(spark, root, name)
    st = loading.stage(query, os.path.join(root, name), txn=uuid.uuid4().hex, base=base)
    loading._write_text(spark, os.path.join(st.path, "_progress"), json.dumps(done))
    loading.publish(spark, st)
    return st.txn


def progress(spark: SparkSession, root: str, name: str) -> dict[str, int]:
    """Last batch of each stream query that is folded into the current version."""
    path = os.path.join(root, name)
    cur = loading.current_txn(spark, path)
    raw = cur and loading._read_text(spark, os.path.join(path, "_versions", cur, "_progress"))
    return json.loads(raw) if raw else {}


def refresh_incremental(spark: SparkSession, root: str, name: str, new_rows: DataFrame, keys: list[str],
                        measures: list[Measure], txn: str | None = None, done: dict[str, int] | None = None) -> str:
    """V2: fold the states of the new rows into the current stored states (never rereads the
    base); the result is published as a new version, so the read and the write never share
    a path.  It is published only if no other refresh was published since it was begun.  ``done``
    is the stream progress the new version records (the current one's unless given)."""
    path = os.path.join(root, name)
    base, parent = loading.current_version(spark, path)
    done = progress(spark, root, name) if done is None else done
    cur = None if parent is None else spark.read.parquet(os.path.join(path, "_versions", parent))
    delta = states(new_rows, keys, measures)
    merged = delta if cur is None else merge_states(cur, delta, keys, measures)
    st = loading.stage(merged, path, txn=txn or uuid.uuid4().hex, base=base)
    loading._write_text(spark, os.path.join(st.path, "_progress"), json.dumps(done))
    loading.publish(spark, st)
    return st.txn


def read_view(spark: SparkSession, root: str, name: str, keys: list[str], measures: list[Measure]) -> DataFrame:
    return finalize(loading.read_current(spark, os.path.join(root, name)), keys, measures)


def refresh_partitions(query: DataFrame, path: str, partition_col: str) -> None:
    """V3: recompute only the touched time partitions (dynamic partition overwrite)."""
    spread_for_write(query, [partition_col]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(partition_col).parquet(path)


def touched_partitions_refresh(view: DataFrame, base: DataFrame, delta: DataFrame, part: Column, part_name: str,
                               recompute) -> DataFrame:
    """V3 as a plan: untouched partitions of the stored view + the touched ones recomputed
    from the base (touched = partitions present in the delta)."""
    touched = delta.select(part.alias(part_name)).distinct()
    keep = view.join(touched, part_name, "left_anti")
    fresh = recompute(base.withColumn(part_name, part).join(touched, part_name, "left_semi"))
    return keep.unionByName(fresh)


def staleness(base: DataFrame, view: DataFrame, base_ts: str, view_ts: str) -> DataFrame:
    """V5: how far the view lags its base: newest times, rows, lag in seconds.
    One aggregate over the union of both inputs (no join)."""
    u = base.select(F.col(base_ts).alias("_bt"), F.lit(None).cast(base.schema[base_ts].dataType).alias("_vt"),
                    F.lit(1).alias("_bn"), F.lit(0).alias("_vn")) \
        .unionByName(view.select(F.lit(None).cast(view.schema[view_ts].dataType).alias("_bt"), F.col(view_ts).alias("_vt"),
                                 F.lit(0).alias("_bn"), F.lit(1).alias("_vn")))
    a = u.agg(F.max("_bt").alias("base_max_ts"), F.max("_vt").alias("view_max_ts"),
              F.sum("_bn").cast("bigint").alias("base_rows"), F.sum("_vn").cast("bigint").alias("view_rows"))
    lag = (F.unix_micros(F.col("base_max_ts").cast("timestamp")) - F.unix_micros(F.col("view_max_ts").cast("timestamp"))) / 1e6
    return a.select("*", lag.alias("lag_s"), (F.col("base_rows") - F.col("view_rows")).alias("rows_behind"))


def staleness_by_partition(base: DataFrame, view: DataFrame, base_part: Column, view_part: Column) -> DataFrame:
    """V5 per partition: rows in the base vs rows covered by the view."""
    b = base.groupBy(base_part.alias("part")).agg(F.count(F.lit(1)).alias("base_rows"))
    v = view.groupBy(view_part.alias("part")).agg(F.count(F.lit(1)).alias("view_rows"))
    # a union, so that rows without a partition value meet too
    none = F.lit(0).cast("bigint")
    both = b.select("part", "base_rows", none.alias("view_rows")).unionByName(v.select("part", none.alias("base_rows"), "view_rows"))
    return both.groupBy("part").agg(F.sum("base_rows").alias("base_rows"), F.sum("view_rows").alias("view_rows"))
