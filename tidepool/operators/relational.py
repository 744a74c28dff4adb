"""Relational operators the reference reaches only through SQL text (S4-S19), as named
DataFrame functions.  Catalyst plans them; this module only adds what Spark lacks (as-of and
range joins) and the guards that matter at scale (checked broadcast, skew-split windows).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.operators.running import exact_split, limbs_of, ranks, running, slice_bounds, whole
from tidepool.session import cut_lineage

FLOATS = (T.DoubleType, T.FloatType)

# A side is broadcast only when its estimated size is below this bound.  The estimate counts a scan by its
# compressed files: as rows in the driver's memory, narrow columns of many rows took 20 times as much.
BROADCAST_MAX_BYTES = 8 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (file sizes for scans, propagated upwards)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only behind a size check; above it the planner (and AQE at runtime,
    from the real shuffle sizes) decides, usually a sort-merge join."""
    return F.broadcast(df) if estimated_bytes(df) <= max_bytes else df


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Equality on a key; pushed into the parquet scan as a filter."""
    return df.where(F.col(key) == F.lit(value))


def aggregate(df: DataFrame, keys: list[str], aggs: list[Column], where: Column | None = None,
              having: Column | None = None) -> DataFrame:
    """Grouped aggregation (partial aggregation before the shuffle is automatic)."""
    src = df.where(where) if where is not None else df
    out = src.groupBy(*keys).agg(*aggs)
    return out.where(having) if having is not None else out


def distinct_counts(df: DataFrame, cols: list[str], by: list[str] | None = None, rsd: float | None = None) -> DataFrame:
    """Exact distinct counts, or HyperLogLog++ estimates with relative error ``rsd``."""
    if rsd is None:
        aggs = [F.count_distinct(F.col(c)).alias(f"ndv_{c}") for c in cols]
    else:
        aggs = [F.approx_count_distinct(F.col(c), rsd).alias(f"ndv_{c}") for c in cols]
    return df.groupBy(*(by or [])).agg(*aggs)


def dense_aggregate(df: DataFrame, dims: list[str], aggs: list[Column], mode: str = "cube",
                    sets: list[list[str]] | None = None) -> DataFrame:
    """Cube / rollup / grouping sets with ``grouping_id`` (first dim = highest bit)."""
    gid = F.grouping_id(*[F.col(d) for d in dims]).cast("bigint").alias("gid")
    if mode == "cube":
        return df.cube(*dims).agg(*aggs, gid)
    if mode == "rollup":
        return df.rollup(*dims).agg(*aggs, gid)
    if mode == "sets":
        if not sets:
            raise ValueError("grouping sets need sets")
        return df.groupingSets([[F.col(c) for c in st] for st in sets], *[F.col(d) for d in dims]).agg(*aggs, gid)
    raise ValueError("mode must be cube, rollup or sets")


def equi_join(left: DataFrame, right: DataFrame, keys, how: str = "inner",
              broadcast_max_bytes: int | None = BROADCAST_MAX_BYTES) -> DataFrame:
    """Equi-join; NULL keys never match. The right side is broadcast only when its
    estimated size is under the bound (and never for the outer side of a full join)."""
    if broadcast_max_bytes is not None and how in ("inner", "left", "left_outer", "left_semi", "left_anti", "semi", "anti"):
        right = broadcast_if_small(right, broadcast_max_bytes)
    return left.join(right, on=keys, how=how)


# ---------------------------------------------------------------- time joins

def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def range_join(left: DataFrame, right: DataFrame, key: str, l_ts: str, r_ts: str, within_seconds: int,
               suffixes=("_l", "_r")) -> DataFrame:
    """Pairs with equal ``key`` and ``0 <= right.ts - left.ts <= within``.

    Both sides are bucketed by time (bucket width = ``within``); each right row keeps its
    own bucket and each left row is sent to its bucket and the next one, so the equi-join
    on (key, bucket) finds every pair exactly once and a hot key is spread over its time
    buckets instead of landing in one task.  The exact range filter follows.
    """
    w = int(within_seconds) * 1_000_000
    lb = F.floor(_micros(l_ts) / F.lit(w)).cast("bigint")
    rb = F.floor(_micros(r_ts) / F.lit(w)).cast("bigint")
    lcols = [F.col(c).alias(c + suffixes[0]) if c != key else F.col(c) for c in left.columns]
    rcols = [F.col(c).alias(c + suffixes[1]) if c != key else F.col(c) for c in right.columns]
    l2 = left.select(*lcols, F.explode(F.array(lb, lb + 1)).alias("_bucket"))
    r2 = right.select(*rcols, rb.alias("_bucket"))
    lt, rt = F.col(l_ts + suffixes[0]), F.col(r_ts + suffixes[1])
    gap = _micros_col(rt) - _micros_col(lt)
    return l2.join(r2, on=[key, "_bucket"], how="inner").where((gap >= 0) & (gap <= F.lit(w))).drop("_bucket")


def _micros_col(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, key: str, l_ts: str, r_ts: str, r_cols: list[str],
              r_id: str, prefix: str = "asof_", slices: int | None = None) -> DataFrame:
    """For every left row, the latest right row of the same key with ``r.ts <= l.ts``
    (at equal times the right row counts as earlier; ties among right rows by ``r_id``).

    Both sides are merged into one stream ordered by (key, ts, side, r_id) and each left row
    takes the last right row seen so far: one skew-safe running window (``running``), so a
    hot key is cut into range slices instead of landing in one task.  NULL keys never match.
    """
    payload = [r_id] + [c for c in r_cols if c != r_id]
    rsel = right.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_k"), F.col(r_ts).alias("_ts"), F.lit(0).alias("_side"), F.col(r_id).alias("_rid"),
        F.struct(*[F.col(c) for c in payload]).alias("_r"))
    lsel = left.select(F.col(key).alias("_k"), F.col(l_ts).alias("_ts"), F.lit(1).alias("_side"),
                       F.struct(*[F.col(c) for c in left.columns]).alias("_left"))
    lsel = lsel.withColumn("_rid", F.lit(None).cast(rsel.schema["_rid"].dataType)) \
        .withColumn("_r", F.lit(None).cast(rsel.schema["_r"].dataType))
    rsel = rsel.withColumn("_left", F.lit(None).cast(lsel.schema["_left"].dataType))
    both = lsel.unionByName(rsel)
    r = running(both, ["_k"], [F.col("_ts"), F.col("_side"), F.col("_rid")], lasts={"_hit": F.col("_r")}, slices=slices)
    return r.where(F.col("_side") == 1).select(F.col("_left.*"), *[F.col("_hit")[c].alias(prefix + c) for c in payload])


# ---------------------------------------------------------------- windows

def rank_within(df: DataFrame, by: list[str], order: list[tuple[str, str]], tiebreak: list[str] | None = None,
                n_tiles: int = 4, slices: int | None = None) -> DataFrame:
    """row_number (order + tie-break), rank, dense_rank, ntile per key, skew-safe.

    One sliced pass (``running.ranks``): the window runs per (key, slice) and earlier slices
    add their row and peer-group counts; ntile follows from the row number and the key's
    row count, which the same carry table provides.
    """
    r = ranks(df, by, list(order), [(c, "ASC") for c in (tiebreak or [])], slices=slices)
    cnt = F.col("_total")
    size = F.floor(cnt / n_tiles)
    extra = cnt % n_tiles
    r0 = F.col("row_number") - 1
    tile = F.when(r0 < extra * (size + 1), F.floor(r0 / (size + 1)) + 1) \
        .otherwise(extra + F.floor((r0 - extra * (size + 1)) / size) + 1)
    return r.select(*df.columns, "row_number", "rank", "dense_rank", tile.cast("bigint").alias("ntile"))


def top_k(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """S15 global: per-partition heaps merged on one task (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(int(k))


def top_k_per_group(df: DataFrame, by: list[str], k: int, order: list[Column]) -> DataFrame:
    """S15 per key: ``row_number() <= k``; Spark plans a partial WindowGroupLimit before the
    shuffle, so each map task sends at most k rows per key (a hot key is cut map-side)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= int(k)).drop("_rn")


def _left_null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join where NULL keys meet NULL keys."""
    named = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return a.join(named, cond, "left").drop(*[f"_r_{k}" for k in keys])


def analytic(df: DataFrame, by: list[str], ts: str, value: str, tiebreak: list[str] | None = None, moving_rows: int = 3,
             range_seconds: int = 3600, slices: int | None = None) -> DataFrame:
    """Lag / lead / running sum / moving average over rows / sum over a time range,
    per key in (ts, tie-break) order, without a per-key task.

    Running sums are taken over ``exact_split`` (DECIMAL and counters of NaN and infinities), so
    frame sums taken as differences of running sums stay exact and a NaN counts in its frames
    only; a frame without a value has no sum.  The running pass is materialised once; every row
    then offers its value to the rows one before / after it and its running sums to the row k
    after it, one shuffle on (key, row number) - balanced by both columns - gives lag, lead and
    the moving frame; the range frame [ts - range, ts] (peers included) is the running sum at the
    last peer minus the running sum before ``ts - range`` (an as-of lookup, also skew-safe).
    """
    order = [ts, *(tiebreak or [])]
    v = F.col(value)
    # one pass gives the slices of both running passes, which are over the same times, and the sizes of the values
    bounds, found = slice_bounds(df, order, slices, {"limbs": limbs_of(v)} if isinstance(df.schema[value].dataType, FLOATS) else None)
    parts = {**exact_split(df, v, limbs=found.get("limbs"))(v), "n": v.isNotNull().cast("bigint")}
    r = running(df, by, order, sums={"_pos": F.lit(1).cast("bigint"), **{f"_{n}": c for n, c in parts.items()}}, slices=slices, bounds=bounds)
    # the running pass feeds several lookups: materialise it once in the shared folder
    r = r.withColumn("_st", F.struct(*[F.col(f"_{n}").alias(n) for n in parts])).drop(*[f"_{n}" for n in parts])
    r = cut_lineage(r, "analytic")
    stype = r.schema["_st"].dataType

    def frame(upto: str, before: str | None = None) -> tuple[Column, Column]:
        """(sum as a double, number of values) between two running states."""
        d = {n: F.col(f"{upto}.{n}") if before is None
             else F.col(f"{upto}.{n}") - F.coalesce(F.col(f"{before}.{n}"), F.col(f"{upto}.{n}") - F.col(f"{upto}.{n}")) for n in parts}
        return F.when(d["n"] > 0, whole(d)), d["n"]

    k = int(moving_rows)
    # lag, lead and the row k back, in one shuffle: each row offers itself to its neighbours
    vtype = df.schema[value].dataType
    offers = r.select(*by, F.explode(F.array(
        F.struct((F.col("_pos") + 1).alias("_at"), F.lit(0).alias("_role"), F.col(value).alias("_v"),
                 F.lit(None).cast(stype).alias("_sk")),
        F.struct((F.col("_pos") - 1).alias("_at"), F.lit(1).alias("_role"), F.col(value).alias("_v"),
                 F.lit(None).cast(stype).alias("_sk")),
        F.struct((F.col("_pos") + k).alias("_at"), F.lit(2).alias("_role"), F.lit(None).cast(vtype).alias("_v"),
                 F.col("_st").alias("_sk")))).alias("_o"))
    nb = offers.groupBy(*by, F.col("_o._at").alias("_pos")).agg(
        F.max(F.when(F.col("_o._role") == 0, F.col("_o._v"))).alias("_prev"),
        F.max(F.when(F.col("_o._role") == 1, F.col("_o._v"))).alias("_next"),
        F.max(F.col("_o._sk")).alias("_st_k"))
    j = _left_null_safe(r, nb, [*by, "_pos"])
    prev_v, next_v = F.col("_prev").alias("prev_value"), F.col("_next").alias("next_value")
    mov_s, mov_n = frame("_st", "_st_k")
    # range frame: running sum at the last peer of ts ...
    peer = r.groupBy(*by, ts).agg(F.max_by("_st", "_pos").alias("_st_peer"))
    # ... minus the running sum of the rows strictly before ts - range (as-of on the merged stream)
    probe = r.select(*by, ts).distinct().select(
        *by, F.col(ts).alias("_t"), (F.col(ts).cast("timestamp") - F.make_dt_interval(secs=F.lit(range_seconds))).cast(
            df.schema[ts].dataType).alias("_pt"))
    marks = r.select(*by, F.col(ts).alias("_pt"), F.lit(1).alias("_side"), F.col("_pos"), F.col("_st").alias("_sv"),
                     F.lit(None).cast(df.schema[ts].dataType).alias("_t"))
    qs = probe.select(*by, "_pt", F.lit(0).alias("_side"), F.lit(None).cast("bigint").alias("_pos"),
                      F.lit(None).cast(stype).alias("_sv"), "_t")
    asof = running(qs.unionByName(marks), by, [F.col("_pt"), F.col("_side"), F.col("_pos")],
                   lasts={"_st_before": F.col("_sv")}, slices=slices, bounds=bounds).where(F.col("_side") == 0) \
        .select(*by, F.col("_t").alias(ts), "_st_before")
    rng = _left_null_safe(peer, asof, [*by, ts]).select(
        *by, ts, frame("_st_peer", "_st_before")[0].alias("_range"))
    j = _left_null_safe(j, rng, [*by, ts])
    return j.select(*df.columns, prev_v, next_v, frame("_st")[0].alias("running_sum"),
                    (mov_s / mov_n).alias("moving_avg"), F.col("_range").alias("range_sum"))


def time_buckets(df: DataFrame, ts: str, unit: str = "hour", by: list[str] | None = None) -> DataFrame:
    """Counts per date_trunc bucket."""
    return df.groupBy(F.date_trunc(unit, F.col(ts)).cast(df.schema[ts].dataType).alias("bucket"), *(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
