"""Metric and observability tables (M1-M12) computed from fact tables.

Counters, histograms and summaries are single aggregates (map-side partial aggregation);
gauges, concurrency and timelines use the skew-safe running windows of ``running``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators.relational import FLOATS, broadcast_if_small
from tidepool.operators.running import exact_split, limbs_of, running, slice_bounds, whole
from tidepool.session import cut_lineage

# Default latency bucket bounds in seconds (the usual client-library default).
DEFAULT_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
# Default summary objectives, quantile -> allowed error.
DEFAULT_OBJECTIVES = {0.5: 0.05, 0.9: 0.01, 0.99: 0.001}
# Ingestion-lag buckets are 0.1 * 2**i seconds for i = 0..14 (0.1 ... 1638.4).
LAG_BUCKET_START = 0.1
LAG_BUCKET_FACTOR = 2.0
LAG_BUCKET_COUNT = 15


def lag_bounds() -> tuple[float, ...]:
    return tuple(LAG_BUCKET_START * LAG_BUCKET_FACTOR ** i for i in range(LAG_BUCKET_COUNT))


def counter(df: DataFrame, labels: list[str], value: str | None = None) -> DataFrame:
    """M1: count (and sum of ``value``, if given) per label set."""
    sums = [] if value is None else [F.sum(value).alias("sum")]
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("count"), *sums)


def gauge(df: DataFrame, keys: list[str], ts: str, op: str, amount: str, tiebreak: list[str] | None = None) -> DataFrame:
    """M2: value over time of a gauge driven by set / inc / dec / add / sub operations.

    value(row) = amount of the latest ``set`` + the sum of the deltas since it (0 before
    any set).  Both parts are skew-safe running windows over ``exact_split``, so the difference
    of running sums stays exact on long series and a NaN or infinity counts until the next ``set``.
    """
    o = F.lower(F.col(op))
    v = F.col(amount)
    order = [F.col(ts), *[F.col(c) for c in (tiebreak or [])]]
    # one pass gives the slices of both running passes and the sizes of the amounts
    bounds, found = slice_bounds(df, order, None, {"limbs": limbs_of(v)} if isinstance(df.schema[amount].dataType, FLOATS) else None)
    split = exact_split(df, v, also=(1.0,), limbs=found.get("limbs"))
    one = F.lit(1).cast(df.schema[amount].dataType)
    delta = F.when(o == "inc", one).when(o == "dec", -one).when(o == "add", v).when(o == "sub", -v).otherwise(one - one)
    amounts, deltas = split(v), split(delta)
    r = df
    for name in amounts:
        r = r.withColumn(f"_d_{name}", deltas[name]).withColumn(f"_a_{name}", amounts[name])
    sums = {f"_run_{name}": F.col(f"_d_{name}") for name in amounts}
    r = running(r, keys, order, sums=sums, bounds=bounds)
    # at a set row the base is amount - run(at the set); carried forward as "last non-null"
    # the second pass reads the first one three times (slice bounds, summary, window):
    # materialise it once in the shared folder instead of recomputing it
    base = F.struct(*[(F.col(f"_a_{n}") - F.col(f"_run_{n}")).alias(n) for n in amounts])
    r = cut_lineage(r.withColumn("_base", F.when(o == "set", base)), "gauge")
    r = running(r, keys, order, lasts={"_last_base": F.col("_base")}, bounds=bounds)
    value = whole({n: F.coalesce(F.col(f"_last_base.{n}"), F.col(f"_run_{n}") - F.col(f"_run_{n}")) + F.col(f"_run_{n}")
                   for n in amounts})
    return r.withColumn("gauge_value", value).drop("_base", "_last_base", *[f"_{k}_{n}" for n in amounts for k in ("d", "a", "run")])


def histogram(df: DataFrame, col: str, bounds=DEFAULT_BOUNDS, labels: list[str] | None = None) -> DataFrame:
    """M3: cumulative ``le`` buckets plus ``+Inf``, with sum and count, in one aggregate."""
    v = F.col(col)
    aggs = [F.count_if(v <= F.lit(float(b))).alias(f"_le{i}") for i, b in enumerate(bounds)]
    aggs += [F.count(v).alias("_inf"), F.sum(v).alias("sum"), F.count(v).alias("count")]
    wide = df.groupBy(*(labels or [])).agg(*aggs)
    pairs = [F.struct(F.lit(str(float(b))).alias("le"), F.col(f"_le{i}").alias("n")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.col("_inf").alias("n")))
    return wide.select(*(labels or []), "sum", "count", F.explode(F.array(*pairs)).alias("_p")).select(
        *(labels or []), F.col("_p.le").alias("le"), F.col("_p.n").alias("bucket_count"), "sum", "count")


def _same_labels(labels: list[str], left: str, right: str):
    """Null-safe equality of the label columns of two aliased frames (true when there are none)."""
    cond = F.lit(True)
    for x in labels:
        cond = cond & F.col(f"{left}.{x}").eqNullSafe(F.col(f"{right}.{x}"))
    return cond


def exact_quantiles(df: DataFrame, value, labels: list[str], quantiles: list[float]) -> DataFrame:
    """(labels, _q0, _q1, ...): exact interpolated quantiles of the non-null doubles ``value`` per
    label set; NaN is the greatest value.

    Values are counted per label set before anything is ordered, a sliced running count gives each
    value its ranks, and the two neighbours of each quantile are picked by an aggregate, so no task
    ever holds the values of a label set.  A label set without a value gives no row."""
    counts = cut_lineage(df.select(*labels, value.alias("_v")).where("_v IS NOT NULL").groupBy(*labels, "_v").agg(
        F.count(F.lit(1)).alias("_c")), "value-counts")
    upto = running(counts, labels, ["_v"], sums={"_cum": F.col("_c")})
    total = counts.groupBy(*labels).agg(F.sum("_c").alias("_n"))
    total = total if labels else F.broadcast(total)  # without labels: one row
    ranked = upto.alias("l").join(total.alias("r"), _same_labels(labels, "l", "r")).select("l.*", "r._n")
    at = [F.lit(float(q)) * (F.col("_n") - 1) for q in quantiles]
    first = [F.min(F.when(F.col("_cum") > side(p), F.col("_v"))) for p in at for side in (F.floor, F.ceil)]
    near = ranked.groupBy(*labels, "_n").agg(*[c.alias(f"_e{i}") for i, c in enumerate(first)])
    out = []
    for i, p in enumerate(at):
        lo, hi = F.col(f"_e{2 * i}"), F.col(f"_e{2 * i + 1}")
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi).alias(f"_q{i}"))
    return near.select(*labels, *out)


def _with_quantiles(wide: DataFrame, df: DataFrame, value, labels: list[str], quantiles: list[float]) -> DataFrame:
    found = exact_quantiles(df, value, labels, quantiles)
    found = found if labels else F.broadcast(found)  # without labels: one row
    return wide.alias("l").join(found.alias("r"), _same_labels(labels, "l", "r"), "left").select(
        "l.*", *[f"r._q{i}" for i in range(len(quantiles))])


def summary(df: DataFrame, col: str, objectives=None, labels: list[str] | None = None, exact: bool = False) -> DataFrame:
    """M4: quantiles per label set; approximate with accuracy ceil(1/err), or exact."""
    objectives = objectives or DEFAULT_OBJECTIVES
    v = F.col(col).cast("double")
    goals = sorted(objectives.items())
    aggs = [] if exact else [F.percentile_approx(v, float(q), int(-(-1 // err))).alias(f"_q{i}")
                             for i, (q, err) in enumerate(goals)]
    wide = df.groupBy(*(labels or [])).agg(*aggs, F.sum(v).alias("sum"), F.count(v).alias("count"))
    if exact:
        wide = _with_quantiles(wide, df, v, labels or [], [q for q, _e in goals])
    pairs = [F.struct(F.lit(float(q)).alias("quantile"), F.col(f"_q{i}").cast("double").alias("value"))
             for i, (q, _e) in enumerate(goals)]
    return wide.select(*(labels or []), "sum", "count", F.explode(F.array(*pairs)).alias("_p")).select(
        *(labels or []), F.col("_p.quantile").alias("quantile"), F.col("_p.value").alias("value"), "sum", "count")


def sketch_size(objectives: dict | None = None) -> int:
    """The k of a KLL sketch whose rank error is below the least of the objectives' (its published
    bound for one quantile at 99%: 2.296 / k ** 0.9021)."""
    least = min((objectives or DEFAULT_OBJECTIVES).values())
    return int(min(65_535, max(8, math.ceil((2.296 / least) ** (1 / 0.9021)))))


def sketch_states(df: DataFrame, col: str, labels: list[str] | None = None, objectives: dict | None = None) -> DataFrame:
    """M4 as mergeable states: (labels, sketch, sum, count) with a quantile sketch of the non-null doubles per label set.
    Its size is bounded by the objectives, not by the rows; NaN and NULL have no rank and are left out."""
    v = F.col(col).cast("double")
    v = F.when(~F.isnan(v), v)
    return df.groupBy(*(labels or [])).agg(
        F.call_function("kll_sketch_agg_double", v, F.lit(sketch_size(objectives))).alias("sketch"), F.sum(v).alias("sum"), F.count(v).alias("count"))


def merge_sketches(states: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """The states of parts of the rows (of tasks, days, batches) as one state per label set."""
    return states.groupBy(*(labels or [])).agg(
        F.call_function("kll_merge_agg_double", F.col("sketch")).alias("sketch"), F.sum("sum").alias("sum"), F.sum("count").alias("count"))


def sketch_quantiles(states: DataFrame, labels: list[str] | None = None, objectives: dict | None = None) -> DataFrame:
    """(labels, quantile, value, sum, count) of states; a label set without a value has null values."""
    goals = sorted((objectives or DEFAULT_OBJECTIVES))
    at = lambda q: F.when(F.col("count") > 0, F.call_function("kll_sketch_get_quantile_double", F.col("sketch"), F.lit(float(q))))
    pairs = F.array(*[F.struct(F.lit(float(q)).alias("quantile"), at(q).alias("value")) for q in goals])
    return states.select(*(labels or []), "sum", "count", F.explode(pairs).alias("_p")).select(
        *(labels or []), F.col("_p.quantile").alias("quantile"), F.col("_p.value").alias("value"), "sum", "count")


def sliding_summary(df: DataFrame, col: str, ts: str, length: str, step: str, objectives=None,
                    labels: list[str] | None = None, exact: bool = False) -> DataFrame:
    """M5: M4 over a sliding time window ``window(ts, length, step)``."""
    w = df.withColumn("_w", F.window(F.col(ts), length, step))
    s = summary(w.withColumn("window_start", F.col("_w.start").cast("timestamp_ntz")), col, objectives,
                ["window_start", *(labels or [])], exact)
    return s


def ingestion_lag(df: DataFrame, received: str = "received_at", ts: str = "ts", labels: list[str] | None = None) -> DataFrame:
    """M6: histogram of processing time minus event time, in seconds (0.1 * 2**i buckets)."""
    lag = (F.unix_micros(F.col(received).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / F.lit(1e6)
    return histogram(df.withColumn("lag_s", lag).where(F.col("lag_s").isNotNull()), "lag_s", lag_bounds(), labels)


def metrics_query(df: DataFrame, names=None, labels: dict | None = None, time_range=None, ts: str = "ts",
                  name_col: str = "name", label_cols: dict | None = None) -> DataFrame:
    """M7: AND of name list, label equalities and a half-open time range."""
    pred = F.lit(True)
    if names:
        pred = pred & F.col(name_col).isin(list(names))
    for k, v in (labels or {}).items():
        col = (label_cols or {}).get(k, k)
        pred = pred & (F.col(col) == F.lit(v))
    if time_range:
        start, end = time_range
        if start is not None:
            pred = pred & (F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
        if end is not None:
            pred = pred & (F.col(ts) < F.lit(end).cast("timestamp_ntz"))
    return df.where(pred)


def latest_status(df: DataFrame, name: str | None = None, ctype: str | None = None, name_col="component_name",
                  type_col="component_type", ts="checked_at", tiebreak: str | None = None) -> DataFrame:
    """M8: the latest status row per component; a given name wins over the type filter."""
    src = df
    if name is not None:
        src = src.where(F.col(name_col) == F.lit(name))
    elif ctype is not None:
        src = src.where(F.col(type_col) == F.lit(ctype))
    others = [c for c in df.columns if c != name_col]
    order = F.struct(F.col(ts), *([F.col(tiebreak)] if tiebreak else []))
    return src.groupBy(name_col).agg(F.max_by(F.struct(*[F.col(c) for c in others]), order).alias("_r")) \
        .select(name_col, *[F.col("_r")[c].alias(c) for c in others])


def require_component(df: DataFrame, name: str) -> None:
    """M8: a named but missing component is an error (a one-row existence probe)."""
    if df.limit(1).count() == 0:
        raise LookupError(f"component {name!r} not found")


def slow_queries(log: DataFrame, threshold: float, k: int, duration="duration_s", group="group_name",
                 qid="query_id", scan="scan_rows", exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """M9: (top-k slowest above the threshold, per-group p95 / count / scan volume of slow queries).
    The p95 is approximate (bounded sketch) unless ``exact``."""
    slow = log.where(F.col(duration) > F.lit(threshold))
    top = slow.orderBy(F.col(duration).desc(), F.col(qid)).limit(int(k))
    v = F.col(duration).cast("double")
    aggs = [] if exact else [F.percentile_approx(v, 0.95, 1000).alias("_q0")]
    per = slow.groupBy(group).agg(F.count(F.lit(1)).alias("slow_count"), F.sum(scan).alias("scan_rows"), *aggs)
    if exact:
        per = _with_quantiles(per, slow, v, [group], [0.95])
    return top, per.select(group, "slow_count", F.col("_q0").alias("p95_duration"), "scan_rows")


def group_concurrency(log: DataFrame, limits: DataFrame, group="group_name", start="start_ts", duration="duration_s",
                      qid="query_id") -> DataFrame:
    """Running queries per group over time (+1 at start, -1 at end; ends first on ties),
    with the concurrency limit and the queue length above it, at every change point."""
    end = (F.col(start).cast("timestamp") + F.make_dt_interval(secs=F.col(duration).cast("decimal(18,6)"))).cast("timestamp_ntz")
    ev = log.select(F.col(group), F.col(start).alias("at_ts"), F.lit(1).alias("delta"), F.col(qid)) \
        .unionByName(log.select(F.col(group), end.alias("at_ts"), F.lit(-1).alias("delta"), F.col(qid)))
    r = running(ev, [group], ["at_ts", "delta", qid], sums={"running": F.col("delta")})
    j = r.join(broadcast_if_small(limits), on=group, how="left")
    return j.select(group, "at_ts", "delta", qid, F.col("running").cast("bigint").alias("running"), "concurrency_limit",
                    F.greatest(F.col("running") - F.col("concurrency_limit"), F.lit(0)).cast("bigint").alias("queued"))


def parse_memory_limit(c: Column) -> tuple[Column, Column]:
    """``10G`` / ``512M`` / ``1T`` / ``1024K`` -> bytes; ``20%`` -> fraction of the node."""
    s = F.upper(F.trim(c))
    num = F.regexp_extract(s, r"^([0-9]+(\.[0-9]+)?)", 1).try_cast("double")
    unit = F.regexp_extract(s, r"^[0-9.]+\s*([KMGT]?B?|%)$", 1)
    mult = (F.when(unit.startswith("K"), F.lit(1024.0)).when(unit.startswith("M"), F.lit(1024.0 ** 2))
            .when(unit.startswith("G"), F.lit(1024.0 ** 3)).when(unit.startswith("T"), F.lit(1024.0 ** 4))
            .when(unit.isin("", "B"), F.lit(1.0)))
    is_pct = unit == "%"
    bytes_ = F.when(~is_pct & s.rlike(r"^[0-9.]+\s*([KMGT]?B?)$"), num * mult)
    frac = F.when(is_pct, num / 100.0)
    return bytes_, frac


def group_share(log: DataFrame, groups: DataFrame, group="group_name", duration="duration_s") -> DataFrame:
    """Used vs entitled CPU share per group, parsed memory limit, and validity."""
    used = log.groupBy(group).agg(F.sum(duration).alias("used_s"))
    mem_b, mem_f = parse_memory_limit(F.col("memory_limit"))
    reason = (F.when(F.col("name").isNull() | (F.trim(F.col("name")) == ""), F.lit("no name"))
              .when(F.col("cpu_share").isNull() | (F.col("cpu_share") <= 0), F.lit("cpu_share <= 0"))
              .when(F.col("memory_limit").isNull() | (F.trim(F.col("memory_limit")) == ""), F.lit("no memory limit"))
              .when(mem_b.isNull() & mem_f.isNull(), F.lit("bad memory limit")))
    g = groups.select(F.col("name").alias(group), "cpu_share", "memory_limit", mem_b.alias("memory_bytes"),
                      mem_f.alias("memory_fraction"), reason.alias("invalid_reason"))
    # one row per configured group: the groups table is bounded by the configuration, so it
    # is broadcast and the shares are taken over that small joined table
    j = F.broadcast(g).join(used, on=group, how="left").withColumn("used_s", F.coalesce(F.col("used_s"), F.lit(0.0)))
    everything = Window.partitionBy()
    tot_used = F.sum(F.col("used_s")).over(everything)
    tot_share = F.sum(F.when(F.col("invalid_reason").isNull(), F.col("cpu_share"))).over(everything)
    return j.select(group, "cpu_share", "memory_limit", "memory_bytes", "memory_fraction", "invalid_reason", "used_s",
                    (F.col("used_s") / tot_used).alias("used_share"),
                    F.when(F.col("invalid_reason").isNull(), F.col("cpu_share") / tot_share).alias("entitled_share"))


def audit_timeline(df: DataFrame, entity: str, ts: str, tiebreak: list[str] | None = None) -> DataFrame:
    """Events per entity in order with the time since the previous one (seconds)."""
    r = running(df, [entity], [ts, *(tiebreak or [])], lasts={"prev_ts": F.col(ts)}, exclusive_lasts=True)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("prev_ts").cast("timestamp"))) / F.lit(1e6)
    return r.withColumn("since_prev_s", gap)
