"""Named metric, alert and analysis queries (M1-M12, A2, A3, J1-J4) with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators import alerts as al
from tidepool.operators import analysis as an
from tidepool.operators import metrics as me
from tidepool.operators.relational import broadcast_if_small
from tidepool.plans import fixtures as fx
from tidepool.plans.q_ingest import RAW_SQL
from tidepool.session import load

HIST_BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0)


def m1_counter(spark, sf):
    p = fx.metric_points(spark, sf)
    return me.counter(p, ["name"], "value").withColumn("sum", F.round("sum", 2))


M1_SQL = "SELECT event_type AS name, COUNT(*) AS count, round(sum(value), 2) AS sum FROM events GROUP BY 1"

# Gauge operations given to event types in the gauge fixture.
GAUGE_OPS = {"signup": "set", "view": "add", "click": "inc", "purchase": "sub", "error": "dec"}


def m2_gauge(spark, sf):
    e = load(spark, sf, "events")
    op = F.create_map(*[x for k, v in GAUGE_OPS.items() for x in (F.lit(k), F.lit(v))])[F.col("event_type")]
    g = me.gauge(e.withColumn("op", op), ["user_id"], "ts", "op", "value", tiebreak=["event_id"])
    return g.select("user_id", "event_id", F.round("gauge_value", 4).alias("gauge_value"))


M2_SQL = """WITH g AS (SELECT user_id, event_id, ts, value, event_type,
  CASE event_type WHEN 'click' THEN 1.0 WHEN 'error' THEN -1.0 WHEN 'view' THEN value WHEN 'purchase' THEN -value ELSE 0.0 END AS d
  FROM events),
r AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g),
b AS (SELECT *, CASE WHEN event_type = 'signup' THEN value - run END AS base FROM r)
SELECT user_id, event_id, round(coalesce(last_value(base IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) + run, 4) AS gauge_value FROM b"""


def _hist_sql(value_expr: str, src: str, bounds, label: str, where: str = "TRUE") -> str:
    cols = " UNION ALL ".join(
        f"SELECT {label}, '{float(b)}' AS le, CAST(count_if(v <= {float(b)}) AS BIGINT) AS bucket_count, round(sum(v), 2) AS sum, COUNT(v) AS count "
        f"FROM x GROUP BY {label}" for b in bounds)
    inf = f"SELECT {label}, '+Inf' AS le, COUNT(v) AS bucket_count, round(sum(v), 2) AS sum, COUNT(v) AS count FROM x GROUP BY {label}"
    return f"WITH {src}, x AS (SELECT {label}, {value_expr} AS v FROM base WHERE {where}) {cols} UNION ALL {inf}"


def m3_histogram(spark, sf):
    h = me.histogram(fx.metric_points(spark, sf), "value", HIST_BOUNDS, ["name"])
    return h.withColumn("sum", F.round("sum", 2))


M3_SQL = _hist_sql("value", "base AS (SELECT event_type AS name, value FROM events)", HIST_BOUNDS, "name")


def m4_summary_exact(spark, sf):
    s = me.summary(fx.metric_points(spark, sf), "value", labels=["name"], exact=True)
    return s.select("name", "quantile", F.round("value", 6).alias("value"), F.round("sum", 2).alias("sum"), "count")


M4_SQL = """SELECT name, CAST(q AS DOUBLE) AS quantile, round(CASE q WHEN 0.5 THEN q50 WHEN 0.9 THEN q90 ELSE q99 END, 6) AS value, sum, count FROM
(SELECT event_type AS name, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.9) AS q90, quantile_cont(value, 0.99) AS q99,
 round(sum(value), 2) AS sum, COUNT(value) AS count FROM events GROUP BY 1), (SELECT unnest([0.5, 0.9, 0.99]) AS q)"""


def m4_summary_approx(spark, sf):
    """M4 default (approximate): whether each estimate's rank lies within the stated error."""
    p = fx.metric_points(spark, sf)
    # one row per label set and quantile
    est = me.summary(p, "value", labels=["name"]).select(F.col("name").alias("_name"), "quantile", F.col("value").alias("est"))
    v, n = F.col("value"), F.count("value")
    err = F.create_map(*[F.lit(float(x)) for kv in me.DEFAULT_OBJECTIVES.items() for x in kv])[F.col("quantile")]
    ranks = p.join(broadcast_if_small(est), F.col("name") == F.col("_name")).groupBy("name", "quantile").agg(
        (F.count_if(v < F.col("est")) / n).alias("lo"), (F.count_if(v <= F.col("est")) / n).alias("hi"), n.alias("count"))
    return ranks.select("name", "quantile", ((F.col("lo") <= F.col("quantile") + err) & (F.col("hi") >= F.col("quantile") - err)).alias(
        "within_error"), "count")


M4_APPROX_SQL = """SELECT event_type AS name, CAST(unnest([0.5, 0.9, 0.99]) AS DOUBLE) AS quantile, TRUE AS within_error,
COUNT(value) AS count FROM events GROUP BY event_type"""


def m5_sliding_summary(spark, sf):
    s = me.sliding_summary(fx.metric_points(spark, sf), "value", "ts", "1 day", "12 hours",
                           objectives={0.5: 0.05}, labels=["name"], exact=True)
    return s.select("window_start", "name", F.round("value", 6).alias("p50"), "count")


M5_SQL = """SELECT w AS window_start, name, round(quantile_cont(value, 0.5), 6) AS p50, COUNT(value) AS count FROM
(SELECT event_type AS name, value, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS w
 FROM events) GROUP BY w, name"""


def m6_ingestion_lag(spark, sf):
    h = me.ingestion_lag(fx.raw_events(spark, sf), labels=["data_type"])
    return h.withColumn("sum", F.round("sum", 2))


M6_SQL = _hist_sql("epoch_us(received_at) / 1e6 - epoch_us(ts) / 1e6",
                   RAW_SQL.replace("raw AS (", "base AS (", 1), me.lag_bounds(), "data_type", "ts IS NOT NULL")


def m7_metrics_query(spark, sf):
    q = me.metrics_query(fx.metric_points(spark, sf), names=["click", "view"], labels={"user": "7"},
                         time_range=("2024-01-03 00:00:00", "2024-01-25 00:00:00"))
    return q.select("name", "user", "ts", "value")


M7_SQL = """SELECT event_type AS name, CAST(user_id AS VARCHAR) AS user, ts, value FROM events
WHERE event_type IN ('click', 'view') AND CAST(user_id AS VARCHAR) = '7'
AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts < TIMESTAMP '2024-01-25 00:00:00'"""


def m8_latest_status(spark, sf):
    s = me.latest_status(fx.status_history(spark, sf), ctype="user", tiebreak="event_id")
    return s.select("component_name", "status", "checked_at")


M8_SQL = """SELECT CAST(user_id AS VARCHAR) AS component_name, arg_max(event_type, (ts, event_id)) AS status,
max(ts) AS checked_at FROM events GROUP BY user_id"""


def m9_slow_top(spark, sf):
    top, _ = me.slow_queries(fx.query_log(spark, sf), 100.0, 20)
    return top.select("query_id", "group_name", "duration_s")


M9_TOP_SQL = "SELECT event_id AS query_id, event_type AS group_name, value AS duration_s FROM events WHERE value > 100.0 ORDER BY value DESC, event_id LIMIT 20"


def m9_slow_groups(spark, sf):
    _, per = me.slow_queries(fx.query_log(spark, sf), 100.0, 20, exact=True)
    return per.select("group_name", "slow_count", F.round("p95_duration", 6).alias("p95_duration"), "scan_rows")


M9_GROUPS_SQL = """SELECT event_type AS group_name, COUNT(*) AS slow_count, round(quantile_cont(value, 0.95), 6) AS p95_duration,
CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS scan_rows FROM events WHERE value > 100.0 GROUP BY 1"""


def _limits(spark):
    """Workload-group configuration (one row per group)."""
    return spark.createDataFrame([("click", 3), ("view", 3), ("error", 2), ("purchase", 2), ("signup", 2)],
                                 "group_name string, concurrency_limit int")


LIMITS_SQL = "(VALUES ('click', 3), ('view', 3), ('error', 2), ('purchase', 2), ('signup', 2)) AS l(group_name, concurrency_limit)"


def m10_group_concurrency(spark, sf):
    c = me.group_concurrency(fx.query_log(spark, sf), _limits(spark))
    return c.select("group_name", "query_id", "delta", "at_ts", "running", "queued")


M10_SQL = f"""WITH ev AS (
  SELECT event_type AS group_name, ts AS at_ts, 1 AS delta, event_id AS query_id FROM events
  UNION ALL SELECT event_type, ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)), -1, event_id FROM events),
r AS (SELECT *, sum(delta) OVER (PARTITION BY group_name ORDER BY at_ts, delta, query_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM ev)
SELECT r.group_name, query_id, delta, at_ts, CAST(running AS BIGINT) AS running,
       CAST(greatest(running - concurrency_limit, 0) AS BIGINT) AS queued FROM r LEFT JOIN {LIMITS_SQL} USING (group_name)"""


def _groups(spark):
    """Workload-group definitions, two of them invalid on purpose."""
    return spark.createDataFrame(
        [("click", 40, "10G"), ("view", 30, "20%"), ("error", 10, "512M"), ("purchase", 20, "1T"), ("signup", 0, "1G"),
         ("", 10, "1G"), ("batch", 5, None)],
        "name string, cpu_share int, memory_limit string")


def m11_group_share(spark, sf):
    s = me.group_share(fx.query_log(spark, sf), _groups(spark))
    return s.select("group_name", "memory_bytes", "memory_fraction", "invalid_reason", F.round("used_s", 2).alias("used_s"),
                    F.round("used_share", 6).alias("used_share"), F.round("entitled_share", 6).alias("entitled_share"))


M11_SQL = """WITH g AS (SELECT * FROM (VALUES ('click', 40, '10G'), ('view', 30, '20%'), ('error', 10, '512M'), ('purchase', 20, '1T'),
  ('signup', 0, '1G'), ('', 10, '1G'), ('batch', 5, NULL)) AS g(name, cpu_share, memory_limit)),
u AS (SELECT event_type AS group_name, sum(value) AS used_s FROM events GROUP BY 1),
j AS (SELECT g.name AS group_name, cpu_share, memory_limit,
  CASE WHEN memory_limit LIKE '%G' THEN CAST(rtrim(memory_limit, 'G') AS DOUBLE) * 1024 * 1024 * 1024
       WHEN memory_limit LIKE '%M' THEN CAST(rtrim(memory_limit, 'M') AS DOUBLE) * 1024 * 1024
       WHEN memory_limit LIKE '%T' THEN CAST(rtrim(memory_limit, 'T') AS DOUBLE) * 1024 * 1024 * 1024 * 1024 END AS memory_bytes,
  CASE WHEN memory_limit LIKE '%\\%' ESCAPE '\\' THEN CAST(rtrim(memory_limit, '%') AS DOUBLE) / 100 END AS memory_fraction,
  CASE WHEN g.name IS NULL OR trim(g.name) = '' THEN 'no name' WHEN cpu_share IS NULL OR cpu_share <= 0 THEN 'cpu_share <= 0'
       WHEN memory_limit IS NULL OR trim(memory_limit) = '' THEN 'no memory limit' END AS invalid_reason,
  coalesce(u.used_s, 0.0) AS used_s FROM g LEFT JOIN u ON g.name = u.group_name)
SELECT group_name, memory_bytes, memory_fraction, invalid_reason, round(used_s, 2) AS used_s,
  round(used_s / sum(used_s) OVER (), 6) AS used_share,
  round(CASE WHEN invalid_reason IS NULL THEN cpu_share / sum(CASE WHEN invalid_reason IS NULL THEN cpu_share END) OVER () END, 6) AS entitled_share
FROM j"""


def m12_audit_timeline(spark, sf):
    t = me.audit_timeline(fx.status_history(spark, sf), "component_name", "checked_at", ["event_id"])
    return t.select("component_name", "event_id", "status", F.round("since_prev_s", 6).alias("since_prev_s"))


M12_SQL = """SELECT CAST(user_id AS VARCHAR) AS component_name, event_id, event_type AS status,
round(epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6, 6) AS since_prev_s FROM events"""

# The alert rules of the alert fixture.
RULES = [
    {"rule_id": "r1", "name": "views high", "metric": "view", "expression": "value > 40", "for_duration_s": 7200, "severity": "warning"},
    {"rule_id": "r2", "name": "errors high", "metric": "error", "expression": "value > 60", "for_duration_s": 0, "severity": "critical"},
    {"rule_id": "r3", "name": "clicks high", "metric": "click", "expression": "value > 30", "for_duration_s": 10800, "severity": "info"},
    {"rule_id": "r4", "name": "", "metric": "click", "expression": "value > 1", "for_duration_s": 0, "severity": "info"},
]


def a2_alerts(spark, sf):
    series = al.sample_series(fx.metric_points(spark, sf), "1 hour")
    a = al.evaluate_alerts(series, RULES, 3600)
    return a.select("rule_id", "active_at", "resolved_at", F.round("value", 6).alias("value"), "state")


def _alerts_sql(label: str = "", source: str = "", as_of: bool = False) -> str:
    rules = " UNION ALL ".join(
        f"SELECT '{r['rule_id']}' AS rule_id, {r['for_duration_s']} AS for_s, ts{label}, value, coalesce({r['expression']}, false) AS cond "
        f"FROM s WHERE metric = '{r['metric']}'" for r in RULES if r["name"])
    over = " OR last_us + 3600000000 < (SELECT max(epoch_us(ts)) FROM s)" if as_of else ""
    return f"""WITH s AS (SELECT event_type AS metric, date_trunc('hour', ts) AS ts{source}, avg(value) AS value FROM events GROUP BY ALL),
r AS ({rules}),
f AS (SELECT *, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER w AS prev_us, lag(cond) OVER w AS prev_c,
      lead(epoch_us(ts)) OVER w AS next_us FROM r WINDOW w AS (PARTITION BY rule_id{label} ORDER BY ts)),
g AS (SELECT *, sum(CASE WHEN cond AND (prev_c IS NULL OR NOT prev_c OR us - prev_us > 3600000000) THEN 1 ELSE 0 END)
      OVER (PARTITION BY rule_id{label} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f),
i AS (SELECT rule_id{label}, island, min(ts) AS active_at, max(us) AS last_us, min(us) AS first_us, arg_max(value, ts) AS value,
      arg_max_null(next_us, ts) AS next_us, any_value(for_s) AS for_s FROM g WHERE cond GROUP BY rule_id{label}, island),
st AS (SELECT *, next_us IS NOT NULL{over} AS ended, last_us - first_us >= CAST(for_s AS BIGINT) * 1000000 AS lasted FROM i)
SELECT rule_id{label}, active_at,
  CASE WHEN ended AND lasted THEN make_timestamp(CASE WHEN next_us - last_us <= 3600000000 THEN next_us ELSE last_us + 3600000000 END) END AS resolved_at,
  round(value, 6) AS value, CASE WHEN ended THEN 'RESOLVED' WHEN lasted THEN 'FIRING' ELSE 'PENDING' END AS state
FROM st WHERE lasted OR NOT ended"""


A2_SQL = _alerts_sql()


def a3_active_alerts(spark, sf):
    series = al.sample_series(fx.metric_points(spark, sf), "1 hour")
    a = al.evaluate_alerts(series, RULES, 3600)
    return al.active_alerts(a, 1, 10, [("active_at", "DESC"), ("rule_id", "ASC")]).select("rule_id", "active_at", "state")


A3_SQL = f"SELECT rule_id, active_at, state FROM ({A2_SQL}) WHERE state IN ('FIRING', 'PENDING') ORDER BY active_at DESC, rule_id LIMIT 10"


def j1_historical_scan(spark, sf):
    li = load(spark, sf, "lineitem")
    return an.historical_scan(li, "l_shipdate", ("1995-01-01", "1999-01-01"), ["l_returnflag"],
                              [F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue")],
                              where=F.col("l_discount") > 0.05)


J1_SQL = """SELECT l_returnflag, COUNT(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' AND l_discount > 0.05 GROUP BY 1"""


def j2_correlation(spark, sf):
    c = an.correlation_analysis(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag"])
    return c.withColumn("corr", F.round("corr", 6))


J2_SQL = """SELECT l_returnflag, col_a, col_b, round(c, 6) AS corr FROM (
 SELECT l_returnflag, 'l_quantity' AS col_a, 'l_extendedprice' AS col_b, corr(l_quantity, l_extendedprice) AS c FROM lineitem GROUP BY 1
 UNION ALL SELECT l_returnflag, 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem GROUP BY 1
 UNION ALL SELECT l_returnflag, 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem GROUP BY 1)"""


def j2_cooccurrence(spark, sf):
    return an.cooccurrence(load(spark, sf, "events"), "user_id", "ts", "event_type")


J2_CO_SQL = """WITH d AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS w, event_type FROM events)
SELECT a.event_type AS kind_a, b.event_type AS kind_b, COUNT(*) AS windows FROM d a JOIN d b
ON a.user_id = b.user_id AND a.w = b.w AND a.event_type < b.event_type GROUP BY 1, 2"""


# Fixed value: the support of the pairs.
MIN_WINDOWS = 12


def j2_cooccurrence_support(spark, sf):
    """J2 with a support: users that act on the same kind of event on the same days, often enough."""
    return an.cooccurrence(load(spark, sf, "events"), "event_type", "ts", "user_id", "1 day", MIN_WINDOWS)


J2_SUPPORT_SQL = f"""WITH d AS (SELECT DISTINCT event_type, date_trunc('day', ts) AS w, user_id FROM events)
SELECT a.user_id AS kind_a, b.user_id AS kind_b, COUNT(*) AS windows FROM d a JOIN d b
ON a.event_type = b.event_type AND a.w = b.w AND a.user_id < b.user_id GROUP BY 1, 2 HAVING COUNT(*) >= {MIN_WINDOWS}"""


def j3_trend(spark, sf):
    o = load(spark, sf, "orders")
    x = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(86400e6))
    t = an.trend_fit(o, x, "o_totalprice", ["o_orderpriority"])
    return t.select("o_orderpriority", F.round("slope", 4).alias("slope"), F.round("r2", 8).alias("r2"), "points")


J3_SQL = """SELECT o_orderpriority, round(regr_slope(o_totalprice, epoch_us(o_orderdate) / 86400e6), 4) AS slope,
round(regr_r2(o_totalprice, epoch_us(o_orderdate) / 86400e6), 8) AS r2,
CAST(regr_count(o_totalprice, epoch_us(o_orderdate) / 86400e6) AS BIGINT) AS points FROM orders GROUP BY 1"""


def j4_task_history(spark, sf):
    h = an.task_history(fx.task_transitions(spark, sf))
    return h.select("task_id", "last_state", "events", "illegal_transitions", F.round("queue_s", 3).alias("queue_s"),
                    F.round("run_s", 3).alias("run_s"))


J4_SQL = """WITH t AS (SELECT user_id AS task_id, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'RUNNING'
  WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'CANCELLED' END AS state, ts, event_id FROM events),
f AS (SELECT task_id, arg_max(state, (ts, event_id)) AS last_state, min(CASE WHEN state = 'PENDING' THEN ts END) AS fp,
  min(CASE WHEN state = 'RUNNING' THEN ts END) AS fr, COUNT(*) AS events,
  arg_min((ts, event_id), (ts, event_id)) FILTER (WHERE state IN ('SUCCESS', 'FAILED', 'CANCELLED')) AS ft FROM t GROUP BY 1),
a AS (SELECT t.task_id, COUNT(*) AS n FROM t JOIN f USING (task_id) WHERE f.ft IS NOT NULL AND (t.ts > f.ft[1] OR (t.ts = f.ft[1] AND t.event_id > f.ft[2])) GROUP BY 1)
SELECT task_id, last_state, events, CAST(coalesce(a.n, 0) AS BIGINT) AS illegal_transitions,
  round(epoch_us(fr) / 1e6 - epoch_us(fp) / 1e6, 3) AS queue_s, round(epoch_us(ft[1]) / 1e6 - epoch_us(fr) / 1e6, 3) AS run_s
FROM f LEFT JOIN a USING (task_id)"""


QUERIES = {
    "m1_counter": (m1_counter, M1_SQL),
    "m2_gauge": (m2_gauge, M2_SQL),
    "m3_histogram": (m3_histogram, M3_SQL),
    "m4_summary_exact": (m4_summary_exact, M4_SQL),
    "m4_summary_approx": (m4_summary_approx, M4_APPROX_SQL),
    "m5_sliding_summary": (m5_sliding_summary, M5_SQL),
    "m6_ingestion_lag": (m6_ingestion_lag, M6_SQL),
    "m7_metrics_query": (m7_metrics_query, M7_SQL),
    "m8_latest_status": (m8_latest_status, M8_SQL),
    "m9_slow_top": (m9_slow_top, M9_TOP_SQL),
    "m9_slow_groups": (m9_slow_groups, M9_GROUPS_SQL),
    "m10_group_concurrency": (m10_group_concurrency, M10_SQL),
    "m11_group_share": (m11_group_share, M11_SQL),
    "m12_audit_timeline": (m12_audit_timeline, M12_SQL),
    "a2_alerts": (a2_alerts, A2_SQL),
    "a3_active_alerts": (a3_active_alerts, A3_SQL),
    "j1_historical_scan": (j1_historical_scan, J1_SQL),
    "j2_correlation": (j2_correlation, J2_SQL),
    "j2_cooccurrence": (j2_cooccurrence, J2_CO_SQL),
    "j2_cooccurrence_support": (j2_cooccurrence_support, J2_SUPPORT_SQL),
    "j3_trend": (j3_trend, J3_SQL),
    "j4_task_history": (j4_task_history, J4_SQL),
}
