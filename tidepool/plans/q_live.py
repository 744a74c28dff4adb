"""Queries that run the live and stored forms end to end and read the result back, with DuckDB twins:
labelled loads, stream sinks, stream views, stream alerts, late rows, ordered delivery; and the rows
of operators that need derived text (T3) or whole documents (T11)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions import text as tx
from tidepool.operators import alerts as al
from tidepool.operators import search as se
from tidepool.operators import views as vw
from tidepool.plans import fixtures as fx
from tidepool.plans.q_index import V_SQL, VIEW_KEYS, VIEW_MEASURES, _round_view
from tidepool.plans.q_ingest import L5_SQL, RAW_SQL, REASON_SQL
from tidepool.plans.q_metrics import RULES, _alerts_sql
from tidepool.plans.q_search import KEYWORD, _tok
from tidepool.session import load, scratch_path
from tidepool.sources import ingest, loading
from tidepool.streaming import streams as st
from tidepool.streaming import timers as tm


def _fresh(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


# ---------------------------------------------------------------- loads

def l10_filter_ratio(spark, sf):
    """A load with 8% bad rows is refused at a ratio of 0.05 and taken at 0.1."""
    raw = fx.raw_events(spark, sf)
    counts = loading.load_counts(raw.withColumn(loading.REASON, ingest.reject_reason(raw))).first().asDict()
    rows = []
    for ratio in (0.05, 0.1):
        try:
            loading.check_filter_ratio(counts, ratio)
            taken = True
        except loading.LoadRejected:
            taken = False
        rows.append((ratio, counts["total_rows"], counts["filtered_rows"], taken))
    return spark.createDataFrame(rows, "max_ratio double, total_rows bigint, filtered_rows bigint, accepted boolean")


L10_SQL = f"""WITH {RAW_SQL}, c AS (SELECT COUNT(*) AS t, CAST(count_if({REASON_SQL} IS NOT NULL) AS BIGINT) AS f FROM raw)
SELECT CAST(r AS DOUBLE) AS max_ratio, t AS total_rows, f AS filtered_rows, f / t <= r AS accepted
FROM c, (SELECT unnest([0.05, 0.1]) AS r)"""


def l17_load_once(spark, sf):
    """The valid raw events loaded twice under one label, and once under another."""
    raw, root = fx.raw_events(spark, sf).drop("tags"), _fresh(spark, "l17")
    df = raw.withColumn(loading.REASON, ingest.reject_reason(raw))
    for label in ("first", "first", "second"):
        loading.load_once(df, root, label, max_filter_ratio=0.1)
    return spark.read.parquet(f"{root}/data").groupBy("data_type", F.col("_load_label").alias("label")).agg(
        F.count(F.lit(1)).alias("rows"))


L17_SQL = f"""WITH {RAW_SQL} SELECT data_type, label, COUNT(*) AS rows
FROM (SELECT data_type, {REASON_SQL} AS r FROM raw), (SELECT unnest(['first', 'second']) AS label) WHERE r IS NULL GROUP BY 1, 2"""


# ---------------------------------------------------------------- text

# Letters that the derived text has as Han characters.
LATIN, HAN = "aeinrst", "\u4e00\u4e8c\u4e09\u4eba\u5927\u5c0f\u65e5"


def t3_chinese_tokens(spark, sf):
    """T3 over texts in which some letters are Han characters, so that runs of both kinds alternate."""
    t = tx.tokens(F.translate(F.lower("text"), LATIN, HAN), "chinese")
    return load(spark, sf, "documents").select(
        "doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.md5(F.array_join(t, " ").cast("binary")).alias("tokens_md5"))


T3_SQL = f"""WITH x AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(lower(text), '{LATIN}', '{HAN}'),
  '(\\p{{Han}}+)', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+') AS runs FROM documents),
t AS (SELECT doc_id, flatten(list_transform(runs, lambda r: CASE WHEN regexp_matches(r, '^\\p{{Han}}') AND length(r) > 1
  THEN list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) ELSE [r] END)) AS toks FROM x)
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens_md5 FROM t"""


def t11_documents(spark, sf):
    """The hits' whole documents as JSON, checked by the fields in them."""
    tabs = [t for t in fx.search_tables(spark, sf) if t.name == "documents"]
    hits = se.search(tabs, KEYWORD, document=True)
    own = lambda f: F.get_json_object("document", f"$.{f}")
    return hits.select("source_table", "id", own("doc_id").cast("bigint").alias("doc_id"), own("lang").alias("lang"),
                       own("source").alias("source"), F.md5(own("text").cast("binary")).alias("text_md5"))


T11_SQL = f"""SELECT 'documents' AS source_table, CAST(doc_id AS VARCHAR) AS id, doc_id, lang, source, md5(text) AS text_md5
FROM documents WHERE coalesce(list_contains({_tok('text')}, '{KEYWORD.lower()}'), false)"""


# ---------------------------------------------------------------- alerts

def a1_check_rules(spark, sf):
    """A1 over rules derived from parts, some without a name, expression or severity."""
    k = F.col("p_partkey")
    rules = load(spark, sf, "part").select(
        k.alias("rule_id"), F.when(k % 5 == 0, "").otherwise(F.col("p_name")).alias("name"),
        F.when(k % 7 != 0, F.concat(F.lit("value > "), k)).alias("expression"),
        F.when(k % 11 == 0, " ").otherwise("info").alias("severity"))
    return al.check_rules(rules).select("rule_id", "invalid_reason")


A1_SQL = """SELECT p_partkey AS rule_id, CASE WHEN p_partkey % 5 = 0 OR p_name IS NULL OR trim(p_name) = '' THEN 'name is required'
WHEN p_partkey % 7 = 0 THEN 'expression is required' WHEN p_partkey % 11 = 0 THEN 'severity is required' END AS invalid_reason FROM part"""


def a4_stream_alerts(spark, sf):
    """A4: the hourly series of every user as a stream through the alert states; the last state of
    each island equals A2."""
    series = al.sample_series(fx.metric_points(spark, sf), "1 hour", labels=["user"])
    src, sink, ck = (_fresh(spark, f"a4-{x}") for x in ("src", "sink", "ck"))
    series.write.parquet(src)
    out = st.stream_alerts(st.read_stream(spark, src, series.schema), RULES, 3600, ["user"])
    q = out.writeStream.outputMode("update").option("checkpointLocation", ck).foreachBatch(
        lambda df, bid: df.write.mode("overwrite").parquet(f"{sink}/batch_id={bid}")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(out.schema.add("batch_id", "long")).parquet(sink)
    last = got.groupBy("rule_id", "user", "active_at").agg(
        F.max_by(F.struct("resolved_at", "value", "state"), "batch_id").alias("r")).where("r.state <> 'INACTIVE'")
    return last.select("rule_id", "user", F.col("active_at").cast("timestamp_ntz").alias("active_at"),
                       F.col("r.resolved_at").cast("timestamp_ntz").alias("resolved_at"), F.round("r.value", 6).alias("value"),
                       F.col("r.state").alias("state"))


A4_SQL = _alerts_sql(', "user"', ', CAST(user_id AS VARCHAR) AS "user"')


def _sunk(spark, out, name, mode):
    """The stream ``out`` run to the end of its input, each batch's rows under its id."""
    sink, ck = _fresh(spark, f"{name}-sink"), _fresh(spark, f"{name}-ck")
    w = out.writeStream.outputMode(mode).option("checkpointLocation", ck).foreachBatch(
        lambda df, bid: df.write.mode("overwrite").parquet(f"{sink}/batch_id={bid}")).trigger(availableNow=True)
    tm.start_stateful(w).awaitTermination()
    return spark.read.schema(T.StructType([*out.schema.fields, T.StructField("batch_id", T.LongType())])).parquet(sink)


def a4_alert_timers(spark, sf):
    """A4 with timers over the hourly series of every user: the last state of each island equals A2 as of the last sample of all."""
    series = al.sample_series(fx.metric_points(spark, sf), "1 hour", labels=["user"])
    src = _fresh(spark, "a4t-src")
    series.write.parquet(src)
    got = _sunk(spark, tm.timed_alerts(st.read_stream(spark, src, series.schema), RULES, 3600, ["user"]), "a4t", "update")
    last = got.groupBy("rule_id", "user", "active_at").agg(
        F.max_by(F.struct("resolved_at", "value", "state"), "batch_id").alias("r")).where("r.state <> 'INACTIVE'")
    return last.select("rule_id", "user", F.col("active_at").cast("timestamp_ntz").alias("active_at"),
                       F.col("r.resolved_at").cast("timestamp_ntz").alias("resolved_at"), F.round("r.value", 6).alias("value"),
                       F.col("r.state").alias("state"))


A4_TIMERS_SQL = _alerts_sql(', "user"', ', CAST(user_id AS VARCHAR) AS "user"', as_of=True)


# ---------------------------------------------------------------- streams

def r6_stream_delivery(spark, sf):
    """Every message with a delay of up to six hours through the stream; what has come out is what is due at the
    last event time, and all of it once."""
    src = _fresh(spark, "r6-src")
    m = load(spark, sf, "events").select(F.col("event_id").alias("sequence_id"), F.col("user_id").alias("key"),
                                         F.col("ts").cast("timestamp").alias("event_time"), "props",
                                         ((F.col("event_id") % 7) * 3600).alias("delay_s"))
    m.write.parquet(src)
    out = tm.delayed_delivery(st.read_stream(spark, src, m.schema), deliver_after_s="delay_s")
    return _sunk(spark, out, "r6", "append").select(
        "sequence_id", "key", F.col("event_time").cast("timestamp_ntz").alias("event_time"), "props",
        F.col("due_at").cast("timestamp_ntz").alias("due_at"))


R6_STREAM_SQL = """SELECT event_id AS sequence_id, user_id AS key, ts AS event_time, props, ts + to_hours(CAST(event_id % 7 AS BIGINT)) AS due_at
FROM events WHERE (epoch_us(ts + to_hours(CAST(event_id % 7 AS BIGINT))) + 999) // 1000 <= (SELECT max(epoch_us(ts)) // 1000 FROM events)"""

# Bounds and lateness of the live histogram and summary, and the summary's objectives.
LIVE_BOUNDS, LIVE_DELAY_S, LIVE_OBJECTIVES = (1.0, 5.0, 10.0, 50.0, 100.0), 3600, {0.5: 0.05, 0.9: 0.02}
_CLOSED = f"(SELECT max(epoch_us(ts)) // 1000 * 1000 - {LIVE_DELAY_S * 1_000_000} FROM events)"


def _live_points(spark, sf, name):
    src = _fresh(spark, name)
    e = st.as_event_time(load(spark, sf, "events").select("event_type", "ts", "value"))
    e.write.parquet(src)
    return st.read_stream(spark, src, e.schema)


def r4_live_histogram(spark, sf):
    """Daily histograms per event type of the windows that the stream has closed."""
    h = st.live_histogram(_live_points(spark, sf, "r4h-src"), "value", "ts", "1 day", None, LIVE_BOUNDS, ["event_type"], f"{LIVE_DELAY_S} seconds")
    return _sunk(spark, h, "r4h", "append").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "le", "bucket_count", F.round("sum", 2).alias("sum"), "count")


R4_HIST_SQL = f"""WITH w AS (SELECT date_trunc('day', ts) AS window_start, event_type, value FROM events),
closed AS (SELECT * FROM w WHERE epoch_us(window_start) + 86400000000 <= {_CLOSED})
SELECT window_start, event_type, le, CAST(count_if(value <= CAST(replace(le, '+Inf', 'Infinity') AS DOUBLE)) AS BIGINT) AS bucket_count,
round(sum(value), 2) AS sum, COUNT(value) AS count
FROM closed, (SELECT unnest([{", ".join(repr(str(b)) for b in LIVE_BOUNDS)}, '+Inf']) AS le) GROUP BY 1, 2, 3"""


def r4_live_summary(spark, sf):
    """Sliding summaries of the closed windows: whether each quantile's rank lies within its objective."""
    s = st.live_summary(_live_points(spark, sf, "r4s-src"), "value", "ts", "1 day", "12 hours", LIVE_OBJECTIVES, ["event_type"], f"{LIVE_DELAY_S} seconds")
    est = _sunk(spark, s, "r4s", "append").select(F.col("window_start").alias("_w"), F.col("event_type").alias("_t"), "quantile",
                                                  F.col("value").alias("est"), F.col("count").alias("_n"))
    e = st.as_event_time(load(spark, sf, "events")).withColumn("window_start", F.window("ts", "1 day", "12 hours")["start"])
    v, n = F.col("value"), F.count("value")
    err = F.create_map(*[F.lit(float(x)) for kv in LIVE_OBJECTIVES.items() for x in kv])[F.col("quantile")]
    ranks = e.join(est, (F.col("window_start") == F.col("_w")) & (F.col("event_type") == F.col("_t"))).groupBy("window_start", "event_type", "quantile").agg(
        (F.count_if(v < F.col("est")) / n).alias("lo"), (F.count_if(v <= F.col("est")) / n).alias("hi"), n.alias("count"), F.max("_n").alias("_n"))
    good = (F.col("lo") <= F.col("quantile") + err) & (F.col("hi") >= F.col("quantile") - err) & (F.col("_n") == F.col("count"))
    return ranks.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "quantile", good.alias("within_error"), "count")


R4_SUMMARY_SQL = f"""WITH w AS (SELECT make_timestamp(epoch_us(ts) // 43200000000 * 43200000000 - k * 43200000000) AS window_start, event_type, value
  FROM events, (SELECT unnest([0, 1]) AS k))
SELECT window_start, event_type, CAST(unnest([{", ".join(map(str, LIVE_OBJECTIVES))}]) AS DOUBLE) AS quantile, TRUE AS within_error, COUNT(value) AS count
FROM w WHERE epoch_us(window_start) + 86400000000 <= {_CLOSED} GROUP BY window_start, event_type"""


def r1_two_queries(spark, sf):
    """Two stream queries on one sink; each adds its rows."""
    raw = fx.raw_events(spark, sf).drop("event_id", "value", "tags")
    src, sink, dead = (_fresh(spark, f"r1two-{x}") for x in ("src", "sink", "dead"))
    raw.write.parquet(src)
    for _ in range(2):
        st.ingest_stream(st.read_stream(spark, src, raw.schema), sink, dead, _fresh(spark, "r1two-ck")).awaitTermination()
    return spark.read.parquet(sink).groupBy(F.col("data_type").alias("target_table")).agg(
        F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("rows"))


R1_TWO_SQL = f"SELECT target_table, CAST(2 AS BIGINT) AS queries, CAST(2 * rows AS BIGINT) AS rows FROM ({L5_SQL})"

# Fixed value: the lateness that R3 allows, in seconds.
LATE_S = 7 * 24 * 3600


def r3_late_rows(spark, sf):
    """Even events first, then the odd ones, of which those a week behind are late."""
    e = st.as_event_time(load(spark, sf, "events")).select("event_id", "ts")
    state, ok, late = (_fresh(spark, f"r3-{x}") for x in ("state", "ok", "late"))
    for batch in (0, 1):
        st.split_late(e.where(F.col("event_id") % 2 == batch), batch, "ts", LATE_S, state, ok, late, "first")
    # another query on the same tables, whose batches count from 0 too
    st.split_late(e, 0, "ts", LATE_S, state, ok, late, "second")
    on_time = spark.read.parquet(ok).withColumn("late", F.lit(False))
    return on_time.unionByName(spark.read.parquet(late).withColumn("late", F.lit(True))).select(
        F.col("query_id").alias("query"), "event_id", F.col("batch_id").cast("bigint").alias("batch_id"), "late")


R3_SQL = f"""SELECT 'first' AS query, event_id, event_id % 2 AS batch_id, event_id % 2 = 1 AND ts < (SELECT max(ts) FROM events
WHERE event_id % 2 = 0) - to_seconds({LATE_S}) AS late FROM events
UNION ALL SELECT 'second', event_id, CAST(0 AS BIGINT), FALSE FROM events"""


def r5_ordered_per_key(spark, sf):
    """Per key one partition, and its first and last message as they come."""
    o = st.ordered_per_key(load(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id")
    o = o.select("user_id", "event_id", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part"))
    return o.groupBy("user_id").agg(F.count_distinct("part").alias("partitions"), F.min_by("event_id", "at").alias("first_id"),
                                    F.max_by("event_id", "at").alias("last_id"), F.count(F.lit(1)).alias("n"))


R5_SQL = """SELECT user_id, CAST(1 AS BIGINT) AS partitions, min(event_id) AS first_id, max(event_id) AS last_id, COUNT(*) AS n
FROM events GROUP BY 1"""


def v4_stream_refresh(spark, sf):
    """V4: lineitem as a stream folded into an incremental view, which is read back."""
    li = load(spark, sf, "lineitem")
    src, root, ck = (_fresh(spark, f"v4-{x}") for x in ("src", "root", "ck"))
    li.write.parquet(src)
    st.view_refresh_stream(st.read_stream(spark, src, li.schema), root, "v", VIEW_KEYS, VIEW_MEASURES, ck).awaitTermination()
    return _round_view(vw.read_view(spark, root, "v", VIEW_KEYS, VIEW_MEASURES))


QUERIES = {
    "l10_filter_ratio": (l10_filter_ratio, L10_SQL),
    "l17_load_once": (l17_load_once, L17_SQL),
    "t3_chinese_tokens": (t3_chinese_tokens, T3_SQL),
    "t11_documents": (t11_documents, T11_SQL),
    "a1_check_rules": (a1_check_rules, A1_SQL),
    "a4_stream_alerts": (a4_stream_alerts, A4_SQL),
    "a4_alert_timers": (a4_alert_timers, A4_TIMERS_SQL),
    "r4_live_histogram": (r4_live_histogram, R4_HIST_SQL),
    "r4_live_summary": (r4_live_summary, R4_SUMMARY_SQL),
    "r6_stream_delivery": (r6_stream_delivery, R6_STREAM_SQL),
    "r1_two_queries": (r1_two_queries, R1_TWO_SQL),
    "r3_late_rows": (r3_late_rows, R3_SQL),
    "r5_ordered_per_key": (r5_ordered_per_key, R5_SQL),
    "v4_stream_refresh": (v4_stream_refresh, V_SQL),
}
