"""Batch twins of the streaming operators (R2, R4, R6, R7, R8) with DuckDB oracles.

The live forms are exercised by the stream tests; these run the same functions on the whole
events table read as a batch.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.session import load
from tidepool.streaming import streams as st

# The message fixture repeats every tenth event (sequence id = event id).
REPEAT_EVERY = 10


def _messages(spark, sf):
    e = load(spark, sf, "events")
    msgs = e.unionByName(e.where(F.col("event_id") % REPEAT_EVERY == 0))
    return msgs.select(F.col("event_id").alias("sequence_id"), F.col("user_id").alias("key"), F.col("ts").alias("event_time"),
                       "event_type", "value")


MSG_SQL = f"""msgs AS (SELECT event_id AS sequence_id, user_id AS key, ts AS event_time, event_type, value FROM events
  UNION ALL SELECT event_id, user_id, ts, event_type, value FROM events WHERE event_id % {REPEAT_EVERY} = 0)"""


def r2_dedup(spark, sf):
    d = st.dedup_batch(_messages(spark, sf), ["sequence_id"], ["event_time", "event_type"])
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sequence_id").alias("ids"))


R2_SQL = f"""WITH {MSG_SQL} SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT sequence_id) AS ids FROM
(SELECT DISTINCT ON (sequence_id) * FROM msgs) GROUP BY 1"""


def r4_window_counts(spark, sf):
    """R4 over a batch (a watermark drops nothing there): hourly tumbling counts per type."""
    w = st.windowed_counts(st.as_event_time(load(spark, sf, "events")), "ts", "1 hour", by=["event_type"], value="value")
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


R4_SQL = """SELECT date_trunc('hour', ts) AS window_start, event_type, COUNT(*) AS n, round(sum(value), 2) AS total
FROM events GROUP BY 1, 2"""


def r6_deliverable(spark, sf):
    m = _messages(spark, sf).withColumn("delay_s", (F.col("sequence_id") % 7) * 3600)
    d = st.deliverable(m, "2024-01-15 00:00:00", "event_time", None, "delay_s")
    return d.select("sequence_id", "due_at")


R6_SQL = f"""WITH {MSG_SQL} SELECT sequence_id, event_time + to_hours(CAST(sequence_id % 7 AS BIGINT)) AS due_at FROM msgs
WHERE event_time + to_hours(CAST(sequence_id % 7 AS BIGINT)) <= TIMESTAMP '2024-01-15 00:00:00'"""


def r7_dead_letter(spark, sf):
    m = _messages(spark, sf).withColumn("attempts", (F.col("sequence_id") % 5).cast("int"))
    retry, dead = st.retry_split(m, "attempts", 3, "event_time", 600)
    return retry.withColumn("route", F.lit("retry")).unionByName(dead.withColumn("route", F.lit("dead_letter")), True) \
        .groupBy("route", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("due_at").alias("last_due"))


R7_SQL = f"""WITH {MSG_SQL} SELECT CASE WHEN sequence_id % 5 >= 3 THEN 'dead_letter' ELSE 'retry' END AS route, event_type,
COUNT(*) AS n, max(event_time + INTERVAL 10 MINUTE) FILTER (WHERE sequence_id % 5 < 3) AS last_due FROM msgs GROUP BY 1, 2"""


def r8_messages(spark, sf):
    e = load(spark, sf, "events")
    m = st.to_messages(e, "user_id", ["event_id", "event_type", "value"], "ts")
    return m.select("key", "value", "event_time")


R8_SQL = """SELECT CAST(user_id AS VARCHAR) AS key, CAST(to_json({'event_id': event_id, 'event_type': event_type, 'value': value}) AS VARCHAR) AS value,
ts AS event_time FROM events"""


QUERIES = {
    "r2_dedup": (r2_dedup, R2_SQL),
    "r4_window_counts": (r4_window_counts, R4_SQL),
    "r6_deliverable": (r6_deliverable, R6_SQL),
    "r7_dead_letter": (r7_dead_letter, R7_SQL),
    "r8_messages": (r8_messages, R8_SQL),
}
