"""Named ingestion and load queries (L1-L5, L8, L9, L11-L16, L19-L21) with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators import keyed, quality
from tidepool.plans import fixtures as fx
from tidepool.sources import ingest, loading
from tidepool.session import load

RAW_SQL = """raw AS (
  SELECT CAST(event_id AS VARCHAR) AS id,
         CASE WHEN event_id % 50 = 0 THEN '' ELSE 'user-' || CAST(user_id AS VARCHAR) END AS data_source_id,
         CASE WHEN event_id % 50 = 1 THEN '' ELSE event_type END AS data_type,
         CASE WHEN event_id % 50 = 2 THEN NULL ELSE ts END AS ts,
         CASE WHEN event_id % 50 = 3 THEN NULL ELSE props END AS data,
         ts + to_microseconds(CAST((event_id % 2000) * 1000000 AS BIGINT)) AS received_at,
         event_id, value
  FROM events)"""

REASON_SQL = """CASE WHEN data_source_id IS NULL OR data_source_id = '' THEN 'empty data_source_id'
       WHEN data_type IS NULL OR data_type = '' THEN 'empty data_type'
       WHEN ts IS NULL OR ts = TIMESTAMP '0001-01-01 00:00:00' THEN 'zero timestamp'
       WHEN data IS NULL THEN 'neither data nor raw_payload' END"""

CUT_TARGET = "2024-01-20 00:00:00"
CUT_BATCH = "2024-01-15 00:00:00"


def _target_batch(spark, sf, batch_value=None):
    e = load(spark, sf, "events")
    target = e.where(F.col("ts") < F.lit(CUT_TARGET).cast("timestamp_ntz"))
    bv = batch_value if batch_value is not None else F.col("value") + F.lit(1.0)
    batch = e.where(F.col("ts") >= F.lit(CUT_BATCH).cast("timestamp_ntz")).withColumn("value", bv)
    return target, batch


TB_SQL = f"""target AS (SELECT * FROM events WHERE ts < TIMESTAMP '{CUT_TARGET}'),
batch AS (SELECT event_id, ts, user_id, event_type, value + 1.0 AS value, props FROM events
          WHERE ts >= TIMESTAMP '{CUT_BATCH}'),
u AS (SELECT *, 0 AS o FROM target UNION ALL SELECT *, 1 AS o FROM batch)"""


def l1_validate(spark, sf):
    r = ingest.validate_events(fx.raw_events(spark, sf))
    return r.select("id", "data_type", "reject_reason")


L1_SQL = f"WITH {RAW_SQL} SELECT id, data_type, {REASON_SQL} AS reject_reason FROM raw"


def l2_rejected(spark, sf):
    _, bad = ingest.split_rejects(fx.raw_events(spark, sf))
    return bad.select("id", "reject_reason")


L2_SQL = f"WITH {RAW_SQL} SELECT id, reason AS reject_reason FROM (SELECT id, {REASON_SQL} AS reason FROM raw) WHERE reason IS NOT NULL"


def l3_summary(spark, sf):
    return ingest.ingest_summary(fx.raw_events(spark, sf), by=["data_type"])


L3_SQL = f"""WITH {RAW_SQL}
SELECT data_type, CAST(count_if(r IS NULL) AS BIGINT) AS ingested, CAST(0 AS BIGINT) AS persist_failed,
       CAST(count_if(r IS NOT NULL) AS BIGINT) AS validation_failed
FROM (SELECT data_type, {REASON_SQL} AS r FROM raw) GROUP BY data_type"""


NOW = "2024-02-01 00:00:00"


def l4_normalize(spark, sf):
    n = ingest.normalize_events(fx.raw_events(spark, sf), NOW)
    return n.select("id", "ts")


L4_SQL = f"WITH {RAW_SQL} SELECT id, coalesce(ts, TIMESTAMP '{NOW}') AS ts FROM raw"


def l4_normalize_text(spark, sf):
    """L4 over text timestamps (the wire form): unparsable text -> now."""
    e = load(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 7 == 0, F.lit("not a time"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ts"))
    return ingest.normalize_events(e, NOW, fmt="yyyy-MM-dd HH:mm:ss").select("event_id", "ts")


L4_TEXT_SQL = f"""SELECT event_id, coalesce(try_strptime(CASE WHEN event_id % 7 = 0 THEN 'not a time'
  ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END, '%Y-%m-%d %H:%M:%S'), TIMESTAMP '{NOW}') AS ts FROM events"""


def l5_route(spark, sf):
    """The valid rows written by type, read back."""
    root, raw = _scratch(spark, "l5"), fx.raw_events(spark, sf)
    valid, _ = ingest.split_rejects(raw)
    ingest.route_by_type(valid.drop("tags"), root)
    return spark.read.parquet(root).groupBy(F.col("data_type").alias("target_table")).agg(F.count(F.lit(1)).alias("rows"))


L5_SQL = f"""WITH {RAW_SQL} SELECT data_type AS target_table, COUNT(*) AS rows
FROM (SELECT data_type, {REASON_SQL} AS r FROM raw) WHERE r IS NULL GROUP BY data_type"""


def l8_map_columns(spark, sf):
    return loading.map_columns(load(spark, sf, "events"), [
        "event_id", "upper(event_type) AS kind", "round(value * 2, 2) AS doubled",
        "get_json_object(props, '$.k') AS k"])


L8_SQL = """SELECT event_id, upper(event_type) AS kind, round(value * 2, 2) AS doubled,
json_extract_string(props, '$.k') AS k FROM events"""


def l9_l11_load_counts(spark, sf):
    raw = fx.raw_events(spark, sf)
    df = raw.withColumn(loading.REASON, ingest.reject_reason(raw))
    return loading.load_counts(loading.load_where(df, "data_type <> 'view'"))


L11_SQL = f"""WITH {RAW_SQL}, r AS (SELECT *, {REASON_SQL} AS reason FROM raw)
SELECT COUNT(*) AS total_rows,
  CAST(count_if(reason IS NULL AND coalesce(data_type <> 'view', false)) AS BIGINT) AS loaded_rows,
  CAST(count_if(reason IS NOT NULL) AS BIGINT) AS filtered_rows,
  CAST(count_if(reason IS NULL AND NOT coalesce(data_type <> 'view', false)) AS BIGINT) AS unselected_rows FROM r"""


def l12_duplicate(spark, sf):
    t, b = _target_batch(spark, sf)
    return keyed.load_duplicate(t, b).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 2).alias("value"))


L12_SQL = f"""WITH {TB_SQL} SELECT event_type, COUNT(*) AS rows, round(sum(value), 2) AS value FROM u GROUP BY event_type"""


def l13_aggregate(spark, sf):
    t, b = _target_batch(spark, sf)
    out = keyed.load_aggregate(t, b, ["user_id", "event_type"],
                               {"value": "sum", "ts": "max", "event_id": "replace", "props": "replace"},
                               seq=["ts", "event_id"])
    return out.withColumn("value", F.round("value", 2))


L13_SQL = f"""WITH {TB_SQL},
last AS (SELECT user_id, event_type, event_id, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY o DESC, ts DESC, event_id DESC) AS rn FROM u)
  WHERE rn = 1),
agg AS (SELECT user_id, event_type, round(sum(value), 2) AS value, max(ts) AS ts FROM u GROUP BY user_id, event_type)
SELECT a.user_id, a.event_type, a.value, a.ts, l.event_id, l.props FROM agg a JOIN last l USING (user_id, event_type)"""


def l14_unique(spark, sf):
    t, b = _target_batch(spark, sf)
    return keyed.load_unique(t, b, ["user_id", "event_type"], seq=["ts", "event_id"])


L14_SQL = f"""WITH {TB_SQL}
SELECT user_id, event_type, event_id, ts, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY o DESC, ts DESC, event_id DESC) AS rn FROM u)
WHERE rn = 1"""


def l15_primary_partial(spark, sf):
    t, b = _target_batch(spark, sf)
    return keyed.load_primary(t, b, ["event_id"], seq=["ts"], cols=["value"]).select("event_id", "value", "event_type")


L15_SQL = f"""WITH {TB_SQL}
SELECT coalesce(t.event_id, b.event_id) AS event_id, CASE WHEN b.event_id IS NOT NULL THEN b.value ELSE t.value END AS value,
       t.event_type AS event_type
FROM target t FULL OUTER JOIN batch b ON t.event_id = b.event_id"""


def l15_primary_full(spark, sf):
    t, b = _target_batch(spark, sf)
    return keyed.load_primary(t, b, ["event_id"], seq=["ts"]).select("event_id", "value", "event_type", "ts")


L15_FULL_SQL = f"""WITH {TB_SQL}
SELECT event_id, value, event_type, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY o DESC, ts DESC) AS rn FROM u) WHERE rn = 1"""


def l16_merge_condition(spark, sf):
    e = load(spark, sf, "events")
    t = e.where(F.col("ts") < F.lit(CUT_TARGET).cast("timestamp_ntz"))
    b = e.where(F.col("ts") >= F.lit(CUT_BATCH).cast("timestamp_ntz")).withColumn(
        "value", F.col("value") * 2.0 - 30.0)
    return keyed.merge_condition(t, b, ["event_id"], "value", seq=["ts"]).select("event_id", "value", "event_type")


L16_SQL = f"""WITH target AS (SELECT * FROM events WHERE ts < TIMESTAMP '{CUT_TARGET}'),
batch AS (SELECT event_id, ts, user_id, event_type, value * 2.0 - 30.0 AS value, props FROM events
          WHERE ts >= TIMESTAMP '{CUT_BATCH}')
SELECT coalesce(t.event_id, b.event_id) AS event_id,
       CASE WHEN t.event_id IS NULL OR b.value >= t.value THEN b.value ELSE t.value END AS value,
       CASE WHEN t.event_id IS NULL OR b.value >= t.value THEN b.event_type ELSE t.event_type END AS event_type
FROM target t FULL OUTER JOIN batch b ON t.event_id = b.event_id"""


def l19_time_range(spark, sf):
    """Events written by day, and a time range read back from the days it touches."""
    path = _scratch(spark, "l19")
    loading.write_by_time(load(spark, sf, "events"), path, "ts")
    got = loading.read_time_range(spark, path, "ts", "2024-01-10 06:00:00", "2024-01-17 12:00:00")
    return got.groupBy("d").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 2).alias("value"))


L19_SQL = """SELECT CAST(ts AS DATE) AS d, COUNT(*) AS rows, round(sum(value), 2) AS value FROM events
WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-17 12:00:00' GROUP BY 1"""


def l20_bucket_skew(spark, sf):
    """L20 skew report: rows per bucket of lineitem by l_orderkey (Spark's bucket hash)."""
    b = loading.bucket_skew(load(spark, sf, "lineitem"), ["l_orderkey"], 16)
    return b.agg(F.count(F.lit(1)).alias("buckets"), F.sum("rows").alias("rows"))


L20_SQL = "SELECT CAST(16 AS BIGINT) AS buckets, CAST(COUNT(*) AS BIGINT) AS rows FROM lineitem"


def l21_scan(spark, sf):
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    return loading.scan(load(spark, sf, "lineitem"), cols, limit=100, offset=50, order_by=cols)


L21_SQL = """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice LIMIT 100 OFFSET 50"""


QUERIES = {
    "l1_validate": (l1_validate, L1_SQL),
    "l2_rejected": (l2_rejected, L2_SQL),
    "l3_summary": (l3_summary, L3_SQL),
    "l4_normalize": (l4_normalize, L4_SQL),
    "l4_normalize_text": (l4_normalize_text, L4_TEXT_SQL),
    "l5_route": (l5_route, L5_SQL),
    "l8_map_columns": (l8_map_columns, L8_SQL),
    "l9_l11_load_counts": (l9_l11_load_counts, L11_SQL),
    "l12_duplicate": (l12_duplicate, L12_SQL),
    "l13_aggregate": (l13_aggregate, L13_SQL),
    "l14_unique": (l14_unique, L14_SQL),
    "l15_primary_partial": (l15_primary_partial, L15_SQL),
    "l15_primary_full": (l15_primary_full, L15_FULL_SQL),
    "l16_merge_condition": (l16_merge_condition, L16_SQL),
    "l19_time_range": (l19_time_range, L19_SQL),
    "l20_bucket_skew": (l20_bucket_skew, L20_SQL),
    "l21_scan": (l21_scan, L21_SQL),
}


# ---------------------------------------------------------------- file loads over derived files

# The load fixture spoils the value of every 97th event (text that is no number).
SPOIL_EVERY = 97
LOAD_SCHEMA = "event_id bigint, event_type string, value double, ts timestamp_ntz"


def _spoiled_events(spark, sf):
    e = load(spark, sf, "events")
    bad = F.col("event_id") % SPOIL_EVERY == 0
    return e.select("event_id", "event_type", F.when(bad, F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("value"),
                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


def _scratch(spark, name):
    import uuid
    from tidepool.session import scratch_path
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def l6_load_csv(spark, sf):
    """Events written as '|'-separated text with spoiled values, loaded back with per-row rejects."""
    from pyspark.sql import types as T
    path = _scratch(spark, "l6")
    _spoiled_events(spark, sf).write.option("sep", "|").csv(path)
    df = loading.load_csv(spark, path, T._parse_datatype_string(LOAD_SCHEMA), column_separator="|")
    return df.select("event_id", "value", F.col(loading.REASON).alias("reject_reason"))


L6_SQL = f"""SELECT event_id, CASE WHEN event_id % {SPOIL_EVERY} = 0 THEN NULL ELSE value END AS value,
CASE WHEN event_id % {SPOIL_EVERY} = 0 THEN 'bad value in value' END AS reject_reason FROM events"""


def l7_load_json(spark, sf):
    """The same rows as JSON lines."""
    from pyspark.sql import types as T
    path = _scratch(spark, "l7")
    _spoiled_events(spark, sf).write.json(path)
    df = loading.load_json(spark, path, T._parse_datatype_string(LOAD_SCHEMA))
    return df.select("event_id", "value", F.col(loading.REASON).alias("reject_reason"))


def _audit_ids(staged):
    """An audit of staged rows: ids are there and unique (D2's checks of the data)."""
    found = quality.check_schema(staged.select("id"), [{"name": "id", "type": "string", "nullable": False, "pk": True}])
    bad = [r["check"] for r in found.where("violations > 0").collect()]  # at most one row per check and column
    if bad:
        raise ValueError(f"staged rows fail {bad}")


def l18_staged_publish(spark, sf):
    """L17 + L18: a labelled staged load of the valid raw events, audited, published, read back."""
    raw = fx.raw_events(spark, sf)
    df = raw.withColumn(loading.REASON, ingest.reject_reason(raw)).drop("tags")
    root = _scratch(spark, "l18")
    st = loading.stage(df, root, max_filter_ratio=0.1)
    loading.publish(spark, st, audits=[_audit_ids])
    return loading.read_current(spark, root).groupBy("data_type").agg(F.count(F.lit(1)).alias("rows"))


L18_SQL = f"""WITH {RAW_SQL} SELECT data_type, COUNT(*) AS rows
FROM (SELECT data_type, {REASON_SQL} AS r FROM raw) WHERE r IS NULL GROUP BY data_type"""


def r1_ingest_stream(spark, sf):
    """Raw events as a file stream through validate -> route -> table; the sink read back."""
    from tidepool.streaming import streams as st
    raw = fx.raw_events(spark, sf).drop("event_id", "value", "tags")
    src, sink, dead, ck = (_scratch(spark, f"r1-{x}") for x in ("src", "sink", "dead", "ck"))
    raw.write.parquet(src)
    q = st.ingest_stream(st.read_stream(spark, src, raw.schema), sink, dead, ck)
    q.awaitTermination()
    return spark.read.parquet(sink).groupBy(F.col("data_type").alias("target_table")).agg(F.count(F.lit(1)).alias("rows"))


QUERIES.update({
    "l6_load_csv": (l6_load_csv, L6_SQL),
    "l7_load_json": (l7_load_json, L6_SQL),
    "l18_staged_publish": (l18_staged_publish, L18_SQL),
    "r1_ingest_stream": (r1_ingest_stream, L5_SQL),
})


def l14_upsert_stored(spark, sf):
    """L14 on the stored form: target and batch are loaded into a table of 16 key buckets, the batch
    without naming the count."""
    import uuid

    from tidepool.session import scratch_path
    t, b = _target_batch(spark, sf)
    path = scratch_path(spark, f"l14stored-{uuid.uuid4().hex}")
    keys, seq = ["user_id", "event_type"], ["ts", "event_id"]
    keyed.upsert(path, t, keys, seq, n_buckets=16)
    keyed.upsert(path, b, keys, seq)
    return spark.read.parquet(path).drop(keyed.KEY_BUCKET).select("user_id", "event_type", "event_id", "ts", "value", "props")


QUERIES["l14_upsert_stored"] = (l14_upsert_stored, L14_SQL)
