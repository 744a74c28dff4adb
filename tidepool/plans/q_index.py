"""Named index, view and data-quality queries (T18-T20 index forms, X1-X3, V1-V3, V5, D1-D7)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidepool.functions import text as tx
from tidepool.operators import index as ix
from tidepool.operators import quality as qa
from tidepool.operators import views as vw
from tidepool.plans import fixtures as fx
from tidepool.plans.q_search import KEYWORD, T7_ALL_SQL, T7_SQL, T16_SQL, T20_SQL, TWO_WORDS, _tok
from tidepool.session import cut_lineage, load, scratch_path


def _postings(spark, sf):
    return ix.build_inverted_index(fx.search_tables(spark, sf))


def t18_postings(spark, sf):
    post, _ = ix.build_inverted_index(fx.search_tables(spark, sf))
    return post.select("source_table", "id", "tie", "token", "tf", F.element_at("positions", 1).alias("first_pos"),
                       F.size("positions").alias("n_pos"))


INDEXED_SQL = f"""rows AS (
  SELECT 'documents' AS source_table, CAST(doc_id AS VARCHAR) AS id, '' AS tie, {_tok('text')} AS t FROM documents
  UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), {_tok('text')} FROM conversations
  UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), '', {_tok('text')} FROM benchmark)"""
T18_SQL = f"""WITH {INDEXED_SQL} SELECT source_table, id, tie, token, COUNT(*) AS tf, CAST(min(pos) AS INTEGER) AS first_pos,
CAST(COUNT(*) AS INTEGER) AS n_pos FROM (
  SELECT source_table, id, tie, unnest(t) AS token, unnest(range(len(t))) AS pos FROM rows)
GROUP BY source_table, id, tie, token"""


def t19_index_any(spark, sf):
    post, _ = _postings(spark, sf)
    return ix.search_index(post, KEYWORD)


T19_ANY_SQL = f"SELECT DISTINCT source_table, id, tie FROM ({T7_SQL})"


def t19_index_all(spark, sf):
    post, _ = _postings(spark, sf)
    return ix.search_index(post, TWO_WORDS, recall_priority=False)


T19_ALL_SQL = f"SELECT DISTINCT source_table, id, tie FROM ({T7_ALL_SQL})"


def t12_bm25(spark, sf):
    post, lengths = _postings(spark, sf)
    root = scratch_path(spark, f"bm25-{uuid.uuid4().hex}")
    ix.write_index(post, lengths, root, buckets=32)
    return ix.bm25(ix.read_postings(spark, root), ix.read_stats(spark, root), TWO_WORDS) \
        .withColumn("score", F.round("score", 6))


T12_BM25_SQL = f"""WITH docs AS (
  SELECT 'documents' AS source_table, CAST(doc_id AS VARCHAR) AS id, '' AS tie, {_tok('text')} AS t FROM documents
  UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), {_tok('text')} FROM conversations
  UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), '', {_tok('text')} FROM benchmark),
stats AS (SELECT source_table, COUNT(*) AS n_docs, avg(coalesce(len(t), 0)) AS avgdl FROM docs GROUP BY 1),
occ AS (SELECT source_table, id, tie, coalesce(len(t), 0) AS dl, unnest(t) AS token FROM docs),
tf AS (SELECT source_table, id, tie, dl, token, COUNT(*) AS tf FROM occ WHERE token IN ('mit', 'license') GROUP BY ALL),
df AS (SELECT source_table, token, COUNT(*) AS df FROM tf GROUP BY ALL)
SELECT source_table, id, tie, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2
  / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
FROM tf JOIN df USING (source_table, token) JOIN stats USING (source_table) GROUP BY source_table, id, tie"""


def t20_phrase_index(spark, sf):
    post, _ = _postings(spark, sf)
    hits = ix.match_phrase_index(post, "under the MIT License")
    return hits.where(F.col("source_table") == "documents").select(F.col("id").cast("bigint").alias("doc_id"))


T20_INDEX_SQL = T20_SQL


def x1_bitmap_index(spark, sf):
    idx = ix.build_bitmap_index(load(spark, sf, "events"), ["event_type", "user_id"], "event_id")
    return idx.groupBy("column", "value").agg(F.sum(F.bitmap_count("bitmap")).cast("bigint").alias("rows"),
                                              F.count(F.lit(1)).alias("buckets"))


X1_SQL = """SELECT 'event_type' AS "column", event_type AS value, COUNT(*) AS rows,
  COUNT(DISTINCT (event_id + 1 - 1) // 32768) AS buckets FROM events GROUP BY 2
UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), COUNT(*), COUNT(DISTINCT (event_id + 1 - 1) // 32768) FROM events GROUP BY 2"""


def x2_bitmap_and(spark, sf):
    idx = ix.build_bitmap_index(load(spark, sf, "events"), ["event_type", "user_id"], "event_id")
    return ix.bitmap_filter(idx, {"event_type": ["click", "view"], "user_id": list(range(0, 40))}, "and")


X2_AND_SQL = "SELECT COUNT(*) AS rows FROM events WHERE event_type IN ('click', 'view') AND user_id < 40"


def x2_bitmap_or(spark, sf):
    idx = ix.build_bitmap_index(load(spark, sf, "events"), ["event_type", "user_id"], "event_id")
    return ix.bitmap_filter(idx, {"event_type": ["error"], "user_id": [3, 5, 7]}, "or")


X2_OR_SQL = "SELECT COUNT(*) AS rows FROM events WHERE event_type = 'error' OR user_id IN (3, 5, 7)"


def x2_bitmap_ids(spark, sf):
    idx = ix.build_bitmap_index(load(spark, sf, "events"), ["event_type", "user_id"], "event_id")
    return ix.bitmap_ids(idx, {"event_type": ["click", "view"], "user_id": list(range(0, 40))}, "and")


X2_IDS_SQL = "SELECT event_id AS id FROM events WHERE event_type IN ('click', 'view') AND user_id < 40"


def x3_layout(spark, sf):
    r = ix.recommend_layout(load(spark, sf, "orders"), exact=True)
    return r.select("column", "type", "ndv", F.round("null_share", 6).alias("null_share"),
                    F.round("avg_length", 6).alias("avg_length"), "advice")


def _x3_sql() -> str:
    cols = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
            ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]
    parts = []
    for c, t in cols:
        avg = f"avg(length({c}))" if t == "string" else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS \"column\", '{t}' AS type, COUNT(DISTINCT {c}) AS ndv, "
                     f"count_if({c} IS NULL) / COUNT(*) AS null_share, {avg} AS avg_length, COUNT(*) AS n FROM orders")
    return f"""SELECT "column", type, ndv, round(null_share, 6) AS null_share, round(avg_length, 6) AS avg_length,
CASE WHEN type LIKE 'timestamp%' OR type = 'date' THEN 'partition'
     WHEN type = 'string' AND avg_length >= 32 THEN 'inverted'
     WHEN ndv <= 1000 THEN 'bitmap' WHEN ndv / n >= 0.5 THEN 'bucket' ELSE 'none' END AS advice
FROM ({' UNION ALL '.join(parts)})"""


X3_SQL = _x3_sql()

VIEW_KEYS = ["l_returnflag", "l_linestatus"]
VIEW_MEASURES = [vw.Measure("qty", "sum", "l_quantity"), vw.Measure("lines", "count"), vw.Measure("min_price", "min", "l_extendedprice"),
                 vw.Measure("max_price", "max", "l_extendedprice"), vw.Measure("avg_disc", "avg", "l_discount")]
VIEW_CUT = "1999-01-01 00:00:00"


def _round_view(df):
    return df.select(*VIEW_KEYS, F.round("qty", 2).alias("qty"), "lines", "min_price", "max_price",
                     F.round("avg_disc", 6).alias("avg_disc"))


def v1_full_refresh(spark, sf):
    """V1: the view's first version over the older rows, then a full refresh over all, read back."""
    from tidepool.sources import loading
    li, root = load(spark, sf, "lineitem"), scratch_path(spark, f"v1-{uuid.uuid4().hex}")
    for rows in (li.where(F.col("l_shipdate") < F.lit(VIEW_CUT).cast("timestamp_ntz")), li):
        vw.refresh_full(spark, root, "v", vw.view_query(rows, VIEW_KEYS, VIEW_MEASURES))
    return _round_view(loading.read_current(spark, f"{root}/v"))


V_SQL = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, COUNT(*) AS lines, min(l_extendedprice) AS min_price,
max(l_extendedprice) AS max_price, round(avg(l_discount), 6) AS avg_disc FROM lineitem GROUP BY 1, 2"""


def v2_incremental(spark, sf):
    """V2: stored states of the older rows, then an incremental refresh by the appended ones."""
    li, root = load(spark, sf, "lineitem"), scratch_path(spark, f"v2-{uuid.uuid4().hex}")
    cut = F.lit(VIEW_CUT).cast("timestamp_ntz")
    for rows in (li.where(F.col("l_shipdate") < cut), li.where(F.col("l_shipdate") >= cut)):
        vw.refresh_incremental(spark, root, "v", rows, VIEW_KEYS, VIEW_MEASURES)
    return _round_view(vw.read_view(spark, root, "v", VIEW_KEYS, VIEW_MEASURES))


def v2_incremental_sketch(spark, sf):
    """V2 with an HLL sketch measure (mergeable distinct estimate): the exact counts, and whether
    the estimates lie within three standard errors (1.6% each) of them."""
    li = load(spark, sf, "lineitem")
    ms = [vw.Measure("parts", "approx_distinct", "l_partkey")]
    cut = F.lit(VIEW_CUT).cast("timestamp_ntz")
    old = vw.states(li.where(F.col("l_shipdate") < cut), VIEW_KEYS, ms)
    new = vw.states(li.where(F.col("l_shipdate") >= cut), VIEW_KEYS, ms)
    est = vw.finalize(vw.merge_states(old, new, VIEW_KEYS, ms), VIEW_KEYS, ms).withColumnRenamed("parts", "_est")
    exact = li.groupBy(*VIEW_KEYS).agg(F.count_distinct("l_partkey").alias("parts"))
    return exact.join(est, VIEW_KEYS).select(*VIEW_KEYS, "parts", (F.abs(F.col("_est") - F.col("parts")) <= 0.05 * F.col("parts")).alias("within_error"))


V2_SKETCH_SQL = """SELECT l_returnflag, l_linestatus, COUNT(DISTINCT l_partkey) AS parts, TRUE AS within_error FROM lineitem GROUP BY 1, 2"""


def v2_incremental_quantile(spark, sf):
    """V2 with a quantile sketch measure: the exact counts, and whether the merged median's rank lies within 1.5%."""
    li = load(spark, sf, "lineitem")
    ms = [vw.Measure("p50", "quantile", "l_extendedprice", 0.5), vw.Measure("n", "count", "l_extendedprice")]
    cut = F.lit(VIEW_CUT).cast("timestamp_ntz")
    old = vw.states(li.where(F.col("l_shipdate") < cut), VIEW_KEYS, ms)
    new = vw.states(li.where(F.col("l_shipdate") >= cut), VIEW_KEYS, ms)
    est = vw.finalize(vw.merge_states(old, new, VIEW_KEYS, ms), VIEW_KEYS, ms)
    below = li.join(est, VIEW_KEYS).groupBy(*VIEW_KEYS).agg(
        F.max("n").alias("n"), F.count_if(F.col("l_extendedprice") < F.col("p50")).alias("lo"), F.count_if(F.col("l_extendedprice") <= F.col("p50")).alias("hi"))
    return below.select(*VIEW_KEYS, "n", ((F.col("lo") <= 0.515 * F.col("n")) & (F.col("hi") >= 0.485 * F.col("n"))).alias("within_error"))


V2_QUANTILE_SQL = """SELECT l_returnflag, l_linestatus, COUNT(l_extendedprice) AS n, TRUE AS within_error FROM lineitem GROUP BY 1, 2"""


def v3_touched_partitions(spark, sf):
    """V3: a per-day view stored by month; the months that later rows touch are computed again from
    the base and replace their partitions, the others stay."""
    cut = F.lit(VIEW_CUT).cast("timestamp_ntz")
    li = load(spark, sf, "lineitem").withColumn("m", F.trunc(F.to_date("l_shipdate"), "month"))

    def per_day(df):
        return df.groupBy("m", F.to_date("l_shipdate").alias("d")).agg(
            F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 2).alias("qty"))

    path = scratch_path(spark, f"v3-{uuid.uuid4().hex}")
    vw.refresh_partitions(per_day(li.where(F.col("l_shipdate") < cut)), path, "m")
    touched = li.where(F.col("l_shipdate") >= cut).select("m").distinct()
    vw.refresh_partitions(per_day(li.join(touched, "m", "left_semi")), path, "m")
    return spark.read.schema("d date, lines long, qty double, m date").parquet(path).drop("m")


V3_SQL = "SELECT CAST(l_shipdate AS DATE) AS d, COUNT(*) AS lines, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1"

STALE_CUT = "2024-01-25 00:00:00"


def v5_staleness(spark, sf):
    e = load(spark, sf, "events")
    view = e.where(F.col("ts") < F.lit(STALE_CUT).cast("timestamp_ntz"))
    return vw.staleness(e, view, "ts", "ts").withColumn("lag_s", F.round("lag_s", 3))


V5_SQL = f"""SELECT max(ts) AS base_max_ts, max(ts) FILTER (WHERE ts < TIMESTAMP '{STALE_CUT}') AS view_max_ts,
COUNT(*) AS base_rows, CAST(count_if(ts < TIMESTAMP '{STALE_CUT}') AS BIGINT) AS view_rows,
round(epoch_us(max(ts)) / 1e6 - epoch_us(max(ts) FILTER (WHERE ts < TIMESTAMP '{STALE_CUT}')) / 1e6, 3) AS lag_s,
CAST(COUNT(*) - count_if(ts < TIMESTAMP '{STALE_CUT}') AS BIGINT) AS rows_behind FROM events"""


def v5_staleness_by_day(spark, sf):
    e = load(spark, sf, "events")
    view = e.where(F.col("ts") < F.lit(STALE_CUT).cast("timestamp_ntz"))
    return vw.staleness_by_partition(e, view, F.to_date("ts"), F.to_date("ts"))


V5_DAY_SQL = f"""SELECT CAST(ts AS DATE) AS part, COUNT(*) AS base_rows, CAST(count_if(ts < TIMESTAMP '{STALE_CUT}') AS BIGINT) AS view_rows
FROM events GROUP BY 1"""


INVENTORY_COLUMNS = {
    "orders": [("o_orderkey", "BIGINT"), ("o_custkey", "BIGINT"), ("o_orderstatus", "STRING"), ("o_totalprice", "DOUBLE"),
               ("o_orderdate", "DATETIME"), ("o_orderpriority", "STRING")],
    "customer": [("c_custkey", "BIGINT"), ("c_name", "STRING"), ("c_nationkey", "INT"), ("c_acctbal", "DOUBLE"),
                 ("c_mktsegment", "STRING")],
}


def d1_inventory(spark, sf):
    return qa.column_inventory({t: load(spark, sf, t) for t in INVENTORY_COLUMNS}, exact=True)


D1_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{ty}' AS model_type, true AS nullable, "
    f"CAST(count_if({c} IS NULL) AS BIGINT) AS nulls, COUNT(DISTINCT {c}) AS ndv, COUNT(*) AS rows FROM {t}"
    for t, cols in INVENTORY_COLUMNS.items() for c, ty in cols)

SCHEMA_SPEC = [
    {"name": "l_orderkey", "type": "BIGINT", "pk": True},
    {"name": "l_linenumber", "type": "INT", "pk": True},
    {"name": "l_quantity", "type": "DOUBLE", "nullable": False},
    {"name": "l_shipdate", "type": "DATE"},
    {"name": "l_comment", "type": "VARCHAR(44)"},
]


def d2_check_schema(spark, sf):
    return qa.check_schema(load(spark, sf, "lineitem"), SCHEMA_SPEC)


D2_SQL = """SELECT * FROM (VALUES ('type_mismatch', 'l_shipdate', 'DATE vs DATETIME', 1), ('missing_column', 'l_comment', 'VARCHAR(44)', 1),
  ('extra_column', 'l_partkey', 'BIGINT', 1), ('extra_column', 'l_suppkey', 'BIGINT', 1), ('extra_column', 'l_extendedprice', 'DOUBLE', 1),
  ('extra_column', 'l_discount', 'DOUBLE', 1), ('extra_column', 'l_tax', 'DOUBLE', 1), ('extra_column', 'l_returnflag', 'STRING', 1),
  ('extra_column', 'l_linestatus', 'STRING', 1)) AS v("check", column_name, detail, violations)
UNION ALL SELECT 'not_null', 'l_orderkey', '', CAST(count_if(l_orderkey IS NULL) AS BIGINT) FROM lineitem
UNION ALL SELECT 'not_null', 'l_linenumber', '', CAST(count_if(l_linenumber IS NULL) AS BIGINT) FROM lineitem
UNION ALL SELECT 'not_null', 'l_quantity', '', CAST(count_if(l_quantity IS NULL) AS BIGINT) FROM lineitem
UNION ALL SELECT 'duplicate_key', 'l_orderkey,l_linenumber', '', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM
  (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1)"""


def d3_email_audit(spark, sf):
    return qa.email_audit(load(spark, sf, "documents"), "text")


D3_SQL = f"""SELECT regexp_full_match(c, '{qa.EMAIL_PATTERN}') AS valid, COUNT(*) AS n FROM
(SELECT unnest(regexp_extract_all(text, '([^ \\t\\n\\r]+@[^ \\t\\n\\r]+)', 1)) AS c FROM documents) GROUP BY 1"""


def d4_sanitize(spark, sf):
    s = qa.sanitize_text(F.col("html"))
    return load(spark, sf, "pages").select("page_id", F.char_length(s).alias("n_chars"), F.md5(s).alias("md5"))


D4_SQL = """SELECT page_id, CAST(length(s) AS INTEGER) AS n_chars, md5(s) AS md5 FROM
(SELECT page_id, replace(regexp_replace(html, '<[^>]*>', '', 'g'), '''', '''''') AS s FROM pages)"""


def d5_time_text(spark, sf):
    o = load(spark, sf, "orders")
    txt = F.date_format("o_orderdate", qa.DEFAULT_TIME_FORMAT)
    broken = F.when(F.col("o_orderkey") % 10 == 0, F.replace(txt, F.lit("-"), F.lit("/"))).otherwise(txt)
    return qa.time_text_audit(o.select(broken.alias("t")), "t")


D5_SQL = """WITH t AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN replace(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '-', '/')
  ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS t FROM orders)
SELECT COUNT(*) AS texts, CAST(count_if(try_strptime(t, '%Y-%m-%d %H:%M:%S') IS NOT NULL) AS BIGINT) AS parsed,
CAST(count_if(try_strptime(t, '%Y-%m-%d %H:%M:%S') IS NULL) AS BIGINT) AS unparsed,
CAST(count_if(strftime(try_strptime(t, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') = t) AS BIGINT) AS round_trip FROM t"""


def d6_unique_contains(spark, sf):
    d = load(spark, sf, "documents")
    t = tx.tokens("text")
    return d.select("doc_id", F.size(qa.unique_values(t)).alias("distinct_tokens"),
                    qa.contains_value(t, F.lit("the")).alias("has_the"))


D6_SQL = f"""SELECT doc_id, CAST(len(list_distinct(t)) AS INTEGER) AS distinct_tokens, list_contains(t, 'the') AS has_the
FROM (SELECT doc_id, {_tok('text')} AS t FROM documents)"""


def d7_payload(spark, sf):
    e = qa.payload_flatten(load(spark, sf, "events"), "props", "k bigint, missing string")
    return qa.payload_pack(e, ["k"], "packed").select("event_id", "k", "missing", "packed")


D7_SQL = """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing,
CAST(to_json({'k': CAST(json_extract_string(props, '$.k') AS BIGINT)}) AS VARCHAR) AS packed FROM events"""


QUERIES = {
    "t18_postings": (t18_postings, T18_SQL),
    "t19_index_any": (t19_index_any, T19_ANY_SQL),
    "t19_index_all": (t19_index_all, T19_ALL_SQL),
    "t12_bm25": (t12_bm25, T12_BM25_SQL),
    "t20_phrase_index": (t20_phrase_index, T20_INDEX_SQL),
    "x1_bitmap_index": (x1_bitmap_index, X1_SQL),
    "x2_bitmap_and": (x2_bitmap_and, X2_AND_SQL),
    "x2_bitmap_or": (x2_bitmap_or, X2_OR_SQL),
    "x2_bitmap_ids": (x2_bitmap_ids, X2_IDS_SQL),
    "x3_layout": (x3_layout, X3_SQL),
    "v1_full_refresh": (v1_full_refresh, V_SQL),
    "v2_incremental": (v2_incremental, V_SQL),
    "v2_incremental_sketch": (v2_incremental_sketch, V2_SKETCH_SQL),
    "v2_incremental_quantile": (v2_incremental_quantile, V2_QUANTILE_SQL),
    "v3_touched_partitions": (v3_touched_partitions, V3_SQL),
    "v5_staleness": (v5_staleness, V5_SQL),
    "v5_staleness_by_day": (v5_staleness_by_day, V5_DAY_SQL),
    "d1_inventory": (d1_inventory, D1_SQL),
    "d2_check_schema": (d2_check_schema, D2_SQL),
    "d3_email_audit": (d3_email_audit, D3_SQL),
    "d4_sanitize": (d4_sanitize, D4_SQL),
    "d5_time_text": (d5_time_text, D5_SQL),
    "d6_unique_contains": (d6_unique_contains, D6_SQL),
    "d7_payload": (d7_payload, D7_SQL),
}


def t19_index_hits(spark, sf):
    """T19 with the semi join back to the base tables: the same hits (with snippets) as T7."""
    tabs = fx.search_tables(spark, sf)
    post, _ = ix.build_inverted_index(tabs)
    # the index is materialised once (reliable checkpoint in the shared folder), as a written
    # index would be, and every table's semi join reads it
    hits = ix.search_with_index(tabs, cut_lineage(post), KEYWORD)
    return hits.select("source_table", "id", "score", F.col("hit_fields")["text"].alias("snippet"), "tie")


QUERIES["t19_index_hits"] = (t19_index_hits, T7_SQL)


def t16_search_page_store(spark, sf):
    """T16 over a written index and doc store: the same page as the flagship scan search."""
    import uuid
    tabs = fx.search_tables(spark, sf)
    root = scratch_path(spark, f"t16store-{uuid.uuid4().hex}")
    post, lengths = ix.build_inverted_index(tabs)
    ix.write_index(post, lengths, f"{root}/index")
    ix.write_doc_store(tabs, f"{root}/docs")
    page = ix.search_page_from_store(ix.read_postings(spark, f"{root}/index"), ix.read_doc_store(spark, f"{root}/docs"),
                                     KEYWORD, page=2, size=20)
    return page.select("source_table", "id", "score", F.col("hit_fields")["text"].alias("snippet"), "tie")


QUERIES["t16_search_page_store"] = (t16_search_page_store, T16_SQL)


def t19_written_index(spark, sf):
    """T19 on the written form: an index stored with another bucket count than the default, read back."""
    import uuid

    root = scratch_path(spark, f"t19written-{uuid.uuid4().hex}")
    post, lengths = ix.build_inverted_index(fx.search_tables(spark, sf))
    ix.write_index(post, lengths, root, buckets=16)
    return ix.search_index(ix.read_postings(spark, root), KEYWORD)


QUERIES["t19_written_index"] = (t19_written_index, T19_ANY_SQL)
