"""Named search queries (T1-T23) with their DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions import text as tx
from tidepool.operators import search as se
from tidepool.plans import fixtures as fx
from tidepool.session import load

KEYWORD = "license"
TWO_WORDS = "MIT License"

# DuckDB twin of the standard tokenizer.
DUCK_TOKENS = "list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
DUCK_SNIPPET = ("CASE WHEN instr(lower({c}), lower('{kw}')) > 0 THEN CASE WHEN length({c}) > 100 "
                "THEN substr({c}, 1, 100) || '...' ELSE {c} END END")


def _tok(c):
    return DUCK_TOKENS.format(c=c)


def _snip(c, kw):
    return DUCK_SNIPPET.format(c=c, kw=kw)


def _duck_hits(pred_fmt: str, kw: str, score: str = "CAST(1.0 AS DOUBLE)") -> str:
    """UNION ALL of the three search tables in the hit schema (flat)."""
    parts = [
        ("documents", "doc_id", "''"),
        ("conversations", "conv_id", "CAST(turn AS VARCHAR)"),
        ("benchmark", "item_id", "''"),
    ]
    sel = []
    for t, idc, tie in parts:
        sel.append(
            f"SELECT '{t}' AS source_table, CAST({idc} AS VARCHAR) AS id, {score.replace('{c}', 'text')} AS score, "
            f"{_snip('text', kw)} AS snippet, {tie} AS tie FROM {t} WHERE {pred_fmt.replace('{c}', 'text')}"
        )
    return " UNION ALL ".join(sel)


def _flat(hits):
    return hits.select("source_table", "id", "score", F.col("hit_fields")["text"].alias("snippet"), "tie")


# ---------------------------------------------------------------- queries

def t1_tokens(spark, sf):
    d = load(spark, sf, "documents")
    t = tx.tokens("text")
    return d.select("doc_id", F.size(t).cast("bigint").alias("n_tokens"),
                    F.try_element_at(t, F.lit(1)).alias("first_token"), F.try_element_at(t, F.lit(-1)).alias("last_token"))


T1_SQL = f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, t[1] AS first_token, t[-1] AS last_token
FROM (SELECT doc_id, {_tok('text')} AS t FROM documents)
"""


def t1_vocabulary(spark, sf):
    """Distinct tokens with document frequency over all documents (partial aggregation per token)."""
    d = load(spark, sf, "documents")
    toks = d.select("doc_id", F.explode(F.array_distinct(tx.tokens("text"))).alias("token"))
    return toks.groupBy("token").agg(F.count(F.lit(1)).alias("doc_freq"))


T1_VOCAB_SQL = f"""
SELECT token, COUNT(*) AS doc_freq FROM (
  SELECT DISTINCT doc_id, unnest({_tok('text')}) AS token FROM documents) GROUP BY token
"""


def t2_english_tokens(spark, sf):
    d = load(spark, sf, "documents")
    t = tx.tokens("text", "english")
    return d.select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.try_element_at(t, F.lit(1)).alias("first_token"))


_STOP = ", ".join(f"'{w}'" for w in tx.ENGLISH_STOP_WORDS)
T2_SQL = f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, t[1] AS first_token FROM (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'),
                             lambda x: x <> '' AND NOT list_contains([{_STOP}], x)) AS t FROM documents)
"""


def t4_match_any(spark, sf):
    d = load(spark, sf, "documents")
    return d.where(tx.match_any("text", TWO_WORDS)).select("doc_id", "lang", "source")


T4_SQL = f"""
SELECT doc_id, lang, source FROM documents
WHERE coalesce(list_has_any({_tok('text')}, ['mit', 'license']), false)
"""


def t5_match_all(spark, sf):
    d = load(spark, sf, "documents")
    return d.where(tx.match_all("text", TWO_WORDS)).select("doc_id", "lang", "source")


T5_SQL = f"""
SELECT doc_id, lang, source FROM documents
WHERE coalesce(list_has_all({_tok('text')}, ['mit', 'license']), false)
"""


def t6_match_fields(spark, sf):
    p = load(spark, sf, "part")
    return p.where(tx.match_fields(["p_name", "p_type", "p_brand"], "red bolt", "any")).select("p_partkey")


T6_SQL = f"""
SELECT p_partkey FROM part WHERE
  coalesce(list_has_any({_tok('p_name')}, ['red', 'bolt']), false)
  OR coalesce(list_has_any({_tok('p_type')}, ['red', 'bolt']), false)
  OR coalesce(list_has_any({_tok('p_brand')}, ['red', 'bolt']), false)
"""


def t7_search(spark, sf):
    hits = se.search(fx.search_tables(spark, sf), KEYWORD)
    return _flat(hits)


T7_SQL = _duck_hits(f"coalesce(list_has_any({_tok('{c}')}, ['license']), false)", KEYWORD)


def t7_search_all(spark, sf):
    hits = se.search(fx.search_tables(spark, sf), TWO_WORDS, recall_priority=False)
    return _flat(hits)


T7_ALL_SQL = _duck_hits(f"coalesce(list_has_all({_tok('{c}')}, ['mit', 'license']), false)", TWO_WORDS)


def t16_search_page(spark, sf):
    """Flagship: search three tables, order by score then (table, id, tie), second page of 20."""
    page = se.search_page(fx.search_tables(spark, sf), KEYWORD, page=2, size=20)
    return _flat(page)


T16_SQL = f"""
SELECT * FROM ({T7_SQL}) ORDER BY score DESC, source_table, id, tie LIMIT 20 OFFSET 20
"""


def t16_total_hits(spark, sf):
    hits = se.search(fx.search_tables(spark, sf), KEYWORD, document=False)
    return hits.groupBy().agg(F.count(F.lit(1)).alias("total_hits"))


T16_TOTAL_SQL = f"SELECT COUNT(*) AS total_hits FROM ({T7_SQL})"


def t12_tf_score(spark, sf):
    hits = se.search(fx.search_tables(spark, sf), TWO_WORDS, score="tf")
    return _flat(hits)


T12_SQL = _duck_hits(
    f"coalesce(list_has_any({_tok('{c}')}, ['mit', 'license']), false)", TWO_WORDS,
    score="CAST(len(list_filter(" + _tok("text") + ", lambda x: x IN ('mit', 'license'))) AS DOUBLE)",
)


def t13_time_range(spark, sf):
    """T13/T14 on events as a searchable table: time range and equality filters ANDed."""
    e = load(spark, sf, "events")
    t = se.SearchTable("events", e, ["props"], id_col="event_id", ts_col="ts")
    hits = se.search([t], "69", time_range=("2024-01-05 00:00:00", "2024-01-12 00:00:00"),
                     filters={"event_type": ["click", "error"]})
    return hits.select("source_table", "id", "ts")


T13_SQL = f"""
SELECT 'events' AS source_table, CAST(event_id AS VARCHAR) AS id, ts FROM events
WHERE coalesce(list_has_any({_tok('props')}, ['69']), false)
  AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'
  AND event_type IN ('click', 'error')
"""


def t17_capped(spark, sf):
    """Each table's first 5 hits in the hit order (score, then id and tie)."""
    hits = se.search(fx.search_tables(spark, sf), KEYWORD, document=False)
    return _flat(se.top_hits_per_table(hits, 5)).drop("snippet")


T17_SQL = """
SELECT * FROM (
 (SELECT 'documents' AS source_table, CAST(doc_id AS VARCHAR) AS id, CAST(1.0 AS DOUBLE) AS score, '' AS tie
   FROM documents WHERE coalesce(list_has_any({d}, ['license']), false) ORDER BY 2, 4 LIMIT 5)
 UNION ALL
 (SELECT 'conversations', CAST(conv_id AS VARCHAR), CAST(1.0 AS DOUBLE), CAST(turn AS VARCHAR) FROM conversations
   WHERE coalesce(list_has_any({d}, ['license']), false) ORDER BY 2, 4 LIMIT 5)
 UNION ALL
 (SELECT 'benchmark', CAST(item_id AS VARCHAR), CAST(1.0 AS DOUBLE), '' FROM benchmark
   WHERE coalesce(list_has_any({d}, ['license']), false) ORDER BY 2, 4 LIMIT 5))
""".replace("{d}", _tok("text"))


def t8_search_long(spark, sf):
    p = load(spark, sf, "part")
    t = se.SearchTable("part", p, ["p_name", "p_type"], id_col="p_partkey")
    return se.search_long([t], "small").select("source_table", "id", "field", "content", "snippet")


T8_SQL = f"""
SELECT 'part' AS source_table, CAST(p_partkey AS VARCHAR) AS id, 'p_name' AS field, p_name AS content,
       {_snip('p_name', 'small')} AS snippet FROM part WHERE coalesce(list_has_any({_tok('p_name')}, ['small']), false)
UNION ALL
SELECT 'part', CAST(p_partkey AS VARCHAR), 'p_type', p_type, {_snip('p_type', 'small')}
FROM part WHERE coalesce(list_has_any({_tok('p_type')}, ['small']), false)
"""


def t9_snippets(spark, sf):
    """T9 over every document: snippet of the whole keyword string (NULL when absent)."""
    d = load(spark, sf, "documents")
    return d.select("doc_id", tx.snippet("text", "the MIT License").alias("snippet"))


T9_SQL = f"SELECT doc_id, {_snip('text', 'the MIT License')} AS snippet FROM documents"


def t10_hit_ids(spark, sf):
    """The id rule on every search table (last column named id / *_id)."""
    tabs = fx.search_tables(spark, sf) + [se.SearchTable("labels", load(spark, sf, "labels"), None)]
    rows = [t.df.select(F.lit(t.name).alias("source_table"), se._hit_id(t).alias("id")) for t in tabs]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("source_table").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("min_id"),
                                           F.max("id").alias("max_id"))


T10_SQL = """
SELECT source_table, COUNT(*) AS n, min(id) AS min_id, max(id) AS max_id FROM (
  SELECT 'documents' AS source_table, CAST(doc_id AS VARCHAR) AS id FROM documents
  UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR) FROM conversations
  UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR) FROM benchmark
  UNION ALL SELECT 'labels', CAST(doc_id AS VARCHAR) FROM labels) GROUP BY source_table
"""


def t20_phrase(spark, sf):
    d = load(spark, sf, "documents")
    return d.where(tx.match_phrase("text", "under the MIT License")).select("doc_id")


T20_SQL = f"""
SELECT doc_id FROM (SELECT doc_id, {_tok('text')} AS t FROM documents)
WHERE len(list_filter(range(1, len(t) - 2), lambda i: t[i] = 'under' AND t[i + 1] = 'the' AND t[i + 2] = 'mit' AND t[i + 3] = 'license')) > 0
"""


def t20_bool(spark, sf):
    d = load(spark, sf, "documents")
    pred = tx.match_bool("text", must=["license"], must_not=["apache"])
    return d.where(pred).select("doc_id")


T20_BOOL_SQL = f"""
SELECT doc_id FROM (SELECT doc_id, {_tok('text')} AS t FROM documents)
WHERE coalesce(list_contains(t, 'license'), false) AND NOT coalesce(list_contains(t, 'apache'), false)
"""


def t21_log_search(spark, sf):
    e = load(spark, sf, "events")
    return se.log_search(e, ts_col="ts", level_col="event_type", message_col="props", levels=["error"],
                         time_range=("2024-01-03 00:00:00", "2024-01-20 00:00:00"), keywords="7",
                         k=50, tiebreak="event_id").select("event_id", "ts", "event_type", "props")


T21_SQL = f"""
SELECT event_id, ts, event_type, props FROM events
WHERE event_type IN ('error') AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'
  AND coalesce(list_has_any({_tok('props')}, ['7']), false)
ORDER BY ts DESC, event_id DESC LIMIT 50
"""


def t22_like(spark, sf):
    p = load(spark, sf, "part")
    return p.where(tx.like_search("p_name", "%GEAR%", "ilike") | tx.like_search("p_type", "Promo", "contains")) \
        .select("p_partkey", "p_name")


T22_SQL = """
SELECT p_partkey, p_name FROM part
WHERE coalesce(p_name ILIKE '%GEAR%', false) OR coalesce(instr(lower(p_type), 'promo') > 0, false)
"""


def t23_fields(spark, sf):
    """No fields given -> every string column of part is searched."""
    p = load(spark, sf, "part")
    t = se.SearchTable("part", p, None, id_col="p_partkey")
    return se.search([t], "economy gizmo", document=False).select("source_table", "id")


T23_SQL = f"""
SELECT 'part' AS source_table, CAST(p_partkey AS VARCHAR) AS id FROM part WHERE
  coalesce(list_has_any({_tok('p_name')}, ['economy', 'gizmo']), false) OR coalesce(list_has_any({_tok('p_brand')}, ['economy', 'gizmo']), false)
  OR coalesce(list_has_any({_tok('p_type')}, ['economy', 'gizmo']), false)
"""


QUERIES = {
    "t1_tokens": (t1_tokens, T1_SQL),
    "t1_vocabulary": (t1_vocabulary, T1_VOCAB_SQL),
    "t2_english_tokens": (t2_english_tokens, T2_SQL),
    "t4_match_any": (t4_match_any, T4_SQL),
    "t5_match_all": (t5_match_all, T5_SQL),
    "t6_match_fields": (t6_match_fields, T6_SQL),
    "t7_search": (t7_search, T7_SQL),
    "t7_search_all": (t7_search_all, T7_ALL_SQL),
    "t8_search_long": (t8_search_long, T8_SQL),
    "t9_snippets": (t9_snippets, T9_SQL),
    "t10_hit_ids": (t10_hit_ids, T10_SQL),
    "t12_tf_score": (t12_tf_score, T12_SQL),
    "t13_time_range": (t13_time_range, T13_SQL),
    "t16_search_page": (t16_search_page, T16_SQL),
    "t16_total_hits": (t16_total_hits, T16_TOTAL_SQL),
    "t17_capped": (t17_capped, T17_SQL),
    "t20_phrase": (t20_phrase, T20_SQL),
    "t20_bool": (t20_bool, T20_BOOL_SQL),
    "t21_log_search": (t21_log_search, T21_SQL),
    "t22_like": (t22_like, T22_SQL),
    "t23_fields": (t23_fields, T23_SQL),
}
