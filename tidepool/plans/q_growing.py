"""Queries over the index forms that are stored and grow: boolean trees, segments, ranked pages, trigrams
(T20, T18, T12 / T16, T22), with DuckDB twins."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tidepool.operators import boolean as bq
from tidepool.operators import grams as gr
from tidepool.operators import index as ix
from tidepool.operators import ranked as rk
from tidepool.operators import segments as sg
from tidepool.operators import sliced as sl
from tidepool.operators.search import SearchTable
from tidepool.plans import fixtures as fx
from tidepool.plans.q_index import INDEXED_SQL, T12_BM25_SQL
from tidepool.plans.q_search import TWO_WORDS, _tok
from tidepool.session import load, scratch_path
from tidepool.sources import clustered as cl
from tidepool.sources import loading


def _fresh(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


# ---------------------------------------------------------------- T20

def _wide_tables(spark, sf):
    return [SearchTable("documents", load(spark, sf, "documents"), ["text", "lang"]),
            SearchTable("conversations", load(spark, sf, "conversations"), ["text", "role"], tiebreak=("turn",))]


#: (mit and license, or the phrase "of the") and (english, or said by the assistant) and not apache
TREE = (bq.Term("mit license", all=True) | bq.Phrase("of the")) & (bq.Term("en", "lang") | bq.Term("assistant", "role")) & ~bq.Term("apache")


def t20_tree(spark, sf):
    """A nested query over two fields of two tables, from the postings."""
    post, lengths = ix.build_inverted_index(_wide_tables(spark, sf))
    return bq.search_postings(TREE, post, lengths)


def t20_tree_scan(spark, sf):
    """The same query as a predicate over the rows."""
    return bq.search_rows(_wide_tables(spark, sf), TREE)


_HAS = "coalesce(list_contains(t, '{}'), false)"
T20_TREE_SQL = f"""WITH r AS (
  SELECT 'documents' AS source_table, CAST(doc_id AS VARCHAR) AS id, '' AS tie, {_tok('text')} AS t, {_tok('lang')} AS l, CAST([] AS VARCHAR[]) AS who FROM documents
  UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), {_tok('text')}, CAST([] AS VARCHAR[]), {_tok('role')} FROM conversations)
SELECT source_table, id, tie FROM r
WHERE (({_HAS.format('mit')} AND {_HAS.format('license')})
   OR coalesce(len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) > 0, false))
  AND (coalesce(list_contains(l, 'en'), false) OR coalesce(list_contains(who, 'assistant'), false))
  AND NOT {_HAS.format('apache')} AND NOT coalesce(list_contains(l, 'apache'), false) AND NOT coalesce(list_contains(who, 'apache'), false)"""


def t20_not_alone(spark, sf):
    """A NOT without anything beside it, taken from all rows of the index."""
    post, lengths = ix.build_inverted_index(fx.search_tables(spark, sf))
    return bq.search_postings(~(bq.Term("license") | bq.Phrase("of the")), post, lengths)


T20_NOT_SQL = f"""WITH {INDEXED_SQL} SELECT source_table, id, tie FROM rows
WHERE NOT {_HAS.format('license')} AND NOT coalesce(len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) > 0, false)"""


# ---------------------------------------------------------------- T18

# Fixed value: the language whose documents are deleted from the index again.
GONE_LANG = "de"


def t18_segments(spark, sf):
    """One segment per table, the documents of one language deleted, one table indexed again in place of itself, all
    merged; the postings equal those of one build over the rows that are left."""
    root, tables = _fresh(spark, "t18"), fx.search_tables(spark, sf)
    for t in tables:
        sg.append(spark, root, [t], buckets=16)
    gone = load(spark, sf, "documents").where(F.col("lang") == GONE_LANG)
    sg.delete(spark, root, gone.select(F.lit("documents").alias("source_table"), F.col("doc_id").cast("string").alias("id"), F.lit("").alias("tie")))
    sg.append(spark, root, [t for t in tables if t.name == "benchmark"], replace=True)
    sg.merge(spark, root)
    return sg.read_postings(spark, root).select("source_table", "id", "tie", "token", "tf", F.element_at("positions", 1).alias("first_pos"),
                                                F.size("positions").alias("n_pos"))


T18_SEGMENTS_SQL = f"""WITH {INDEXED_SQL.replace("FROM documents", f"FROM documents WHERE lang IS DISTINCT FROM '{GONE_LANG}'")}
SELECT source_table, id, tie, token, COUNT(*) AS tf, CAST(min(pos) AS INTEGER) AS first_pos, CAST(COUNT(*) AS INTEGER) AS n_pos FROM (
  SELECT source_table, id, tie, unnest(t) AS token, unnest(range(len(t))) AS pos FROM rows)
GROUP BY source_table, id, tie, token"""


# ---------------------------------------------------------------- T12 / T16

def _ranked(spark, sf):
    root = _fresh(spark, "ranked")
    rk.write_ranked(*ix.build_inverted_index(fx.search_tables(spark, sf)), root, buckets=16)
    return root


def t16_ranked_page(spark, sf):
    """The second page of the best scores, from the blocks that can hold one."""
    return rk.ranked_page(spark, _ranked(spark, sf), TWO_WORDS, page=2, size=10)


T16_RANKED_SQL = f"""SELECT * FROM ({T12_BM25_SQL.replace("), 6) AS score", "), 9) AS score")})
ORDER BY score DESC, source_table, id, tie LIMIT 10 OFFSET 10"""


# ---------------------------------------------------------------- T22

# Fixed value: the pattern of the trigram search.
PATTERN = "%the MIT lic_nse%"


def t22_trigrams(spark, sf):
    """A pattern over all search tables, by trigram postings and a check of the candidates."""
    root, tables = _fresh(spark, "grams"), fx.search_tables(spark, sf)
    gr.write_grams(tables, root, buckets=16)
    return gr.like_rows(tables, gr.read_grams(spark, root), PATTERN, "ilike")


T22_GRAMS_SQL = f"""SELECT 'documents' AS source_table, 'text' AS field, CAST(doc_id AS VARCHAR) AS id, '' AS tie FROM documents WHERE text ILIKE '{PATTERN}'
UNION ALL SELECT 'conversations', 'text', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR) FROM conversations WHERE text ILIKE '{PATTERN}'
UNION ALL SELECT 'benchmark', 'text', CAST(item_id AS VARCHAR), '' FROM benchmark WHERE text ILIKE '{PATTERN}'"""


# ---------------------------------------------------------------- X1 / X2

#: orders of a price range that are not of two statuses, or have an early date
def _orders_where():
    price, status = sl.Range("o_totalprice", 20_000.0, 150_000.0), sl.In("o_orderstatus", ("F", "P"))
    return (price & ~status) | sl.Range("o_orderdate", None, dt.datetime(1992, 6, 1), True)


def _orders_index(spark, sf):
    o = load(spark, sf, "orders").withColumn("id", F.concat(F.lit("order "), F.col("o_orderkey")))
    return sl.build_sliced_index(o, ["o_totalprice", "o_orderstatus", "o_orderdate"], "id")


def x2_sliced_count(spark, sf):
    """Ranges and NOT over bit-sliced bitmaps of number, text and time columns."""
    return sl.count_where(_orders_index(spark, sf), _orders_where())


def x2_sliced_ids(spark, sf):
    """The text ids of the same rows."""
    return sl.ids_where(_orders_index(spark, sf), _orders_where())


_ORDERS_WHERE = """(o_totalprice >= 20000 AND o_totalprice < 150000 AND NOT o_orderstatus IN ('F', 'P')) OR o_orderdate <= TIMESTAMP '1992-06-01'"""
X2_COUNT_SQL = f"SELECT COUNT(*) AS rows FROM orders WHERE {_ORDERS_WHERE}"
X2_SLICED_IDS_SQL = f"SELECT 'order ' || o_orderkey AS id FROM orders WHERE {_ORDERS_WHERE}"


# ---------------------------------------------------------------- S4 / L21 / X3, L20

# The customer and the dates of the lookups.
LOOKUP_CUSTOMER, LOOKUP_DATES = 7, ("1995-03-01 00:00:00", "1995-04-01 00:00:00")


def s4_clustered_lookup(spark, sf):
    """Orders laid out by the advised columns; a point and a range lookup of the files that can hold them."""
    root, o = _fresh(spark, "clustered"), load(spark, sf, "orders")
    cl.write_clustered(o, root, ["o_custkey", "o_orderdate"], files=16)
    times = tuple(dt.datetime.fromisoformat(t) for t in LOOKUP_DATES)
    one = cl.read_clustered(spark, root, {"o_custkey": LOOKUP_CUSTOMER}).withColumn("lookup", F.lit("customer"))
    some = cl.read_clustered(spark, root, ranges={"o_orderdate": times}).withColumn("lookup", F.lit("month"))
    return one.unionByName(some).select("lookup", *o.columns)


S4_CLUSTERED_SQL = f"""SELECT 'customer' AS lookup, * FROM orders WHERE o_custkey = {LOOKUP_CUSTOMER}
UNION ALL SELECT 'month', * FROM orders WHERE o_orderdate >= TIMESTAMP '{LOOKUP_DATES[0]}' AND o_orderdate < TIMESTAMP '{LOOKUP_DATES[1]}'"""


def l20_bucketed(spark, sf):
    """Orders and lineitem written in buckets of their order, read back and joined bucket by bucket; rows and quantity per
    order priority."""
    own = uuid.uuid4().hex
    names = {t: f"l20_{t}_{own}" for t in ("orders", "lineitem")}
    loading.write_bucketed(load(spark, sf, "orders"), names["orders"], ["o_orderkey"], 8, ["o_orderkey"])
    loading.write_bucketed(load(spark, sf, "lineitem"), names["lineitem"], ["l_orderkey"], 8, ["l_orderkey"])
    j = spark.table(names["lineitem"]).join(spark.table(names["orders"]).hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 2).alias("qty"))


L20_BUCKETED_SQL = """SELECT o_orderpriority, COUNT(*) AS lines, round(sum(l_quantity), 2) AS qty
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"""


QUERIES = {
    "s4_clustered_lookup": (s4_clustered_lookup, S4_CLUSTERED_SQL),
    "l20_bucketed": (l20_bucketed, L20_BUCKETED_SQL),
    "x2_sliced_count": (x2_sliced_count, X2_COUNT_SQL),
    "x2_sliced_ids": (x2_sliced_ids, X2_SLICED_IDS_SQL),
    "t20_tree": (t20_tree, T20_TREE_SQL),
    "t20_tree_scan": (t20_tree_scan, T20_TREE_SQL),
    "t20_not_alone": (t20_not_alone, T20_NOT_SQL),
    "t18_segments": (t18_segments, T18_SEGMENTS_SQL),
    "t16_ranked_page": (t16_ranked_page, T16_RANKED_SQL),
    "t22_trigrams": (t22_trigrams, T22_GRAMS_SQL),
}
