"""Derived indexes (T18, T19, T20 index form, X1-X3).

Postings are an ordinary table: one row per (table, field, row, token) with the term
frequency and positions.  It is written partitioned by a token hash bucket, so a lookup of
a few tokens reads only their buckets (``PartitionFilters``), and sorted by token inside each
file so parquet min/max statistics skip row groups.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions import text as tx
from tidepool.operators.search import SearchTable, _hit_id, _tie, hit_id_column, row_filter, searchable_fields
from tidepool.session import spread_for_write
from tidepool.sources.loading import drop_layout, read_layout, write_layout

TOKEN_BUCKETS = 64
# BM25 parameters (the published defaults).
BM25_K1 = 1.2
BM25_B = 0.75
#: tokens whose postings are made at once; a field is never divided
PART_TOKENS = 1 << 19


def token_bucket(token: Column, buckets: int = TOKEN_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _grouped(b: pa.RecordBatch) -> pa.RecordBatch:
    """The postings of the fields of a batch, whose ``toks`` are the tokens of one text or of several."""
    texts = b.column("toks")
    n_texts = pc.list_value_length(texts).to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(texts.flatten()).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.repeat(np.arange(b.num_rows), n_texts), sizes)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    coded = texts.flatten().flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own = row * len(coded.dictionary) + code
    # the positions of one text are in order already
    order = np.lexsort((pos, own)) if (n_texts > 1).any() else np.argsort(own, kind="stable")
    first = np.flatnonzero(np.diff(own[order], prepend=-1))
    ends = np.append(first, len(order))
    of, token = pa.array(row[order[first]]), pa.array(code[order[first]])
    return pa.RecordBatch.from_arrays([
        *[b.column(c).take(of) for c in ("source_table", "field", "id", "tie", "length")], coded.dictionary.take(token), pa.array(np.diff(ends)),
        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(pos[order].astype(np.int32)))],
        ["source_table", "field", "id", "tie", "length", "token", "tf", "positions"])


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings by parts of a batch of about ``PART_TOKENS`` tokens."""
    for b in batches:
        n = pc.list_value_length(b.column("toks")).to_numpy(zero_copy_only=False) * b.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(n) - n) // PART_TOKENS
        cuts = [*np.flatnonzero(np.diff(part, prepend=-1)), b.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            yield _grouped(b.slice(low, high - low))


def build_inverted_index(tables: list[SearchTable], parser: str = "standard",
                         slices: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, doc_lengths).

    postings: source_table, field, id, tie, length, token, tf, positions (0-based token positions)
    doc_lengths: source_table, field, id, tie, length (tokens in the field)
    Grouping is per (row, field, token), so a very common token never forms one big group.
    The field's length rides on each of its postings, so ranking needs no join back to the rows.
    """
    rows_of = []
    for t in tables:
        if t.id_col is None and hit_id_column(t.df) is None:
            raise ValueError(f"table {t.name} has no id column: its rows cannot be told apart in an index")
        fields = t.fields or searchable_fields(t.df)
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
        rows_of.append(t.df.select(F.lit(t.name).alias("source_table"), _hit_id(t).alias("id"), _tie(t).alias("tie"),
                                   pairs.alias("p")))
    rows = reduce(lambda a, b: a.unionByName(b), rows_of)
    # lengths need no row of another task: the scan's splits share the work, and no text is moved
    long = rows.select("source_table", "id", "tie", F.explode("p").alias("p")) \
        .select("source_table", "id", "tie", F.col("p.field").alias("field"), tx.tokens(F.col("p.value"), parser).alias("toks"))
    lengths = long.select("source_table", "field", "id", "tie", F.coalesce(F.size("toks"), F.lit(0)).alias("length"))
    # rows are hash-partitioned by their key once (moving texts, not exploded tokens): the
    # per-(row, field, token) aggregation below is then clustered already and needs no
    # shuffle of the exploded occurrences
    # an explicit count: tokenising is CPU work, and AQE would coalesce by bytes (texts are
    # small next to the work they cause) down to a few tasks
    n = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "source_table", "id", "tie")
    # a row's tokens are grouped within the row, so no occurrence is a row of a sort; rows that share a key
    # lie in one group and their fields of one length are indexed as one
    held = rows.groupBy("source_table", "id", "tie").agg(F.flatten(F.collect_list("p")).alias("p"))
    fields_of = held.select("source_table", "id", "tie", F.transform("p", lambda p: F.struct(
        p["field"].alias("field"), tx.tokens(p["value"], parser).alias("toks"))).alias("f"))
    kinds = F.array_distinct(F.transform("f", lambda x: F.struct(x["field"].alias("field"), F.coalesce(F.size(x["toks"]), F.lit(0)).alias("length"))))
    # outer, so that no filter is inferred that tokenises every text a second time
    per_field = fields_of.select("source_table", "id", "tie", "f", F.explode_outer(kinds).alias("k")).where("k.length > 0").select(
        "source_table", F.col("k.field").alias("field"), "id", "tie", F.col("k.length").alias("length"),
        F.filter("f", lambda x: (x["field"] == F.col("k.field")) & (F.size(x["toks"]) == F.col("k.length"))).alias("f"))
    post = per_field.select("source_table", "field", "id", "tie", "length", F.transform("f", lambda x: x["toks"]).alias("toks")).mapInArrow(
        _in_parts, "source_table string, field string, id string, tie string, length int, token string, tf bigint, positions array<int>")
    return post, lengths


def field_stats(lengths: DataFrame) -> DataFrame:
    """(source_table, field, n_docs, avgdl): what ranking needs to know of each field."""
    return lengths.groupBy("source_table", "field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avgdl"))


def write_index(postings: DataFrame, lengths: DataFrame, path: str, buckets: int = TOKEN_BUCKETS, parser: str = "standard") -> None:
    """T18 layout: postings partitioned by token bucket and sorted by token; field stats beside.

    The bucket count and the parser are stored with the index and read back by every lookup.
    Rows that share a key (table, id, tie) are refused: their postings would run together.
    Texts are tokenised once: rows are counted from their keys alone, and the tokens of a field
    are summed over the written postings."""
    spark = lengths.sparkSession
    keys = lengths.groupBy("source_table", "field", "id", "tie").count()
    # one row per (table, field)
    rows = keys.groupBy("source_table", "field").agg(
        F.count(F.lit(1)).alias("n_docs"), F.max(F.struct("count", "id", "tie")).alias("most")).collect()
    for r in rows:
        if r["most"]["count"] > 1:
            raise ValueError(f"table {r['source_table']}: id {r['most']['id']} with tie {r['most']['tie']} is not unique")
    drop_layout(spark, path)
    p = postings.withColumn("bucket", token_bucket(F.col("token"), buckets))
    # the bucket of a very common token ("the") is split over several writers by its size; each file
    # is sorted by token so row-group statistics prune lookups
    spread_for_write(p, ["bucket"]).sortWithinPartitions("bucket", "token") \
        .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    n_docs = spark.createDataFrame([(r["source_table"], r["field"], r["n_docs"]) for r in rows],
                                   "source_table string, field string, n_docs long")
    toks = spark.read.parquet(f"{path}/postings").groupBy("source_table", "field").agg(F.sum("tf").alias("toks"))
    n_docs.join(toks, ["source_table", "field"], "left") \
        .select("source_table", "field", "n_docs", (F.coalesce("toks", F.lit(0)) / F.col("n_docs")).alias("avgdl")) \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    write_layout(spark, path, {"buckets": int(buckets), "parser": parser})


def read_stats(spark, path: str) -> DataFrame:
    """The field stats of a written index (a row per table and field)."""
    read_layout(spark, path)
    return spark.read.parquet(f"{path}/stats")


def _with_layout(df: DataFrame, col: str, layout: dict) -> DataFrame:
    """The stored layout travels with the frame, as metadata of its bucket column."""
    return df.withColumn(col, F.col(col).alias(col, metadata={"layout": json.dumps(layout)}))


def _layout_of(df: DataFrame, col: str) -> dict:
    raw = df.schema[col].metadata.get("layout")
    if raw is None:
        raise ValueError("the frame does not carry its layout: read it with read_postings / read_doc_store")
    return json.loads(raw)


def read_postings(spark, path: str) -> DataFrame:
    return _with_layout(spark.read.parquet(f"{path}/postings"), "bucket", read_layout(spark, path))


def lookup(postings: DataFrame, toks: list[str], parser: str | None = None) -> DataFrame:
    """Postings of the given tokens.  On a written index the bucket predicate (constant
    folded to literals) prunes the partitions that cannot hold the tokens; the bucket count is
    the stored one, and another parser than the index was built with is refused."""
    pred = F.col("token").isin(toks)
    if "bucket" in postings.columns:
        layout = _layout_of(postings, "bucket")
        if parser is not None and parser != layout["parser"]:
            raise ValueError(f"the index was built with parser {layout['parser']!r}, not {parser!r}")
        pred = pred & F.col("bucket").isin([token_bucket(F.lit(t), layout["buckets"]) for t in toks])
    return postings.where(pred)


def search_index(postings: DataFrame, keywords: str, recall_priority: bool = True, parser: str = "standard") -> DataFrame:
    """Hit keys (source_table, id, tie) by token lookup; equals the scan (T4/T5) by
    construction. All-mode needs every token in one field, so it counts per field first."""
    toks = tx.keyword_tokens(keywords, parser)
    hits = lookup(postings, toks, parser)
    if recall_priority:
        return hits.select("source_table", "id", "tie").distinct()
    per_field = hits.groupBy("source_table", "field", "id", "tie").agg(F.count_distinct("token").alias("n"))
    return per_field.where(F.col("n") == len(toks)).select("source_table", "id", "tie").distinct()


def bm25(postings: DataFrame, stats: DataFrame, keywords: str, parser: str = "standard",
         k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """T12 option ``bm25``: Okapi BM25 per (table, field, row) for the keyword tokens, summed
    over fields: idf = ln(1 + (N - df + 0.5) / (df + 0.5)),
    score = sum idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)).
    ``stats`` holds N and avgdl per (table, field): ``read_stats`` of a written index, or
    ``field_stats``.  A search costs its tokens' postings, not the corpus."""
    toks = tx.keyword_tokens(keywords, parser)
    hits = lookup(postings, toks, parser)
    dfreq = hits.groupBy("source_table", "field", "token").agg(F.count(F.lit(1)).alias("df"))
    j = hits.join(dfreq, ["source_table", "field", "token"]).join(stats, ["source_table", "field"])
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf").cast("double")
    part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("avgdl")))
    return j.groupBy("source_table", "id", "tie").agg(F.sum(part).alias("score"))


def match_phrase_index(postings: DataFrame, phrase: str, parser: str = "standard") -> DataFrame:
    """T20 index form: rows whose field has the phrase tokens at consecutive positions.

    Per (row, field) only the phrase tokens' position lists are gathered (bounded by the
    phrase length), then ``exists(p in pos(t1): for all j, p + j in pos(t_j+1))``.
    """
    toks = tx.keyword_tokens(phrase, parser, dedup=False)
    uniq = list(dict.fromkeys(toks))
    hits = lookup(postings, uniq, parser)
    g = hits.groupBy("source_table", "field", "id", "tie").agg(
        F.map_from_entries(F.collect_list(F.struct("token", "positions"))).alias("m"))
    g = g.where(F.size("m") == len(uniq))
    first = F.col("m")[F.lit(toks[0])]
    cond = F.exists(first, lambda p: reduce(lambda a, c: a & c, [
        F.array_contains(F.col("m")[F.lit(t)], p + j) for j, t in enumerate(toks)]))
    return g.where(cond).select("source_table", "id", "tie").distinct()


# ---------------------------------------------------------------- bitmap index

def build_bitmap_index(df: DataFrame, cols: list[str], id_col: str) -> DataFrame:
    """Value -> bitmap of row ids, per 32768-id bucket (ids must be >= 0; stored as id+1).

    Rows: column, value (as string), bucket, bitmap (binary), rows.
    The rows of one bitmap are brought together before it is built: bitmaps made where rows happen to lie
    would be as many as rows, at 4096 bytes each, in the shuffle and the sort of their merge.
    """
    pos = F.col(id_col).cast("bigint") + 1
    parts = []
    for c in cols:
        parts.append(df.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"),
                               F.bitmap_bucket_number(pos).alias("bucket"), F.bitmap_bit_position(pos).alias("bit")))
    long = reduce(lambda a, b: a.unionByName(b), parts).repartition("value", "bucket")
    return long.groupBy("column", "value", "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"),
                                                         F.count(F.lit(1)).alias("rows"))


def _bitmap_result(index: DataFrame, preds: dict, op: str) -> DataFrame:
    """(bucket, bitmap) of AND / OR over ``column IN values`` predicates: per bucket an OR over
    the values of one predicate, then AND (only buckets where every predicate is present) or OR."""
    per = []
    for i, (c, vals) in enumerate(preds.items()):
        vals = [str(v) for v in (vals if isinstance(vals, (list, tuple, set)) else [vals])]
        per.append(index.where((F.col("column") == c) & F.col("value").isin(vals))
                   .groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap")).withColumn("pred", F.lit(i)))
    u = reduce(lambda a, b: a.unionByName(b), per)
    if op == "and":
        return u.groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"),
                                       F.count_distinct("pred").alias("n")).where(F.col("n") == len(preds)).drop("n")
    if op == "or":
        return u.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    raise ValueError("op must be 'and' or 'or'")


def bitmap_filter(index: DataFrame, preds: dict, op: str = "and") -> DataFrame:
    """Number of rows matching AND / OR of the predicates (``bitmap_count`` over buckets)."""
    return _bitmap_result(index, preds, op).agg(
        F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).cast("bigint").alias("rows"))


def bitmap_ids(index: DataFrame, preds: dict, op: str = "and") -> DataFrame:
    """The ids of the rows matching AND / OR of the predicates, read off the set bits of the
    result bitmaps (a bucket's bitmap is 4096 bytes; bytes without a bit are dropped at once)."""
    at = _bitmap_result(index, preds, op).select(
        "bucket", "bitmap", F.explode(F.sequence(F.lit(0), F.length("bitmap") - 1)).alias("at"))
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.col("at") + 1, F.lit(1))), 16, 10).cast("int")
    held = at.select("bucket", "at", byte.alias("byte")).where("byte > 0")
    bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: F.call_function("getbit", F.col("byte"), i) == 1)
    return held.withColumn("bit", F.explode(bits)).select(
        ((F.col("bucket") - 1) * 32768 + F.col("at") * 8 + F.col("bit")).cast("bigint").alias("id"))


# ---------------------------------------------------------------- layout advice

# Layout advice thresholds.
BITMAP_MAX_NDV = 1000
BUCKET_MIN_DISTINCT_SHARE = 0.5
INVERTED_MIN_AVG_LENGTH = 32


def recommend_layout(df: DataFrame, exact: bool = False) -> DataFrame:
    """Per column NDV, null share, mean text length and type -> partition / bucket /
    bitmap / inverted / none advice.  One aggregate pass, unpivoted with ``stack``."""
    fields = df.schema.fields
    ndv = F.count_distinct if exact else F.approx_count_distinct
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        c = F.col(f.name)
        aggs += [ndv(c).alias(f"_n{i}"), F.count_if(c.isNull()).alias(f"_z{i}"),
                 (F.avg(F.char_length(c)) if isinstance(f.dataType, T.StringType) else F.lit(None).cast("double")).alias(f"_l{i}")]
    wide = df.agg(*aggs)
    n = len(fields)
    stack = "stack({n}, {rows}) as (column, type, ndv, nulls, avg_length)".format(
        n=n, rows=", ".join(f"'{f.name}', '{f.dataType.simpleString()}', _n{i}, _z{i}, _l{i}" for i, f in enumerate(fields)))
    long = wide.selectExpr("_rows", stack)
    is_time = F.col("type").startswith("timestamp") | (F.col("type") == "date")
    share = F.col("ndv") / F.col("_rows")
    advice = (F.when(is_time, F.lit("partition"))
              .when((F.col("type") == "string") & (F.col("avg_length") >= INVERTED_MIN_AVG_LENGTH), F.lit("inverted"))
              .when(F.col("ndv") <= BITMAP_MAX_NDV, F.lit("bitmap"))
              .when(share >= BUCKET_MIN_DISTINCT_SHARE, F.lit("bucket"))
              .otherwise(F.lit("none")))
    return long.select("column", "type", F.col("ndv").cast("bigint").alias("ndv"),
                       (F.col("nulls") / F.col("_rows")).alias("null_share"), "avg_length", advice.alias("advice"))


def search_with_index(tables: list[SearchTable], postings: DataFrame, keywords: str, recall_priority: bool = True,
                      parser: str = "standard", document: bool = False, hit_max_bytes: int | None = None,
                      time_range=None, filters=None) -> DataFrame:
    """T19 full form: hit keys from the postings (no text matching), then a semi join back
    to each base table for the hit schema (snippets, optional document).  Equals the scan
    search (T7) by construction.  The hit-key side is broadcast only when its estimated size
    is under ``hit_max_bytes`` (default: the relational broadcast bound)."""
    from tidepool.functions import text as tx_
    from tidepool.operators.relational import BROADCAST_MAX_BYTES, broadcast_if_small

    keys = search_index(postings, keywords, recall_priority, parser)
    parts = []
    for t in tables:
        fields = t.fields or searchable_fields(t.df)
        k = keys.where(F.col("source_table") == F.lit(t.name)).select(F.col("id").alias("_kid"), F.col("tie").alias("_ktie"))
        k = broadcast_if_small(k, hit_max_bytes or BROADCAST_MAX_BYTES)
        base = t.df
        if time_range is not None or filters:
            # T13 / T14 on the base rows (pushed into the scan), then the semi join
            base = base.where(row_filter(t, time_range, filters))
        base = base.withColumn("_kid", _hit_id(t)).withColumn("_ktie", _tie(t))
        rows = base.join(k, on=["_kid", "_ktie"], how="left_semi")
        doc = F.to_json(F.struct(*[F.col(c) for c in t.df.columns])) if document else F.lit(None).cast("string")
        parts.append(rows.select(
            F.lit(t.name).alias("source_table"), F.col("_kid").alias("id"), F.lit(1.0).cast("double").alias("score"),
            doc.alias("document"), tx_.hit_fields(fields, keywords).alias("hit_fields"),
            (F.col(t.ts_col).cast("timestamp_ntz") if t.ts_col else F.lit(None).cast("timestamp_ntz")).alias("ts"),
            F.col("_ktie").alias("tie")))
    return reduce(lambda a, b: a.unionByName(b), parts)



# ---------------------------------------------------------------- doc store: fetch only the page's rows

DOC_BUCKETS = 256


def id_bucket(id_col: Column, buckets: int = DOC_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int")


def write_doc_store(tables: list[SearchTable], path: str, buckets: int = DOC_BUCKETS, document: bool = False) -> None:
    """The searchable fields of every row, partitioned by (table, id bucket), so the rows of a
    result page are fetched from a few partitions instead of scanning the texts."""
    parts = []
    for t in tables:
        fields = t.fields or searchable_fields(t.df)
        doc = F.to_json(F.struct(*[F.col(c) for c in t.df.columns])) if document else F.lit(None).cast("string")
        parts.append(t.df.select(
            F.lit(t.name).alias("source_table"), _hit_id(t).alias("id"), _tie(t).alias("tie"),
            F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f).cast("string") for f in fields]))
            .alias("fields"), doc.alias("document"),
            (F.col(t.ts_col).cast("timestamp_ntz") if t.ts_col else F.lit(None).cast("timestamp_ntz")).alias("ts")))
    rows = reduce(lambda a, b: a.unionByName(b), parts).withColumn("id_bucket", id_bucket(F.col("id"), buckets))
    drop_layout(rows.sparkSession, path)
    spread_for_write(rows, ["source_table", "id_bucket"]).sortWithinPartitions("source_table", "id_bucket", "id") \
        .write.mode("overwrite").partitionBy("source_table", "id_bucket").parquet(path)
    write_layout(rows.sparkSession, path, {"buckets": int(buckets)})


def read_doc_store(spark, path: str) -> DataFrame:
    return _with_layout(spark.read.parquet(path), "id_bucket", read_layout(spark, path))


def search_page_from_store(postings: DataFrame, store: DataFrame, keywords: str, page: int = 1, size: int = 10,
                           recall_priority: bool = True, parser: str = "standard", max_size: int | None = None) -> DataFrame:
    """T16 over the index: the hit keys come from token lookups, the page is cut from the keys
    (score is constant, so the order is (table, id, tie)), and only the page's rows are read
    from the doc store - the join on its partition columns lets dynamic partition pruning
    skip every other bucket.  Hit fields hold the snippets (T9) of the fields that hold the
    whole keyword string."""
    from tidepool.functions import text as tx_
    from tidepool.operators.search import order_hits
    from tidepool.plans import sqlapi

    keys = search_index(postings, keywords, recall_priority, parser).withColumn("score", F.lit(1.0).cast("double"))
    page_keys = sqlapi.paginate(keys, page, size, order_hits(None), max_size) \
        .withColumn("id_bucket", id_bucket(F.col("id"), _layout_of(store, "id_bucket")["buckets"]))
    rows = store.join(page_keys, ["source_table", "id_bucket", "id", "tie"], "inner")
    snippets = F.transform_values("fields", lambda k, v: tx_.snippet(v, keywords))
    return rows.select("source_table", "id", "score", "document",
                       F.map_filter(snippets, lambda k, v: v.isNotNull()).alias("hit_fields"), "ts", "tie")
