"""Substring and pattern search by trigram postings (T22): an index that narrows the rows before the exact check.

Every distinct run of three characters of a field, folded in case, is a posting.  A text that holds a
pattern's literal parts holds all their trigrams, so the rows with all of them are the candidates,
and only their texts are read and checked.  A pattern without three literal characters in a row
has no trigram: it is refused here and needs the scan (``text.like_search``).

Postings are lists: a task takes the rows of a field in blocks of a bounded number of trigrams and writes, per
block and trigram, the places in the block of the rows that hold it.  A last row of the block without a trigram
has the keys by place.  So the shuffle moves a row per trigram of a block, not one per trigram of every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import text as tx
from tidepool.operators import index as ix
from tidepool.operators.relational import broadcast_if_small
from tidepool.operators.search import SearchTable, _hit_id, _tie, searchable_fields
from tidepool.session import spread_for_write
from tidepool.sources.loading import drop_layout, read_layout, write_layout

KEY = ["source_table", "id", "tie"]
SIZE = 3
#: trigrams of a block, each counted once per row: what a task holds at a time; a row is never divided
BLOCK = 1 << 21
#: characters of a text whose trigrams are taken at once
SLICE = 1 << 20
#: the bucket of the rows that hold the keys of a block
KEYS_BUCKET = -1
_BITS = 21  # of a code point
_POSTINGS = "source_table string, field string, block long, token string, rows array<int>, keys array<struct<id: string, tie: string>>"
_KEYS = pa.list_(pa.struct([("id", pa.string()), ("tie", pa.string())]))


def fold(c: Column) -> Column:
    """Without case, character by character (lower-casing alone depends on a letter's place in its word)."""
    return F.upper(F.lower(c))


def _codes(text: str) -> np.ndarray:
    """The distinct trigrams of a folded text as sorted numbers."""
    parts = []
    for lo in range(0, max(0, len(text) - SIZE + 1), SLICE):
        c = np.frombuffer(text[lo:lo + SLICE + SIZE - 1].encode("utf-32-le"), "<u4").astype(np.int64)
        parts.append(np.unique(c[:-2] << 2 * _BITS | c[1:-1] << _BITS | c[2:]))
    if not parts:
        return np.empty(0, np.int64)
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def _tokens(codes: np.ndarray) -> list[str]:
    chars = np.stack([codes >> 2 * _BITS, codes >> _BITS, codes], 1) & (1 << _BITS) - 1
    text = chars.astype("<u4").tobytes().decode("utf-32-le")
    return [text[i:i + SIZE] for i in range(0, len(text), SIZE)]


def _block(own: tuple[str, str], number: int, held: list[np.ndarray], keys: list[dict]) -> Iterator[pa.RecordBatch]:
    codes = np.concatenate(held)
    order = np.argsort(codes, kind="stable")  # the rows of a trigram stay in order
    rows = np.repeat(np.arange(len(held), dtype=np.int32), [len(h) for h in held])[order]
    first = np.flatnonzero(np.diff(codes[order], prepend=-1))
    tokens = _tokens(codes[order][first])
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(rows)).astype(np.int32)), pa.array(rows))
    for toks, places, owners in ((tokens, lists, pa.nulls(len(tokens), _KEYS)),
                                 ([None], pa.nulls(1, pa.list_(pa.int32())), pa.array([keys], _KEYS))):
        n = len(toks)
        yield pa.RecordBatch.from_arrays([pa.array([own[0]] * n, pa.string()), pa.array([own[1]] * n, pa.string()), pa.array([number] * n, pa.int64()),
                                          pa.array(toks, pa.string()), places, owners],
                                         ["source_table", "field", "block", "token", "rows", "keys"])


def _in_blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    # blocks are numbered within their partition, as rows are by monotonically_increasing_id
    number = TaskContext.get().partitionId() << 32
    own, held, keys, size = None, [], [], 0
    for batch in batches:
        for table, field, key, tie, text in zip(*[batch.column(c).to_pylist() for c in ("source_table", "field", "id", "tie", "text")], strict=True):
            codes = _codes(text)
            if not len(codes):
                continue
            if held and (own != (table, field) or size + len(codes) > block):
                yield from _block(own, number, held, keys)
                number, held, keys, size = number + 1, [], [], 0
            own, size = (table, field), size + len(codes)
            held.append(codes)
            keys.append({"id": key, "tie": tie})
    if held:
        yield from _block(own, number, held, keys)


def gram_postings(tables: list[SearchTable], block: int = BLOCK) -> DataFrame:
    """(source_table, field, block, token, rows, keys): per block of a field's rows, a row per distinct trigram with the places in
    the block of the rows that hold it (``keys`` null), and one row with the keys of all places (``token`` and ``rows`` null)."""
    out = []
    for t in tables:
        for f in t.fields or searchable_fields(t.df):
            out.append(t.df.where(F.col(f).isNotNull()).select(
                F.lit(t.name).alias("source_table"), F.lit(f).alias("field"), _hit_id(t).alias("id"), _tie(t).alias("tie"),
                fold(F.col(f).cast("string")).alias("text")))
    return reduce(lambda a, b: a.unionByName(b), out).mapInArrow(lambda batches: _in_blocks(batches, block), _POSTINGS)


def write_grams(tables: list[SearchTable], path: str, buckets: int = ix.TOKEN_BUCKETS, block: int = BLOCK) -> None:
    """The postings by bucket of the trigram, sorted by it; the keys of the blocks in a bucket of their own."""
    spark = tables[0].df.sparkSession
    drop_layout(spark, path)
    p = gram_postings(tables, block).withColumn("bucket", F.when(F.col("token").isNull(), KEYS_BUCKET).otherwise(ix.token_bucket(F.col("token"), buckets)))
    spread_for_write(p, ["bucket"]).sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/grams")
    write_layout(spark, path, {"buckets": int(buckets), "parser": "grams"})


def read_grams(spark: SparkSession, path: str) -> DataFrame:
    return ix._with_layout(spark.read.parquet(f"{path}/grams"), "bucket", read_layout(spark, path))


def literal_parts(pattern: str, how: str = "contains") -> list[str]:
    """The parts of a pattern that a text must hold as they are (but for case)."""
    if how == "contains":
        return [pattern]
    if how not in ("like", "ilike"):
        raise ValueError("how must be contains, like or ilike")
    parts = re.findall(r"(?:[^%_\\]|\\.)+", pattern, re.DOTALL)
    return [re.sub(r"\\(.)", r"\1", p, flags=re.DOTALL) for p in parts]


def pattern_grams(spark: SparkSession, pattern: str, how: str = "contains") -> list[str]:
    parts = [p for p in literal_parts(pattern, how) if p]
    if not parts:
        return []
    row = spark.range(1).select(*[fold(F.lit(p)).alias(f"p{i}") for i, p in enumerate(parts)]).first()
    return sorted({p[i:i + SIZE] for p in row for i in range(len(p) - SIZE + 1)})


def candidates(postings: DataFrame, pattern: str, how: str = "contains") -> DataFrame:
    """(source_table, field, id, tie) of the fields that hold all trigrams of the pattern."""
    wanted = pattern_grams(postings.sparkSession, pattern, how)
    if not wanted:
        raise ValueError(f"pattern {pattern!r} has no {SIZE} literal characters in a row: search it by scan")
    own = ["source_table", "field", "block"]
    # a block holds a trigram once, so a block with as many lists as trigrams has them all
    places = ix.lookup(postings, wanted).groupBy(*own).agg(F.collect_list("rows").alias("lists")).where(F.size("lists") == len(wanted)).select(
        *own, F.reduce(F.slice("lists", 2, len(wanted)), F.get("lists", F.lit(0)), F.array_intersect).alias("rows"))
    keys = postings.where(F.col("token").isNull())
    if "bucket" in postings.columns:
        keys = keys.where(F.col("bucket") == KEYS_BUCKET)
    return places.join(keys.select(*own, "keys"), own).select("source_table", "field", F.explode("rows").alias("row"), "keys").select(
        "source_table", "field", F.get("keys", F.col("row")).alias("k")).select("source_table", "field", "k.id", "k.tie").distinct()


def like_rows(tables: list[SearchTable], postings: DataFrame, pattern: str, how: str = "contains") -> DataFrame:
    """(source_table, field, id, tie) of the fields that match: the candidates' texts alone are checked."""
    found = candidates(postings, pattern, how)
    out = []
    for t in tables:
        own = found.where(F.col("source_table") == t.name)
        for f in t.fields or searchable_fields(t.df):
            keys = broadcast_if_small(own.where(F.col("field") == f).select("id", "tie"))
            rows = t.df.select(_hit_id(t).alias("id"), _tie(t).alias("tie"), F.col(f).cast("string").alias("_text")).join(keys, ["id", "tie"], "left_semi")
            out.append(rows.where(tx.like_search("_text", pattern, how)).select(
                F.lit(t.name).alias("source_table"), F.lit(f).alias("field"), "id", "tie"))
    return reduce(lambda a, b: a.unionByName(b), out)
