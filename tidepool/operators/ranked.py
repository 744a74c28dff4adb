"""A ranked page from the index without reading all postings of its tokens (T12, T16): impact blocks.

A task takes the rows of its postings in chunks, orders a chunk's rows by length and cuts them into blocks of ``ROWS``
rows, so a block's rows score alike for a token.  A posting carries its impact, the part of its BM25 score that does
not depend on the query.  What leaves the task are lists: a row per token of the chunk with the blocks and the places
there of its rows and what their impacts are made of, packed into bytes, and a row per block without a token that has
the keys by place.  So the shuffle moves neither keys nor a row per posting; a posting is a row of the files again, that names its
row by block and place.  A block table holds, per token and block, the greatest impact and the count.  A query reads the block
table of its tokens, takes a threshold from the blocks of the greatest bounds, and then reads only the blocks whose
bound reaches it.  The page equals that of ``index.bm25`` over all postings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import text as tx
from tidepool.operators import index as ix
from tidepool.operators.relational import broadcast_if_small
from tidepool.operators.search import order_hits
from tidepool.plans import sqlapi
from tidepool.session import cut_lineage, spread_for_write
from tidepool.sources.loading import drop_layout, read_layout, write_layout

KEY = ["source_table", "id", "tie"]
#: rows of a block
ROWS = 128
#: postings of a chunk, whose rows are ordered at a time; a row is never divided
CHUNK = 1 << 20
#: the bucket of the rows that hold the keys of a block
KEYS_BUCKET = -1
#: rows of a page of the posting files: what a scan can pass over
PAGE_ROWS = 2000
#: blocks that a scan may name one by one
NAMED_BLOCKS = 2000
#: scores are rounded, so that equal rows tie whatever the order of their sums; bounds are not
DIGITS, SLACK = 9, 1e-8


_LISTS = "source_table string, field string, token string, packed binary, start long, keys array<struct<id: string, tie: string>>"
_POSTINGS = "bucket int, source_table string, field string, token string, block long, place int, impact double, most double, n long, " \
    "keys array<struct<id: string, tie: string>>"
_KEYS = pa.list_(pa.struct([("id", pa.string()), ("tie", pa.string())]))
#: bits of a block's number in its partition, and of the partition; the length of the rows is above
_NUMBER_BITS = 21
_FIELDS = ["source_table", "field", *KEY[1:], "length", "token", "tf"]


def _row_starts(t: pa.Table) -> np.ndarray:
    """Where the postings of another row begin."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in KEY:
        x = t.column(c).combine_chunks()
        new[1:] |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _codes(x: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    coded = x.combine_chunks().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _pack(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Whole numbers from 0 on as bytes of seven bits, the last of each below 128; one item from each of ``starts`` on."""
    sizes = np.ones(len(values), np.int64)
    for j in range(1, 10):
        sizes += (values >> np.uint64(7 * j)) > 0
    at = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    for j in range(int(sizes.max())):
        m = sizes > j
        out[at[m] + j] = (values[m] >> np.uint64(7 * j)) & np.uint64(127) | (sizes[m] > j + 1).astype(np.uint64) << np.uint64(7)
    ends = np.append(at[starts], len(out)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(out)])


def _unpack(packed: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers, how many there are in each item)."""
    sizes = pc.binary_length(packed).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(packed.to_pylist()), np.uint8)
    last = raw < 128
    ends = np.flatnonzero(last)
    starts = np.append(0, ends[:-1] + 1)
    values = np.zeros(len(ends), np.uint64)
    for j in range(int((ends - starts).max()) + 1):
        m = starts + j <= ends
        values[m] |= (raw[starts[m] + j] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * j)
    upto = np.append(0, np.cumsum(last))[np.append(0, np.cumsum(sizes))]
    return values, np.diff(upto)


def _steps(x: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Steps from number to number, from 0 at each of ``firsts``, with the sign as the lowest bit."""
    x = x.astype(np.int64)
    d = np.diff(x, prepend=0)
    d[firsts] = x[firsts]
    return (d << 1 ^ d >> 63).astype(np.uint64)


def _from_steps(u: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    d = (u >> np.uint64(1)).astype(np.int64) ^ -(u & np.uint64(1)).astype(np.int64)
    upto = np.cumsum(d)
    return upto - np.repeat(upto[firsts] - d[firsts], sizes)


def _blocks(t: pa.Table, starts: np.ndarray, number: int, rows: int) -> tuple[int, list[pa.RecordBatch]]:
    """(blocks, their lists of postings and their keys) of whole rows, that begin at ``starts``."""
    (table, tables), (field, fields), (token, tokens) = (_codes(t.column(c)) for c in ("source_table", "field", "token"))
    length, tf = (t.column(c).to_numpy().astype(np.int64) for c in ("length", "tf"))
    # by table and by length, and cut within the table
    own = table[starts]
    total = np.add.reduceat(tf, starts)
    order = np.lexsort((total, own))
    own = own[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    nth = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    begins = nth % rows == 0
    block, place = np.cumsum(begins) - 1, nth % rows
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    row = np.repeat(rank, np.diff(np.append(starts, t.num_rows)))
    heads = np.flatnonzero(begins)
    # numbers follow the lengths over all partitions too, so that the blocks of a page are neighbours in the files
    longs = np.minimum(total[order][heads], (1 << 20) - 1)
    numbers = longs << 2 * _NUMBER_BITS | np.arange(len(heads)) + number
    held = pa.StructArray.from_arrays([t.column(c).combine_chunks().take(pa.array(starts[order])) for c in KEY[1:]], ["id", "tie"])
    held = pa.ListArray.from_arrays(pa.array(np.append(heads, len(own)).astype(np.int32)), held)
    key = (table * len(fields) + field) * len(tokens) + token
    at = block[row] * rows + place[row]
    by = np.lexsort((at, key))
    lists = np.flatnonzero(np.diff(key[by], prepend=-1))
    one = by[lists]
    packed = np.stack([_steps(at[by], lists), tf[by].astype(np.uint64), _steps(length[by], lists), _steps(longs[block[row[by]]], lists)], 1)
    n = len(heads)
    names = ["source_table", "field", "token", "packed", "start", "keys"]
    return n, [pa.RecordBatch.from_arrays([tables.take(pa.array(table[one])), fields.take(pa.array(field[one])), tokens.take(pa.array(token[one])),
                                           _pack(packed.ravel(), lists * 4), pa.array(np.full(len(one), number)), pa.nulls(len(one), _KEYS)], names),
               pa.RecordBatch.from_arrays([tables.take(pa.array(own[heads])), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()),
                                           pa.array(numbers), held], names)]


def _postings(batches: Iterator[pa.RecordBatch], rows: int, avgdl: dict, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """A row per posting of the lists, of which the first of a block has the greatest impact and the count of all; rows of keys as they are."""
    names = ["bucket", "source_table", "field", "token", "block", "place", "impact", "most", "n", "keys"]
    for batch in batches:
        is_list = pc.is_valid(batch.column("token"))
        t, k = batch.filter(is_list), batch.filter(pc.invert(is_list))
        if k.num_rows:
            yield pa.RecordBatch.from_arrays([
                *[k.column(c) for c in names[:4]], k.column("start"), *[pa.nulls(k.num_rows, x) for x in (pa.int32(), pa.float64(), pa.float64(), pa.int64())],
                k.column("keys")], names)
        if not t.num_rows:
            continue
        values, sizes = _unpack(t.column("packed"))
        at, tf, length, longs = values.reshape(-1, 4).T
        sizes = sizes // 4
        lists = np.cumsum(sizes) - sizes
        at, length, longs = (_from_steps(x, lists, sizes) for x in (at, length, longs))
        of = np.repeat(np.arange(t.num_rows), sizes)
        block = longs << 2 * _NUMBER_BITS | at // rows + t.column("start").to_numpy()[of]
        mean = [avgdl.get(x) for x in zip(t.column("source_table").to_pylist(), t.column("field").to_pylist(), strict=True)]
        tf = tf.astype(np.float64)
        impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / np.array(mean, np.float64)[of]))
        first = np.diff(block, prepend=-1) != 0
        first[lists] = True
        firsts = np.flatnonzero(first)
        most, n = np.zeros(len(of)), np.zeros(len(of), np.int64)
        most[firsts], n[firsts] = np.maximum.reduceat(impact, firsts), np.diff(np.append(firsts, len(of)))
        own = pa.array(of)
        yield pa.RecordBatch.from_arrays([
            *[t.column(c).take(own) for c in names[:4]], pa.array(block), pa.array((at % rows).astype(np.int32)), pa.array(impact),
            pa.array(most, mask=~first), pa.array(n, mask=~first), pa.nulls(len(of), _KEYS)], names)


def _in_blocks(batches: Iterator[pa.RecordBatch], chunk: int, rows: int) -> Iterator[pa.RecordBatch]:
    number, held, size, wanted = TaskContext.get().partitionId() << _NUMBER_BITS, [], 0, chunk
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < wanted:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        starts = _row_starts(t)
        last = int(starts[-1])  # this row may go on
        if last:
            n, out = _blocks(t.slice(0, last), starts[:-1], number, rows)
            yield from out
            number += n
        held = t.slice(last).to_batches()
        size = t.num_rows - last
        wanted = max(chunk, 2 * size)
    if size:
        t = pa.Table.from_batches(held).combine_chunks()
        yield from _blocks(t, _row_starts(t), number, rows)[1]


def write_ranked(postings: DataFrame, lengths: DataFrame, path: str, parser: str = "standard", buckets: int = ix.TOKEN_BUCKETS,
                 rows: int = ROWS, page_rows: int = PAGE_ROWS, k1: float = ix.BM25_K1, b: float = ix.BM25_B) -> None:
    """Write the postings with impacts, sorted by token and block, the keys of the blocks, the block table and the field stats.

    The postings of a row lie together as ``build_inverted_index`` makes them; others are brought together first."""
    spark = postings.sparkSession
    stats = cut_lineage(ix.field_stats(lengths), "stats")
    # a row per table and field
    avgdl = {(r["source_table"], r["field"]): r["avgdl"] for r in stats.collect()}
    own = postings.select(*_FIELDS).where(" and ".join(f"{c} is not null" for c in KEY))
    chunk, rows = CHUNK, int(rows)
    drop_layout(spark, path)

    def write(p: DataFrame) -> None:
        p = p.mapInArrow(lambda batches: _in_blocks(batches, chunk, rows), _LISTS)
        p = p.withColumn("bucket", F.when(F.col("token").isNull(), KEYS_BUCKET).otherwise(ix.token_bucket(F.col("token"), buckets)))
        spread_for_write(p, ["bucket"]).mapInArrow(lambda batches: _postings(batches, rows, avgdl, k1, b), _POSTINGS) \
            .sortWithinPartitions("bucket", "token", "source_table", "block").write.mode("overwrite") \
            .option("parquet.page.row.count.limit", str(page_rows)).partitionBy("bucket").parquet(f"{path}/postings")
    write(own)
    if _is_divided(spark, path):
        write(own.repartition(*KEY).sortWithinPartitions(*KEY))
    bounds = spark.read.parquet(f"{path}/postings").where((F.col("bucket") != KEYS_BUCKET) & F.col("n").isNotNull()).select(
        "bucket", "token", "source_table", "field", "block", "most", "n")
    # a file of postings is of one bucket: there is nothing to bring together
    bounds.sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    write_layout(spark, path, {"buckets": int(buckets), "parser": parser})


def _is_divided(spark: SparkSession, path: str) -> bool:
    """Whether some row is in two blocks, which bounds of blocks do not allow."""
    keys = spark.read.parquet(f"{path}/postings").where(F.col("bucket") == KEYS_BUCKET).select("source_table", F.explode("keys").alias("k"))
    return bool(keys.groupBy("source_table", "k").count().where("count > 1").limit(1).collect())


def _read(spark: SparkSession, path: str, part: str) -> DataFrame:
    return ix._with_layout(spark.read.parquet(f"{path}/{part}"), "bucket", read_layout(spark, path))


def _scores(spark: SparkSession, path: str, toks: list[str], idf: DataFrame, kept: DataFrame, parser: str) -> DataFrame:
    """Scores of the rows of the blocks ``kept`` (source_table, block); a few blocks are named in the scan's filter."""
    hits = ix.lookup(_read(spark, path, "postings"), toks, parser)
    named = [r["block"] for r in kept.select("block").distinct().limit(NAMED_BLOCKS + 1).collect()]
    if len(named) <= NAMED_BLOCKS:
        hits = hits.where(F.col("block").isin(named))
    chosen = broadcast_if_small(kept.select("source_table", "block"))
    own = ["source_table", "block"]
    hits = hits.join(chosen, own).join(broadcast_if_small(idf), ["source_table", "field", "token"])
    scores = hits.groupBy(*own, "place").agg(F.round(F.sum(F.col("idf") * F.col("impact")), DIGITS).alias("score"))
    keys = _read(spark, path, "postings").where((F.col("bucket") == KEYS_BUCKET) & F.col("token").isNull())
    if len(named) <= NAMED_BLOCKS:
        keys = keys.where(F.col("block").isin(named))
    return scores.join(keys.join(chosen, own).select(*own, "keys"), own).select(
        "source_table", F.get("keys", F.col("place")).alias("k"), "score").select("source_table", "k.id", "k.tie", "score")


def bounds_of(spark: SparkSession, path: str, toks: list[str], parser: str) -> tuple[DataFrame, DataFrame]:
    """(idf per table, field and token; the greatest score a row of each block can have, and its postings), stored."""
    blocks = ix.lookup(_read(spark, path, "blocks"), toks, parser)
    stats = spark.read.parquet(f"{path}/stats")
    found = blocks.groupBy("source_table", "field", "token").agg(F.sum("n").alias("df")).join(broadcast_if_small(stats), ["source_table", "field"])
    idf = cut_lineage(found.select("source_table", "field", "token", F.log(
        1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "idf")
    bounds = blocks.join(broadcast_if_small(idf), ["source_table", "field", "token"]).groupBy("source_table", "block").agg(
        F.sum(F.col("idf") * F.col("most")).alias("bound"), F.sum("n").alias("n"))
    return idf, cut_lineage(bounds, "bounds")


def kept_blocks(spark: SparkSession, path: str, keywords: str, wanted: int, parser: str = "standard") -> tuple[list[str], DataFrame, DataFrame]:
    """(tokens, idf, blocks whose bound reaches the ``wanted``-th best score known so far): no row of another block
    is among the first ``wanted``."""
    toks = tx.keyword_tokens(keywords, parser)
    idf, bounds = bounds_of(spark, path, toks, parser)
    # the best blocks by bound give the threshold; which ones they are changes only how much it saves
    first = bounds.orderBy(F.desc("bound"), "source_table", "block").limit(max(8, wanted // 16))
    best = _scores(spark, path, toks, idf, first, parser).orderBy(F.desc("score")).limit(wanted).agg(
        F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).first()
    if best["n"] < wanted:
        return toks, idf, bounds
    return toks, idf, bounds.where(F.col("bound") >= F.lit(best["least"] - SLACK * (1 + abs(best["least"]))))


def ranked_page(spark: SparkSession, path: str, keywords: str, page: int = 1, size: int = 10, parser: str = "standard") -> DataFrame:
    """One page of the rows by falling score (``DIGITS`` digits), then table, id and tie: (source_table, id, tie, score)."""
    toks, idf, kept = kept_blocks(spark, path, keywords, page * size, parser)
    return sqlapi.paginate(_scores(spark, path, toks, idf, kept, parser), page, size, order_hits([("score", "DESC")]))
