r"""Substring dedup: words covered by a long window that an earlier document has as well.

A text's windows of ``WINDOW`` words are cut into super-k-mers: runs of consecutive windows whose
minimiser, the least hash among a window's ``MINIMISER``-word pieces, is the same.  A super-k-mer
travels as one packed string of its words to its minimiser's bucket.  Equal windows have equal
minimisers, so they meet in one bucket, where sorting tells their counts and first document.

Only minimisers found in two documents or more can hold a repeated window, so the others' strings
never travel; equal strings (copies) are sent once.  A bucket too large for one task is not kept
together: its windows are dealt out one by one, by their own hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import batch_rows, drop_stored, in_chunks, own_columns, settled, stored, window_hashes, word_hashes

WINDOW, MINIMISER = 50, 8
#: words a bucket may hold in one task
BUCKET_WORDS = 2_000_000


def super_kmers(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, number of windows) of each run of windows."""
    pieces = window_hashes(word_hashes(words), MINIMISER)
    span = WINDOW - MINIMISER + 1
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # running minimum over `span` pieces by doubling
    low, have = pieces, 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    low = np.minimum(low[:n], low[span - have:span - have + n])
    first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    return low[first], first, np.diff(np.append(first, n))


def _light(batch):
    ids, marks, mins, firsts, counts = [], [], [], [], []
    for doc_id, mark, text in batch_rows(batch, "doc_id", "mark", "text"):
        m, first, n = super_kmers((text or b"").split())
        ids.append(np.full(len(m), doc_id, np.int64))
        marks.append(np.full(len(m), mark, np.int64))
        mins.append(m.astype(np.int64))
        firsts.append(first)
        counts.append(n)
    join = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))
    return pa.RecordBatch.from_arrays([join(x) for x in (mins, ids, marks, firsts, counts)], ["minimiser", "doc_id", "mark", "first", "n"])


def _packed(batch):
    """The strings of a document's super-k-mers that were asked for."""
    mins, ids, marks, firsts, counts, strings, prints = [], [], [], [], [], [], []
    for doc_id, mark, text, runs in batch_rows(batch, "doc_id", "mark", "text", "runs"):
        words = (text or b"").split()
        for run in runs:
            at, n = run["first"], run["n"]
            string = b" ".join(words[at:at + n + WINDOW - 1])
            mins.append(run["minimiser"])
            ids.append(doc_id)
            marks.append(mark)
            firsts.append(at)
            counts.append(n)
            strings.append(string)
            prints.append(xxhash.xxh3_128_digest(string))
    return pa.RecordBatch.from_arrays(
        [*[pa.array(x, pa.int64()) for x in (mins, ids, marks, firsts, counts)],
         pa.array(strings, pa.binary()), pa.array(prints, pa.binary())], ["minimiser", "doc_id", "mark", "first", "n", "string", "print"])


def _windows(string: bytes) -> list[bytes]:
    """128-bit hashes of a string's windows."""
    ends = [-1, *[i for i, c in enumerate(string) if c == 32], len(string)]
    view = memoryview(string)
    return [xxhash.xxh3_128_digest(view[ends[k] + 1:ends[k + WINDOW]]) for k in range(len(ends) - WINDOW)]


def _spans(places: list[int]) -> list[dict]:
    """Runs of consecutive window places."""
    out: list[dict] = []
    for p in sorted(set(places)):
        if out and out[-1]["last"] == p - 1:
            out[-1]["last"] = p
        else:
            out.append({"from": p, "last": p})
    return out


_SPANS = pa.list_(pa.struct([("from", pa.int64()), ("last", pa.int64())]))


def _sort_buckets(batches):
    """Per string the windows that a smaller document than the string's first has."""
    def settle(rows):
        windows = sorted((h, doc, k, at) for k, (_, doc, string) in enumerate(rows) for at, h in enumerate(_windows(string)))
        found: dict[int, list[int]] = {}
        last, least = None, 0
        for h, doc, k, at in windows:  # the least document of a window comes first
            if h != last:
                last, least = h, doc
            elif doc > least:
                found.setdefault(k, []).append(at)
        return [(rows[k][0], _spans(places)) for k, places in found.items()]

    now, rows, out = None, [], []
    for batch in batches:
        for minimiser, mark, doc, string in batch_rows(batch, "minimiser", "print", "doc_id", "string"):
            if minimiser != now and rows:
                out += settle(rows)
                rows = []
                if len(out) > 5000:
                    yield _found(out)
                    out = []
            now = minimiser
            rows.append((mark, doc, string))
    out += settle(rows)
    yield _found(out)


def _found(out):
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], _SPANS)], ["print", "spans"])


def _explode_windows(batch):
    prints, docs, ats, hashes = [], [], [], []
    for mark, doc, string in batch_rows(batch, "print", "doc_id", "string"):
        own = _windows(string)
        prints += [mark] * len(own)
        docs += [doc] * len(own)
        ats += range(len(own))
        hashes += own
    return pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(docs, pa.int64()), pa.array(ats, pa.int64()),
                                       pa.array(hashes, pa.binary())], ["print", "doc_id", "at", "window"])


def repeated_runs(documents: DataFrame, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(doc_id, mark, first, last): runs of windows of (doc_id, mark, text) that a smaller doc_id has as well; ``mark`` tells
    texts of one doc_id apart."""
    light = stored(documents.mapInArrow(lambda b: in_chunks(b, _light), "minimiser long, doc_id long, mark long, first long, n long"), "kmers")
    shared = light.groupBy("minimiser").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("minimiser")
    asked = light.join(shared, "minimiser").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("minimiser", "first", "n")).alias("runs"))
    strings = stored(documents.join(asked, ["doc_id", "mark"]).mapInArrow(
        lambda b: in_chunks(b, _packed), "minimiser long, doc_id long, mark long, first long, n long, string binary, print binary"), "strings")
    drop_stored(light)

    distinct = strings.groupBy("print").agg(
        F.min(F.struct("doc_id", "minimiser", "n", "string")).alias("s"), F.count("*").alias("times")).select(
        "print", "s.doc_id", "s.minimiser", "s.n", "s.string", "times")
    distinct = stored(distinct, "distinct")
    sizes = distinct.groupBy("minimiser").agg(F.sum(F.col("n") + WINDOW - 1).alias("words"), F.count("*").alias("k")).where("k > 1")
    small = distinct.join(sizes.where(F.col("words") <= bucket_words).select("minimiser"), "minimiser", "left_semi")
    large = distinct.join(sizes.where(F.col("words") > bucket_words).select("minimiser"), "minimiser", "left_semi")

    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = "print binary, spans array<struct<from: long, last: long>>"
    sorted_in = small.select("minimiser", "print", "doc_id", "string").repartition(n, "minimiser").sortWithinPartitions(
        "minimiser").mapInArrow(_sort_buckets, spans)
    single = large.select("print", "doc_id", "string").mapInArrow(
        lambda b: in_chunks(b, _explode_windows), "print binary, doc_id long, at long, window binary")
    least = single.groupBy("window").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("window", "a")
    dealt = single.join(least, "window").where("doc_id > a").select(
        "print", F.array(F.struct(F.col("at").alias("from"), F.col("at").alias("last"))).alias("spans"))
    found = sorted_in.union(dealt)

    # the string's first document loses the windows found; later ones hold the string again, and lose it all
    at = strings.select("print", "doc_id", "mark", "first", "n")
    firsts = distinct.select("print", F.col("doc_id").alias("own"), "times")
    copies = at.join(firsts.where("times > 1").drop("times"), "print").where("doc_id > own").select(
        "doc_id", "mark", "first", (F.col("first") + F.col("n") - 1).alias("last"))
    own = at.join(firsts.drop("times"), "print").where("doc_id = own").join(found, "print").select(
        "doc_id", "mark", "first", F.explode("spans").alias("s")).select(
        "doc_id", "mark", (F.col("first") + F.col("s.from")).alias("first"), (F.col("first") + F.col("s.last")).alias("last"))
    return copies.union(own)


def _strip(with_text: bool):
    def work(batch):
        out = []
        for doc_id, text, runs in batch_rows(batch, "doc_id", "text", "runs"):
            words = (text or b"").split()
            n = len(words)
            if runs:
                cover = np.zeros(n + 1, np.int64)
                np.add.at(cover, [r["first"] for r in runs], 1)
                np.add.at(cover, [r["last"] + WINDOW for r in runs], -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:n]) == 0)]
            kept = b" ".join(words)
            out.append((doc_id, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                          ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
    return lambda batches: in_chunks(batches, work)


def dedup_substrings(documents: DataFrame, with_text: bool = True, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and, with ``with_text``, kept_text (the
    kept words joined by single spaces).

    A word goes if some window of ``WINDOW`` consecutive words that covers it also starts in a
    document with a smaller doc_id, judged on the input; repeats within one document stay.  A null
    or blank text has no words; texts shorter than a window lose none.  Rows that repeat a doc_id
    count as one document as to which is first, and are returned each with its own removals.  A null doc_id neither loses words nor makes others lose any.  No
    document gives no row.  Other columns are ignored.
    """
    docs = own_columns(documents, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).withColumn("mark", F.xxhash64("text"))
    runs = settled(lambda: repeated_runs(docs.where("doc_id IS NOT NULL"), bucket_words), "runs")
    by_doc = runs.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    # runs grow with the corpus: never broadcast, however few they are here
    out = docs.join(by_doc.hint("merge"), ["doc_id", "mark"], "left").mapInArrow(
        _strip(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
    cols = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return out.select(*cols, F.col("kept").cast("string").alias("kept_text")) if with_text else out.select(*cols)
