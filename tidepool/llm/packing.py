"""Best-fit packing of token sequences: best-two-fit over the lengths, executed on length counts.

Documents become token ids with an end id; longer ones than a sequence are cut from their end into
full pieces, so only the first piece may be short.  What has to be packed is then a multiset of
lengths of at most ``size`` different values, whatever the number of documents: the bins are
planned on these counts (a plan entry stands for many equal bins), and the plan is dealt out to the
pieces by their rank among pieces of the same length.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import batch_rows, in_chunks, own_columns, stored

SIZE = 2048
END_ID = 0
#: tasks a length's pieces are ranked by: one for each million pieces, within these bounds
SALTS, MOST_SALTS = 64, 1024


def encoder(vocabulary: str = "byte_bpe_50k", added: bool = False):
    """texts -> lists of ids.  The public tokenizer ``<vocabulary>.json`` and its rank file hold the
    same vocabulary and give the same ids (a test compares them); the ranks are several times
    faster.  With ``added``, names of the added tokens in a text are those tokens, as they are to the
    public tokenizer by default; otherwise they are ordinary text."""
    import public_tokenizers
    import tiktoken
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    named = {}
    if added:
        with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as lines:
            tokens = json.load(lines)["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokens):
            raise ValueError(f"{vocabulary}: added tokens that depend on their neighbours")
        named = {t["content"]: t["id"] for t in tokens}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={k: v for k, v in ranks.items() if v not in named.values()},
                              special_tokens=named)
    return (lambda text: coder.encode(text, allowed_special="all")) if added else coder.encode_ordinary


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones but perhaps for the first."""
    first = n % size or size
    return [(0, first)] + [(at, size) for at in range(first, n, size)]


def _pieces(vocabulary: str, size: int):
    held: list = []

    def work(batch):
        if not held:
            held.append(encoder(vocabulary, added=True))
        ids_out, piece, start, length, crc = [], [], [], [], []
        for doc_id, text in batch_rows(batch, "doc_id", "text"):
            ids = np.array([*held[0](text or ""), END_ID], "<u4")
            for k, (at, n) in enumerate(cut(len(ids), size)):
                ids_out.append(doc_id)
                piece.append(k)
                start.append(at)
                length.append(n)
                crc.append(zlib.crc32(ids[at:at + n].tobytes()))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids_out, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
             pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
    return lambda batches: in_chunks(batches, work, 256)


def token_pieces(documents: DataFrame, size: int = SIZE, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids, end id included.  The ids are
    those of the public tokenizer as it is, names of added tokens in a text included."""
    docs = own_columns(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(_pieces(vocabulary, size), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _largest(left: np.ndarray, most: int) -> int:
    """Greatest length that is left and at most ``most``; 0 if none."""
    at = np.flatnonzero(left[1:most + 1]) if most > 0 else ()
    return int(at[-1]) + 1 if len(at) else 0


def _best_two(left: np.ndarray, least: int, most: int) -> tuple[int, int] | None:
    """Two lengths that are left with the greatest sum above ``least`` and at most ``most``."""
    there = np.flatnonzero(left[:most + 1])
    best, sums = None, least
    if not len(there):
        return None
    at = np.searchsorted(there, most - there, "right") - 1  # for each a, the greatest b that fits
    for i in np.flatnonzero(at >= 0):
        a, b = int(there[i]), int(there[at[i]])
        if a == b and left[a] < 2:
            if at[i] == 0:
                continue
            b = int(there[at[i] - 1])
        if a + b > sums:
            best, sums = (a, b), a + b
    return best


def plan_bins(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """[(number of bins, lengths in each)]: best-two-fit over a multiset of lengths.

    A bin takes the longest piece left that fits, again and again.  Then its smallest piece is
    replaced by the two unpacked pieces that fit the gap left by it most tightly, as long as that
    fills the bin more.  A filled pattern is repeated as often as the counts allow.
    """
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[int, list[int]]] = []
    while left.any():
        own: list[int] = []
        gap = size
        while (x := _largest(left, gap)):
            own.append(x)
            left[x] -= 1
            gap -= x
        while gap and len(own) > 1:
            small = own[-1]
            two = _best_two(left, small, gap + small)
            if two is None:
                break
            own.pop()
            left[small] += 1
            left[two[0]] -= 1
            left[two[1]] -= 1
            own += sorted(two, reverse=True)
            own.sort(reverse=True)
            gap = size - sum(own)
        uses = Counter(own)
        again = int(min(left[x] // n for x, n in uses.items()))
        for x, n in uses.items():
            left[x] -= again * n
        plan.append((again + 1, own))
    return plan


def _slots(plan: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence, places per bin and their offsets' start, of
    every plan entry that uses it."""
    taken: Counter = Counter()
    rows: dict[int, list] = {}
    sequence = 0
    for bins, own in plan:
        offsets: dict[int, list[int]] = {}
        at = 0
        for x in own:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, places in offsets.items():
            rows.setdefault(x, []).append((taken[x], sequence, bins, places))
            taken[x] += bins * len(places)
        sequence += bins
    return rows


def _deal(rows: dict[int, list]):
    firsts = {x: np.array([r[0] for r in r_], np.int64) for x, r_ in rows.items()}

    def work(batch):
        length = batch.column(batch.schema.get_field_index("length")).to_pylist()
        rank = batch.column(batch.schema.get_field_index("rank")).to_pylist()
        seq, off = [], []
        for x, r in zip(length, rank, strict=True):
            first, sequence, bins, places = rows[x][int(np.searchsorted(firsts[x], r, "right")) - 1]
            slot, k = divmod(r - first, bins)
            seq.append(sequence + k)
            off.append(places[slot])
        names = [n for n in batch.schema.names if n != "rank"]
        return pa.RecordBatch.from_arrays(
            [*[batch.column(batch.schema.get_field_index(n)) for n in names], pa.array(seq, pa.int64()), pa.array(off, pa.int64())],
            [*names, "sequence_id", "offset"])
    return lambda batches: in_chunks(batches, work, 8192)


def pack(documents: DataFrame, size: int = SIZE, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece that holds the end id alone.  Repeated rows and rows without
    a doc_id are packed each.  Ties of length are dealt out in the order of (doc_id, piece, crc)
    within salted groups.  No document gives no row.  Other columns are ignored.

    What reaches the driver is one count per length, at most ``size`` rows; the plan made of it has
    a few entries per length.  Ranks come from windows over (length, salt), so a length that a
    third of the documents share is ranked by many tasks.
    """
    pieces = stored(token_pieces(documents, size, vocabulary), "pieces")
    # repeated rows are alike in every column, and so in one salted group, where row_number parts them
    salts = min(MOST_SALTS, max(SALTS, pieces.count() // 1_000_000))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    table = groups.toPandas()  # at most size x MOST_SALTS rows
    table = table.sort_values(["length", "salt"])
    table["base"] = table.groupby("length")["n"].cumsum() - table["n"]
    counts = table.groupby("length")["n"].sum()
    slots = _slots(plan_bins({int(k): int(v) for k, v in counts.items()}, size))
    base = {(int(r.length), int(r.salt)): int(r.base) for r in table.itertuples()}

    from pyspark.sql import Window
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within).cast("long") - 1)
    held = pieces.sparkSession.sparkContext.broadcast((slots, base))  # bounded by size and MOST_SALTS

    def deal(batches):
        rows, bases = held.value

        def shifted():
            for b in batches:
                rank = [bases[(x, s)] + r for x, s, r in batch_rows(b, "length", "salt", "rank")]
                keep = [n for n in b.schema.names if n not in ("salt", "rank")]
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(b.schema.get_field_index(n)) for n in keep], pa.array(rank, pa.int64())], [*keep, "rank"])
        return _deal(rows)(shifted())

    return ranked.mapInArrow(deal, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
