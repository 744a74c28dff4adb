r"""Phrase collocation mining: frequent word n-grams by Misra-Gries summaries, counted exactly after.

Texts are tokenised once, into chunks of word numbers with the chunk's own vocabulary; all passes
read those.  A pass deals n-gram hashes out to hash partitions; each keeps one Misra-Gries summary of
more counters than its mass (the occurrences dealt to it) divided by the threshold, so what it cuts
off every counter stays below the threshold and no frequent n-gram is lost.  Tasks sum equal n-grams
first and send the mass of each partition ahead, so a hot n-gram is one row per task and the capacity
is known before the first counter is set.

Parts of a frequent n-gram are as frequent as it is: words come first, then pairs of frequent words,
then longer n-grams of frequent pairs.  Survivors reach the next pass as a bit per hash in a map of
at most ``FILTER_BITS`` bits, which may let other n-grams through but stops no survivor.  The last pass
counts what the maps let through by the words themselves, so neither hashes nor summaries decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import MULT, batch_rows, drop_stored, mix, own_columns, stored

MAX_WORDS, MIN_COUNT, TOP = 5, 100, 2000
#: words of a chunk, about
CHUNK_WORDS = 1 << 16
#: bytes of a text that are tokenised at once
TEXT_BYTES = 1 << 20
#: greatest size of a survivors' map, 16 MB; more survivors only let more through
FILTER_BITS = 1 << 27
#: counted n-grams a task holds before it sums equal ones and sends them off; names it holds in the last pass
RUN, NAMES = 1 << 19, 1 << 18
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TO_PLAIN = bytes.maketrans(_UPPER + b".,;:!?\x0b\x0c\r\t", _UPPER.lower() + b"\n" * 9 + b" ")
_BREAK = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")
GOLD = 0x9E3779B97F4A7C15


class MisraGries:
    """Mergeable counters of at most ``capacity`` items; a true count lies between an item's counter and that plus ``cut``."""

    def __init__(self, capacity: int):
        self.capacity, self.cut = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = summed(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        over = len(self.keys) - self.capacity
        if over > 0:
            off = int(np.partition(self.counts, over - 1)[over - 1])
            left = self.counts > off
            self.keys, self.counts = self.keys[left], self.counts[left] - off
            self.cut += off

    def merge(self, other: MisraGries) -> None:
        self.add(other.keys, other.counts)
        self.cut += other.cut

    def at_least(self, least: int) -> np.ndarray:
        """Items whose true count may reach ``least``."""
        return self.keys[self.counts + self.cut >= least]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[order], first)


# --- tokens -------------------------------------------------------------------------------------

def _chunk(lang: str, texts: list[bytes]) -> tuple:
    """(lang, n, vocabulary, numbers): the texts' words as places in the vocabulary, its size between pieces; of two bytes
    each where they suffice, else four."""
    plain = b"\n".join(texts).translate(_TO_PLAIN).replace(b"\n", b" \n ")
    coded = pa.array(plain.split(b" "), pa.large_binary()).dictionary_encode()
    ids, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    kind = np.ones(len(words), bool)
    number = np.zeros(len(words), np.int64)
    own = [w not in (b"", b"\n") for w in words]
    size = sum(own)
    number[own] = np.arange(size)
    for k, w in enumerate(words):
        if w == b"":
            kind[k] = False
        elif w == b"\n":
            number[k] = size
    out = number[ids[kind[ids]]].astype("<u2" if size < 1 << 16 else "<u4")
    vocabulary = b"\n".join(w for w, good in zip(words, own, strict=True) if good)
    return lang, int((out < size).sum()), vocabulary, out.tobytes()


def _bounded(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``TEXT_BYTES``, cut between pieces, which no phrase crosses."""
    at = 0
    while len(text) - at > TEXT_BYTES and (end := _BREAK.search(text, at + TEXT_BYTES)):
        yield text[at:end.start()]
        at = end.end()
    yield text[at:] if at else text


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def give(lang):
        row = _chunk(lang, held.pop(lang))
        del size[lang]
        return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.string()), pa.array([row[1]], pa.int64()),
                                           pa.array([row[2]], pa.binary()), pa.array([row[3]], pa.binary())],
                                          ["lang", "n", "vocabulary", "numbers"])

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            lang = lang.as_py()
            for part in _bounded(text.as_py() or b""):
                held.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part) + 1
                if size[lang] >= 6 * CHUNK_WORDS:
                    yield give(lang)
    for lang in list(held):
        yield give(lang)


def tokens(documents: DataFrame) -> DataFrame:
    """(lang, n, vocabulary, numbers): the documents' words in chunks of one language, stored."""
    docs = own_columns(documents, "lang", "text").select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return stored(docs.mapInArrow(_tokenise, "lang string, n long, vocabulary binary, numbers binary"), "tokens", "zstd")


# --- n-grams of a chunk -------------------------------------------------------------------------

class Survivors:
    """Bits by hash of the n-grams that survived the passes so far; sent to the tasks."""

    def __init__(self):
        self.maps: dict[str, np.ndarray] = {}

    def has(self, level: str, h: np.ndarray) -> np.ndarray:
        bits = self.maps[level]
        at = h & np.uint64(len(bits) * 8 - 1)
        return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


class Grams:
    """A chunk's n-grams by hash of language, length and words."""

    def __init__(self, lang: str, vocabulary: bytes, numbers: bytes):
        self.words = vocabulary.split(b"\n") if vocabulary else []
        n = len(self.words)
        self.ids = np.frombuffer(numbers, "<u2" if n < 1 << 16 else "<u4").astype(np.int32)  # the last stands for a break
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        self.salt = xxhash.xxh3_64_intdigest(lang.encode())
        self.own = hashes
        self.raw = [np.append(hashes, np.uint64(0))[self.ids]]

    def finish(self, raw: np.ndarray, m: int) -> np.ndarray:
        return mix(raw ^ np.uint64((self.salt + m * GOLD) % (1 << 64)))

    def longer(self, m: int) -> np.ndarray:
        """Hashes of all runs of ``m`` words, before the last mixing."""
        while len(self.raw) < m:
            k = len(self.raw)
            self.raw.append(self.raw[-1][:-1] * MULT + self.raw[0][k:])
        return self.raw[m - 1]

    def places(self, sieve: Survivors, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(m, places, hashes) of the runs of 2 to ``longest`` words without a break whose words, and from
        three words on whose pairs, survived."""
        known = np.append(sieve.has("words", self.finish(self.own, 1)), False)[self.ids]
        pair = known[:-1] & known[1:]
        for m in range(2, longest + 1):
            n = len(self.ids) - m + 1
            if n <= 0:
                return
            if m == 2:
                at = np.flatnonzero(pair)
                h = self.finish(self.longer(2)[at], 2)
                if longest > 2:
                    good = sieve.has("pairs", h)
                    at, h = at[good], h[good]
                    pair = np.zeros(len(pair), bool)
                    pair[at] = True
                run = pair
            else:
                run = run[:n] & pair[m - 2:m - 2 + n]
                at = np.flatnonzero(run)
                h = self.finish(self.longer(m)[at], m)
            yield m, at, h


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Grams]]:
    for batch in batches:
        for lang, vocabulary, numbers in zip(*(batch.column(c) for c in ("lang", "vocabulary", "numbers")), strict=True):
            yield lang.as_py(), Grams(lang.as_py(), vocabulary.as_py(), numbers.as_py())


# --- summaries ----------------------------------------------------------------------------------

def _narrow(counts: np.ndarray) -> bytes:
    """Counts as the narrowest integers that hold them."""
    most = int(counts.max(initial=0))
    return counts.astype(next(k for k, top in (("<u1", 1 << 8), ("<u2", 1 << 16), ("<u4", 1 << 32), ("<u8", 1 << 64)) if most < top)).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // max(n, 1) or 1}").astype(np.int64)


def _cuts(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, from, to) of the runs of a sorted array."""
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    return [(int(part[i]), int(i), int(j)) for i, j in zip(edges, np.append(edges[1:], len(part)), strict=True)]


def _deal(level: str, bits: int, longest: int, sieve):
    """Per run of a task and hash partition (the hash's low ``bits``): its mass (kind 0), and its n-grams by the next 32 bits
    of their hash with their counts, packed (kind 1).  N-grams that share those bits count as one, which may let one
    survive that is not frequent, but none go that is."""
    def rows(keys, counts):
        part = (keys & np.uint64((1 << bits) - 1)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, low, counts = part[order], ((keys[order] >> np.uint64(bits)) & np.uint64(0xFFFFFFFF)).astype("<u4"), counts[order]
        cuts = _cuts(part)
        parts = [c[0] for c in cuts]
        mass = [int(counts[i:j].sum()) for _, i, j in cuts]
        none = [None] * len(cuts)
        for kind, size, keyed, counted in ((0, mass, none, none), (1, mass, [low[i:j].tobytes() for _, i, j in cuts], [_narrow(counts[i:j]) for _, i, j in cuts])):
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int32()), pa.array([kind] * len(parts), pa.int8()), pa.array(size, pa.int64()), pa.array(keyed, pa.binary()),
                 pa.array(counted, pa.binary())], ["part", "kind", "mass", "grams", "counts"])

    def work(batches):
        keys, counts, n = [], [], 0
        for _, grams in _chunks(batches):
            if level == "words":
                k = grams.finish(grams.own, 1)
                c = np.bincount(grams.ids, minlength=len(k))[:len(k)].astype(np.int64)
                keys.append(k)
                counts.append(c)
                n += len(k)
            else:
                for m, _, h in grams.places(sieve.value, longest):
                    if m > 2 or longest == 2:
                        k, c = np.unique(h, return_counts=True)
                        keys.append(k)
                        counts.append(c)
                        n += len(k)
            if n >= RUN:
                k, c = summed(np.concatenate(keys), np.concatenate(counts))
                if len(k) > RUN // 2:
                    yield from rows(k, c)
                    keys, counts, n = [], [], 0
                else:
                    keys, counts, n = [k], [c], len(k)
        if n:
            yield from rows(*summed(np.concatenate(keys), np.concatenate(counts)))
    return work


def _summarise(least: int, bits: int, spare: int = 0):
    """Per hash partition, from its masses and then its n-grams: those that may reach ``least``.  A partition's
    counters are one more than its mass divided by ``least``, and ``spare``."""
    def work(batches):
        now, mass, summary, keys, counts, held = None, 0, None, [], [], 0

        def flush():
            if keys:
                summary.add(np.concatenate(keys), np.concatenate(counts))
                keys.clear()
                counts.clear()

        def done():
            flush()
            got = summary.at_least(least) if summary is not None else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(((got << np.uint64(bits)) | np.uint64(now)).view(np.int64))], ["gram"])

        for batch in batches:
            for part, kind, size, grams, counted in batch_rows(batch, "part", "kind", "mass", "grams", "counts"):
                if part != now:
                    if now is not None:
                        yield done()
                    now, mass, summary, held = part, 0, None, 0
                if kind == 0:
                    mass += size
                    continue
                if summary is None:
                    summary = MisraGries(mass // least + 1 + spare)
                own = np.frombuffer(grams, "<u4").astype(np.uint64)
                keys.append(own)
                counts.append(_wide(counted, len(own)))
                held += len(own)
                if held >= max(1 << 18, len(summary.keys)):
                    flush()
                    held = 0
        if now is not None:
            yield done()
    return work


def _surviving(chunks: DataFrame, level: str, least: int, longest: int, sieve) -> DataFrame:
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = (4 * n - 1).bit_length()
    dealt = chunks.select("lang", "vocabulary", "numbers").mapInArrow(
        _deal(level, bits, longest, sieve), "part int, kind byte, mass long, grams binary, counts binary")
    return dealt.repartition(n, "part").sortWithinPartitions("part", "kind").mapInArrow(_summarise(least, bits), "gram long")


def _as_map(survivors: DataFrame, most: int) -> np.ndarray:
    """The survivors' bits; 16 bits for each of the ``most`` that there can be, in all a power of two and at most ``FILTER_BITS``."""
    size = min(FILTER_BITS, max(1 << 16, 1 << (16 * most).bit_length()))
    at = F.col("gram").bitwiseAND(F.lit(size - 1))
    blocks = survivors.groupBy(F.shiftright(at, 15).alias("block")).agg(
        F.expr(f"bitmap_construct_agg((gram & {size - 1}) & 32767)").alias("bits")).collect()
    bits = np.zeros(size // 8, np.uint8)
    for block, own in blocks:
        bits[block * 4096:(block + 1) * 4096] = np.frombuffer(own, np.uint8)
    return bits


# --- exact counts -------------------------------------------------------------------------------

def _found(grams: Grams, sieve: Survivors, longest: int) -> Iterator[tuple[int, list[bytes], list[int]]]:
    """(m, phrases, counts): a chunk's phrases of ``m`` words that the maps let through."""
    known = sieve.has("words", grams.finish(grams.own, 1))
    c = np.bincount(grams.ids, minlength=len(known))
    own = np.flatnonzero(known)
    yield 1, [grams.words[k] for k in own], c[own].tolist()
    for m, at, h in grams.places(sieve, longest):
        if m > 2:
            good = sieve.has("phrases", h)
            at, h = at[good], h[good]
        if not len(at):
            continue
        order = np.argsort(h, kind="stable")
        at, h = at[order], h[order]
        new = np.append(True, h[1:] != h[:-1])
        # equal hashes are one phrase only if the words are the same; else all are told apart by words
        lead = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        if any((grams.ids[at + j] != grams.ids[lead + j]).any() for j in range(m)):
            spans, back = np.unique(grams.ids[at[:, None] + np.arange(m)], axis=0, return_inverse=True)
            counts = np.bincount(back.ravel())
        else:
            first = np.flatnonzero(new)
            spans, counts = grams.ids[at[first][:, None] + np.arange(m)], np.diff(np.append(first, len(at)))
        yield m, [b" ".join([grams.words[k] for k in row]) for row in spans.tolist()], counts.tolist()


_PACKED = ["lang", "words", "part", "phrases", "counts"]


def _count(longest: int, sieve, parts: int):
    """Per run of a task, language, length and hash partition: the phrases, sorted and packed, and their counts."""
    def work(batches):
        held: dict[tuple[str, int], dict[bytes, int]] = {}

        def give():
            for (lang, m), found in held.items():
                dealt: dict[int, list[bytes]] = {}
                for phrase in sorted(found):
                    dealt.setdefault(xxhash.xxh3_64_intdigest(phrase) % parts, []).append(phrase)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(dealt), pa.string()), pa.array([m] * len(dealt), pa.int32()), pa.array(list(dealt), pa.int32()),
                     pa.array([b"\n".join(own) for own in dealt.values()], pa.binary()),
                     pa.array([_narrow(np.array([found[x] for x in own], np.int64)) for own in dealt.values()], pa.binary())], _PACKED)

        for lang, grams in _chunks(batches):
            for m, names, counts in _found(grams, sieve.value, longest):
                own = held.setdefault((lang, m), {})
                for name, f in zip(names, counts, strict=True):
                    own[name] = own.get(name, 0) + f
            if sum(map(len, held.values())) > NAMES:
                yield from give()
                held.clear()
        yield from give()
    return work


def _add_up(least: int):
    """The phrases of each language, length and partition (rows come by these) with their counts of ``least`` or more."""
    def work(batches):
        now, total = None, {}

        def done():
            good = {p: f for p, f in total.items() if f >= least}
            total.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]] * len(good), pa.string()), pa.array(list(good), pa.binary()), pa.array([now[1]] * len(good), pa.int32()),
                 pa.array(list(good.values()), pa.int64())], ["lang", "phrase", "words", "f"])

        for batch in batches:
            for lang, m, part, phrases, counted in batch_rows(batch, *_PACKED):
                if (lang, m, part) != now:
                    if now is not None:
                        yield done()
                    now = (lang, m, part)
                own = phrases.split(b"\n")
                for phrase, f in zip(own, _wide(counted, len(own)).tolist(), strict=True):
                    total[phrase] = total.get(phrase, 0) + f
        if now is not None:
            yield done()
    return work


def frequent_phrases(chunks: DataFrame, longest: int = MAX_WORDS, least: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, words, f): all phrases of 1 to ``longest`` words found ``least`` times or more in their
    language's pieces, with their exact counts; ``chunks`` as made by :func:`tokens`."""
    sc = chunks.sparkSession.sparkContext
    sieve = Survivors()
    words = chunks.agg(F.sum("n")).first()[0] or 0
    for level, m in (("words", 1), ("pairs", 2), ("phrases", longest)):
        if level == "phrases" and longest < 3 or level == "pairs" and longest < 2:
            continue
        sieve.maps[level] = _as_map(_surviving(chunks, level, least, m, sc.broadcast(sieve)), words * max(1, m - 2) // least)
    sent = sc.broadcast(sieve)
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = chunks.select("lang", "vocabulary", "numbers").mapInArrow(
        _count(longest, sent, n), "lang string, words int, part int, phrases binary, counts binary")
    own = ["lang", "words", "part"]
    counted = packed.repartition(n, *own).sortWithinPartitions(*own).mapInArrow(
        _add_up(least), "lang string, phrase binary, words int, f long")
    return counted.withColumn("phrase", F.col("phrase").cast("string"))


def _part(phrase, first, count):
    return F.array_join(F.slice(F.split(phrase, " "), first, count), " ")


def collocations(documents: DataFrame, longest: int = MAX_WORDS, least: int = MIN_COUNT, top: int = TOP,
                 covered: int = 100) -> DataFrame:
    """(lang, rank, phrase, words, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    a is the phrase's count, n the language's words, l and r the counts of the two parts of the cut with
    the least score, floor(1000 * a * n / (l * r)) (the first such cut).  A phrase goes if a longer
    frequent one holds it and has ``covered`` per cent of its count.  Order: score, then a, both falling,
    then the phrase by bytes.

    A null lang is ``und``, a null or blank text has no words; repeated rows count each; a language
    without a frequent phrase, and no document, give no row.  Other columns are ignored.
    """
    chunks = tokens(documents)
    n = stored(chunks.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    grams = stored(frequent_phrases(chunks, longest, least), "phrases")
    drop_stored(chunks)
    many = grams.where("words > 1")
    part = grams.select("lang", F.col("phrase").alias("part"), "f")
    cuts = many.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("cut"))
    cuts = cuts.withColumn("left", _part("phrase", F.lit(1), F.col("cut"))).withColumn(
        "right", _part("phrase", F.col("cut") + 1, F.col("words") - F.col("cut")))
    cuts = cuts.join(part.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.join(n, "lang").withColumn("above", (wide("a") * wide("n")).cast("decimal(34,0)") * F.lit(1000)).withColumn(
        "below", (wide("l") * wide("r")).cast("decimal(38,0)"))
    exact = ((F.col("above") - F.col("above") % F.col("below")) / F.col("below")).cast("long")
    best = cuts.withColumn("score", exact).groupBy("lang", "phrase", "words", "a", "n").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("b"))

    # how often the longest-lived phrase around each phrase is found
    inner = many.where("words > 2").select("lang", "f", "phrase", "words", F.explode(F.expr("sequence(2, words - 1)")).alias("size"))
    inner = inner.select("lang", "f", "phrase", "size", F.explode(F.expr("sequence(1, words - size + 1)")).alias("at"))
    around = inner.groupBy("lang", _part("phrase", F.col("at"), F.col("size")).alias("phrase")).agg(F.max("f").alias("outer"))
    kept = best.join(around, ["lang", "phrase"], "left").where(
        F.col("outer").isNull() | (F.lit(100).cast("decimal(3,0)") * wide("outer") < F.lit(covered).cast("decimal(3,0)") * wide("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = kept.select("lang", "phrase", F.col("words").cast("long").alias("words"), "a", "b.l", "b.r", "n", "b.score")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "words", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
runs AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, CAST(len(w) - m + 2 AS BIGINT))) AS i FROM worded, range(1, 6) t(m) WHERE len(w) >= m)),
grams AS (SELECT lang, m AS words, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, phrase, words, f AS a, cut, string_split(phrase, ' ') AS w
  FROM grams, range(1, 5) t(cut) WHERE words > 1 AND cut < words),
scored AS (
  SELECT c.lang, c.phrase, c.words, c.a, c.cut, x.f AS l, y.f AS r, t.n,
         CAST((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN totals t USING (lang)
  JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(f) AS around
  FROM (SELECT lang, string_split(phrase, ' ') AS w, words, f, size, unnest(range(1, CAST(words - size + 2 AS BIGINT))) AS i
        FROM grams, range(2, 5) t(size) WHERE size < words)
  GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.around IS NULL OR 100 * i.around < 100 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, words, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
