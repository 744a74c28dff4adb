"""Phrase collocations, conversation repair and Hilbert sharding against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepool.llm import hilbert, phrases, repair

DOCS = "doc_id long, text string, lang string, source string, n_chars long, f long, part int, place long, extra string"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, 0, 1, 2, 3, "x") for i, t, lang, s in rows], DOCS)


# --- collocations -------------------------------------------------------------------------------

def plain_collocations(rows, longest, least, top):
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(upper)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + m])) for i in range(len(w) - m + 1))
    good = {k: v for k, v in f.items() if v >= least}
    out = []
    for lang in n:
        mine = {p: v for (own, p), v in good.items() if own == lang}
        found = []
        for p, a in mine.items():
            inside = any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                         for q, b in mine.items())
            if len(p) > 1 and not inside:
                score, k = min((1000 * a * n[lang] // (mine[p[:k]] * mine[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), len(p), mine[p[:k]], mine[p[k:]]))
        for rank, (score, a, p, m, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), m, -a, left, right, n[lang], -score))
    return sorted(out)


def text_of(rng, words):
    return "".join(rng.choice(["a", "B", "cc", "É", "ü x", "the", "of"]) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", " \x0b"])
                   for _ in range(words))


def test_collocations_match_plain_counting(spark):
    rng = random.Random(5)
    rows = [(k, text_of(rng, rng.choice([0, 1, 4, 60])), rng.choice(["en", "de", None]), "s") for k in range(120)]
    rows += [(500, None, "en", "s"), (501, "", None, "s"), (502, " \t\n", "fr", "s"), (None, "a b a b", "en", "s"),
             (7, text_of(rng, 9000), "en", "s"), *[(8, "new york city is new york city", "en", None)] * 9]
    for longest, least, top in ((5, 8, 2000), (3, 20, 7), (2, 3, 50)):
        got = sorted(tuple(r) for r in phrases.collocations(docs_of(spark, rows), longest, least, top).collect())
        assert got == plain_collocations(rows, longest, least, top) and got


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "TEXT_BYTES", 40)
    rng = random.Random(1)
    for text in (text_of(rng, 300), "word " * 100, "a, " * 50, "", "é" * 99 + "." + "b" * 60):
        parts = list(phrases._bounded(text.encode()))
        pieces = lambda t: [p.split() for p in re.split(rb"[.,;:!?\n\x0b\x0c\r]", t) if p.split()]
        assert [p for part in parts for p in pieces(part)] == pieces(text.encode())
        assert len(parts) > 1 or len(text) < 60 or not re.search(r"[.,;:!?\n]", text[40:])


def test_collocations_of_nothing(spark):
    assert phrases.collocations(docs_of(spark, [])).count() == 0
    assert phrases.collocations(docs_of(spark, [(1, None, None, None), (2, "a b", "en", "s")])).count() == 0


def test_collocation_scores_pass_64_bits(spark):
    """1000 * a * n goes beyond 64 bits here; the score must not."""
    a, n = 10 ** 10, 10 ** 12
    row = spark.createDataFrame([(a, n, 10 ** 11, 10 ** 11)], "a long, n long, l long, r long")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    top, low = (wide("a") * wide("n")).cast("decimal(34,0)") * F.lit(1000), (wide("l") * wide("r")).cast("decimal(38,0)")
    assert row.select(((top - top % low) / low).cast("long")).first()[0] == 1000 * a * n // 10 ** 22


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=80), min_size=1, max_size=5), st.integers(1, 12))
def test_summaries_keep_what_is_frequent(streams, least):
    """Merged summaries of capacity above mass / threshold keep every item at the threshold, and bound its count."""
    mass, true = sum(map(len, streams)), Counter(itertools.chain(*streams))
    whole = phrases.MisraGries(mass // least + 1)
    for s in streams:
        part = phrases.MisraGries(mass // least + 1)
        for at in range(0, len(s), 7):
            keys, counts = np.unique(np.array(s[at:at + 7], np.uint64), return_counts=True)
            part.add(keys, counts.astype(np.int64))
        whole.merge(part)
    assert len(whole.keys) <= whole.capacity and whole.cut < least
    assert {k for k, c in true.items() if c >= least} <= set(whole.at_least(least).tolist())
    for k, c in zip(whole.keys.tolist(), whole.counts.tolist(), strict=True):
        assert c <= true[k] <= c + whole.cut


def test_equal_hashes_of_other_words_are_told_apart(spark, monkeypatch):
    """Every n-gram of two words or more gets one of two hashes: the counts stay exact."""
    real = phrases.Grams.finish
    monkeypatch.setattr(phrases.Grams, "finish", lambda self, raw, m: real(self, raw, m) if m == 1 else real(self, raw, m) & np.uint64(1))
    rng = random.Random(2)
    rows = [(k, text_of(rng, 40), "en", "s") for k in range(30)]
    sieve = phrases.Survivors()
    sieve.maps = {k: np.full(8192, 255, np.uint8) for k in ("words", "pairs", "phrases")}

    class Sent:
        value = sieve
    chunks = list(phrases._tokenise(iter([phrases.pa.RecordBatch.from_pydict(
        {"lang": [r[2] for r in rows], "text": [r[1].encode() for r in rows]})])))
    got = Counter()
    packed = sorted((r for batch in phrases._count(3, Sent, 4)(iter(chunks)) for r in batch.to_pylist()), key=lambda r: (r["words"], r["part"]))
    for batch in phrases._add_up(1)(iter([phrases.pa.RecordBatch.from_pylist(packed)])):
        for r in batch.to_pylist():
            got[r["phrase"].decode()] += r["f"]
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    want = Counter()
    for _, text, _, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(upper)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in (1, 2, 3):
                want.update(" ".join(w[i:i + m]) for i in range(len(w) - m + 1))
    assert got == want


# --- conversation repair ------------------------------------------------------------------------

def plain_repair(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, repaired) of one conversation's (role, text) by trying, row by
    row, every edit on every partial audit."""
    pattern = re.compile(r"(s?(ua)+)?\Z")
    begins = re.compile(r"(s?(ua)*u?)?\Z")
    faults, seen = [], set()
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    ways = {"": (0, "", ())}  # roles so far -> cheapest

    def better(new, roles, way):
        if begins.match(roles) and (roles not in new or way[:2] < new[roles][:2]):
            new[roles] = way

    def insert(ways):
        new = dict(ways)
        for _ in range(2):
            for roles, (cost, audit, out) in list(new.items()):
                for name in ("user", "assistant"):
                    better(new, roles + name[0], (cost + 2, audit + "I", (*out, f"{name}:")))
        return new

    for (role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for roles, (cost, audit, out) in insert(ways).items():
            better(new, roles, (cost + 3, audit + "D", out))
            if fault not in ("b", "d"):
                more = fault == "t"
                if role and role[0] in "sua":
                    better(new, roles + role[0], (cost + more, audit + "K", (*out, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    better(new, roles + name[0], (cost + 2 + more, audit + "R", (*out, f"{name}:{text}")))
        ways = new
    cost, audit, out = min(w for roles, w in insert(ways).items() if pattern.match(roles))
    pairs = [a[:1] + b[:1] for (a, _), (b, _) in itertools.pairwise(rows)]
    return (*[faults.count(x) for x in "bdt"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, "\n".join(out))


def sorted_turns(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


def random_conversations(rng, n, longest):
    texts = ["Yes.", "Yes.", "no", "", " \t\n", "Why? ", "a b!\n", "ends,", "ü."]
    out = []
    for c in range(n):
        for k in range(rng.randint(1, longest)):
            out.append((rng.choice([c, c, c, None]) if c == 0 else c, rng.choice([k, k, 2 * k, None, 3]),
                        rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice([*texts, None])))
    return out


@pytest.mark.parametrize("segment_rows", [1, 3, 4096])
def test_repair_matches_plain_search(spark, segment_rows):
    rng = random.Random(segment_rows)
    rows = random_conversations(rng, 60, 9)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, place long, segment string")
    report, turns = repair.repair(df, segment_rows)
    got = {r.conv_id: r for r in report.collect()}
    hashes = {r.conv_id: r.repaired_sha256 for r in repair.digest(turns).collect()}
    by_conv = {}
    for c, t, role, text in rows:
        by_conv.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    assert set(got) == set(by_conv)
    for c, own in by_conv.items():
        *want, repaired = plain_repair([(role, text) for _, role, text in sorted_turns(own)])
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        r = got[c]
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit] == [gaps, *want], (c, own)
        assert hashes.get(c, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(repaired.encode()).hexdigest()


def test_repair_of_one_long_conversation_in_segments(spark):
    rng = random.Random(9)
    rows = [(1, k, rng.choice(["user", "assistant"]), f"{rng.randint(0, 200)}{rng.choice(['.', ''])}") for k in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    report, turns = repair.repair(df, 50)
    *want, repaired = plain_repair([(r, t) for _, _, r, t in rows])
    got = report.first()
    assert [got.blank, got.duplicate, got.truncated, got.illegal, got.cost, got.audit] == want
    out = [f"{r.role}:{r.text}" for r in turns.orderBy("place", "k").collect()]
    assert "\n".join(out) == repaired


def test_damage_and_conversations_without_rows(spark):
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", f"Text {k}.") for c in range(40) for k in range(2)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in repair.damaged_and_repaired(df).collect()}
    assert set(out) == {None, *range(40)}
    code = lambda c, k: zlib.crc32(f"{c}:{k}".encode()) % 20
    gone = [c for c in range(40) if code(c, 0) == 0 and code(c, 1) == 0]
    for c in range(40):
        own = []
        for k, (role, text) in enumerate((("user", "Text 0."), ("assistant", "Text 1."))):
            h = code(c, k)
            if h:
                own += [(k, "user" if h == 4 else role, "" if h == 1 else text[:-1] if h == 2 else text)] * (2 if h == 3 else 1)
        *want, repaired = plain_repair([(r, t) for _, r, t in sorted_turns(own)])
        assert [out[c].blank, out[c].duplicate, out[c].truncated, out[c].illegal, out[c].cost, out[c].audit] == want
        assert out[c].repaired_sha256 == hashlib.sha256(repaired.encode()).hexdigest()
    for c in gone:
        assert (out[c].gaps, out[c].cost, out[c].audit) == (0, 0, "")
    assert repair.damaged_and_repaired(df.where("false")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("DIKR", max_size=24), min_size=2, max_size=6), st.sampled_from([2, 5, (1 << 61) - 1]))
def test_trails_order_like_their_texts(texts, mod):
    """Whatever the hash: of two letters' remainders almost all collide."""
    kept = repair._MOD
    repair._MOD = mod
    try:
        trails, nodes = repair.Trails(), []
        for t in texts:
            # share the longest prefix that an earlier text has, or begin anew
            node, at = 0, 0
            for other, end in nodes[::2]:
                common = len([1 for a, b in itertools.takewhile(lambda x: x[0] == x[1], zip(other, t, strict=False))])
                if common > at:
                    node, at = trails.lifted(end, len(other) - common), common
            for letter in t[at:]:
                node = trails.add(node, letter)
            nodes.append((t, node))
        for (s, a), (t, b) in itertools.product(nodes, nodes):
            assert "".join(trails.text(a)) == s
            assert trails.order(a, b) == (s > t) - (s < t)
    finally:
        repair._MOD = kept


# --- Hilbert sharding ---------------------------------------------------------------------------

@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2), (4, 1), (3, 3)])
def test_the_curve_is_a_walk_through_all_cells(spark, n, bits):
    side = 1 << bits
    cells = spark.createDataFrame(list(itertools.product(range(side), repeat=n)), ", ".join(f"c{d} int" for d in range(n)))
    rows = cells.withColumn("h", hilbert.curve_index([F.col(f"c{d}") for d in range(n)], bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(side ** n))
    for a, b in itertools.pairwise(rows):
        assert sum(abs(x - y) for x, y in zip(a[:n], b[:n], strict=True)) == 1


def check_shards(rows, got, shards):
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(
        (i is not None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) <= set(range(shards))
    sizes = [counts[k] for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for k in range(shards):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(counts[k]))
    assert {r.law for r in got} <= {"rows"} and {r.grown_shard for r in got} <= {None}
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    # equal texts lie side by side
    runs = [k for k, _ in itertools.groupby((r.size, r.text_crc32) for r in order)]
    assert len(runs) == len(set(runs))
    return order


def test_shards_are_equal_runs_along_the_curve(spark):
    rng = random.Random(4)
    rows = [(k, "x" * rng.choice([0, 5, 40, 3000]) + f" {k}", rng.choice(["en", "de", None]), f"src{rng.randint(0, 30)}") for k in range(400)]
    rows += [(k, "the same text", "en", f"src{k % 9}") for k in range(1000, 1150)]
    rows += [(None, None, None, None), (5, "", "en", "a"), *[(6, "repeated", "fr", "b")] * 3, (7, "é" * 60000, "fr", "c")]
    order = check_shards(rows, hilbert.shard(docs_of(spark, rows)).collect(), 24)
    alone = [r.curve for r in order if Counter((x.size, x.text_crc32) for x in order)[(r.size, r.text_crc32)] == 1]
    assert alone == sorted(alone)
    check_shards(rows, hilbert.shard(docs_of(spark, rows), ("source", "extra"), 7, 3).collect(), 7)
    few = rows[:5]
    check_shards(few, hilbert.shard(docs_of(spark, few)).collect(), 24)
    assert hilbert.shard(docs_of(spark, [])).count() == 0


def test_written_shards_are_pruned_by_every_dimension(spark, tmp):
    rng = random.Random(8)
    rows = [(k, f"text {k} " * rng.choice([1, 30, 400]), f"l{rng.randint(0, 15):02}", f"s{rng.randint(0, 63):02}") for k in range(4000)]
    out = hilbert.shard(docs_of(spark, rows), ("lang", "source"), 64, 4, carry=["text"])
    hilbert.write_shards(out, tmp, ("lang", "source"))
    manifest = spark.read.parquet(f"{tmp}/manifest")
    assert manifest.count() == 64 and manifest.agg(F.sum("rows")).first()[0] == 4000
    for dim, value in (("lang", "l05"), ("source", "s31")):
        got = hilbert.read_shards(spark, tmp, **{dim: value})
        want = {(i, t) for i, t, lang, s in rows if (lang if dim == "lang" else s) == value}
        assert {(r.doc_id, r.text) for r in got.collect()} == want
        touched = manifest.where((F.col(f"{dim}.low") <= value) & (F.col(f"{dim}.high") >= value)).count()
        assert touched <= 24  # of 64, for either dimension
    assert hilbert.read_shards(spark, tmp, lang="none").count() == 0
