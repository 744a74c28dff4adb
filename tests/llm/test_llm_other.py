"""Vectors, chats, URLs, packing and the pipeline."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepool.llm import chat, hnsw, packing, urls

SF = "/root/testdata/sf0.001"


def clashing(df):
    for name in ("key", "n", "u", "v", "shard", "block", "label2", "rest", "rank", "salt", "host", "path", "who", "chunk"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


# --- vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_links(rows, least=0.93):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= least) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None, :])
    np.fill_diagonal(near, False)
    parent = {i: i for i in ids}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a, b in zip(*np.nonzero(near), strict=True):
        p, q = sorted((root(ids[a]), root(ids[b])))
        parent[q] = p
    return {i: (int(n), root(i)) for i, n in zip(ids, near.sum(axis=1), strict=True)}


@pytest.mark.parametrize("shard", [8192, 100])
def test_vectors_against_brute_force(spark, shard):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(500):
        v = rng.standard_normal(16)
        if i and rng.random() < 0.5:
            k = rng.integers(0, i)
            v = np.array(rows[k][1]) + rng.standard_normal(16) * 0.12
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 2))))
    out = hnsw.near_vectors(clashing(spark.createDataFrame(rows, SCHEMA)), shard=shard, block=64).collect()
    got, audited = {r.vec_id: (r.n_links, r.component_id) for r in out}, [r.recall for r in out]
    want = brute_links(rows)
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert there > 300 and found >= 0.99 * there
    assert all(got[i][0] <= want[i][0] for i in want)  # none is made up
    assert audited and all(r is not None and r >= hnsw.AUDIT_RECALL for r in audited)
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.97


def test_vectors_edge_rows(spark):
    e, z, nan = [1.0, 0.0], [0.0, 0.0], [float("nan"), 1.0]
    rows = [(1, e, 0), (2, [2.0, 0.0], 0), (3, e, None), (4, None, 0), (5, z, 0), (6, nan, 0), (7, [float("inf"), 1.0], 0),
            (8, [None, 1.0], 0), (9, [], 0), (10, e, 1), (None, e, 0), (2, [2.0, 0.0], 0), (11, [1.0, 0.0, 0.0], 0)]
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in hnsw.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert [g for g in got if g[1]] == [(1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False)]
    assert all(g[2] == g[0] and g[3] for g in got if g[0] and not g[1]) and got[0] == (0, 0, None, False)
    assert hnsw.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_vectors_are_one_class_and_sizes_do_not_matter(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.98, 0.198997, 0.0], [0.0, 1.0, 0.0]
    rows = [(i, a, 0) for i in range(100, 400)] + [(i, b, 0) for i in range(50, 60)] + [(7, c, 0), (8, a, 1), (9, [1e200, 0.0, 0.0], 0),
                                                                                   (10, [1e-200, 0.0, 0.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_vectors(spark.createDataFrame(rows, SCHEMA.replace("float", "double"))).collect()}
    assert len(got) == len(rows) and got[7] == (0, 7) and got[8] == (0, 8)
    # 300 of a, 10 of b and the two of other sizes all link with each other
    assert {v for k, v in got.items() if k not in (7, 8)} == {(311, 9)}


def test_audit_widens_the_beam():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((800, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(x)
    graph.build(list(range(800)))
    graph.ef = 1
    assert graph.audit(0.93) >= hnsw.AUDIT_RECALL and (graph.ef > 1 or graph.exact)
    again = hnsw.Graph.load(graph.dump(), x)
    q = x[5]
    assert sorted(again.search(q, 0.93)) == sorted(graph.search(q, 0.93))


def hot_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 32))
    x[:300] = x[0] + rng.standard_normal((300, 32)) * 0.02
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_audit_sees_misses_beside_a_hot_group():
    class HotOnly(hnsw.Graph):
        def search(self, q, least, own=None):
            return np.arange(900) if self.exact else np.arange(300)

    graph = HotOnly(hot_and_pairs())
    assert graph.audit(0.93) < hnsw.AUDIT_RECALL and graph.exact


def test_a_graph_in_parts_is_searched_by_brute_force():
    x = hot_and_pairs()
    graph = hnsw.Graph(x).build(list(range(900)))
    graph.count[:] = 0
    graph.audit(0.93)
    again = hnsw.Graph.load(graph.dump(), x)
    for k in (5, 450, 899):
        found = again.search(x[k], 0.93)
        assert set(np.flatnonzero(x @ x[k] >= 0.93)) <= set(found)


# --- chats

CHAT = "conv_id long, turn long, role string, text string"


def brute_chat(rows, size=512):
    talks = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            talks[c].append((t, r or "unknown", x or ""))
    out = {}
    for c, turns in talks.items():
        for who in {r for _, r, _ in turns} - {"system"}:
            parts = defaultdict(list)
            for t, r, x in sorted(turns, key=lambda a: (a[0] is not None, a[0] or 0, a[1], a[2])):
                parts[0 if t is None or not size else t // size].append((r, x))
            for k, part in parts.items():
                text, mask = "", []
                for r, x in part:
                    head = "<|system|>\n" if r == "system" else "<|assistant|>\n" if r == who else f"<|user:{r}|>\n"
                    text += head + x + "<|end|>\n"
                    mask.append((len(head), len(x) + 7, r == who))
                out[c, k, who] = (text, mask)
    return out


@pytest.mark.parametrize("size", [None, 2])
def test_chat_matches_brute_force(spark, size):
    rows = [(1, 0, "system", "Be kind"), (1, 1, "ann", "Hi é"), (1, 2, "bob", None), (1, 3, "ann", ""), (1, 3, "ann", ""),
            (2, None, None, "who?"), (2, 0, "ann", "me"), (2, 700, "bob", "late"), (3, 0, "system", "alone"), (None, 0, "ann", "lost"), (4, 5, "x", "y" * 100_000)]
    got = chat.rotate_perspectives(clashing(spark.createDataFrame(rows, CHAT)), chunk_turns=size).collect()
    assert {(r.conv_id, r.chunk, r.perspective): (r.rendered, [(m["head"], m["body"], m["train"]) for m in r["mask"]]) for r in got} == brute_chat(rows, size)
    for r in got:  # the runs and line ends add up to the text
        assert sum(m["head"] + m["body"] + 1 for m in r["mask"]) == len(r.rendered)
    assert chat.rotate_perspectives(spark.createDataFrame([], CHAT)).count() == 0


# --- URLs

def brute_url(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


URLS = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://a.b.example.com/en/", "http://example.com/en",
        "http://example.com", "https://x.net/es/1", "https://net/fr/", "https://xnet/fr/", "http://com/", "http://acom/", "ftp://a.com#/en/",
        "http://é.com/ñ", "x://y.com://z.com/", "http://a.net/es/\nq", "http://.net/es/", "http://example.com./en/", "http://" + "a." * 300 + "com/" + "p" * 9000]


def test_urls_match_brute_force(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, html string")
    want = {i: brute_url(u, urls.RULES) for i, u in enumerate(URLS)}
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    for got in (urls.judge_urls(clashing(df.drop("html")).drop("host", "path"), urls.RULES), urls.judge_urls_joined(df, rules)):
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == want
    assert urls.judge_urls(df.limit(0), urls.RULES).count() == 0
    assert {r.rule for r in urls.judge_urls(df, []).collect()} == {None}
    with pytest.raises(ValueError):
        urls.judge_urls(df, [("a", "/", "allow"), ("a", "/", "block")])


def test_urls_with_long_hosts_and_long_rules(spark):
    host = "a." * 60_000
    rules = [("x.com", "/", "allow"), ("y.net", "/" + "p" * 3000, "block"), ("y.net", "/" + "p" * 64, "allow"), ("long" * 40 + ".org", "/", "block")]
    rows = ["http://" + host + "x.com/", "http://" + host + "ax.com/", "http://y.net/" + "p" * 4000, "http://z.y.net/" + "p" * 100,
            "http://" + "long" * 40 + ".org/", "http://xlong" + "long" * 39 + ".org/", "http://" + "." * 5000 + "x.com/", "http://com/"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    want = {i: brute_url(u, rules) for i, u in enumerate(rows)}
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    for got in (urls.judge_urls(df, rules), urls.judge_urls_joined(df, frame)):
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == want
    assert {v for *_, v in want.values()} == {"allow", "block"}
    assert urls.judge_urls_joined(df, frame.limit(0)).where("verdict = 'allow' AND rule IS NULL").count() == len(rows)


def test_digest_collisions_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda b: len(b))  # equal lengths collide
    path = str(tmp_path / "d.bin")
    urls.write_digests([("aa", "/", "block"), ("bb", "/", "allow"), ("c", "/", "block")], path)
    held = urls.Digests(path)
    at = held.find([b"bb/", b"aa/", b"zz/", b"c/", b"toolong/"])
    assert [bytes(held.string(k)) if k >= 0 else None for k in at] == [b"bb/", b"aa/", None, b"c/", None]


# --- packing

def test_ranks_and_tokenizer_give_the_same_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    theirs.encode_special_tokens = True
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += ["", " ", "\n\n  x", "don't <|endoftext|> é日本 \x00 1234567", "a" * 3000]
    own = packing.encoder()
    assert [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)] == [own(t) for t in texts]


def test_added_tokens_in_texts_are_those_of_the_unchanged_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "x<|endoftext|", "don't <|endoftext|> é日本 \x00 1234567",
             "<|endoftext|>\n" * 2000, "", "none"]
    ids = [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
    own = packing.encoder(added=True)
    assert [own(t) for t in texts] == ids and ids[0] == [64, 220, 50256, 275]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in packing.pack(docs).collect()}
    want = {}
    for i, row in enumerate(ids):
        row = np.array([*row, 0], "<u4")
        for k, (at, n) in enumerate(packing.cut(len(row), 2048)):
            want[i, k] = (n, zlib.crc32(row[at:at + n].tobytes()))
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), max_size=25))
def test_plan_packs_everything_once(counts):
    plan = packing.plan_bins(counts, 60)
    got = Counter()
    for bins, own in plan:
        assert bins > 0 and sum(own) <= 60
        for x in own:
            got[x] += bins
    assert got == Counter(counts)
    total = sum(k * n for k, n in counts.items())
    assert sum(b for b, _ in plan) <= 2 * -(-total // 60) + 1


def test_two_replace_the_smallest():
    # greedy fills 60 with 40 + 15, gap 5; replaced 15 by 11 + 9 fills it
    plan = packing.plan_bins({40: 1, 15: 1, 11: 1, 9: 1}, 60)
    assert plan[0] == (1, [40, 11, 9])


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(
        spark.createDataFrame([(90_001, None), (90_002, ""), (90_003, "word " * 30_000), (90_004, "same"), (90_004, "same"), (None, "x")],
                              "doc_id long, text string"))
    rows = packing.pack(clashing(docs)).collect()
    encode = packing.encoder()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*encode(r.text or ""), 0], "<u4")
        for k, (at, n) in enumerate(packing.cut(len(ids), 2048)):
            want[r.doc_id, k, at, n, zlib.crc32(ids[at:at + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(r.length for r in rows) // 2048)
    assert len(sequences) <= 1.05 * least + 1
    assert packing.pack(docs.limit(0)).count() == 0


# --- pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from tests.llm.test_llm_text import brute_groups, brute_lines
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    one = cp.language_id(spark, docs, SF)
    assert one.columns == list(cp.COLUMNS)
    from tidepool.llm import langid
    model, found = langid.train(docs), {}
    for i, t in text(docs).items():
        if any(c.isalpha() for c in t or ""):
            langs, share = model.mixture(t)
            if share[0] >= cp.MIN_SHARE:
                found[i] = model.langs[langs[0]]
    assert {r.doc_id: r.lang for r in one.collect()} == found and len(found) >= 0.98 * docs.count()
    two = cp.line_dedup(spark, one, SF)
    want = brute_lines(list(text(one).items()))
    import hashlib
    for i, t in text(two).items():
        assert hashlib.sha256(t.encode()).hexdigest() == want[i][2]
    three = cp.near_dedup(spark, two, SF)
    groups = brute_groups(list(text(two).items()))
    assert set(text(three)) == {i for i, (_, c) in groups.items() if i == c}
    four = cp.decontaminate(spark, three, SF)
    bench = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i, t in text(three).items() if any(b in " ".join(t.split()) for b in bench)}
    assert not leaks & set(text(four)) and leaks and four.count() >= three.count() - len(leaks) - 2
    pieces = cp.pack(spark, four, SF)
    assert {r.doc_id for r in pieces.collect()} == set(text(four))
    # the stages run as one: the pieces of the same documents
    encode = packing.encoder(added=True)
    want = Counter()
    for i, t in text(four).items():
        ids = np.array([*encode(t), 0], "<u4")
        for k, (at, n) in enumerate(packing.cut(len(ids), 2048)):
            want[i, k, n, zlib.crc32(ids[at:at + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in cp.run(spark, SF).collect()) == want


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as cp
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string, key string"
    rows = [(1, None, None, None, None, None, None), (2, "", "en", "s", 0, "x", "k"), (None, "text here", "en", "s", 9, "x", "k"),
            (3, "some words in a text", "en", None, 20, None, "k"), (3, "some words in a text", "en", None, 20, None, "k")]
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == list(cp.COLUMNS)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        left = sorted(str(r.doc_id) for r in cp.pack(spark, docs, str(tmp_path)).collect())
        assert left == (["3", "None"] if data else [])


def test_pipeline_keeps_every_row(spark, tmp_path):
    import corpus_pipeline as cp
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "this passage is held by the benchmark alone")], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    rows = [(None, "a text of nobody in particular", None), (None, "and another one without a number", None),
            (7, "one text of seven is about trees", None), (7, "the other text of seven is on rivers", None),
            (7, "the third says: this passage is held by the benchmark alone", None),
            (8, "some words that come two times over", None), (8, "some words that come two times over", None), (9, "12 ?!", None)]
    texts = lambda df: sorted(r.text for r in df.collect())
    for lang in (None, "en"):  # nothing to learn from; one language
        docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, _ in rows], schema)
        one = cp.language_id(spark, docs, str(tmp_path))
        assert texts(one) == sorted(t for i, t, _ in rows if i != 9)
        three = cp.near_dedup(spark, one, str(tmp_path))
        assert texts(three) == sorted({t for i, t, _ in rows if i != 9})
        two = cp.line_dedup(spark, one, str(tmp_path))
        assert texts(two) == texts(three)
        four = cp.decontaminate(spark, two, str(tmp_path))
        assert texts(four) == sorted({t for i, t, _ in rows if i != 9 and "passage" not in t})
        pieces = cp.pack(spark, four, str(tmp_path)).collect()
        assert sorted(str(r.doc_id) for r in pieces) == ["7", "7", "8", "None", "None"]
