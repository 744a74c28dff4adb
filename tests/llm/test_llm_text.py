"""Text operators of the llm subpackage against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import components, decontam, langid, lines, minhash, substrings, toxicity

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def clashing(df):
    """The same rows with extra columns named like the operators' own."""
    for name in ("key", "keys", "n", "u", "v", "k", "lang_pred", "score", "component", "dropped", "runs", "at", "Words",
                 "region", "a", "b", "title.with.dots"):
        df = df.withColumn(name, F.lit("x"))
    return df


def random_docs(seed, n=120, vocabulary=300):
    rng = np.random.default_rng(seed)
    docs = []
    for i in range(n):
        words = [f"w{k}" for k in rng.integers(0, vocabulary, rng.integers(0, 150))]
        if docs and rng.random() < 0.6:
            words = docs[rng.integers(0, len(docs))][1].split()
            for _ in range(rng.integers(0, 6)):
                if words:
                    words[rng.integers(0, len(words))] = f"e{rng.integers(0, 999)}"
        docs.append((i * 3 + 1, " ".join(words)))
    return docs


# --- lines

def brute_lines(rows, least=40, docs=5):
    key = lambda line: line.strip(BLANK).translate(LOWER)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    hot = {k: max(v) for k, v in holders.items() if len(k) >= least and len(v) >= docs}
    out = {}
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if hot.get(key(x), i) == i]
        out[i] = (len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_lines_match_brute_force(spark):
    long = "An old license line that many documents carry, ÉÀ"
    rows = [(i, f"own {i}\n  {long.upper() if i % 2 else long}\t\n{long}\nend") for i in range(7)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, "short\nshort"), (24, "é" * 39), (25, long)]
    rows += [(30 + i, "x" * 40) for i in range(5)] + [(40 + i, "x" * 39) for i in range(6)] + [(50 + i, "é" * 40) for i in range(4)]
    got = lines.dedup_lines(clashing(frame(spark, rows))).collect()
    want = brute_lines(rows)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in got} == want
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_lines_null_ids_repeats_and_empty(spark):
    line = "y" * 50
    rows = [(None, line), (1, line), (1, line), (2, line), (3, line), (4, line)]
    got = sorted((r.doc_id or 0, r.n_dropped) for r in lines.dedup_lines(frame(spark, rows)).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 0), (3, 0), (4, 0)]  # four documents hold it, not five
    assert lines.dedup_lines(frame(spark, [])).count() == 0


# --- near duplicates

def brute_groups(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = words_of((t or "").translate(LOWER))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [minhash.BLOCK, 150])
def test_near_duplicates_match_brute_force(spark, block):
    rows = random_docs(3) + [(9001, None), (9002, ""), (9003, "a b"), (9004, "A  B"), (9005, " \t\n"), (9006, "b a")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in
           minhash.near_duplicates(clashing(frame(spark, rows)), block=block).collect()}
    want = {i: (n, c, c == i) for i, (n, c) in brute_groups(rows).items()}
    assert got == want


@pytest.mark.parametrize("own", [10, 14, 40])
def test_documents_of_one_template(spark, own):
    """Most of each text is the same: one region, whose pairs are linked by what they have beyond the template."""
    rng = np.random.default_rng(own)
    shared = [f"s{k}" for k in range(80)]
    rows = []
    for i in range(90):
        extra = [f"o{rng.integers(0, 400)}" for _ in range(own)]
        if i > 20 and i % 3 == 0:
            extra = rows[i - 20][1].split()[80:80 + own - 1] + [f"z{i}"]
        rows.append((i, " ".join(shared + extra)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows), block=900).collect()}
    assert got == brute_groups(rows)


def test_shared_rare_shingles_keep_every_link(spark):
    """Regions cut by shingles: no linked pair is left without a common region."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{x}" for x in [*range(40), *rng.integers(40, 44, 8)])) for i in range(60)]
    sets = {i: set(minhash.shingles(t.encode()).tolist()) for i, t in rows}
    members = frame(spark, [(1, i, i, True, minhash.shingles(t.encode()).astype("<u8").tobytes(), len(sets[i]), 2, 2) for i, t in rows],
                    "region long, doc_id long, component long, open boolean, shingles binary, n_shingles long, ni long, nj long")
    met = {}
    for r in minhash._sharing(members, 75, 1000).collect():
        met.setdefault(r.group, set()).add(r.doc_id)
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert linked and all(any({a, b} <= g for g in met.values()) for a, b in linked)


def test_near_duplicates_edge_rows(spark):
    rows = [(None, "one two three four five six"), (5, "one two three four five six"), (5, "one two three four five six"),
            (7, "One Two Three Four Five Six")]
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == [(0, None, False), (5, 5, True), (5, 5, True), (7, 5, False)]
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_threshold_is_exact(spark):
    base = [f"t{k}" for k in range(44)]  # 40 shingles
    near = base + [f"u{k}" for k in range(13)]  # 40 of 53 shared: 75.47 percent
    far = base + [f"v{k}" for k in range(14)]  # 40 of 54: 74.07
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_components_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(components, "TASK_LINKS", 10)
    chain = [(k, k + 1) for k in range(100, 160)] + [(1, 2), (2, 1), (3, 3), (None, 4)] + [(500, k) for k in range(600, 640)]
    got = {r.id: r.component for r in components.connected_components(
        frame(spark, chain, "u long, v long").repartition(5)).collect()}
    want = {k: 100 for k in range(100, 161)} | {1: 1, 2: 1, 500: 500} | {k: 500 for k in range(600, 640)}
    assert got == want
    assert components.connected_components(frame(spark, [], "u long, v long")).count() == 0


# --- substrings

def brute_substrings(rows, size=50):
    first, texts = {}, {i: words_of(t) for i, t in rows if i is not None}
    for i in sorted(texts):
        for k in range(len(texts[i]) - size + 1):
            first.setdefault(tuple(texts[i][k:k + size]), i)
    out = {}
    for i, w in texts.items():
        gone = {j for k in range(len(w) - size + 1) if first[tuple(w[k:k + size])] < i for j in range(k, k + size)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("bucket", [substrings.BUCKET_WORDS, 60])
def test_substrings_match_brute_force(spark, bucket):
    rng = np.random.default_rng(5)
    passage = [f"p{k}" for k in range(70)]
    rows = []
    for i in range(40):
        w = [f"w{k}" for k in rng.integers(0, 2000, rng.integers(0, 200))]
        if i % 3 == 0:
            at = rng.integers(0, len(w) + 1)
            w[at:at] = passage[rng.integers(0, 25):]
        rows.append((i * 7 + 2, " \n".join(w)))
    rows += [(900, rows[4][1]), (901, rows[4][1]), (902, None), (903, ""), (904, " ".join(["same"] * 120)),
             (905, " ".join(["same"] * 60)), (906, " ".join(passage[:50])), (907, " ".join(passage[:49]))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in
           substrings.dedup_substrings(clashing(frame(spark, rows)), bucket_words=bucket).collect()}
    assert got == brute_substrings(rows)


def test_substrings_edge_rows(spark):
    text = " ".join(f"w{k}" for k in range(55))
    rows = [(None, text), (3, text), (3, text), (4, text)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in substrings.dedup_substrings(frame(spark, rows)).collect())
    assert got == [(0, 0), (3, 0), (3, 0), (4, 55)]
    # rows of one id with other texts, shorter and longer than the runs found
    rows = [(1, text), (5, text), (5, None), (5, "short"), (5, "x " + text + " y"), (5, " ".join(text.split()[5:]))]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.dedup_substrings(frame(spark, rows)).collect())
    assert got == [(1, 55, 0), (5, 0, 0), (5, 1, 0), (5, 50, 50), (5, 55, 55), (5, 57, 55)]
    assert substrings.dedup_substrings(frame(spark, [])).count() == 0


# --- decontamination

ITEM = "A train with 40 cars leaves the town of Anton at 9 km from the river and carries 40 tons to Berta before noon"


def test_decontamination_meets_changed_slots(spark):
    other = ITEM.replace("40", "17").replace("Anton", "Carl").replace("Berta", "Dora")
    mixed = ITEM.replace("with 40", "with 3").replace("40 tons", "5 tons")  # one value became two, in windows of their own
    rows = [(1, "Before. " + ITEM + ". After"), (2, "x y z " + other.replace(" ", "  ", 1) + " end"), (3, ITEM.upper()),
            (4, "nothing of the kind is said in this text at all, not even once"), (5, None), (6, ""), (None, ITEM),
            (7, " ".join(ITEM.split()[:7])), (8, mixed)]
    bench = frame(spark, [(10, ITEM), (11, None), (12, ""), (None, "a b c d e f g h i j"), (13, "four plain words here")], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontam.decontaminate(clashing(frame(spark, rows)), bench).collect()}
    assert got[1] and got[2]
    assert not any(got[i] for i in (4, 5, 6, None, 7))
    short = decontam.decontaminate(frame(spark, [(1, "so four plain words here it is"), (2, "four plain words")]), bench).collect()
    assert {r.doc_id: r.contaminated for r in short} == {1: True, 2: False}


def test_decontamination_slot_consistency(spark):
    item = "if 5 plus 5 apples are put in one basket then all is well"
    bench = frame(spark, [(1, item)], "item_id long, text string")
    rows = [(1, item.replace("5", "8")), (2, item.replace("5 plus 5", "8 plus 9"))]
    got = {r.doc_id: r.n_windows for r in decontam.decontaminate(frame(spark, rows), bench).collect()}
    assert got[1] > got[2]  # windows with both slots fall away where one value became two


def test_decontamination_empty_tables(spark):
    none = frame(spark, [], "item_id long, text string")
    docs = frame(spark, [(1, ITEM)])
    assert [r.contaminated for r in decontam.decontaminate(docs, none).collect()] == [False]
    assert decontam.decontaminate(frame(spark, []), frame(spark, [(1, ITEM)], "item_id long, text string")).count() == 0


def test_decontamination_without_broadcast_is_the_same(spark, monkeypatch):
    rows = [(1, ITEM), (2, "clean text " * 9)]
    bench = frame(spark, [(10, ITEM)], "item_id long, text string")
    want = sorted(map(tuple, decontam.decontaminate(frame(spark, rows), bench).collect()))
    monkeypatch.setattr(decontam, "MAX_BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, decontam.decontaminate(frame(spark, rows), bench).collect())) == want


def flagged(spark, rows, item):
    bench = frame(spark, [(1, item)], "item_id long, text string")
    return {r.doc_id for r in decontam.decontaminate(frame(spark, rows), bench).collect() if r.contaminated}


def test_decontamination_does_not_depend_on_what_stands_before(spark):
    item = "What is the capital of France?"
    rows = [(1, "Question: " + item), (2, "we ask " + item + " Paris"), (3, item.upper()), (4, "Question:\n " + item.replace(" ", "  ")),
            (5, "What is the height of France?"), (6, "the capital of France")]
    assert flagged(spark, rows, item) == {1, 2, 3, 4}
    item = "Anton sells seven apples to the man who came with 5 kg of plums"
    rows = [(1, item.replace("Anton", "Berta")), (2, "Then " + item.replace("5", "6")), (3, item.replace("Anton", "New York")),
            (4, "Anton sold seven pears to a man who left with 5 kg of plums")]
    assert flagged(spark, rows, item) == {1, 2, 3}


def test_decontamination_keeps_items_of_many_slots_and_few_words(spark):
    rows = [(1, "so: What is 12 + 7 - 3? It is"), (2, "What is 12 + 8 - 3?"), (3, "what is this")]
    assert flagged(spark, rows, "What is 12 + 7 - 3?") == {1}
    rows = [(1, "He said: Define entropy briefly. Then"), (2, "define entropy"), (3, "define entropy, very briefly")]
    assert flagged(spark, rows, "Define entropy briefly.") == {1}
    item = "Scores: 3 4 5 6 7 8 9 10 11 12 13"
    assert flagged(spark, [(1, "x " + item), (2, "x " + item.replace("6", "7"))], item) == {1}


def test_decontamination_matches_sql_in_every_form(spark):
    import duckdb
    rng = np.random.default_rng(6)
    words = ["the", "The", "Anna", "Berta", "New", "York", "5", "12.5", "1,000", "kg", "m", "of", "apples", "ÉCOLE", "école", "x2", "ß", "½"]
    join = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", ", ", ". ", "\n", ": ", "-"]) for _ in range(n))
    items = [(i, join(n)) for i, n in enumerate([1, 2, 3, 3, 4, 5, 6, 7, 8, 9, 12, 12, 30, 0])] + [(90, None), (None, join(9)), (91, "12"), (92, "Yes.")]
    rows = [(i, join(40)) for i in range(40)]
    for i, text in items:
        if text:
            rows += [(100 + 4 * (i or 0), join(3) + text + join(3)), (101 + 4 * (i or 0), text.upper()), (102 + 4 * (i or 0), text.replace("Anna", "Carl").replace("5", "7")),
                     (103 + 4 * (i or 0), join(5) + ". " + text + ". " + join(2))]
    rows += [(None, items[12][1]), (1, None), (2, ""), (3, "12 or yes"), (4, "so 12. Yes! no")]
    bench, docs = frame(spark, items, "item_id long, text string"), frame(spark, rows)
    got = Counter(map(tuple, decontam.decontaminate(docs, bench).collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == Counter(con.execute(decontam.ORACLE).fetchall())
    flags = {k[0]: k[3] for k in got}
    assert flags[4] and sum(flags.values()) > 20
    assert flagged(spark, [(3, "12 or yes"), (4, "so 12. Yes! no"), (5, "12 yes")], "Yes.") == {4}


# --- language ID

def test_letters_are_letters_alone():
    assert [langid.has_letter(t) for t in ("½ ² Ⅷ 12 _ !?", "", None, "½a", "ß", "日", "١٢")] == [False, False, False, True, True, True, False]


def test_language_mixtures():
    rng = np.random.default_rng(1)
    vocab = {"aa": ["the", "and", "with", "other", "than"], "bb": ["der", "und", "nicht", "schon", "keit"]}
    text = {k: " ".join(rng.choice(v, 400)) for k, v in vocab.items()}
    counts = np.array([langid.trigram_counts(text[k]) + 0.5 for k in vocab])
    model = langid.Model(list(vocab), np.log(counts / counts.sum(axis=1, keepdims=True)))
    one, share = model.mixture(" ".join(rng.choice(vocab["bb"], 50)))
    assert [model.langs[i] for i in one] == ["bb"] and share[0] == 1.0
    both, share = model.mixture(" ".join([*rng.choice(vocab["aa"], 70), *rng.choice(vocab["bb"], 30)]))
    assert [model.langs[i] for i in both] == ["aa", "bb"] and 0.55 < share[0] < 0.85


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_id_edge_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "12 ?!", None), (5, "", "de"),
            (None, "the dog", None), (6, "und die " * 50_000, None)]
    docs = clashing(frame(spark, [(*r,) for r in rows * 1], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5))
    assert not got[None].held_out and got[6].lang_pred in ("en", "de")
    empty = frame(spark, [], "doc_id long, text string, lang string")
    assert langid.identify(empty).count() == 0
    none = frame(spark, [(1, "words", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(none).collect()] == ["und"]


# --- toxicity

def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    pos, neg = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    assert (pos[:, None] > neg[None, :]).mean() > 0.97
    flagged = got[got.predicted == 1]
    assert (flagged.toxic == 1).mean() > 0.95 and len(flagged) > 0.7 * len(pos)


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(2)
    model = toxicity.Ftrl()
    for _ in range(600):
        y = int(rng.random() < 0.3)
        slots = np.unique(np.append(rng.integers(0, 5000, 30), 7777 if y else 8888))
        model.learn(slots, y)
    w = model.weights(np.arange(10_000))
    assert w[7777] > 0 and (w != 0).sum() < 200


def test_toxicity_edge_rows(spark):
    docs = clashing(frame(spark, [(1, None), (2, ""), (3, "a b"), (None, "c"), (3, "a b")]))
    none = frame(spark, [], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.5}
    lost = frame(spark, [(77, 1), (None, 1), (78, None)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, lost)).count() == 5
    got = toxicity.score(docs, toxicity.train(docs, frame(spark, [(3, 1), (2, 0)], "doc_id long, toxic int"))).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score(frame(spark, []), toxicity.train(docs, none)).count() == 0


# --- plain versions of the learned operators

def plain_mixture(model, text, penalty=1.0):
    """The best penalised language set among all, by EM in plain loops from equal shares."""
    counts = Counter()
    words = b" ".join(text.lower().encode().translate(langid.KEEP).split())
    raw = b" " + words + b" "
    for k in range(len(raw) - 2):
        code = raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]
        counts[(code * 2654435761 % (1 << 32)) >> (32 - langid.BITS)] += 1
    total, best = sum(counts.values()), None
    for size in (1, 2, 3):
        for own in combinations(range(len(model.langs)), size):
            share = [1 / size] * size
            for _ in range(400):
                new = [0.0] * size
                for b, c in counts.items():
                    parts = [s * float(np.exp(model.logp[i, b])) for s, i in zip(share, own, strict=True)]
                    for j, p in enumerate(parts):
                        new[j] += c * p / sum(parts)
                share = [x / total for x in new]
                if size == 1:
                    break
            like = sum(c * float(np.log(sum(s * np.exp(model.logp[i, b]) for s, i in zip(share, own, strict=True)))) for b, c in counts.items())
            value = like - penalty * np.log(total) * (size - 1)
            if best is None or value > best[0]:
                best = (value, dict(zip(own, share, strict=True)))
    return best[1]


def test_mixtures_match_plain_em():
    rng = np.random.default_rng(3)
    vocab = {"aa": ["the", "and", "with", "other"], "bb": ["der", "und", "nicht", "schon"], "cc": ["les", "avec", "mais", "dans"]}
    text = {k: " ".join(rng.choice(v, 300)) for k, v in vocab.items()}
    counts = np.array([langid.trigram_counts(text[k]) + 0.5 for k in vocab])
    model = langid.Model(list(vocab), np.log(counts / counts.sum(axis=1, keepdims=True)))
    for shares in ((30, 0, 0), (20, 15, 0), (15, 12, 14), (0, 2, 25)):
        t = " ".join(w for k, n in zip(vocab, shares, strict=True) for w in rng.choice(vocab[k], n))
        langs, share = model.mixture(t, rounds=400)
        want = plain_mixture(model, t)
        assert set(langs) == set(want)
        assert all(abs(want[i] - s) < 0.01 for i, s in zip(langs, share, strict=True))


def test_ftrl_matches_plain_updates(spark):
    """Weights by the published per-coordinate rules, a dictionary per coordinate."""
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(30)]
    rows = [(i, " ".join(rng.choice(words, 12)) + (" bad words here" if i % 3 == 0 else "")) for i in range(120)]
    labels = [(i, int(i % 3 == 0)) for i in range(120)]
    docs, marks = frame(spark, rows), frame(spark, labels, "doc_id long, toxic long")
    slots, weights = toxicity.train(docs, marks, l1=0.5, alpha=0.5)
    got = dict(zip(slots.tolist(), weights.tolist(), strict=True))
    order = {r.doc_id: r.d for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("d"),
                                                langid.crc_fold(F.col("doc_id")).alias("fold")).where("fold <> 0").collect()}
    z, n, last = {}, {}, 1 << toxicity.BITS

    def weight(i):
        l1 = 0.0 if i == last else 0.5
        x = z.get(i, 0.0)
        return 0.0 if abs(x) <= l1 else -(x - np.sign(x) * l1) / ((1.0 + n.get(i, 0.0) ** 0.5) / 0.5 + 0.1)

    for _ in range(2):
        for i in sorted(order, key=order.get):
            own = [*toxicity.features(dict(rows)[i].encode()).tolist(), last]
            w = {k: weight(k) for k in own}
            g = 1 / (1 + np.exp(-sum(w.values()))) - int(i % 3 == 0)
            for k in own:
                sigma = ((n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5) / 0.5
                z[k] = z.get(k, 0.0) + g - sigma * w[k]
                n[k] = n.get(k, 0.0) + g * g
    want = {k: weight(k) for k in [*z] if weight(k) != 0.0 or k == last}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert len(want) > 5
