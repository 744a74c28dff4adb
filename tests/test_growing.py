"""Boolean trees, segments, ranked pages and trigrams against scans and single builds."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tidepool.functions import text as tx
from tidepool.operators import boolean as bq
from tidepool.operators import grams as gr
from tidepool.operators import index as ix
from tidepool.operators import ranked as rk
from tidepool.operators import segments as sg
from tidepool.operators.search import SearchTable
from tidepool.session import cut_lineage
from tidepool.sources import clustered as cl
from tidepool.sources import loading

WORDS = ["alpha", "Beta", "gamma", "the", "of", "delta", "x1", "北京", "大学", "is"]


def table(spark, rows, name="docs"):
    return SearchTable(name, spark.createDataFrame(rows, "doc_id long, title string, body string"), ["title", "body"])


def random_rows(rng, n, start=0):
    text = lambda k: rng.choice([None, "", " ".join(rng.choice(WORDS) for _ in range(k))])
    return [(start + i, text(3), text(rng.randint(1, 12))) for i in range(n)]


def keys(df):
    return sorted(tuple(r) for r in df.select("source_table", "id", "tie").collect())


@pytest.mark.parametrize("parser", ["standard", "english", "chinese"])
def test_boolean_trees_equal_the_scan(spark, parser):
    rng = random.Random(3)
    t = table(spark, random_rows(rng, 120))
    post, lengths = ix.build_inverted_index([t], parser)
    a, b = bq.Term("alpha gamma"), bq.Term("beta delta", "body", all=True)
    for q in (a, b, ~a, a & ~b, bq.Phrase("gamma alpha"), bq.Phrase("alpha 北京 delta"), (a | bq.Phrase("beta delta", "title")) & ~bq.Term("x1"),
              ~(a & ~bq.Term("x1")), bq.And(~a, ~b), bq.Or(~a, b), bq.Term("nowhere"), bq.Term("alpha", "no such field"), ~bq.Term("nowhere")):
        got = keys(bq.search_postings(q, post, lengths, parser))
        assert got == keys(bq.search_rows([t], q, parser)) and len(got) == len(set(got)), q


def test_phrases_follow_the_parser(spark):
    df = spark.createDataFrame([("rock the house",), ("rock house",), ("house rock",), ("北京大学",), ("北 京大",), (None,)], "t string")
    hits = lambda p, parser: [r.t for r in df.where(tx.match_phrase("t", p, parser)).collect()]
    assert hits("rock house", "standard") == ["rock house"]
    assert hits("rock house", "english") == ["rock the house", "rock house"]  # stop words are not tokens
    assert hits("京大学", "chinese") == ["北京大学"]


def test_a_tree_makes_the_postings_once(spark):
    t = table(spark, random_rows(random.Random(8), 80))
    post, lengths = ix.build_inverted_index([t])
    stored, made = cut_lineage(post), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b
    q = (bq.Term("alpha gamma", all=True) | bq.Phrase("of the")) & (bq.Term("beta", "title") | bq.Term("delta", "body")) & ~bq.Term("x1")
    got = keys(bq.search_postings(q, stored.mapInArrow(counted, stored.schema), lengths))
    assert got == keys(bq.search_rows([t], q)) and got
    # the counts and the clauses read what was made, not the texts again
    assert made.value == stored.count()


def test_postings_are_made_in_parts(spark, monkeypatch):
    t = table(spark, random_rows(random.Random(9), 150))
    whole = ix._in_parts
    got = {}
    for size in (1, 7, 1 << 19):
        def parts(batches, size=size):
            ix.PART_TOKENS = size
            yield from whole(batches)
        monkeypatch.setattr(ix, "_in_parts", parts)
        post, _ = ix.build_inverted_index([t])
        got[size] = sorted((r.field, r.id, r.length, r.token, r.tf, r.positions) for r in post.collect())
    toks = {(f, str(r["doc_id"]), w): [i for i, x in enumerate(r["t"]) if x == w]
            for f in t.fields for r in t.df.select("doc_id", tx.tokens(f).alias("t")).collect() for w in r["t"] or ()}
    assert {(f, i, w): p for f, i, _, w, _, p in got[1]} == toks
    assert got[1] == got[7] == got[1 << 19] and all(tf == len(p) for *_, tf, p in got[1])


def test_rarest_clause_comes_first(spark):
    counts = {"alpha": 100, "beta": 3, "gamma": 50}
    assert bq._size(bq.Term("alpha beta"), counts, "standard") == 103
    assert bq._size(bq.Term("alpha beta", all=True) & bq.Term("gamma"), counts, "standard") == 3
    assert bq._size(~bq.Term("beta"), counts, "standard") > 10 ** 9


def postings_of(df):
    return sorted((r.id, r.field, r.token, r.tf, tuple(r.positions)) for r in df.collect())


def test_segments_equal_one_build(spark, tmp):
    rng = random.Random(4)
    a, b, c = random_rows(rng, 40), random_rows(rng, 30, 40), [(k, "alpha again", None) for k in (3, 41, 50)]
    sg.append(spark, tmp, [table(spark, a)], buckets=4)
    sg.append(spark, tmp, [table(spark, b)])
    key = lambda ids: spark.createDataFrame([("docs", str(i), "") for i in ids], "source_table string, id string, tie string")
    sg.delete(spark, tmp, key([1, 2, 45, 999]))
    sg.append(spark, tmp, [table(spark, c)], replace=True)
    sg.append(spark, tmp, [table(spark, [(2, "came back", "beta")])])  # after its deletion
    live = {r[0]: r for r in [*a, *b]}
    for i in (1, 2, 45):
        del live[i]
    live.update({r[0]: r for r in [*c, (2, "came back", "beta")]})
    whole = table(spark, list(live.values()))
    post, lengths = ix.build_inverted_index([whole])
    stats = lambda df: {(r.field, r.n_docs): round(r.avgdl, 9) for r in df.collect()}

    def same():
        own = sg.read_postings(spark, tmp)
        assert postings_of(own) == postings_of(post)
        assert stats(sg.read_stats(spark, tmp)) == stats(ix.field_stats(lengths))
        assert keys(ix.search_index(own, "alpha beta")) == keys(ix.search_index(post, "alpha beta"))
        assert keys(bq.search_postings(~bq.Term("alpha"), own, sg.read_rows(spark, tmp))) == keys(bq.search_rows([whole], ~bq.Term("alpha")))
        score = lambda p, s: sorted((r.id, round(r.score, 9)) for r in ix.bm25(p, s, "alpha beta").collect())
        assert score(own, sg.read_stats(spark, tmp)) == score(post, ix.field_stats(lengths))

    same()
    first = sorted(map(int, sg.manifest(spark, tmp)[1]["segments"]))[:2]
    sg.merge(spark, tmp, first)
    same()
    sg.merge(spark, tmp)
    _, m = sg.manifest(spark, tmp)
    assert len(m["segments"]) == 1 and m["marks"] == []
    same()
    sg.vacuum(spark, tmp)
    same()
    assert len([n for n in os.listdir(f"{tmp}/postings") if "=" in n]) == 1


def test_a_lookup_reads_live_segments_and_their_buckets(spark, tmp):
    rng = random.Random(5)
    for k in range(3):
        sg.append(spark, tmp, [table(spark, random_rows(rng, 20, 100 * k))], buckets=8)
    dead = sg.manifest(spark, tmp)[1]["segments"]
    sg.merge(spark, tmp, sorted(map(int, dead))[:2])
    _, m = sg.manifest(spark, tmp)
    plan = ix.lookup(sg.read_postings(spark, tmp), ["alpha"])
    files = {f.split("/postings/")[1].rsplit("/", 1)[0] for f in plan.inputFiles()}
    live = {f"segment={s}" for s in m["segments"]}
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in text and all(f"{s}" in text for s in m["segments"])
    read = [r[0] for r in plan.select(F.input_file_name()).distinct().collect()]
    assert read and all(any(s + "/" in f for s in live) for f in read) and files
    assert len({f.split("bucket=")[1].split("/")[0] for f in read}) == 1


def test_segment_writers_do_not_lose_each_other(spark, tmp, monkeypatch):
    sg.append(spark, tmp, [table(spark, [(1, "alpha", None)])], buckets=2)
    real, ran = loading._create_once, []

    def other_first(spark_, path, text):
        # just before the first commit of a manifest that holds a second segment, another writer commits its own
        if "_CURRENT" in path and not ran and len(sg.json.loads(loading._read_text(spark_, f"{tmp}/manifests/{text}"))["segments"]) == 2:
            ran.append(1)
            sg.append(spark_, tmp, [table(spark_, [(3, "gamma", None)])])
        return real(spark_, path, text)

    monkeypatch.setattr(loading, "_create_once", other_first)
    sg.append(spark, tmp, [table(spark, [(2, "beta", None)])])
    assert ran and {r.token for r in sg.read_postings(spark, tmp).collect()} == {"alpha", "beta", "gamma"}
    with pytest.raises(ValueError, match="indexed already"):
        sg.append(spark, tmp, [table(spark, [(2, "again", None)])])
    with pytest.raises(ValueError, match="parser"):
        sg.append(spark, tmp, [table(spark, [(9, "x", None)])], parser="english")
    with pytest.raises(ValueError, match="not unique"):
        sg.append(spark, tmp, [table(spark, [(9, "x", None), (9, "y", None)])])
    monkeypatch.undo()
    # a merge whose input another merge took is refused
    _, m = sg.manifest(spark, tmp)
    real_write = sg._write_segment

    def merged_first(*args):
        out = real_write(*args)
        monkeypatch.setattr(sg, "_write_segment", real_write)
        sg.merge(spark, tmp)
        return out

    monkeypatch.setattr(sg, "_write_segment", merged_first)
    with pytest.raises(loading.StaleVersion):
        sg.merge(spark, tmp)
    assert {r.token for r in sg.read_postings(spark, tmp).collect()} == {"alpha", "beta", "gamma"}
    assert sg.small_segments({"segments": {"1": 4, "2": 5, "3": 7, "4": 900}}, 3) == [1, 2, 3]
    assert sg.small_segments({"segments": {"1": 4, "2": 900}}, 3) == []


def scanned_rows(df):
    """Rows that the file scans of an executed plan gave, by their metrics."""
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if "Scan" in p.nodeName() and p.metrics().contains("numOutputRows"):
            total += p.metrics().apply("numOutputRows").value()
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return total


def test_ranked_page_equals_the_full_order_and_reads_less(spark, tmp):
    rng = random.Random(6)
    rows = []
    for i in range(3000):
        n = rng.choice([5, 20, 80])
        rows.append((i, None, " ".join(["alpha"] * (i % 7 == 0) * rng.randint(1, 4) + ["beta"] * (i % 11 == 0) + [f"w{rng.randint(0, 300)}" for _ in range(n)])))
    rows += [(5000, None, None), (5001, "", "")]
    t = table(spark, rows)
    post, lengths = ix.build_inverted_index([t])
    rk.write_ranked(post, lengths, tmp, buckets=4, rows=64, page_rows=20)
    full = sorted(((-round(r.score, 9), r.id) for r in ix.bm25(post, ix.field_stats(lengths), "alpha beta").collect()))
    for page, size in ((1, 10), (3, 7), (1, 5000)):
        got = [(-r.score, r.id) for r in rk.ranked_page(spark, tmp, "alpha beta", page, size).collect()]
        assert got == full[(page - 1) * size:page * size]
    toks, idf, kept = rk.kept_blocks(spark, tmp, "alpha beta", 10)
    _, bounds = rk.bounds_of(spark, tmp, toks, "standard")
    assert kept.agg(F.sum("n")).first()[0] < 0.5 * bounds.agg(F.sum("n")).first()[0]
    some = rk._scores(spark, tmp, toks, idf, kept, "standard")
    every = rk._scores(spark, tmp, toks, idf, bounds, "standard")
    some.collect()
    every.collect()
    # the block bounds and idf tables are scanned as well, the same rows in both
    assert scanned_rows(some) < scanned_rows(every)
    assert rk.ranked_page(spark, tmp, "nowhere").count() == 0


@pytest.mark.parametrize("how", ["small chunks", "divided rows"])
def test_ranked_postings_leave_their_task_as_lists(spark, tmp, monkeypatch, how):
    rng = random.Random(10)
    tables = [table(spark, random_rows(rng, 300) + [(None, "alpha", "beta beta"), (7, "alpha", "beta of the"), (7, "alpha gamma", "x1")]), table(spark, random_rows(rng, 90), "notes")]
    post, lengths = ix.build_inverted_index(tables)
    monkeypatch.setattr(rk, "CHUNK", 150)
    if how == "divided rows":
        post = post.repartition(5, "token")
    rk.write_ranked(post, lengths, tmp, buckets=4, rows=16)
    own = post.where("id is not null")
    full = sorted((-round(r.score, 9), r.source_table, r.id) for r in ix.bm25(own, ix.field_stats(lengths), "alpha beta").collect())
    for page, size in ((1, 10), (2, 25), (1, 1000)):
        got = [(-r.score, r.source_table, r.id) for r in rk.ranked_page(spark, tmp, "alpha beta", page, size).collect()]
        assert got == full[(page - 1) * size:page * size] and got
    stored = spark.read.parquet(f"{tmp}/postings")
    found, keys_of = stored.where("token is not null"), stored.where("token is null")
    # a posting names its row by block and place, and only the rows of keys have keys
    assert found.count() == own.count() and found.where("keys is not null").count() == 0 and not {"id", "tie"} & set(stored.columns)
    # what is shuffled are lists, fewer than postings: one of each has the bound and the count of all
    lists = found.where("n is not null")
    assert lists.agg(F.sum("n")).first()[0] == own.count() > 1.5 * lists.count()
    assert lists.count() == found.select("source_table", "field", "token", "block").distinct().count() == spark.read.parquet(f"{tmp}/blocks").count()
    assert keys_of.agg(F.max(F.size("keys"))).first()[0] <= 16
    assert sorted((r.source_table, r.id) for r in keys_of.select("source_table", F.explode("keys").alias("k")).select("source_table", "k.id").collect()) == \
        sorted((r.source_table, r.id) for r in own.select("source_table", "id").distinct().collect())


def test_trigrams_equal_like(spark, tmp):
    rows = [(1, "The Quick brown", "fox_100%"), (2, "the quick BROWN", None), (3, "ΟΔΟΣΑ", "ab"), (4, "", "a%b_c"), (5, None, "line\nbreak quick"),
            (6, "straße", "STRASSE"), (7, "quic", "uick brow"), (8, "x" * 50_000 + " needle", "")]
    t = table(spark, rows)
    gr.write_grams([t], tmp, buckets=4)
    post = gr.read_grams(spark, tmp)
    for pattern, how in (("quick", "contains"), ("QUICK BROWN", "contains"), ("%quick%brown%", "like"), ("%Quick%", "like"), ("%QUICK_B%", "ilike"),
                         ("%fox\\_1%", "like"), ("ΟΔΟΣ", "contains"), ("%οδος%", "ilike"), ("straße", "contains"), ("needle", "contains"),
                         ("line\nbr", "contains"), ("the%", "ilike"), ("nothing here", "contains")):
        want = sorted(str(r.doc_id) + f for f in ("title", "body") for r in t.df.where(tx.like_search(f, pattern, how)).collect())
        got = sorted(r.id + r.field for r in gr.like_rows([t], post, pattern, how).collect())
        assert got == want, (pattern, how)
    assert gr.candidates(post, "needle").count() == 1
    assert gr.literal_parts(r"a\%b%c_d\\", "like") == ["a%b", "c", "d\\"]
    for pattern in ("ab", "%a_b%", "%"):
        with pytest.raises(ValueError, match="scan"):
            gr.candidates(post, pattern, "like")


def test_trigram_postings_are_lists_of_a_block(spark, tmp):
    texts = ["the quick fox", "a quick \U0001d4b3y\U0001d4b3 fox", "", "ab", None, "Quick quick QUICK"]
    rows = [(i // 3 if i % 40 else None, texts[i % 6] if i % 7 else f"the quick fox {i}", texts[i % 5]) for i in range(400)]  # keys repeat or are null
    t = table(spark, [*rows, (1000, "quick " + "".join(map(chr, range(0x4e00, 0x5400))), None)])
    parts = t.df.rdd.getNumPartitions()
    # a row per trigram of a block, however many texts hold it
    one = gr.gram_postings([SearchTable("docs", t.df.coalesce(1), ["title"])]).where("token IS NOT NULL")
    assert one.count() == one.select("token").distinct().count()
    n = t.df.where("lower(title) LIKE '%qui%'").count()
    assert n > 200 and [len(r.rows) for r in one.where("token = 'QUI'").collect()] == [n]
    for block in (gr.BLOCK, 100, 1):
        path = f"{tmp}/{block}"
        gr.write_grams([t], path, buckets=3, block=block)
        post = gr.read_grams(spark, path)
        if block < gr.BLOCK:
            assert post.where("keys IS NOT NULL").count() > 2 * parts
        for pattern, how in (("quick", "contains"), ("the%x 1_%", "like"), ("%\U0001d4b3Y\U0001d4b3%", "ilike"), ("fox", "contains"), ("\u4e01\u4e02\u4e03", "contains")):
            want = sorted(str(r.doc_id) + f for f in ("title", "body") for r in t.df.where(tx.like_search(f, pattern, how)).collect() if r.doc_id is not None)
            got = sorted(r.id + r.field for r in gr.like_rows([t], post, pattern, how).collect())
            assert want and got == want, (block, pattern, how)
        held = {tuple(r) for r in gr.candidates(post, "fox").collect()}
        assert held == {tuple(r) for r in gr.candidates(gr.gram_postings([t]), "fox").collect()}
        assert ("docs", "title", None, "") in held or any(k[2] is None for k in held)


def test_clustered_lookups_read_few_files(spark, tmp):
    rng = random.Random(9)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice(["k%03d" % rng.randint(0, 400), None]) if i % 50 else "hot", t0 + dt.timedelta(minutes=rng.randint(0, 10 ** 5)), rng.gauss(0, 1))
            for i in range(20_000)]
    df = spark.createDataFrame(rows, "id long, name string, ts timestamp_ntz, v double")
    cl.write_clustered(df, tmp, ["id", "ts"], files=25)
    whole = sorted(map(tuple, df.collect()), key=str)
    assert sorted(map(tuple, cl.read_clustered(spark, tmp).collect()), key=str) == whole
    own = cl.read_clustered(spark, tmp, {"id": 777})
    assert [tuple(r) for r in own.collect()] == [rows[777]] and len(own.inputFiles()) <= 8
    lo, hi = t0 + dt.timedelta(days=10), t0 + dt.timedelta(days=11)
    some = cl.read_clustered(spark, tmp, ranges={"ts": (lo, hi)})
    assert sorted(r.id for r in some.collect()) == sorted(r[0] for r in rows if lo <= r[2] < hi) and len(some.inputFiles()) <= 10
    both = cl.read_clustered(spark, tmp, {"id": [5, 19_000], "name": "nobody"}, {"ts": (None, hi)})
    assert both.count() == 0
    assert cl.files_for(spark, tmp, {"id": -1}) == [] and cl.read_clustered(spark, tmp, {"id": -1}).count() == 0
    # one column: a point lies in one file, or in two where it is cut
    one = os.path.join(tmp, "one")
    cl.write_clustered(df, one, ["name"], files=25)
    for name in ("k005", "k399"):
        got = cl.read_clustered(spark, one, {"name": name})
        assert len(got.inputFiles()) <= 2 and got.count() == sum(r[1] == name for r in rows)
    assert cl.read_clustered(spark, one, {"name": "hot"}).count() == 400
    assert cl.write_advised(df, os.path.join(tmp, "two"), files=4)[0] == "ts"
    with pytest.raises(ValueError):
        cl.write_advised(df.select(F.lit(1).alias("c")), os.path.join(tmp, "three"))


def test_sliced_bitmaps_repeat_no_row(spark):
    from tidepool.operators import sliced as sl
    df = spark.createDataFrame([(i * 40_000 // 50, i % 5 or None) for i in range(200)], "pos long, code long")
    rows = df.select(F.expr(f"pos div {sl.BUCKET}").alias("bucket"), F.expr(f"cast(pos % {sl.BUCKET} as int)").alias("place"), "code")
    got = sl._slices(rows, "c", 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # rows are shuffled as they are: what is made of them comes after
    assert plan.count("Exchange") == 1
    below = plan[plan.index("Exchange"):]
    assert "Generate" not in below and "bitmap_construct_agg" not in below
    bits = {(r["slice"], r["bit"]): r["n"] for r in got.groupBy("slice", "bit").agg(F.sum(F.bitmap_count("bitmap")).alias("n")).collect()}
    want = {(-1, 1): 160, (-1, 0): 40}
    for s in range(3):
        for b in (0, 1):
            n = 40 * sum((c >> s & 1) == b for c in range(1, 5))
            if n:
                want[(s, b)] = n
    assert bits == want
