import datetime as dt
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tidepool.operators import index as ix
from tidepool.operators import search as se
from tidepool.operators import sliced as sl
from tidepool.operators import views as vw
from tidepool.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def _keys(df):
    return sorted((r["source_table"], r["id"], r["tie"]) for r in df.select("source_table", "id", "tie").collect())


def test_index_search_equals_scan_search(spark, tmp):
    tabs = fx.search_tables(spark, SF)
    post, lengths = ix.build_inverted_index(tabs)
    ix.write_index(post, lengths, tmp)
    written = ix.read_postings(spark, tmp)
    for kw, rp in [("the", True), ("mit license", True), ("mit license", False)]:
        scan = _keys(se.search(tabs, kw, recall_priority=rp, document=False))
        assert _keys(ix.search_index(written, kw, rp)) == scan
        assert _keys(ix.search_index(post, kw, rp)) == scan
    plan = ix.lookup(written, ["license"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_phrase_index_equals_phrase_scan(spark):
    tabs = fx.search_tables(spark, SF)
    post, _ = ix.build_inverted_index(tabs)
    from tidepool.functions import text as tx
    scan = sorted(r["doc_id"] for r in tabs[0].df.where(tx.match_phrase("text", "under the mit license")).collect())
    idx = sorted(int(r["id"]) for r in ix.match_phrase_index(post, "under the mit license").where("source_table = 'documents'").collect())
    assert scan == idx


def test_bitmap_filter_equals_plain_filter(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    idx = ix.build_bitmap_index(e, ["event_type", "user_id"], "event_id")
    got = ix.bitmap_filter(idx, {"event_type": ["click"], "user_id": [1, 2, 3, 4, 5]}, "and").first()["rows"]
    assert got == e.where("event_type = 'click' AND user_id IN (1, 2, 3, 4, 5)").count()


def test_bitmap_ids_equal_filtered_ids(spark):
    e = spark.createDataFrame([(i, "a" if i % 3 else "b", i % 5) for i in [*range(0, 40), 32766, 32767, 32768, 65535, 70000]],
                              "id long, kind string, user int")
    idx = ix.build_bitmap_index(e, ["kind", "user"], "id")
    for op, both in (("and", "kind = 'a' AND user IN (1, 2)"), ("or", "kind = 'a' OR user IN (1, 2)")):
        got = sorted(r["id"] for r in ix.bitmap_ids(idx, {"kind": "a", "user": [1, 2]}, op).collect())
        assert got == sorted(r["id"] for r in e.where(both).collect())
    assert ix.bitmap_ids(idx, {"kind": "none"}).count() == 0


def test_written_stats_equal_field_stats(spark, tmp):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, None, ""), (3, "", None), (4, "a a", "--")],
                                 "doc_id long, text string, note string")
    post, lengths = ix.build_inverted_index([se.SearchTable("d", docs, fields=["text", "note"], id_col="doc_id")])
    ix.write_index(post, lengths, tmp, buckets=4)
    key = lambda df: sorted(tuple(r) for r in df.select("source_table", "field", "n_docs", "avgdl").collect())
    assert key(ix.read_stats(spark, tmp)) == key(ix.field_stats(lengths)) == [("d", "note", 4, 0.25), ("d", "text", 4, 1.25)]
    score = lambda df: {r["id"]: round(r["score"], 9) for r in df.collect()}
    written = score(ix.bm25(ix.read_postings(spark, tmp), ix.read_stats(spark, tmp), "a"))
    assert written == score(ix.bm25(post, ix.field_stats(lengths), "a")) and set(written) == {"1", "4"}


M = [vw.Measure("qty", "sum", "l_quantity"), vw.Measure("n", "count"), vw.Measure("hi", "max", "l_extendedprice"),
     vw.Measure("disc", "avg", "l_discount"), vw.Measure("parts", "approx_distinct", "l_partkey")]


def test_incremental_refresh_equals_full_refresh(spark, tmp):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    keys = ["l_returnflag"]
    vw.refresh_incremental(spark, tmp, "v", li.where(F.col("l_shipdate") < cut), keys, M)
    vw.refresh_incremental(spark, tmp, "v", li.where(F.col("l_shipdate") >= cut), keys, M)
    inc = {r["l_returnflag"]: r for r in vw.read_view(spark, tmp, "v", keys, M).collect()}
    full = {r["l_returnflag"]: r for r in vw.view_query(li, keys, M).collect()}
    assert inc.keys() == full.keys()
    for k in full:
        assert round(inc[k]["qty"], 6) == round(full[k]["qty"], 6) and inc[k]["n"] == full[k]["n"]
        assert inc[k]["hi"] == full[k]["hi"] and round(inc[k]["disc"], 9) == round(full[k]["disc"], 9)
        assert inc[k]["parts"] == full[k]["parts"]


def test_refuse_unmergeable(spark):
    import pytest
    with pytest.raises(ValueError):
        vw.states(spark.range(3), [], [vw.Measure("d", "count_distinct", "id")])


def test_partition_refresh_replaces_only_touched_days(spark, tmp):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("d", F.to_date("ts"))
    per_day = e.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    path = os.path.join(tmp, "pd")
    vw.refresh_partitions(per_day, path, "d")
    fixed = per_day.where(F.col("d") == F.lit("2024-01-05").cast("date")).withColumn("n", F.lit(-1).cast("bigint"))
    vw.refresh_partitions(fixed, path, "d")
    back = spark.read.parquet(path)
    assert back.count() == per_day.count()
    assert back.where("n = -1").count() == 1


def test_paged_search_by_index_equals_scan(spark, tmp):
    tabs = fx.search_tables(spark, SF)
    post, lengths = ix.build_inverted_index(tabs)
    ix.write_index(post, lengths, tmp)
    written = ix.read_postings(spark, tmp)
    for p in (1, 2):
        a = [tuple(r) for r in se.search_page(tabs, "the license", page=p, size=7, document=False)
             .select("source_table", "id", "tie", F.col("hit_fields")["text"]).collect()]
        b = [tuple(r) for r in se.search_page(tabs, "the license", page=p, size=7, index=written)
             .select("source_table", "id", "tie", F.col("hit_fields")["text"]).collect()]
        assert a == b and len(a) == 7


def test_page_from_doc_store_equals_scan_page_and_prunes(spark, tmp):
    tabs = fx.search_tables(spark, SF)
    post, lengths = ix.build_inverted_index(tabs)
    ix.write_index(post, lengths, f"{tmp}/index")
    ix.write_doc_store(tabs, f"{tmp}/docs", buckets=32)
    store = ix.read_doc_store(spark, f"{tmp}/docs")
    for p in (1, 2):
        got = ix.search_page_from_store(ix.read_postings(spark, f"{tmp}/index"), store, "the license", page=p, size=7)
        a = sorted(tuple(r) for r in got.select("source_table", "id", "tie", F.col("hit_fields")["text"]).collect())
        b = sorted(tuple(r) for r in se.search_page(tabs, "the license", page=p, size=7, document=False)
                   .select("source_table", "id", "tie", F.col("hit_fields")["text"]).collect())
        assert a == b and len(a) == 7
    got.write.format("noop").mode("overwrite").save()
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()


def test_index_fetch_counts_total_in_the_same_pass(spark, tmp):
    tabs = fx.search_tables(spark, SF)
    post, lengths = ix.build_inverted_index(tabs)
    ix.write_index(post, lengths, tmp)
    page = se.search_fetch(tabs, "license", page=1, size=3, index=ix.read_postings(spark, tmp))
    scan_total = se.search(tabs, "license", document=False).count()
    assert page.total == scan_total and len(page.rows) == min(3, scan_total)
    import pytest
    with pytest.raises(ValueError):
        se.search_page(tabs, "license", index=ix.read_postings(spark, tmp), score="tf")


@pytest.mark.parametrize("buckets", [16, 64, 256])
def test_written_index_answers_by_its_own_layout(spark, tmp, buckets):
    from tidepool.operators.search import SearchTable
    rows = [(i, f"alpha {'beta' if i % 2 else 'gamma'} delta{i % 4}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tabs = [SearchTable("d", docs, fields=["text"], id_col="doc_id")]
    post, lengths = ix.build_inverted_index(tabs)
    ix.write_index(post, lengths, f"{tmp}/index", buckets=buckets)
    ix.write_doc_store(tabs, f"{tmp}/docs", buckets=buckets)
    ix.write_index(post, lengths, f"{tmp}/index", buckets=buckets)  # written again, replaced whole
    ix.write_doc_store(tabs, f"{tmp}/docs", buckets=buckets)
    written = ix.read_postings(spark, f"{tmp}/index")
    for word, n in (("alpha", 40), ("beta", 20), ("gamma", 20), ("delta3", 10), ("nothing", 0)):
        assert ix.search_index(written, word).count() == n
    assert ix.match_phrase_index(written, "alpha beta").count() == 20
    page = ix.search_page_from_store(written, ix.read_doc_store(spark, f"{tmp}/docs"), "beta", page=1, size=7)
    assert page.count() == 7
    with pytest.raises(ValueError):
        ix.search_index(written, "alpha", parser="english")
    with pytest.raises(ValueError):
        ix.search_index(spark.read.parquet(f"{tmp}/index/postings"), "alpha")  # no layout, no guess


def test_index_refuses_tables_without_a_unique_key(spark, tmp):
    from tidepool.operators.search import SearchTable
    plain = spark.createDataFrame([("a b",), ("a c",)], "text string")
    with pytest.raises(ValueError):
        ix.build_inverted_index([SearchTable("p", plain, fields=["text"])])
    twice = spark.createDataFrame([(1, "a b"), (1, "a c")], "doc_id long, text string")
    post, lengths = ix.build_inverted_index([SearchTable("t", twice, fields=["text"], id_col="doc_id")])
    with pytest.raises(ValueError):
        ix.write_index(post, lengths, tmp)


@pytest.mark.parametrize("kind", ["string", "long"])
def test_sliced_bitmaps_equal_plain_filters(spark, kind):
    rng = random.Random(7)
    rows = [(k - 40_000, rng.choice([None, *range(-5, 6)]), rng.choice([None, "a", "b", "ç", ""]), rng.choice([None, rng.gauss(0, 1e6), 0.5]))
            for k in range(0, 80_000, 7)]
    df = spark.createDataFrame(rows, "id long, n int, s string, v double")
    if kind == "string":
        df = df.withColumn("id", F.concat(F.lit("r"), F.col("id")))
    ix_ = sl.build_sliced_index(df, ["n", "s", "v"], "id")
    cases = [(sl.Range("n", -2, 3), "n >= -2 AND n < 3"), (sl.Range("n", None, 0, True), "n <= 0"), (~sl.Range("v", 0.5), "NOT v >= 0.5"),
             (sl.In("s", ("a", "zz")) | sl.IsNull("v"), "s IN ('a', 'zz') OR v IS NULL"), (~sl.In("s", ("a", "")), "NOT s IN ('a', '')"),
             (~(sl.Range("n", 1) & ~sl.IsNull("s")), "NOT (n >= 1 AND s IS NOT NULL)"), (sl.Range("v", 1e9), "v >= 1e9"), (sl.In("n", ()), "false"),
             (~sl.In("s", ("a", None)), "s NOT IN ('a', NULL)"), (sl.Range("n"), "n IS NOT NULL"), (~sl.IsNull("n") & sl.Range("v", -1e5, 1e5), "n IS NOT NULL AND v >= -1e5 AND v < 1e5")]
    for p, sql in cases:
        want = sorted(r.id for r in df.where(sql).collect())
        assert sl.count_where(ix_, p).first()["rows"] == len(want), sql
        assert sorted(r.id for r in sl.ids_where(ix_, p).collect()) == want, sql
    with pytest.raises(ValueError, match="told apart"):
        sl.build_sliced_index(df.union(df.limit(1)), ["n"], "id")


def test_code_runs_cover_their_range():
    for first, last in ((0, 0), (0, 7), (3, 12), (5, 5), (1, 14)):
        got = [x for lead, free in sl._runs(first, last, 4) for x in range(lead << free, (lead + 1) << free)]
        assert got == list(range(first, last + 1))


def test_a_null_partition_is_one_row(spark):
    base = spark.createDataFrame([(None,), (1,), (1,)], "p int")
    got = {r.part: (r.base_rows, r.view_rows) for r in vw.staleness_by_partition(base, base.limit(2), F.col("p"), F.col("p")).collect()}
    assert set(got) == {None, 1} and got[None][0] == 1 and got[1][0] == 2


def test_a_stale_refresh_is_refused(spark, tmp, monkeypatch):
    from tidepool.sources import loading
    ms = [vw.Measure("n", "count")]
    a = spark.createDataFrame([(1,)], "k int")
    vw.refresh_incremental(spark, tmp, "v", a, ["k"], ms)
    real = loading.stage

    def overtaken(*args, **kw):
        monkeypatch.setattr(loading, "stage", real)
        vw.refresh_incremental(spark, tmp, "v", a, ["k"], ms)
        return real(*args, **kw)

    for refresh in (lambda: vw.refresh_incremental(spark, tmp, "v", a, ["k"], ms),
                    lambda: vw.refresh_full(spark, tmp, "v", vw.states(a, ["k"], ms))):
        monkeypatch.setattr(loading, "stage", overtaken)
        with pytest.raises(loading.StaleVersion):
            refresh()
    # no delta that was published is lost
    assert vw.read_view(spark, tmp, "v", ["k"], ms).first().n == 3


def test_pairs_with_support_equal_the_plain_form(spark):
    from tidepool.operators import analysis as an
    rng = random.Random(2)
    rows = [(rng.randint(0, 5), dt.datetime(2024, 1, 1 + rng.randint(0, 9)), rng.choice("abcdefghij" + "abc" * 5)) for _ in range(400)]
    df = spark.createDataFrame([*rows, (1, rows[0][1], None), (None, rows[0][1], "a")], "e int, ts timestamp, k string")
    plain = {(r.kind_a, r.kind_b): r.windows for r in an.cooccurrence(df, "e", "ts", "k").collect()}
    for least in (2, 10, 30):
        got = {(r.kind_a, r.kind_b): r.windows for r in an.cooccurrence(df, "e", "ts", "k", min_windows=least).collect()}
        assert got == {p: n for p, n in plain.items() if n >= least}


def test_pairs_with_support_are_counted_in_blocks(spark, monkeypatch):
    from tidepool.operators import analysis as an
    rng = random.Random(4)
    # one entity that every kind acts on each day, and many that few do: both ways of counting
    rows = [(0, dt.datetime(2024, 1, 1 + d), f"k{k:02}") for k in range(30) for d in range(4)]
    rows += [(rng.randint(1, 60), dt.datetime(2024, 1, 1 + rng.randint(0, 9)), f"k{rng.randint(0, 29):02}") for _ in range(900)]
    df = spark.createDataFrame(rows, "e int, ts timestamp, k string")
    plain = {(r.kind_a, r.kind_b): r.windows for r in an.cooccurrence(df, "e", "ts", "k").collect()}
    monkeypatch.setattr(an, "BLOCK_WINDOWS", 200)
    monkeypatch.setattr(an, "TILE_CELLS", 64)
    monkeypatch.setattr(an, "DENSE_SHARE", 4)
    pairs = an.cooccurrence(df, "e", "ts", "k", min_windows=6)
    assert {(r.kind_a, r.kind_b): r.windows for r in pairs.collect()} == {p: n for p, n in plain.items() if n >= 6}
    # the pairs themselves are not joined by their windows, nor shuffled
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "kind_a" not in plan.split("FlatMapGroupsInArrow", 1)[1].split("\n", 1)[1]


def test_pairs_with_support_shuffle_each_row_a_bounded_number_of_times(spark, monkeypatch):
    from tidepool.operators import analysis as an
    rng = random.Random(5)
    rows = [(rng.randint(0, 20), dt.datetime(2024, 1, 1 + rng.randint(0, 9)), f"k{rng.randint(0, 99):02}") for _ in range(4000)]
    df = spark.createDataFrame(rows, "e int, ts timestamp, k string").repartition(5)
    plain = {(r.kind_a, r.kind_b): r.windows for r in an.cooccurrence(df, "e", "ts", "k").collect()}
    want = {p: n for p, n in plain.items() if n >= 7}
    monkeypatch.setattr(an, "BLOCK_WINDOWS", 20)
    # more than 100 blocks of the least size: a row is moved to about 8, and to more where a task could not hold two of the eight
    for most, low, high in ((1 << 21, 5, 9), (100, 15, 60)):
        monkeypatch.setattr(an, "BLOCKS", 8, raising=False)
        monkeypatch.setattr(an, "MOST_BLOCK_WINDOWS", most, raising=False)
        pairs = an.cooccurrence(df, "e", "ts", "k", min_windows=7)
        assert {(r.kind_a, r.kind_b): r.windows for r in pairs.collect()} == want and len(want) > 50
        copies = int(re.search(r"sequence\(0, (\d+)", pairs._jdf.queryExecution().analyzed().toString())[1]) + 1
        assert low <= copies <= high
    # windows are numbered without gaps, whatever their partition
    numbered = an._numbered(df.select("e", "ts").distinct().repartition(7))
    assert sorted(r["_item"] for r in numbered.collect()) == list(range(numbered.count()))


def test_bitmaps_are_built_where_their_rows_are(spark):
    from tidepool.operators import index as ix
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "id long, v int")
    plan = ix.build_bitmap_index(df, ["v"], "id")._jdf.queryExecution().executedPlan().toString()
    # the only shuffle moves rows, before any bitmap
    assert plan.count("Exchange") == 1
    assert "bitmap_construct_agg" not in plan[plan.index("Exchange"):]


def test_postings_group_tokens_within_their_row(spark):
    from tidepool.operators import index as ix
    from tidepool.operators.search import SearchTable
    # a key that repeats: fields of one length are indexed as one, others apart
    df = spark.createDataFrame([(1, "b a b"), (1, "a c c"), (1, "a"), (2, None), (3, " . "), (4, "x")], "doc_id long, body string")
    post, lengths = ix.build_inverted_index([SearchTable("docs", df, ["body"])])
    got = sorted((r.id, r.length, r.token, r.tf, r.positions) for r in post.collect())
    assert got == [("1", 1, "a", 1, [0]), ("1", 3, "a", 2, [0, 1]), ("1", 3, "b", 2, [0, 2]), ("1", 3, "c", 2, [1, 2]), ("4", 1, "x", 1, [0])]
    assert sorted((r.id, r.length) for r in lengths.collect()) == [("1", 1), ("1", 3), ("1", 3), ("2", 0), ("3", 0), ("4", 1)]
    # no aggregate over the occurrences of tokens
    plan = post._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.index("Aggregate") > plan.rindex("Generate explode(array_distinct")
