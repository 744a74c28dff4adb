import pytest
from pyspark.sql import functions as F

from tidepool.operators import search as se
from tidepool.plans import sqlapi


def _tables(spark):
    a = spark.createDataFrame([(1, "alpha beta", "x"), (2, "beta gamma", None), (3, None, "beta")],
                              "doc_id long, body string, title string")
    b = spark.createDataFrame([(10, 0, "beta"), (10, 1, "beta beta"), (11, 0, "delta")],
                              "conv_id long, turn long, text string")
    return [se.SearchTable("a", a, ["body", "title"]), se.SearchTable("b", b, ["text"], tiebreak=("turn",))]


def test_search_merges_tables_and_fields(spark):
    hits = se.search(_tables(spark), "beta").collect()
    keys = sorted((h["source_table"], h["id"], h["tie"]) for h in hits)
    assert keys == [("a", "1", ""), ("a", "2", ""), ("a", "3", ""), ("b", "10", "0"), ("b", "10", "1")]
    h3 = [h for h in hits if h["id"] == "3"][0]
    assert h3["hit_fields"] == {"title": "beta"}
    assert h3["score"] == 1.0
    assert '"doc_id":3' in h3["document"]


def test_all_mode_needs_one_field(spark):
    a = spark.createDataFrame([(1, "alpha", "beta"), (2, "alpha beta", None)], "id long, f1 string, f2 string")
    hits = se.search([se.SearchTable("a", a, ["f1", "f2"])], "alpha beta", recall_priority=False).collect()
    assert [h["id"] for h in hits] == ["2"]


def test_hit_id_rule_last_wins(spark):
    df = spark.createDataFrame([(1, 2, "x")], "id long, user_id long, t string")
    assert se.hit_id_column(df) == "user_id"
    assert se.searchable_fields(df) == ["t"]


def test_pages_cover_the_whole_result(spark):
    tabs = _tables(spark)
    whole = se.search(tabs, "beta gamma delta alpha", document=False)
    total = whole.count()
    seen = []
    for p in range(1, 5):
        seen += [(r["source_table"], r["id"], r["tie"]) for r in se.search_page(tabs, "beta gamma delta alpha", page=p, size=2,
                                                                                 document=False).collect()]
    assert len(seen) == total == len(set(seen))
    page = se.search_fetch(tabs, "beta", page=2, size=2)
    assert page.total == 5 and len(page.rows) == 2 and page.total_pages == 3


def test_page_past_the_end_and_defaults():
    assert sqlapi.normalize_page(0, 0) == (1, 10)
    assert sqlapi.normalize_page(3, 100, max_size=100) == (3, 100)
    with pytest.raises(ValueError):
        sqlapi.normalize_page(3, 500, max_size=100)
    assert sqlapi.total_pages_value(21, 10) == 3


def test_page_past_end_is_empty(spark):
    assert se.search_page(_tables(spark), "beta", page=9, size=10).count() == 0


def test_skip_failing_table(spark):
    tabs = _tables(spark) + [se.SearchTable("bad", _tables(spark)[0].df, ["no_such_field"])]
    rep = se.SearchReport()
    hits = se.search(tabs, "beta", on_error="skip", report=rep)
    assert hits.count() == 5 and rep.skipped and rep.skipped[0][0] == "bad"


def test_time_range_and_filters(spark):
    df = spark.createDataFrame([(1, "beta", "2024-01-01 10:00:00", "x"), (2, "beta", "2024-01-02 10:00:00", "y"),
                                (3, "beta", "2024-01-03 10:00:00", "x")], "id long, t string, ts string, k string") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    t = se.SearchTable("e", df, ["t"], ts_col="ts")
    got = se.search([t], "beta", time_range=("2024-01-01 00:00:00", "2024-01-03 10:00:00"), filters={"k": "x"}).collect()
    assert [r["id"] for r in got] == ["1"]


def test_run_sql_refuses_empty_and_duplicates(spark):
    import pytest
    with pytest.raises(ValueError):
        sqlapi.run_sql(spark, "  ")
    with pytest.raises(ValueError):
        sqlapi.run_sql(spark, "SELECT 1 AS a, 2 AS a")
    assert sqlapi.run_sql(spark, "SELECT :x + 1 AS y", {"x": 41}).first()["y"] == 42


def test_keyset_pages_equal_offset_pages(spark):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_totalprice")
    order = [("o_totalprice", "DESC"), ("o_orderkey", "ASC")]
    after = None
    for p in range(1, 4):
        keyset = sqlapi.page_after(o, order, after, 7).collect()
        offset = sqlapi.paginate(o, p, 7, order).collect()
        assert keyset == offset
        after = (keyset[-1]["o_totalprice"], keyset[-1]["o_orderkey"])
