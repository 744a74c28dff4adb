import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.operators import keyed
from tidepool.sources import ingest, loading

EV = ingest.RAW_EVENT_DDL


def _events(spark):
    ts = dt.datetime(2024, 1, 1, 10, 0, 0)
    zero = dt.datetime(1, 1, 1, 0, 0, 0)
    rows = [
        ("1", "src", "logs", ts, '{"a":1}', None, {"env": "t"}, ts),
        ("2", "", "logs", None, None, None, None, None),            # empty source wins
        ("3", None, "", ts, '{"a":1}', None, None, None),            # NULL source
        ("4", "src", None, ts, '{"a":1}', None, None, None),         # empty type
        ("5", "src", "logs", None, '{"a":1}', None, None, None),     # NULL ts
        ("6", "src", "logs", zero, '{"a":1}', None, None, None),     # zero time
        ("7", "src", "logs", ts, None, bytearray(b""), None, None),  # no payload
        ("8", "src", "logs", ts, None, bytearray(b"x"), None, None),  # raw payload is enough
    ]
    return spark.createDataFrame(rows, EV)


def test_validation_order(spark):
    got = {r["id"]: r["reject_reason"] for r in ingest.validate_events(_events(spark)).collect()}
    assert got == {"1": None, "2": ingest.REASON_EMPTY_SOURCE, "3": ingest.REASON_EMPTY_SOURCE,
                   "4": ingest.REASON_EMPTY_TYPE, "5": ingest.REASON_ZERO_TS, "6": ingest.REASON_ZERO_TS,
                   "7": ingest.REASON_NO_PAYLOAD, "8": None}


def test_summary_and_strict(spark):
    s = ingest.ingest_summary(_events(spark)).first()
    assert (s["ingested"], s["persist_failed"], s["validation_failed"]) == (2, 0, 6)
    with pytest.raises(ValueError):
        ingest.strict_check(s)
    one = ingest.ingest_summary(_events(spark).where("id = '1'")).first()
    ingest.strict_check(one)


def test_normalize_uses_now(spark):
    df = spark.createDataFrame([("a", "2024-01-02 03:04:05"), ("b", "garbage"), ("c", None)], "id string, ts string")
    got = {r["id"]: r["ts"] for r in ingest.normalize_events(df, "2030-01-01 00:00:00").collect()}
    assert got["a"] == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert got["b"] == got["c"] == dt.datetime(2030, 1, 1)


def test_route_by_type_writes_partitions(spark, tmp):
    root = os.path.join(tmp, "routed")
    ingest.route_by_type(_events(spark), root)
    back = spark.read.parquet(root)
    assert back.count() == 2 and {r["data_type"] for r in back.select("data_type").collect()} == {"logs"}


SCHEMA = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType()),
                       T.StructField("amount", T.DoubleType())])


def test_csv_rejects_per_row(spark, tmp):
    p = os.path.join(tmp, "a.csv")
    with open(p, "w") as f:
        f.write("1||ann||2.5\n2||bob||oops\n3||cy\n4||dee||1.0||extra\nx||eve||3.0\n5||fay||4.0\n")
    df = loading.load_csv(spark, p, SCHEMA, column_separator="||")
    got = {r["name"]: r[loading.REASON] for r in df.collect()}
    assert got["ann"] is None and got["fay"] is None
    assert got["bob"] == "bad value in amount"
    assert got["eve"] == "bad value in id"
    assert got["cy"] == "malformed row" and got["dee"] == "malformed row"


def test_csv_row_delimiter(spark, tmp):
    p = os.path.join(tmp, "b.csv")
    with open(p, "w") as f:
        f.write("1,a,1.0;;2,b,2.0;;3,c,3.0")
    df = loading.load_csv(spark, p, SCHEMA, row_delimiter=";;")
    assert df.where(F.col(loading.REASON).isNull()).count() == 3


def test_json_lines_and_array(spark, tmp):
    p = os.path.join(tmp, "a.json")
    with open(p, "w") as f:
        f.write('{"id": 1, "name": "a", "amount": 1.5}\n{"id": "two", "name": "b", "amount": 2}\n{broken\n')
    got = [r[loading.REASON] for r in loading.load_json(spark, p, SCHEMA).orderBy(F.col("name").asc_nulls_last()).collect()]
    assert got == [None, "bad value in id", "malformed row"]
    q = os.path.join(tmp, "arr.json")
    with open(q, "w") as f:
        f.write('[{"id": 1, "name": "a", "amount": 1.5}, {"id": 2, "name": "b", "amount": "x"}, {"id": 3, "name": "c"}]')
    rows = loading.load_json(spark, q, SCHEMA, strip_outer_array=True).orderBy("name").collect()
    assert [r[loading.REASON] for r in rows] == [None, "bad value in amount", None]


def test_filter_ratio_and_report(spark, tmp):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "bad")], f"id long, name string, {loading.REASON} string")
    df = loading.load_where(df, "name <> 'zzz'")
    with pytest.raises(loading.LoadRejected):
        loading.write_load(df, os.path.join(tmp, "t1"), "l1")
    rep = loading.write_load(df, os.path.join(tmp, "t2"), "l2", max_filter_ratio=0.5)
    assert (rep.total_rows, rep.loaded_rows, rep.filtered_rows) == (2, 1, 1) and rep.loaded_bytes > 0


def test_load_once_and_stage(spark, tmp):
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    r1 = loading.load_once(df, tmp, "lbl")
    r2 = loading.load_once(df, tmp, "lbl")
    assert loading._create_once(spark, os.path.join(tmp, "_labels", "other.json.claim"), "x")
    with pytest.raises(RuntimeError):
        loading.load_once(df, tmp, "other")
    assert r2.extra.get("repeated") and r1.loaded_rows == r2.loaded_rows == 1
    assert spark.read.parquet(os.path.join(tmp, "data")).count() == 1
    root = os.path.join(tmp, "staged")
    s1 = loading.stage(df, root, "t1")
    loading.publish(spark, s1)
    s2 = loading.stage(df.union(df), root, "t2")
    loading.abandon(spark, s2)
    loading.abandon(spark, s2)  # twice is fine
    assert loading.read_current(spark, root).count() == 1
    with pytest.raises(ValueError):
        loading.publish(spark, s2)


def test_labels_of_dead_loads(spark, tmp):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    claim = loading._claim_path(tmp, "l/b=1")
    # a load that died after its data: its lease has run out, and what it left is replaced
    loading._create_once(spark, claim, '{"owner": "x", "until": 0}')
    df.union(df).withColumn("_load_label", F.lit("l/b=1")).write.partitionBy("_load_label").parquet(os.path.join(tmp, "data"))
    assert loading.load_once(df, tmp, "l/b=1").loaded_rows == 2
    rows = spark.read.parquet(os.path.join(tmp, "data"))
    assert sorted(r.id for r in rows.where(F.col("_load_label") == "l/b=1").collect()) == [1, 2]
    with pytest.raises(ValueError):
        loading.release_label(spark, tmp, "l/b=1")
    # one whose lease still runs is refused until it is released
    loading._create_once(spark, loading._claim_path(tmp, "two"), '{"owner": "x", "until": 9e18}')
    with pytest.raises(RuntimeError, match="release"):
        loading.load_once(df, tmp, "two")
    loading.release_label(spark, tmp, "two")
    loading.load_once(df, tmp, "two")
    # a load that is refused for its rows gives its claim back
    bad = df.withColumn(loading.REASON, F.lit("bad"))
    with pytest.raises(loading.LoadRejected):
        loading.load_once(bad, tmp, "three")
    loading.load_once(df, tmp, "three")
    assert spark.read.parquet(os.path.join(tmp, "data")).count() == 6


def test_a_load_that_lost_its_claim_writes_nothing(spark, tmp, monkeypatch):
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    real = loading.write_load

    def overtaken(*a, **kw):
        out = real(*a, **kw)
        if "_aside" in a[1]:
            monkeypatch.setattr(loading, "write_load", real)
            loading._delete(spark, loading._claim_path(tmp, "x"))
            loading.load_once(df.union(df), tmp, "x")
        return out

    monkeypatch.setattr(loading, "write_load", overtaken)
    with pytest.raises(RuntimeError, match="lost"):
        loading.load_once(df, tmp, "x")
    assert spark.read.parquet(os.path.join(tmp, "data")).count() == 2


def test_of_two_writers_one_wins(spark, tmp):
    a, b = (spark.createDataFrame([(k, 1.0)], "k long, v double") for k in (1, 2))
    one, two = loading.stage(a, tmp, "one"), loading.stage(b, tmp, "two")
    loading.publish(spark, one)
    with pytest.raises(loading.StaleVersion):
        loading.publish(spark, two)
    assert two.state == "ABANDONED" and [r.k for r in loading.read_current(spark, tmp).collect()] == [1]
    loading.publish(spark, loading.stage(b, tmp, "three"))
    assert loading.current_version(spark, tmp) == (2, "three")
    # a pointer entry of the older form is read, and goes on
    old = os.path.join(tmp, "old")
    a.write.parquet(os.path.join(old, "_versions", "t9"))
    loading._write_text(spark, os.path.join(old, "_CURRENT", f"{17:020d}-t9"), "t9")
    assert loading.current_version(spark, old) == (17, "t9")
    loading.publish(spark, loading.stage(b, old, "next"))
    assert loading.current_version(spark, old) == (18, "next") and loading.read_current(spark, old).first().k == 2


def test_load_moves_only_what_passes(spark, tmp):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "bad"), (3, "a", None)], f"id long, p string, {loading.REASON} string")
    path = os.path.join(tmp, "t")
    for _ in range(2):
        rep = loading.write_load(df, path, "l", max_filter_ratio=0.5, partition_by=["p"])
        assert (rep.total_rows, rep.loaded_rows, rep.filtered_rows) == (3, 2, 1) and rep.loaded_bytes > 0
    with pytest.raises(loading.LoadRejected):
        loading.write_load(df, path, "l", partition_by=["p"])
    assert spark.read.parquet(path).count() == 4 and not [n for n in os.listdir(path) if "aside" in n]
    loading.write_load(df, path, "l", max_filter_ratio=0.5, mode="overwrite", partition_by=["p"])
    assert spark.read.parquet(path).count() == 2


def test_time_partitions_are_pruned(spark, tmp):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    p = os.path.join(tmp, "bytime")
    loading.write_by_time(e, p, "ts", "day")
    r = loading.read_time_range(spark, p, "ts", "2024-01-05 00:00:00", "2024-01-07 00:00:00")
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(d" in plan
    want = e.where("ts >= '2024-01-05' AND ts < '2024-01-07'").count()
    assert r.count() == want


def test_bucketed_write(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    loading.write_bucketed(li, "li_bucketed", ["l_orderkey"], 8, ["l_orderkey"])
    t = spark.table("li_bucketed")
    agg = t.groupBy("l_orderkey").count()
    assert "Exchange" not in agg._jdf.queryExecution().executedPlan().toString()
    assert agg.count() == li.select("l_orderkey").distinct().count()


def test_keyed_loads_with_duplicate_keys_in_batch(spark):
    target = spark.createDataFrame([(1, 10.0, 1), (2, 20.0, 1)], "k long, v double, seq long")
    batch = spark.createDataFrame([(1, 11.0, 2), (1, 12.0, 3), (3, 30.0, 2), (None, 5.0, 9)], "k long, v double, seq long")
    u = {r["k"]: r["v"] for r in keyed.load_unique(target, batch, ["k"], "seq").collect()}
    assert u[1] == 12.0 and u[2] == 20.0 and u[3] == 30.0
    p = {r["k"]: r["v"] for r in keyed.load_primary(target, batch, ["k"], "seq").collect()}
    assert None not in p and p[1] == 12.0
    a = {r["k"]: r["v"] for r in keyed.load_aggregate(target, batch, ["k"], {"v": "sum", "seq": "max"}, "seq").collect()}
    assert a[1] == 33.0
    m = {r["k"]: r["v"] for r in keyed.merge_condition(target, spark.createDataFrame(
        [(1, 9.0, 5), (2, 25.0, 5)], "k long, v double, seq long"), ["k"], "v", "seq").collect()}
    assert m == {1: 10.0, 2: 25.0}


def test_stage_is_one_pass_and_abandons_a_bad_load(spark, tmp):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "bad"), (3, "c", None)], f"id long, name string, {loading.REASON} string")
    st = loading.stage(df, tmp, "ok1", max_filter_ratio=0.5)
    assert (st.report.total_rows, st.report.filtered_rows, st.report.loaded_rows) == (3, 1, 2)
    loading.publish(spark, st)
    assert loading.read_current(spark, tmp).count() == 2
    with pytest.raises(loading.LoadRejected):
        loading.stage(df, tmp, "bad1", max_filter_ratio=0.1)
    assert loading.read_current(spark, tmp).count() == 2


def test_upsert_touches_only_changed_buckets(spark, tmp):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = os.path.join(tmp, "tbl")
    first = e.where("ts < '2024-01-20'")
    second = e.where("ts >= '2024-01-15'").withColumn("value", F.col("value") + 1)
    keyed.upsert(path, first, ["user_id", "event_type"], ["ts", "event_id"], n_buckets=32)
    touched = keyed.upsert(path, second.where("user_id < 20"), ["user_id", "event_type"], ["ts", "event_id"], n_buckets=32)
    assert 0 < len(touched) < 32
    got = spark.read.parquet(path).drop(keyed.KEY_BUCKET)
    want = keyed.load_unique(first, second.where("user_id < 20"), ["user_id", "event_type"], ["ts", "event_id"])
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_upsert_primary_partial_and_condition(spark, tmp):
    t = spark.createDataFrame([(1, 10.0, "a", 1), (2, 20.0, "b", 1)], "k long, v double, s string, seq long")
    b = spark.createDataFrame([(1, 15.0, "x", 2), (3, 30.0, "y", 2)], "k long, v double, s string, seq long")
    p1, p2 = os.path.join(tmp, "p"), os.path.join(tmp, "c")
    keyed.upsert(p1, t, ["k"], "seq", n_buckets=8)
    keyed.upsert(p1, b, ["k"], "seq", model="primary", cols=["v"], n_buckets=8)
    got = {r["k"]: (r["v"], r["s"]) for r in spark.read.parquet(p1).collect()}
    assert got == {1: (15.0, "a"), 2: (20.0, "b"), 3: (30.0, None)}
    keyed.upsert(p2, t, ["k"], "seq", n_buckets=8)
    lower = spark.createDataFrame([(1, 5.0, "z", 3), (2, 25.0, "w", 3)], "k long, v double, s string, seq long")
    keyed.upsert(p2, lower, ["k"], "seq", model="condition", col="v", n_buckets=8)
    got = {r["k"]: (r["v"], r["s"]) for r in spark.read.parquet(p2).collect()}
    assert got == {1: (10.0, "a"), 2: (25.0, "w")}


def test_keyed_refusals(spark):
    t = spark.createDataFrame([(1, 1.0, "a")], "k long, v double, s string")
    with pytest.raises(ValueError):
        keyed.load_aggregate(t, t, ["k"], {"v": "sum"}, "v")  # s has no aggregation type
    with pytest.raises(ValueError):
        keyed.load_aggregate(t, t, ["k"], {"v": "sum", "s": "median"}, "v")


def test_materialisation_goes_to_the_sessions_checkpoint_dir(spark):
    from tidepool.session import checkpoint_dir, cut_lineage
    root = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_dir(spark) == root  # read from the session, not replaced
    m = cut_lineage(spark.range(5), "probe")
    files = m.inputFiles()
    assert files and all(f.split(":", 1)[-1].lstrip("/").startswith(root.lstrip("/")) for f in files), (root, files[:2])
    assert m.count() == 5


def test_upsert_keeps_to_the_stored_layout(spark, tmp):
    rows = [(k, float(k), 1) for k in range(20)]
    first = spark.createDataFrame(rows, "k long, v double, seq long")
    again = first.withColumn("v", F.col("v") + 1).withColumn("seq", F.lit(2).cast("long"))
    for n in (16, 64, 256):
        path = f"{tmp}/t{n}"
        keyed.upsert(path, first, ["k"], "seq", n_buckets=n)
        keyed.upsert(path, again, ["k"], "seq")  # the stored count is taken
        got = spark.read.parquet(path)
        assert got.count() == 20 and got.where("v = k + 1").count() == 20
        with pytest.raises(ValueError):
            keyed.upsert(path, again, ["k"], "seq", n_buckets=n + 1)
        with pytest.raises(ValueError):
            keyed.upsert(path, again, ["v"], "seq")


def test_upsert_after_a_load_that_died(spark, tmp, monkeypatch):
    from tidepool import session
    df = spark.createDataFrame([(1, 1.0, 1), (2, 2.0, 1)], "k long, v double, seq long")
    path = os.path.join(tmp, "t")
    real = session.cut_lineage

    def dies(*a, **kw):
        raise RuntimeError("lost")

    monkeypatch.setattr(session, "cut_lineage", dies)
    with pytest.raises(RuntimeError):
        keyed.upsert(path, df, ["k"], "seq", n_buckets=8)
    monkeypatch.setattr(session, "cut_lineage", real)
    with pytest.raises(ValueError, match="8 buckets"):
        keyed.upsert(path, df, ["k"], "seq", n_buckets=4)
    keyed.upsert(path, df, ["k"], "seq")
    assert spark.read.parquet(path).count() == 2
