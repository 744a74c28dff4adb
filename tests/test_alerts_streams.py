import datetime as dt
import os
import time

import pandas as pd
from pyspark.sql import functions as F

from tidepool.operators import alerts as al
from tidepool.operators import views as vw
from tidepool.plans import fixtures as fx
from tidepool.plans.q_metrics import RULES
from tidepool.streaming import streams as st

SF = "/root/testdata/sf0.001"
H = 3600


def _series(spark, points):
    rows = [("m", "u1", dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), float(v)) for h, v in points]
    return spark.createDataFrame(rows, "metric string, user string, ts timestamp_ntz, value double")


def _eval(spark, points, for_h):
    rules = [{"rule_id": "r", "name": "n", "metric": "m", "expression": "value > 10", "for_duration_s": for_h * H,
              "severity": "info"}]
    return sorted((r["active_at"].hour, r["state"], r["resolved_at"].hour if r["resolved_at"] else None)
                  for r in al.evaluate_alerts(_series(spark, points), rules, H, ["user"]).collect())


def test_alert_durations_recovery_and_gaps(spark):
    # true for 0h..2h (lasted 2h), then false: resolved at the false sample
    assert _eval(spark, [(0, 20), (1, 20), (2, 20), (3, 0)], 2) == [(0, "RESOLVED", 3)]
    # shorter than for_duration and then false: nothing
    assert _eval(spark, [(0, 20), (1, 20), (2, 0)], 2) == []
    # still true at the end but not long enough: pending; long enough: firing
    assert _eval(spark, [(0, 0), (1, 20), (2, 20)], 2) == [(1, "PENDING", None)]
    assert _eval(spark, [(1, 20), (2, 20), (3, 20)], 2) == [(1, "FIRING", None)]
    # a gap longer than the step splits islands; the first ends one step after its last sample
    assert _eval(spark, [(0, 20), (1, 20), (5, 20), (6, 20)], 1) == [(0, "RESOLVED", 2), (5, "FIRING", None)]


def test_two_label_sets_are_separate_series(spark):
    rows = [("m", u, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), 20.0) for u in ("a", "b") for h in range(3)]
    s = spark.createDataFrame(rows, "metric string, user string, ts timestamp_ntz, value double")
    rules = [{"rule_id": "r", "name": "n", "metric": "m", "expression": "value > 10", "for_duration_s": H, "severity": "x"}]
    assert al.evaluate_alerts(s, rules, H, ["user"]).count() == 2


def test_check_rules(spark):
    r = spark.createDataFrame([("a", "x > 1", "info"), ("", "x > 1", "info"), ("b", None, "info"), ("c", "x", " ")],
                              "name string, expression string, severity string")
    assert [x["invalid_reason"] for x in al.check_rules(r).collect()] == [
        None, "name is required", "expression is required", "severity is required"]


def test_stream_alerts_equal_batch_alerts(spark, tmp):
    series = al.sample_series(fx.metric_points(spark, SF), "1 hour")
    batch = {(r["rule_id"], r["active_at"]): (r["state"], r["resolved_at"])
             for r in al.evaluate_alerts(series, RULES, H).collect()}
    # feed the samples as a file stream in time order, several files
    src = os.path.join(tmp, "samples")
    pdf = series.toPandas().sort_values("ts")
    # one file per chunk, written in time order (the file source takes files by modification time)
    for i, chunk in enumerate([pdf.iloc[j:j + 500] for j in range(0, len(pdf), 500)]):
        spark.createDataFrame(chunk, series.schema).coalesce(1).write.mode("overwrite") \
            .parquet(os.path.join(src, f"part={i:04d}"))
        time.sleep(1.1)
    stream = st.read_stream(spark, src + "/*", series.schema, max_files_per_trigger=1)
    q = st.stream_alerts(stream, RULES, H).writeStream.format("memory").queryName("alerts_out") \
        .outputMode("update").option("checkpointLocation", os.path.join(tmp, "ck")).start()
    q.processAllAvailable()
    q.stop()
    out = spark.table("alerts_out").toPandas()
    last = {}
    for r in out.itertuples():
        last[(r.rule_id, pd.Timestamp(r.active_at).to_pydatetime())] = r
    live = {k: v for k, v in last.items() if v.state in ("FIRING", "PENDING", "RESOLVED")}
    assert set(live) == set(batch)
    for k, v in live.items():
        assert v.state == batch[k][0]


def test_ingest_stream_is_replay_safe(spark, tmp):
    raw = fx.raw_events(spark, SF).drop("event_id", "value")
    src = os.path.join(tmp, "src")
    raw.repartition(3).write.parquet(src)
    sink, dead, ck = (os.path.join(tmp, x) for x in ("sink", "dead", "ck"))
    q = st.ingest_stream(st.read_stream(spark, src, raw.schema, max_files_per_trigger=1), sink, dead, ck)
    q.awaitTermination()
    good, bad = spark.read.parquet(sink), spark.read.parquet(dead)
    assert good.count() + bad.count() == raw.count()
    assert bad.count() == raw.where(F.col("id").cast("long") % 50 < 4).count()
    # a second query on the sink numbers its batches from 0 too, and adds to it
    q = st.ingest_stream(st.read_stream(spark, src, raw.schema, max_files_per_trigger=1), sink, dead, os.path.join(tmp, "ck2"))
    q.awaitTermination()
    assert spark.read.parquet(sink).count() == 2 * good.count() == 2 * (raw.count() - raw.where(F.col("id").cast("long") % 50 < 4).count())
    # replaying a batch of a query replaces that batch alone
    first = spark.read.parquet(sink).where(F.col("query_id") == st.query_id(spark, ck)).where("batch_id = 0").count()
    assert first > 0
    st.ingest_batch(spark.read.schema(raw.schema).parquet(src).limit(5), 0, sink, dead, "other")
    st.ingest_batch(spark.read.schema(raw.schema).parquet(src).limit(5), 0, sink, dead, "other")
    assert 0 < spark.read.parquet(sink).where("query_id = 'other'").count() <= 5


def test_dedup_stream_and_windows(spark, tmp):
    e = st.as_event_time(spark.read.parquet(f"{SF}/events.parquet"))
    src = os.path.join(tmp, "ev")
    e.unionByName(e.where("event_id % 10 = 0")).write.parquet(src)
    s = st.read_stream(spark, src, e.schema)
    q = st.dedup_stream(s, ["event_id"], "ts", "1 hour").writeStream.format("memory").queryName("dd") \
        .option("checkpointLocation", os.path.join(tmp, "ck1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("dd").count() == e.count()
    w = st.windowed_counts(st.read_stream(spark, src, e.schema), "ts", "1 day", by=["event_type"], delay="1 hour")
    q2 = w.writeStream.format("memory").queryName("wc").outputMode("append") \
        .option("checkpointLocation", os.path.join(tmp, "ck2")).start()
    q2.processAllAvailable()
    q2.stop()
    got = spark.table("wc")
    # append mode holds back the still-open windows; what was emitted is exact
    batch = {(r["window"]["start"], r["event_type"]): r["n"] for r in
             e.unionByName(e.where("event_id % 10 = 0")).groupBy(F.window("ts", "1 day"), "event_type").count()
             .withColumnRenamed("count", "n").collect()}
    for r in got.collect():
        assert batch[(r["window"]["start"], r["event_type"])] == r["n"]


def test_late_rows_go_to_side_table(spark, tmp):
    mk = lambda rows: spark.createDataFrame(rows, "id long, ts timestamp")
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    paths = [os.path.join(tmp, x) for x in ("state", "ok", "late")]
    st.split_late(mk([(1, t(10)), (2, t(11))]), 0, "ts", 3600, *paths)
    st.split_late(mk([(3, t(9)), (4, t(10.5)), (5, t(12))]), 1, "ts", 3600, *paths)
    late = sorted(r["id"] for r in spark.read.parquet(paths[2]).collect())
    ok = sorted(r["id"] for r in spark.read.parquet(paths[1]).collect())
    assert late == [3] and ok == [1, 2, 4, 5]


def test_ordered_per_key_and_messages(spark, tmp):
    e = spark.read.parquet(f"{SF}/events.parquet")
    o = st.ordered_per_key(e, "user_id", "event_id", 4)
    parts = o.rdd.mapPartitions(lambda it: [[(r["user_id"], r["event_id"]) for r in it]]).collect()
    owner = {}
    for i, p in enumerate(parts):
        assert p == sorted(p)
        for u, _ in p:
            assert owner.setdefault(u, i) == i
    msgs = st.to_messages(e, "user_id", ["event_id", "value"], "ts", {"src": "events"})
    out, ck = os.path.join(tmp, "msgs"), os.path.join(tmp, "ck")
    src = os.path.join(tmp, "events_src")
    e.write.parquet(src)
    q = st.publish(st.read_stream(spark, src, e.schema).transform(
        lambda d: st.to_messages(d, "user_id", ["event_id", "value"], "ts")), out, ck)
    q.awaitTermination()
    assert spark.read.json(out).count() == e.count()
    assert msgs.first()["properties"] == {"src": "events"}


def test_stream_view_refresh_skips_replayed_batches(spark, tmp):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    src = os.path.join(tmp, "li")
    li.repartition(4).write.parquet(src)
    ms = [vw.Measure("qty", "sum", "l_quantity"), vw.Measure("n", "count")]
    q = st.view_refresh_stream(st.read_stream(spark, src, li.schema, max_files_per_trigger=1), tmp, "v", ["l_returnflag"],
                               ms, os.path.join(tmp, "ck"))
    q.awaitTermination()
    own = st.query_id(spark, os.path.join(tmp, "ck"))
    st.view_refresh_batch(li, 0, tmp, "v", ["l_returnflag"], ms, own)  # replay of batch 0: skipped
    got = {r["l_returnflag"]: r["n"] for r in vw.read_view(spark, tmp, "v", ["l_returnflag"], ms).collect()}
    want = {r["l_returnflag"]: r["count"] for r in li.groupBy("l_returnflag").count().collect()}
    assert got == want
    # a new checkpoint is another query: its batch 0 is new rows
    st.view_refresh_batch(li, 0, tmp, "v", ["l_returnflag"], ms, "other")
    got = {r["l_returnflag"]: r["n"] for r in vw.read_view(spark, tmp, "v", ["l_returnflag"], ms).collect()}
    assert got == {k: 2 * n for k, n in want.items()}


def test_stream_alerts_report_late_samples(spark, tmp):
    rules = [{"rule_id": "r", "name": "n", "metric": "m", "expression": "value > 10", "for_duration_s": 0, "severity": "x"}]
    sch = "metric string, ts timestamp_ntz, value double"
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    src = os.path.join(tmp, "s")
    spark.createDataFrame([("m", t(0), 20.0), ("m", t(1), 20.0), ("m", t(2), 0.0)], sch).coalesce(1) \
        .write.parquet(os.path.join(src, "part=0"))
    time.sleep(1.1)
    spark.createDataFrame([("m", t(1), 0.0), ("m", t(3), 20.0)], sch).coalesce(1).write.parquet(os.path.join(src, "part=1"))
    stream = st.read_stream(spark, src + "/*", sch, max_files_per_trigger=1)
    q = st.stream_alerts(stream, rules, H).writeStream.format("memory").queryName("late_out") \
        .outputMode("update").option("checkpointLocation", os.path.join(tmp, "ck")).start()
    q.processAllAvailable()
    q.stop()
    states = sorted((r["state"], r["active_at"].hour) for r in spark.table("late_out").collect())
    assert ("LATE_SAMPLE", 1) in states and ("RESOLVED", 0) in states and ("FIRING", 3) in states
