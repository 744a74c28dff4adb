"""Streams with timers, live histograms and summaries, late rows by query."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from tidepool.operators import alerts as al
from tidepool.operators import metrics as mt
from tidepool.operators import views as vw
from tidepool.streaming import streams as st
from tidepool.streaming import timers as tm

T0 = dt.datetime(2024, 1, 1)
MSG = "id long, event_time timestamp, delay_s double, tags map<string,string>, parts array<struct<a: double, t: timestamp_ntz>>"


def hours(h):
    return T0 + dt.timedelta(hours=h)


def put(spark, rows, schema, path, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(path, "src", f"part={name}"))


def deliver(spark, path):
    """One run of the query over what is there; everything that has come out so far."""
    src = st.read_stream(spark, os.path.join(path, "src", "*"), MSG)
    w = tm.delayed_delivery(src, deliver_after_s="delay_s", slot_seconds=7200, spread=2).writeStream.format("parquet") \
        .option("path", os.path.join(path, "out")).option("checkpointLocation", os.path.join(path, "ck")).trigger(availableNow=True)
    tm.start_stateful(w).awaitTermination()
    return spark.read.parquet(os.path.join(path, "out"))


def test_messages_come_out_at_their_time_across_restarts(spark, tmp):
    rng = random.Random(1)
    every, n = [], 0
    conf = spark.conf.get(tm.STORE, None)
    for run in range(4):
        rows = []
        for _ in range(40):
            # later runs hold some older messages too: none may be dropped
            at = hours(10 * run + rng.uniform(-30, 8))
            rows.append((n, at, rng.choice([0.0, 0.000001, 3600.0, rng.uniform(0, 10 ** 5), None]), rng.choice([None, {}, {"k": "v"}]),
                         rng.choice([None, [], [(0.1 * n, at), (None, None)]])))
            n += 1
        every += rows
        put(spark, rows, MSG, tmp, run)
        out = deliver(spark, tmp)
        clock = max(r[1] for r in every)
        clock = clock.replace(microsecond=clock.microsecond // 1000 * 1000)
        got = sorted(tuple(r) for r in out.select("id", "event_time", "delay_s", "tags", "parts").collect())
        batch = st.deliverable(spark.createDataFrame(every, MSG).withColumn("due_at", F.lit(None).cast("timestamp")), clock, "event_time", None, "delay_s")
        due = {r.id for r in batch.collect()} | {r[0] for r in every if r[2] is None}
        assert [r[0] for r in got] == sorted(due)  # each once, and all that are due
        want = {tuple(r)[0]: tuple(r) for r in spark.createDataFrame(every, MSG).collect()}
        assert all(g == want[g[0]] for g in got)
    assert spark.conf.get(tm.STORE, None) == conf
    put(spark, [(n, hours(10 ** 4), 0.0, None, None)], MSG, tmp, "last")
    assert deliver(spark, tmp).count() == len(every) + 1


RULES = [{"rule_id": "r", "name": "n", "metric": "m", "expression": "value > 10", "for_duration_s": 7200, "severity": "x"}]
SAMPLES = "metric string, user string, ts timestamp_ntz, value double"


def alert_rows(spark, path, idle=None):
    src = st.read_stream(spark, os.path.join(path, "src", "*"), SAMPLES)
    out = tm.timed_alerts(src, RULES, 3600, ["user"], idle_seconds=idle)
    w = out.writeStream.outputMode("update").option("checkpointLocation", os.path.join(path, "ck")).foreachBatch(
        lambda df, bid: df.write.mode("overwrite").parquet(os.path.join(path, "out", f"batch_id={bid}"))).trigger(availableNow=True)
    tm.start_stateful(w).awaitTermination()
    return spark.read.schema(out.schema.add("batch_id", "long")).parquet(os.path.join(path, "out"))


def last_states(out):
    last = out.where("state <> 'LATE_SAMPLE'").groupBy("user", "active_at").agg(F.max_by(F.struct("state", "resolved_at"), "batch_id").alias("r"))
    return {(r.user, r.active_at): (r.r.state, r.r.resolved_at) for r in last.where("r.state <> 'INACTIVE'").collect()}


def test_alerts_end_by_timer_and_equal_the_batch_form(spark, tmp):
    rng = random.Random(2)
    every = []
    for run in range(3):
        rows = []
        for user in "abcd":
            if user == "d":  # a series that falls silent
                continue
            rows += [("m", user, hours(12 * run + h), rng.choice([0.0, 20.0, 20.0, 20.0])) for h in range(12) if rng.random() < 0.8]
        if run == 0:
            rows += [("m", "d", hours(h), 20.0) for h in (9, 10, 11)]
        every += rows
        put(spark, rows, SAMPLES, tmp, run)
        got = last_states(alert_rows(spark, tmp))
        clock = max(r[2] for r in every)
        want = al.evaluate_alerts(spark.createDataFrame(every, SAMPLES), RULES, 3600, ["user"], as_of=clock)
        assert got == {(r.user, r.active_at): (r.state, r.resolved_at) for r in want.collect()}
    assert got["d", hours(9)] == ("RESOLVED", hours(12))


def test_the_rules_of_a_label_set_share_a_state_and_a_timer(spark, tmp):
    rule = lambda i, metric, above, for_s: {**RULES[0], "rule_id": i, "metric": metric, "expression": f"value > {above}", "for_duration_s": for_s}
    rules = [rule("r1", "m", 10, 7200), rule("r2", "m", 15, 0), rule("r3", "n", 10, 3600)]
    keys = ["rule_id", "user", "active_at"]

    def run(path, labels):
        src = st.read_stream(spark, os.path.join(tmp, "src", "*"), SAMPLES)
        out = tm.timed_alerts(src, rules, 3600, labels, idle_seconds=6 * 3600)
        w = out.writeStream.outputMode("update").option("checkpointLocation", f"{path}/ck").foreachBatch(
            lambda df, bid: df.write.mode("overwrite").parquet(f"{path}/out/batch_id={bid}")).trigger(availableNow=True)
        tm.start_stateful(w).awaitTermination()
        got = spark.read.schema(out.schema.add("batch_id", "long")).parquet(f"{path}/out").where("state <> 'LATE_SAMPLE'")
        own = [k for k in keys if k in got.columns]
        last = got.groupBy(*own).agg(F.max_by(F.struct("state", "resolved_at", "value"), "batch_id").alias("r"))
        state = spark.read.format("statestore").option("path", f"{path}/ck").option("stateVarName", "series").load().collect()
        return sorted((*[r[k] for k in own], *r.r) for r in last.where("r.state <> 'INACTIVE'").collect()), state

    rng, every = random.Random(5), []
    for part in range(2):
        users = [u for u in ("a", "b", "c", "gone") if u != "gone" or not part]
        # c has samples of one metric alone; gone falls silent
        rows = [(metric, user, hours(12 * part + h), rng.choice([0.0, 12.0, 20.0, 20.0])) for user in users for metric in "mnx"
                for h in range(12) if rng.random() < 0.8 and (user != "c" or metric == "n")]
        every += rows
        put(spark, rows, SAMPLES, tmp, part)
        got, state = run(f"{tmp}/by-user", ["user"])
        clock = max(r[2] for r in every)
        want = al.evaluate_alerts(spark.createDataFrame(every, SAMPLES), rules, 3600, ["user"], as_of=clock)
        assert got == sorted((r.rule_id, r.user, r.active_at, r.state, r.resolved_at, r.value) for r in want.collect())
        assert {g[0] for g in got} == {"r1", "r2", "r3"}
        # one row of state per user, with its rules; the silent user has left
        assert sorted(r.key.user for r in state) == sorted(users)
        assert {r.key.user: sorted(x.rule_id for x in r.value.rules) for r in state}["a"] == ["r1", "r2", "r3"]
        assert {r.key.user: sorted(x.rule_id for x in r.value.rules) for r in state}["c"] == ["r3"]
    every = [r for r in every if r[1] == "a"]
    tmp = f"{tmp}/alone"
    put(spark, every, SAMPLES, tmp, 0)
    got, state = run(f"{tmp}/no-labels", None)
    want = al.evaluate_alerts(spark.createDataFrame(every, SAMPLES), rules, 3600, as_of=max(r[2] for r in every))
    assert got == sorted((r.rule_id, r.active_at, r.state, r.resolved_at, r.value) for r in want.collect())
    assert sorted(r.key.rule_id for r in state) == ["r1", "r2", "r3"]


def test_idle_series_leave_the_state_and_late_samples_are_told(spark, tmp):
    put(spark, [("m", "a", hours(0), 20.0), ("m", "a", hours(1), 20.0), ("m", "b", hours(0), 0.0)], SAMPLES, tmp, 0)
    alert_rows(spark, tmp, idle=7200)
    put(spark, [("m", "c", hours(10), 0.0)], SAMPLES, tmp, 1)
    alert_rows(spark, tmp, idle=7200)
    state = spark.read.format("statestore").option("path", os.path.join(tmp, "ck")).option("stateVarName", "series").load()
    assert {r.key.user for r in state.collect()} == {"c"}
    put(spark, [("m", "a", hours(1), 20.0), ("m", "a", hours(9), 20.0), ("m", "c", hours(10), 20.0)], SAMPLES, tmp, 2)
    out = alert_rows(spark, tmp, idle=7200)
    late = {(r.user, r.active_at) for r in out.where("state = 'LATE_SAMPLE'").collect()}
    assert late == {("a", hours(1)), ("c", hours(10))}


def test_live_histogram_and_summary_equal_batch(spark, tmp):
    rng = random.Random(3)
    sch = "ts timestamp, kind string, v double"
    rows = [(hours(rng.uniform(0, 60)), rng.choice("ab"), rng.choice([None, rng.gauss(5, 3), float("nan")])) for _ in range(4000)]
    rows.sort()
    for k in range(2):
        spark.createDataFrame(rows[2000 * k:2000 * k + 2000], sch).coalesce(1).write.parquet(os.path.join(tmp, "src", f"part={k}"))
    src = lambda: st.read_stream(spark, os.path.join(tmp, "src", "*"), sch, max_files_per_trigger=1)

    def run(out, name):
        w = out.writeStream.format("parquet").option("path", os.path.join(tmp, name)).option("checkpointLocation", os.path.join(tmp, name + "-ck"))
        tm.start_stateful(w.outputMode("append").trigger(availableNow=True)).awaitTermination()
        return spark.read.parquet(os.path.join(tmp, name))

    df = spark.createDataFrame(rows, sch).withColumn("w", F.window("ts", "6 hours"))
    closed = rows[-1][0] - dt.timedelta(hours=1)
    hist = run(st.live_histogram(src(), "v", "ts", "6 hours", None, (2.0, 5.0), ["kind"]), "h")
    want = mt.histogram(df, "v", (2.0, 5.0), ["w", "kind"]).where(F.col("w.end") <= F.lit(closed)).select(F.col("w.start").alias("window_start"), "kind", "le", "bucket_count", "count")
    assert sorted(map(tuple, hist.select("window_start", "kind", "le", "bucket_count", "count").collect())) == sorted(map(tuple, want.collect()))
    goals = {0.5: 0.05, 0.9: 0.02}
    live = run(st.live_summary(src(), "v", "ts", "12 hours", "6 hours", goals, ["kind"]), "s")
    checked = 0
    for r in live.collect():
        own = sorted(v for t, k, v in rows if v is not None and v == v and k == r.kind and r.window_start <= t < r.window_end)
        assert r.window_end <= closed and r["count"] == len(own)
        if own:
            lo, hi = sum(v < r.value for v in own) / len(own), sum(v <= r.value for v in own) / len(own)
            assert lo <= r.quantile + goals[r.quantile] and hi >= r.quantile - goals[r.quantile]
            checked += 1
    assert checked > 10
    # parts of the rows, merged, keep the errors; a label set without values has none
    parts = [mt.sketch_states(df.where(F.hash("ts") % 3 == k), "v", ["kind"], goals) for k in (-2, -1, 0, 1, 2)]
    states = parts[0]
    for p in parts[1:]:
        states = states.unionByName(p)
    merged = mt.sketch_quantiles(mt.merge_sketches(states, ["kind"]), ["kind"], goals)
    for r in merged.collect():
        own = sorted(v for _, k, v in rows if v is not None and v == v and k == r.kind)
        assert r["count"] == len(own) and abs(sum(v <= r.value for v in own) / len(own) - r.quantile) <= goals[r.quantile]
    none = mt.sketch_quantiles(mt.sketch_states(df.withColumn("v", F.lit(None).cast("double")), "v", ["kind"], goals), ["kind"], goals)
    assert {(r.value, r["count"]) for r in none.collect()} == {(None, 0)}


def test_quantile_measures_merge(spark):
    df = spark.range(10_000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"))
    ms = [vw.Measure("p", "quantile", "v", 0.9), vw.Measure("none", "quantile", "x")]
    df = df.withColumn("x", F.lit(None).cast("double"))
    a, b = vw.states(df.where("v < 3000"), ["k"], ms), vw.states(df.where("v >= 3000"), ["k"], ms)
    for r in vw.finalize(vw.merge_states(a, b, ["k"], ms), ["k"], ms).collect():
        assert abs(r.p - 9000) < 150 and r.none is None


def test_two_queries_keep_their_late_rows(spark, tmp):
    df = spark.range(50).select("id", (F.lit(T0) + F.make_dt_interval(hours=F.col("id").cast("int"))).cast("timestamp").alias("ts"))
    src, paths = os.path.join(tmp, "src"), [os.path.join(tmp, x) for x in ("state", "ok", "late")]
    df.write.parquet(src)
    for name in ("one", "two"):
        st.split_late_stream(st.read_stream(spark, src, df.schema), "ts", 3600, *paths, os.path.join(tmp, f"ck-{name}")).awaitTermination()
    rows = lambda p: spark.read.parquet(p).count() if os.path.exists(p) else 0
    assert rows(paths[1]) + rows(paths[2]) == 100
    own = st.query_id(spark, os.path.join(tmp, "ck-one"))
    st.split_late(df.limit(10), 0, "ts", 3600, *paths, own)  # a replay of a batch replaces it
    assert rows(paths[1]) == 60
