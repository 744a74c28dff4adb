import datetime as dt
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.operators import metrics as me
from tidepool.operators import relational as rel
from tidepool.operators.running import running, with_slices


def _ts(m):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)


def test_asof_equal_times_and_earlier_buckets(spark):
    left = spark.createDataFrame([(1, 1, _ts(10)), (2, 1, _ts(60 * 24 * 3)), (3, 2, _ts(5)), (4, 1, _ts(0))],
                                 "lid long, k long, ts timestamp_ntz")
    right = spark.createDataFrame([(100, 1, _ts(10)), (101, 1, _ts(10)), (102, 1, _ts(11)), (103, 2, _ts(6))],
                                  "rid long, k long, rts timestamp_ntz")
    got = {r["lid"]: r["asof_rid"] for r in rel.asof_join(left, right, "k", "ts", "rts", ["rts"], "rid").collect()}
    # equal time: the right row counts; ties among right rows -> the larger id
    assert got == {1: 101, 2: 102, 3: None, 4: None}


def test_asof_matches_brute_force(spark):
    rnd = random.Random(7)
    lrows = [(i, rnd.randint(0, 3), _ts(rnd.randint(0, 60 * 24 * 10))) for i in range(300)]
    rrows = [(1000 + i, rnd.choice([0, 0, 0, 1, 2]), _ts(rnd.randint(0, 60 * 24 * 10))) for i in range(400)]
    left = spark.createDataFrame(lrows, "lid long, k long, ts timestamp_ntz")
    right = spark.createDataFrame(rrows, "rid long, k long, rts timestamp_ntz")
    got = {r["lid"]: r["asof_rid"] for r in rel.asof_join(left, right, "k", "ts", "rts", [], "rid", slices=16).collect()}
    for lid, k, t in lrows:
        cands = [(rt, rid) for rid, rk, rt in rrows if rk == k and rt <= t]
        assert got[lid] == (max(cands)[1] if cands else None)


def test_range_join_matches_brute_force(spark):
    rnd = random.Random(3)
    a = [(i, rnd.randint(0, 2), _ts(rnd.randint(0, 2000))) for i in range(200)]
    b = [(i, rnd.randint(0, 2), _ts(rnd.randint(0, 2000))) for i in range(200)]
    l = spark.createDataFrame(a, "id long, k long, ts timestamp_ntz")
    r = spark.createDataFrame(b, "id long, k long, ts timestamp_ntz")
    got = sorted((x["id_l"], x["id_r"]) for x in rel.range_join(l, r, "k", "ts", "ts", 600).collect())
    want = sorted((i, j) for i, k, t in a for j, k2, t2 in b if k == k2 and dt.timedelta(0) <= t2 - t <= dt.timedelta(minutes=10))
    assert got == want


def test_running_equals_plain_window_on_a_hot_key(spark):
    rnd = random.Random(1)
    rows = [(0 if rnd.random() < 0.5 else rnd.randint(1, 5), i, _ts(rnd.randint(0, 60 * 24 * 20)),
             float(rnd.randint(1, 9)), rnd.choice([None, float(i)])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, seq long, ts timestamp_ntz, v double, x double")
    r = running(df, ["k"], ["ts", "seq"], sums={"s": F.col("v")}, lasts={"lx": F.col("x")}, slices=16)
    w = Window.partitionBy("k").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select("seq", F.sum("v").over(w).alias("s2"), F.last("x", ignorenulls=True).over(w).alias("lx2"))
    j = r.join(plain, "seq").where((F.col("s") != F.col("s2")) | ~F.col("lx").eqNullSafe(F.col("lx2")))
    assert j.count() == 0


def test_checked_broadcast(spark):
    small = spark.read.parquet("/root/testdata/sf0.001/nation.parquet")
    assert rel.estimated_bytes(small) < rel.BROADCAST_MAX_BYTES
    hinted = rel.broadcast_if_small(small)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in hinted and "broadcast" in hinted
    over = rel.broadcast_if_small(small, max_bytes=10)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in over


def test_topk_per_group_plans_a_group_limit(spark):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    t = rel.top_k_per_group(o, ["o_custkey"], 3, [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    assert "WindowGroupLimit" in t._jdf.queryExecution().executedPlan().toString()


def test_hot_key_is_split_into_slices(spark):
    rnd = random.Random(5)
    # key 0 holds half the rows, all inside one hour (a burst)
    rows = [(0, _ts(rnd.randint(0, 59))) if i % 2 else (rnd.randint(1, 50), _ts(rnd.randint(0, 60 * 24 * 30)))
            for i in range(4000)]
    df = spark.createDataFrame(rows, "k long, ts timestamp_ntz")
    s = with_slices(df, ["ts"], 16)
    per = s.where("k = 0").groupBy("_b").count().collect()
    assert len(per) >= 6 and max(r["count"] for r in per) < 2000 / 3


def test_rank_within_matches_window(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice([0, 0, 0, 1, 2]), rnd.randint(0, 20) * 1.0, i) for i in range(1500)]
    df = spark.createDataFrame(rows, "k long, v double, id long")
    got = rel.rank_within(df, ["k"], [("v", "DESC")], ["id"], n_tiles=4, slices=8)
    w = Window.partitionBy("k").orderBy(F.col("v").desc())
    wt = Window.partitionBy("k").orderBy(F.col("v").desc(), F.col("id"))
    want = df.select("id", F.row_number().over(wt).alias("a"), F.rank().over(w).alias("b"),
                     F.dense_rank().over(w).alias("c"), F.ntile(4).over(wt).alias("d"))
    j = got.join(want, "id").where("row_number <> a OR rank <> b OR dense_rank <> c OR ntile <> d")
    assert j.count() == 0 and got.count() == 1500


def test_string_order_is_sliced_and_ranks_exactly(spark):
    rnd = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "éclair", ""]
    rows = [(0 if i % 2 else rnd.randint(1, 4), rnd.choice(words) + str(rnd.randint(0, 30)), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, s string, id long")
    per = with_slices(df, ["s"], 16).where("k = 0").groupBy("_b").count().collect()
    assert len(per) >= 6
    got = rel.rank_within(df, ["k"], [("s", "ASC")], ["id"], n_tiles=3, slices=16)
    w = Window.partitionBy("k").orderBy(F.col("s"))
    wt = Window.partitionBy("k").orderBy(F.col("s"), F.col("id"))
    want = df.select("id", F.row_number().over(wt).alias("a"), F.rank().over(w).alias("b"),
                     F.dense_rank().over(w).alias("c"), F.ntile(3).over(wt).alias("d"))
    assert got.join(want, "id").where("row_number <> a OR rank <> b OR dense_rank <> c OR ntile <> d").count() == 0


def test_analytic_matches_plain_windows_with_nulls_and_ties(spark):
    rnd = random.Random(13)
    rows = [(0 if i % 2 else rnd.randint(1, 3), i, _ts(rnd.randint(0, 600) // 5 * 5),
             None if rnd.random() < 0.15 else round(rnd.uniform(0, 50), 2)) for i in range(1200)]
    df = spark.createDataFrame(rows, "k long, id long, ts timestamp_ntz, v double")
    got = rel.analytic(df, ["k"], "ts", "v", tiebreak=["id"], moving_rows=3, range_seconds=1800, slices=8)
    w = Window.partitionBy("k").orderBy("ts", "id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    wr = Window.partitionBy("k").orderBy(micros).rangeBetween(-1800 * 1_000_000, 0)
    want = df.select("id", F.lag("v").over(w).alias("a"), F.lead("v").over(w).alias("b"),
                     F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"),
                     F.avg("v").over(w.rowsBetween(-2, 0)).alias("d"), F.sum("v").over(wr).alias("e"))
    j = got.join(want, "id")
    bad = j.where(~F.col("prev_value").eqNullSafe(F.col("a")) | ~F.col("next_value").eqNullSafe(F.col("b"))
                  | (F.abs(F.col("running_sum") - F.col("c")) > 1e-6) | (F.col("running_sum").isNull() != F.col("c").isNull())
                  | ~(F.abs(F.col("moving_avg") - F.col("d")) <= 1e-6).eqNullSafe(F.lit(True)) & F.col("d").isNotNull()
                  | (F.col("moving_avg").isNull() != F.col("d").isNull())
                  | (F.abs(F.col("range_sum") - F.col("e")) > 1e-6) | (F.col("range_sum").isNull() != F.col("e").isNull()))
    assert bad.count() == 0 and got.count() == 1200


def test_analytic_null_keys_meet_their_own_group(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(None, t(h), float(h)) for h in range(1, 6)] + [(1, t(h), float(h)) for h in range(1, 6)]
    df = spark.createDataFrame(rows, "k long, ts timestamp_ntz, v double")
    got = {(r.k, r.ts.hour): r for r in rel.analytic(df, ["k"], "ts", "v").collect()}
    for h in range(1, 6):
        a, b = got[(None, h)], got[(1, h)]
        assert tuple(a)[1:] == tuple(b)[1:]
    assert [got[(None, h)].moving_avg for h in (3, 4, 5)] == [2.0, 3.0, 4.0]


def test_analytic_keeps_small_values_and_nan_counts_in_its_frames_only(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    df = spark.createDataFrame([(1, t(h), 1e-11 * h) for h in range(1, 6)], "k long, ts timestamp_ntz, v double")
    got = {r.ts.hour: r for r in rel.analytic(df, ["k"], "ts", "v", moving_rows=2).collect()}
    for h in range(1, 6):
        assert math.isclose(got[h].running_sum, 1e-11 * h * (h + 1) / 2, rel_tol=1e-12)
        assert math.isclose(got[h].moving_avg, 1e-11 * (h if h == 1 else h - 0.5), rel_tol=1e-12)
    vals = {1: 1.0, 2: float("nan"), 3: 2.0, 4: float("inf"), 5: 3.0, 6: 4.0, 7: None}
    df = spark.createDataFrame([(1, t(h), v) for h, v in vals.items()], "k long, ts timestamp_ntz, v double")
    got = {r.ts.hour: r for r in rel.analytic(df, ["k"], "ts", "v", moving_rows=2, range_seconds=0).collect()}
    assert got[1].running_sum == 1.0 and all(math.isnan(got[h].running_sum) for h in range(2, 8))
    assert math.isnan(got[3].moving_avg) and got[4].moving_avg == float("inf") and got[6].moving_avg == 3.5
    assert got[7].moving_avg == 4.0 and got[7].range_sum is None and got[5].range_sum == 3.0


def test_slices_order_nan_and_nulls_and_part_values_with_one_prefix(spark):
    rows = [(i, None if i % 50 == 0 else float("nan") if i % 7 == 0 else (i * 37 % 1000) / 10) for i in range(1, 1000)]
    df = spark.createDataFrame(rows, "id long, v double").withColumn("k", F.lit(1))
    for way in ("ASC", "DESC"):
        got = rel.rank_within(df, ["k"], [("v", way)], ["id"], slices=8)
        v = F.col("v").asc_nulls_first() if way == "ASC" else F.col("v").desc_nulls_last()
        want = df.select("id", F.row_number().over(Window.partitionBy("k").orderBy(v, "id")).alias("a"),
                         F.dense_rank().over(Window.partitionBy("k").orderBy(v)).alias("b"))
        assert got.join(want, "id").where("row_number = a AND dense_rank = b").count() == 999
    urls = spark.range(10_000).select(F.concat(F.lit("https://www.example.com/a/"), F.md5(F.col("id").cast("string"))).alias("u"))
    sizes = [r["count"] for r in with_slices(urls, ["u"], 8).groupBy("_b").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3000


def test_gauge_takes_nan_until_the_next_set_and_keeps_small_steps(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    ops = [("set", 1.0), ("add", 1e-12), ("sub", float("inf")), ("set", 5.0), ("inc", None), ("add", float("nan")), ("set", 2.0), ("dec", None)]
    df = spark.createDataFrame([(1, t(i), o, a) for i, (o, a) in enumerate(ops)], "k long, ts timestamp_ntz, op string, v double")
    got = [r.gauge_value for r in me.gauge(df, ["k"], "ts", "op", "v").orderBy("ts").collect()]
    assert got[:5] == [1.0, 1.000000000001, float("-inf"), 5.0, 6.0] and math.isnan(got[5]) and got[6:] == [2.0, 1.0]


def _percentile(vals, q):
    """Linear interpolation between the two nearest ranks; NaN sorts last."""
    vals = sorted(vals, key=lambda v: (math.isnan(v), v))
    p = q * (len(vals) - 1)
    lo, hi = vals[math.floor(p)], vals[math.ceil(p)]
    return lo if lo == hi else (math.ceil(p) - p) * lo + (p - math.floor(p)) * hi


def test_exact_quantiles_match_brute_force(spark):
    rng = random.Random(5)
    rows = [("hot", float(rng.randint(0, 200))) for _ in range(3000)] + [("one", 7.5), ("two", 1.0), ("two", 4.0)]
    rows += [(None, float(i)) for i in range(9)] + [("nan", float("nan")), ("nan", 2.0), ("nan", 3.0), ("void", None), ("hot", None)]
    df = spark.createDataFrame(rows, "label string, v double")
    qs = {0.0: 0.1, 0.25: 0.1, 0.5: 0.05, 0.9: 0.01, 1.0: 0.1}
    got = {(r["label"], r["quantile"]): (r["value"], r["count"]) for r in
           me.summary(df, "v", objectives=qs, labels=["label"], exact=True).collect()}
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).extend([] if v is None else [v])
    assert len(got) == len(groups) * len(qs)
    for k, vals in groups.items():
        for q in qs:
            value, n = got[(k, q)]
            assert n == len(vals)
            if not vals:
                assert value is None
                continue
            want = _percentile(vals, q)
            assert (math.isnan(value) and math.isnan(want)) or abs(value - want) < 1e-9, (k, q, value, want)
    whole = me.summary(df, "v", objectives={0.5: 0.05}, exact=True).collect()
    assert len(whole) == 1 and abs(whole[0]["value"] - _percentile([v for _, v in rows if v is not None], 0.5)) < 1e-9
    assert me.summary(df.limit(0), "v", objectives={0.5: 0.05}, labels=["label"], exact=True).count() == 0


def test_exact_quantiles_order_no_label_set_in_one_task(spark):
    df = spark.range(0, 5000).select(F.lit("k").alias("label"), (F.col("id") * 1.5).alias("v"))
    plan = me.exact_quantiles(df, F.col("v"), ["label"], [0.5])._jdf.queryExecution().optimizedPlan().toString()
    rows_windows = [x for x in plan.splitlines() if "Window" in x and "_v" in x]
    assert rows_windows and all("_b" in x for x in rows_windows)


def test_analytic_keys_of_very_different_sizes(spark):
    """No key's values take digits from another's, nor large values from small ones of their own key."""
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=2 * h)
    vals = {"a": [1e25, -1e25, 1e25], "b": [1e-9, 2e-9], "c": [1e300, 3.0, 4.0, 5e-300, 5e-324], "d": [0.0, -0.0, None], "e": [0.1] * 10}
    rows = [(k, t(i), v) for k, own in vals.items() for i, v in enumerate(own)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    got = {(r.k, r.ts): r for r in rel.analytic(df, ["k"], "ts", "v", moving_rows=2).collect()}
    for k, own in vals.items():
        for i, v in enumerate(own):
            r, upto = got[k, t(i)], [x for x in own[:i + 1] if x is not None]
            assert r.running_sum == pytest.approx(math.fsum(upto), rel=1e-12) if upto else r.running_sum is None
            two = [x for x in own[max(0, i - 1):i + 1] if x is not None]
            assert r.moving_avg == pytest.approx(math.fsum(two) / len(two), rel=1e-12, abs=0) if two else r.moving_avg is None
            assert r.range_sum == (v if v is not None else None)


def test_gauge_keys_of_very_different_sizes(spark):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [("a", t(0), "set", 1e25), ("a", t(1), "inc", 0.0), ("b", t(0), "set", 1e-9), ("b", t(1), "add", 2e-9), ("b", t(2), "inc", 7.0),
            ("b", t(3), "set", 4e-9), ("b", t(4), "sub", 1e-9)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, op string, v double")
    got = {(r.k, r.ts.hour): r.gauge_value for r in me.gauge(df, ["k"], "ts", "op", "v").collect()}
    assert got["a", 0] == 1e25 and got["a", 1] == 1e25
    assert [got["b", h] for h in range(5)] == pytest.approx([1e-9, 3e-9, 1 + 3e-9, 4e-9, 3e-9], rel=1e-12)


def test_left_join_of_many_narrow_rows_is_not_broadcast(spark, tmp_path):
    # 60 times the orders of sf0.1 were estimated at 25 to 53 MB by their files, and took 20 times as much as rows
    n = 700_000
    o = spark.range(n).select((F.col("id") % 1000).alias("k"), F.xxhash64("id").alias("a"), F.rand(1).alias("b"))
    o.write.parquet(f"{tmp_path}/o")
    o = spark.read.parquet(f"{tmp_path}/o")
    assert 8 * 1024 * 1024 < rel.estimated_bytes(o) < 64 * 1024 * 1024
    j = rel.equi_join(spark.range(5).withColumnRenamed("id", "k"), o, "k", "left")
    assert "ResolvedHint" not in j._jdf.queryExecution().analyzed().toString()
