"""Named relational queries (S1-S21) over the star schema and events, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators import relational as rel
from tidepool.plans import sqlapi
from tidepool.session import load, register_views


def s1_run_sql(spark, sf):
    register_views(spark, sf, ["orders"])
    return sqlapi.run_sql(spark, """
        SELECT o_orderpriority, COUNT(*) AS n, round(sum(o_totalprice), 2) AS total
        FROM IDENTIFIER(:t) WHERE o_totalprice > :minp GROUP BY o_orderpriority""",
        params={"t": "orders", "minp": 250000.0})


S1_SQL = """SELECT o_orderpriority, COUNT(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders WHERE o_totalprice > 250000.0 GROUP BY o_orderpriority"""


def s2_paginate(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return sqlapi.paginate(o, page=3, size=25, order_by=[("o_totalprice", "DESC"), ("o_orderkey", "ASC")])


S2_SQL = """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50"""


def s3_sort_by(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return sqlapi.paginate(c, 1, 40, [("c_mktsegment", "ASC"), ("c_acctbal", "DESC"), ("c_custkey", "ASC")])


S3_SQL = """SELECT c_custkey, c_mktsegment, c_acctbal FROM customer
ORDER BY c_mktsegment ASC NULLS LAST, c_acctbal DESC NULLS LAST, c_custkey LIMIT 40"""


def s4_point_lookup(spark, sf):
    return rel.point_lookup(load(spark, sf, "lineitem"), "l_orderkey", 4242).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


S4_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_orderkey = 4242"""


def s5_aggregate(spark, sf):
    li = load(spark, sf, "lineitem")
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rel.aggregate(
        li, ["l_returnflag", "l_linestatus"],
        [F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
         F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
         F.round(F.sum(disc), 2).alias("sum_disc_price"),
         F.round(F.sum(disc * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
         F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
         F.round(F.avg("l_discount"), 6).alias("avg_disc"),
         F.count(F.lit(1)).alias("count_order")],
        where=F.col("l_shipdate") <= F.lit("2001-09-02 00:00:00").cast("timestamp_ntz"),
        having=F.col("count_order") > 10)


S5_SQL = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
  round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty,
  round(avg(l_discount), 6) AS avg_disc, COUNT(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00'
GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 10"""


def s6_distinct(spark, sf):
    return rel.distinct_counts(load(spark, sf, "lineitem"), ["l_partkey", "l_suppkey", "l_orderkey"], by=["l_returnflag"])


S6_SQL = """SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS ndv_l_partkey, COUNT(DISTINCT l_suppkey) AS ndv_l_suppkey,
COUNT(DISTINCT l_orderkey) AS ndv_l_orderkey FROM lineitem GROUP BY l_returnflag"""


def s6_approx_distinct(spark, sf):
    """S6 estimate (HLL++, 2% relative error): the exact counts, and whether the estimates lie
    within three standard errors of them."""
    li, cols = load(spark, sf, "lineitem"), ["l_partkey", "l_orderkey"]
    est = rel.distinct_counts(li, cols, by=["l_returnflag"], rsd=0.02)
    names = [c for c in est.columns if c != "l_returnflag"]
    est = est.select("l_returnflag", *[F.col(c).alias(f"_e_{i}") for i, c in enumerate(names)])
    exact = rel.distinct_counts(li, cols, by=["l_returnflag"]).toDF("l_returnflag", "parts", "orders")
    near = lambda i, c: (F.abs(F.col(f"_e_{i}") - F.col(c)) <= 0.06 * F.col(c)).alias(f"{c}_within")
    return exact.join(est, "l_returnflag").select("l_returnflag", "parts", "orders", near(0, "parts"), near(1, "orders"))


S6_APPROX_SQL = """SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_orderkey) AS orders,
TRUE AS parts_within, TRUE AS orders_within FROM lineitem GROUP BY 1"""


def s7_cube(spark, sf):
    li = load(spark, sf, "lineitem")
    return rel.dense_aggregate(li, ["l_returnflag", "l_linestatus"],
                               [F.round(F.sum("l_quantity"), 2).alias("qty"), F.count(F.lit(1)).alias("n")], "cube")


S7_CUBE_SQL = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, COUNT(*) AS n,
CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS gid FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"""


def s7_rollup(spark, sf):
    o = load(spark, sf, "orders")
    return rel.dense_aggregate(o, ["o_orderpriority", "o_orderstatus"],
                               [F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("n")], "rollup")


S7_ROLLUP_SQL = """SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS total, COUNT(*) AS n,
CAST(grouping(o_orderpriority, o_orderstatus) AS BIGINT) AS gid FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)"""


def s7_grouping_sets(spark, sf):
    c = load(spark, sf, "customer")
    return rel.dense_aggregate(c, ["c_mktsegment", "c_nationkey"],
                               [F.round(F.sum("c_acctbal"), 2).alias("bal"), F.count(F.lit(1)).alias("n")], "sets",
                               sets=[["c_mktsegment"], ["c_nationkey"], []])


S7_SETS_SQL = """SELECT c_mktsegment, c_nationkey, round(sum(c_acctbal), 2) AS bal, COUNT(*) AS n,
CAST(grouping(c_mktsegment, c_nationkey) AS BIGINT) AS gid FROM customer
GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())"""


def s8_predicates(spark, sf):
    p = load(spark, sf, "part")
    pred = (F.col("p_size").between(10, 20) & F.col("p_type").isin("SMALL", "PROMO", "LARGE")
            & (F.col("p_name").like("%gear%") | F.col("p_name").rlike("^(red|blue) ")) & F.col("p_retailprice").isNotNull()
            & (F.col("p_brand") != "Brand#3"))
    return p.where(pred).select("p_partkey", "p_name", (F.col("p_retailprice") * 0.9).alias("sale_price"),
                                (F.col("p_size") * 2 + 1).alias("size2"))


S8_SQL = """SELECT p_partkey, p_name, p_retailprice * 0.9 AS sale_price, p_size * 2 + 1 AS size2 FROM part
WHERE p_size BETWEEN 10 AND 20 AND p_type IN ('SMALL', 'PROMO', 'LARGE')
  AND (p_name LIKE '%gear%' OR regexp_matches(p_name, '^(red|blue) ')) AND p_retailprice IS NOT NULL AND p_brand <> 'Brand#3'"""


def s9_join_inner(spark, sf):
    li, o, c = load(spark, sf, "lineitem"), load(spark, sf, "orders"), load(spark, sf, "customer")
    n, r = load(spark, sf, "nation"), load(spark, sf, "region")
    j = rel.equi_join(li, o.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    j = rel.equi_join(j, c.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    j = rel.equi_join(j, n.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    j = rel.equi_join(j, r.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    rev = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return j.groupBy("r_name", F.year("o_orderdate").alias("o_year")).agg(
        F.round(F.sum(rev), 2).alias("revenue"), F.count(F.lit(1)).alias("lines"))


S9_SQL = """SELECT r_name, CAST(year(o_orderdate) AS INTEGER) AS o_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
COUNT(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, year(o_orderdate)"""


def s9_join_left(spark, sf):
    c, o = load(spark, sf, "customer"), load(spark, sf, "orders")
    j = rel.equi_join(c.select("c_custkey", "c_mktsegment"),
                      o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice"), "c_custkey", "left")
    return j.groupBy("c_custkey", "c_mktsegment").agg(F.count("o_orderkey").alias("n_orders"),
                                                     F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("spent"))


S9_LEFT_SQL = """SELECT c_custkey, c_mktsegment, COUNT(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0.0), 2) AS spent
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment"""


def s9_join_full(spark, sf):
    c = load(spark, sf, "customer").where(F.col("c_acctbal") > 5000).groupBy(F.col("c_nationkey").alias("nk")) \
        .agg(F.count(F.lit(1)).alias("rich_customers"))
    s = load(spark, sf, "supplier").where(F.col("s_acctbal") > 5000).groupBy(F.col("s_nationkey").alias("nk")) \
        .agg(F.count(F.lit(1)).alias("rich_suppliers"))
    return rel.equi_join(c, s, "nk", "full_outer")


S9_FULL_SQL = """SELECT coalesce(c.nk, s.nk) AS nk, rich_customers, rich_suppliers FROM
(SELECT c_nationkey AS nk, COUNT(*) AS rich_customers FROM customer WHERE c_acctbal > 5000 GROUP BY 1) c
FULL OUTER JOIN (SELECT s_nationkey AS nk, COUNT(*) AS rich_suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s
ON c.nk = s.nk"""


def s10_semi(spark, sf):
    c, o = load(spark, sf, "customer"), load(spark, sf, "orders")
    big = o.where(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("c_custkey"))
    return rel.equi_join(c, big, "c_custkey", "left_semi").select("c_custkey", "c_name")


S10_SEMI_SQL = """SELECT c_custkey, c_name FROM customer WHERE EXISTS
(SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"""


def s10_anti(spark, sf):
    c, o = load(spark, sf, "customer"), load(spark, sf, "orders")
    urgent = o.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return rel.equi_join(c, urgent, "c_custkey", "left_anti") \
        .select("c_custkey", "c_nationkey")


S10_ANTI_SQL = """SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')"""


def s11_range_join(spark, sf):
    """Every error within 60 minutes after a click of the same user."""
    e = load(spark, sf, "events")
    clicks = e.where(F.col("event_type") == "click").select("user_id", "event_id", "ts")
    errors = e.where(F.col("event_type") == "error").select("user_id", "event_id", "ts")
    j = rel.range_join(clicks, errors, "user_id", "ts", "ts", 3600)
    return j.select("user_id", F.col("event_id_l").alias("click_id"), F.col("event_id_r").alias("error_id"),
                    (F.unix_micros(F.col("ts_r").cast("timestamp")) - F.unix_micros(F.col("ts_l").cast("timestamp"))).alias("gap_us"))


S11_SQL = """SELECT c.user_id, c.event_id AS click_id, r.event_id AS error_id, epoch_us(r.ts) - epoch_us(c.ts) AS gap_us
FROM events c JOIN events r ON c.user_id = r.user_id AND r.ts >= c.ts AND r.ts <= c.ts + INTERVAL 60 MINUTE
WHERE c.event_type = 'click' AND r.event_type = 'error'"""


def s12_asof(spark, sf):
    """Every purchase with the user's latest view at or before it."""
    e = load(spark, sf, "events")
    purchases = e.where(F.col("event_type") == "purchase").select("user_id", "event_id", "ts", "value")
    views = e.where(F.col("event_type") == "view").select("user_id", F.col("event_id").alias("view_id"),
                                                          F.col("ts").alias("view_ts"), F.col("value").alias("view_value"))
    j = rel.asof_join(purchases, views, "user_id", "ts", "view_ts", ["view_ts", "view_value"], "view_id")
    return j.select("user_id", "event_id", "ts", F.col("asof_view_id").alias("view_id"),
                    F.col("asof_view_ts").alias("view_ts"), F.col("asof_view_value").alias("view_value"))


S12_SQL = """WITH p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, event_id AS view_id, ts AS view_ts, value AS view_value FROM events WHERE event_type = 'view'),
m AS (SELECT p.event_id, arg_max(v.view_id, (v.view_ts, v.view_id)) AS view_id FROM p JOIN v
      ON p.user_id = v.user_id AND v.view_ts <= p.ts GROUP BY p.event_id)
SELECT p.user_id, p.event_id, p.ts, v.view_id, v.view_ts, v.view_value FROM p LEFT JOIN m USING (event_id)
LEFT JOIN v ON v.view_id = m.view_id"""


def s13_ranking(spark, sf):
    li = load(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return rel.rank_within(li, ["l_suppkey"], [("l_extendedprice", "DESC")], ["l_orderkey", "l_linenumber"])


S13_SQL = """SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice,
 row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS row_number,
 rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS rank,
 dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS dense_rank,
 ntile(4) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS ntile
FROM lineitem"""


def s14_analytic(spark, sf):
    e = load(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    out = rel.analytic(e, ["user_id"], "ts", "value", tiebreak=["event_id"])
    return out.select("user_id", "event_id", "prev_value", "next_value", F.round("running_sum", 4).alias("running_sum"),
                      F.round("moving_avg", 4).alias("moving_avg"), F.round("range_sum", 4).alias("range_sum"))


S14_SQL = """SELECT user_id, event_id,
 lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS prev_value,
 lead(value) OVER (PARTITION BY user_id ORDER BY ts) AS next_value,
 round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running_sum,
 round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving_avg,
 round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), 4) AS range_sum
FROM events"""


# What the two halves of the keys are multiplied by.
HUGE, TINY = 1e25, 1e-9


def s14_mixed_sizes(spark, sf):
    """S14 where some keys hold values 34 orders of magnitude above the others'."""
    size = F.when(F.col("user_id") % 2 == 0, F.lit(HUGE)).otherwise(F.lit(TINY))
    e = load(spark, sf, "events").select("user_id", "event_id", "ts", (F.col("value") * size).alias("value"))
    out = rel.analytic(e, ["user_id"], "ts", "value", tiebreak=["event_id"])
    return out.select("user_id", "event_id", *[F.round(F.col(c) / size, 4).alias(c) for c in ("running_sum", "moving_avg", "range_sum")])


S14_MIXED_SQL = """SELECT user_id, event_id,
 round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running_sum,
 round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving_avg,
 round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), 4) AS range_sum
FROM events"""


def s15_topk(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rel.top_k(o, 10, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


S15_SQL = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"


def s15_topk_per_group(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rel.top_k_per_group(o, ["o_custkey"], 3, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


S15_GROUP_SQL = """SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER
(PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3"""


def s16_setops(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_nationkey").alias("nk"))
    s = load(spark, sf, "supplier").select(F.col("s_nationkey").alias("nk"))
    u = c.union(s).distinct().withColumn("op", F.lit("union"))
    ua = c.unionAll(s).groupBy("nk").agg(F.count(F.lit(1)).alias("n")).select("nk", F.concat(F.lit("union_all:"), F.col("n").cast("string")).alias("op"))
    i = c.intersect(s).withColumn("op", F.lit("intersect"))
    x = c.exceptAll(s).groupBy("nk").agg(F.count(F.lit(1)).alias("n")).select("nk", F.concat(F.lit("except_all:"), F.col("n").cast("string")).alias("op"))
    return u.unionByName(ua).unionByName(i).unionByName(x)


S16_SQL = """SELECT nk, 'union' AS op FROM (SELECT c_nationkey AS nk FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT nk, 'union_all:' || CAST(COUNT(*) AS VARCHAR) FROM (SELECT c_nationkey AS nk FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY nk
UNION ALL SELECT nk, 'intersect' FROM (SELECT c_nationkey AS nk FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT nk, 'except_all:' || CAST(COUNT(*) AS VARCHAR) FROM (SELECT c_nationkey AS nk FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) GROUP BY nk"""


def s17_subqueries(spark, sf):
    register_views(spark, sf, ["orders", "customer"])
    return sqlapi.run_sql(spark, """
        WITH avg_all AS (SELECT avg(o_totalprice) AS a FROM orders)
        SELECT c.c_custkey, c.c_name,
               (SELECT COUNT(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders
        FROM customer c
        WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
                      AND o.o_totalprice > (SELECT a FROM avg_all) * 1.5)
          AND c.c_acctbal > (SELECT avg(c2.c_acctbal) FROM customer c2 WHERE c2.c_nationkey = c.c_nationkey)""")


S17_SQL = """WITH avg_all AS (SELECT avg(o_totalprice) AS a FROM orders)
SELECT c.c_custkey, c.c_name, (SELECT COUNT(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders
FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > (SELECT a FROM avg_all) * 1.5)
AND c.c_acctbal > (SELECT avg(c2.c_acctbal) FROM customer c2 WHERE c2.c_nationkey = c.c_nationkey)"""


def s18_time_buckets(spark, sf):
    e = load(spark, sf, "events")
    out = rel.time_buckets(e, "ts", "hour", ["event_type"])
    return out.withColumn("total", F.round("total", 2))


S18_SQL = """SELECT date_trunc('hour', ts) AS bucket, event_type, COUNT(*) AS n, round(sum(value), 2) AS total
FROM events GROUP BY ALL"""


def s18_day_window(spark, sf):
    e = load(spark, sf, "events")
    return e.groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").cast("timestamp_ntz").alias("day"), "n")


S18_DAY_SQL = "SELECT date_trunc('day', ts) AS day, COUNT(*) AS n FROM events GROUP BY 1"


def s19_json(spark, sf):
    e = load(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"),
                    F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k_variant"),
                    F.get_json_object("props", "$.missing").alias("missing"))


S19_SQL = """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
CAST(json_extract(props, '$.k') AS BIGINT) AS k_variant, json_extract_string(props, '$.missing') AS missing FROM events"""


def s19_explode(spark, sf):
    """S19 arrays: the embedding vectors exploded with their positions."""
    em = load(spark, sf, "embeddings")
    ex = em.select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return ex.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


S19_EXPLODE_SQL = """SELECT CAST(pos - 1 AS INTEGER) AS pos, COUNT(*) AS n, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM
(SELECT vec_id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY pos"""


def s20_string(spark, sf):
    c = load(spark, sf, "customer")
    return c.select("c_custkey", F.upper("c_mktsegment").alias("up"), F.substring("c_name", 10, 9).alias("sub"),
                    F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("cat"),
                    F.char_length("c_name").alias("len"), F.replace("c_name", F.lit("Customer"), F.lit("C")).alias("rep"),
                    F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("pad"),
                    F.initcap(F.lower("c_mktsegment")).alias("cap"), F.reverse("c_mktsegment").alias("rev"))


S20_STRING_SQL = """SELECT c_custkey, upper(c_mktsegment) AS up, substr(c_name, 10, 9) AS sub,
c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR) AS cat, CAST(length(c_name) AS INTEGER) AS len,
replace(c_name, 'Customer', 'C') AS rep, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS pad,
upper(substr(lower(c_mktsegment), 1, 1)) || substr(lower(c_mktsegment), 2) AS cap, reverse(c_mktsegment) AS rev FROM customer"""


def s20_date(spark, sf):
    o = load(spark, sf, "orders")
    d = F.col("o_orderdate")
    return o.select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.weekday(d).alias("wd"),
                    F.date_add(F.to_date(d), 30).alias("plus30"),
                    F.datediff(F.lit("2000-01-01").cast("date"), F.to_date(d)).alias("days_to_2000"),
                    F.date_format(d, "yyyy-MM").alias("ym"), F.last_day(d).alias("month_end"))


S20_DATE_SQL = """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m,
CAST(isodow(o_orderdate) - 1 AS INTEGER) AS wd, CAST(o_orderdate AS DATE) + 30 AS plus30,
CAST(datediff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INTEGER) AS days_to_2000,
strftime(o_orderdate, '%Y-%m') AS ym, last_day(o_orderdate) AS month_end FROM orders"""


def s20_math(spark, sf):
    li = load(spark, sf, "lineitem")
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.abs(q - 25).alias("dq"),
                     F.round(F.sqrt(p), 6).alias("sq"), F.round(F.log(p), 6).alias("ln"),
                     F.round(F.pow(q, 2), 6).alias("q2"), F.ceil(p / 1000).alias("k_up"), F.floor(p / 1000).alias("k_dn"),
                     (F.col("l_orderkey") % 7).alias("m7"), F.signum(q - 25).alias("sgn"))


S20_MATH_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, abs(l_quantity - 25) AS dq, round(sqrt(l_extendedprice), 6) AS sq,
round(ln(l_extendedprice), 6) AS ln, round(pow(l_quantity, 2), 6) AS q2, CAST(ceil(l_extendedprice / 1000) AS BIGINT) AS k_up,
CAST(floor(l_extendedprice / 1000) AS BIGINT) AS k_dn, l_orderkey % 7 AS m7, CAST(sign(l_quantity - 25) AS DOUBLE) AS sgn FROM lineitem"""


def s20_array_map(spark, sf):
    p = load(spark, sf, "part")
    words = F.split("p_name", " ")
    m = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"))
    return p.select("p_partkey", F.size(words).alias("n_words"), F.array_join(F.array_sort(words), ",").alias("sorted"),
                    F.array_contains(words, "gear").alias("has_gear"),
                    F.array_join(F.slice(F.array("p_type", "p_brand", "p_name"), 2, 2), "|").alias("sl"),
                    m["type"].alias("m_type"), F.array_join(F.array_sort(F.map_keys(m)), ",").alias("keys"))


S20_ARRAY_SQL = """SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n_words,
array_to_string(list_sort(string_split(p_name, ' ')), ',') AS sorted, list_contains(string_split(p_name, ' '), 'gear') AS has_gear,
array_to_string([p_type, p_brand, p_name][2:3], '|') AS sl, p_type AS m_type, 'brand,type' AS keys FROM part"""


def s20_conditional(spark, sf):
    o = load(spark, sf, "orders")
    return o.select("o_orderkey",
                    F.when(F.col("o_totalprice") > 300000, "high").when(F.col("o_totalprice") > 100000, "mid").otherwise("low").alias("band"),
                    F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("partial")).alias("status"),
                    F.greatest(F.col("o_custkey"), F.lit(500)).alias("g"), F.least(F.col("o_custkey"), F.lit(500)).alias("l"))


S20_COND_SQL = """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
coalesce(nullif(o_orderstatus, 'P'), 'partial') AS status, greatest(o_custkey, 500) AS g, least(o_custkey, 500) AS l FROM orders"""


def s21_total_pages(spark, sf):
    o = load(spark, sf, "orders")
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("total")).select(
        "o_orderpriority", "total", sqlapi.total_pages("total", 7).alias("total_pages"))


S21_SQL = """SELECT o_orderpriority, COUNT(*) AS total, CAST(ceil(COUNT(*) / 7) AS BIGINT) AS total_pages FROM orders GROUP BY 1"""


QUERIES = {
    "s1_run_sql": (s1_run_sql, S1_SQL),
    "s2_paginate": (s2_paginate, S2_SQL),
    "s3_sort_by": (s3_sort_by, S3_SQL),
    "s4_point_lookup": (s4_point_lookup, S4_SQL),
    "s5_aggregate": (s5_aggregate, S5_SQL),
    "s6_distinct": (s6_distinct, S6_SQL),
    "s6_approx_distinct": (s6_approx_distinct, S6_APPROX_SQL),
    "s7_cube": (s7_cube, S7_CUBE_SQL),
    "s7_rollup": (s7_rollup, S7_ROLLUP_SQL),
    "s7_grouping_sets": (s7_grouping_sets, S7_SETS_SQL),
    "s8_predicates": (s8_predicates, S8_SQL),
    "s9_join_inner": (s9_join_inner, S9_SQL),
    "s9_join_left": (s9_join_left, S9_LEFT_SQL),
    "s9_join_full": (s9_join_full, S9_FULL_SQL),
    "s10_semi": (s10_semi, S10_SEMI_SQL),
    "s10_anti": (s10_anti, S10_ANTI_SQL),
    "s11_range_join": (s11_range_join, S11_SQL),
    "s12_asof": (s12_asof, S12_SQL),
    "s13_ranking": (s13_ranking, S13_SQL),
    "s14_analytic": (s14_analytic, S14_SQL),
    "s14_mixed_sizes": (s14_mixed_sizes, S14_MIXED_SQL),
    "s15_topk": (s15_topk, S15_SQL),
    "s15_topk_per_group": (s15_topk_per_group, S15_GROUP_SQL),
    "s16_setops": (s16_setops, S16_SQL),
    "s17_subqueries": (s17_subqueries, S17_SQL),
    "s18_time_buckets": (s18_time_buckets, S18_SQL),
    "s18_day_window": (s18_day_window, S18_DAY_SQL),
    "s19_json": (s19_json, S19_SQL),
    "s19_explode": (s19_explode, S19_EXPLODE_SQL),
    "s20_string": (s20_string, S20_STRING_SQL),
    "s20_date": (s20_date, S20_DATE_SQL),
    "s20_math": (s20_math, S20_MATH_SQL),
    "s20_array_map": (s20_array_map, S20_ARRAY_SQL),
    "s20_conditional": (s20_conditional, S20_COND_SQL),
    "s21_total_pages": (s21_total_pages, S21_SQL),
}
