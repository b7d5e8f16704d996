"""Joins, set operations, roll-ups, ranks and event windows on the star schema and the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.operators.joins import as_of, range_join
from corpuscle.sources.files import load
from corpuscle.streaming import jobs


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.event_windows(load(spark, sf_dir, "events"), "1 day")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.event_windows(load(spark, sf_dir, "events"), "2 days", "1 day")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.sessions(load(spark, sf_dir, "events"), "6 hours")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def event_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.dedupe(load(spark, sf_dir, "events").select("user_id", "event_type"), ["user_id", "event_type"])


def star_join_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return joined.rollup("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), revenue.alias("revenue"))


def star_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem")
    return rows.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def star_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    by = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    gap = F.round(F.lag("o_totalprice").over(by) - F.col("o_totalprice"), 2)
    return orders.select("o_custkey", "o_orderkey", F.row_number().over(by).alias("rn"), F.dense_rank().over(by).alias("dr"), F.ntile(4).over(by).alias("quartile"), gap.alias("gap"))


def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    rows = load(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(by))
    return rows.filter("rn <= 3").select("o_custkey", "o_orderkey", "rn")


def star_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, customers = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    parts = [("intersect", suppliers.intersect(customers)), ("except_all", customers.exceptAll(suppliers)), ("intersect_all", suppliers.intersectAll(customers)), ("union", suppliers.union(customers).distinct())]
    out = None
    for name, df in parts:
        one = df.select("k", F.lit(name).alias("part"))
        out = one if out is None else out.unionByName(one)
    return out


def semi_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = load(spark, sf_dir, "customer").select("c_custkey"), load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return customer.join(orders, "c_custkey", "left_semi").withColumn("part", F.lit("semi")).unionByName(customer.join(orders, "c_custkey", "left_anti").withColumn("part", F.lit("anti")))


def full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    c = load(spark, sf_dir, "customer").filter("c_nationkey % 2 = 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    return s.join(c, "k", "full").select("k", "suppliers", "customers")


def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the same user's last click at or before it."""
    rows = load(spark, sf_dir, "events")
    bought = rows.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicked = rows.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return as_of(bought, clicked, ["user_id"], "ts", ["click_id"]).select("event_id", "user_id", "click_id")


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many purchases fall within an hour after each user's error."""
    rows = load(spark, sf_dir, "events").withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp")))
    errors = rows.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("s").alias("low"), (F.col("s") + 3600).alias("high"))
    points = rows.filter("event_type = 'purchase'").select(F.col("event_id").alias("point_id"), F.col("s").alias("at"))
    pairs = range_join(points, errors, "at", "low", "high", 3600)
    return pairs.groupBy("error_id").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (event_windows, sliding_windows, session_windows, event_dedupe, star_join_rollup, star_cube, star_rank, top_per_group, star_set_ops, semi_and_anti, full_outer, as_of_join, interval_join)}
ORACLE_SQL = {
    "event_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "sliding_windows": "SELECT strftime(date_trunc('day', ts) - to_days(CAST(k AS INT)), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL",
    "session_windows": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "event_dedupe": "SELECT DISTINCT user_id, event_type FROM events",
    "star_join_rollup": "SELECT r_name, c_mktsegment, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, c_mktsegment)",
    "star_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "star_rank": "SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(dense_rank() OVER w AS INT) AS dr, CAST(ntile(4) OVER w AS INT) AS quartile, round(lag(o_totalprice) OVER w - o_totalprice, 2) AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)",
    "top_per_group": "SELECT o_custkey, o_orderkey, CAST(rn AS INT) AS rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3",
    "star_set_ops": """WITH s AS (SELECT s_nationkey AS k FROM supplier), c AS (SELECT c_nationkey AS k FROM customer)
SELECT k, 'intersect' AS part FROM (SELECT k FROM s INTERSECT SELECT k FROM c) UNION ALL SELECT k, 'except_all' FROM (SELECT k FROM c EXCEPT ALL SELECT k FROM s)
UNION ALL SELECT k, 'intersect_all' FROM (SELECT k FROM s INTERSECT ALL SELECT k FROM c) UNION ALL SELECT k, 'union' FROM (SELECT k FROM s UNION SELECT k FROM c)""",
    "semi_and_anti": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'semi' ELSE 'anti' END AS part FROM customer",
    "full_outer": "SELECT coalesce(s.k, c.k) AS k, suppliers, customers FROM (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) s FULL JOIN (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1) c ON s.k = c.k",
    "as_of_join": """SELECT event_id, user_id, click_id FROM (SELECT p.event_id, p.user_id, c.event_id AS click_id, row_number() OVER (PARTITION BY p.event_id ORDER BY c.ts DESC, c.event_id DESC) AS n
FROM events p LEFT JOIN events c ON c.event_type = 'click' AND c.user_id = p.user_id AND c.ts <= p.ts WHERE p.event_type = 'purchase') WHERE n = 1""",
    "interval_join": "SELECT e.event_id AS error_id, count(*) AS n FROM events e JOIN events p ON p.event_type = 'purchase' AND epoch(date_trunc('second', p.ts)) BETWEEN epoch(date_trunc('second', e.ts)) AND epoch(date_trunc('second', e.ts)) + 3600 WHERE e.event_type = 'error' GROUP BY 1",
}
