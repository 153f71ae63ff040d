"""Relational coverage beyond the reference: what Catalyst gives, on the same tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sampleloom.queries.tables import table
from sampleloom.registry import query


@query(
    "revenue_summary",
    """SELECT l_returnflag, sum(l_quantity)::BIGINT AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1""",
)
def revenue_summary(spark, d):
    rows = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag").agg(
        F.sum("l_quantity").cast("long").alias("qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count(F.lit(1)).alias("n")
    )


@query(
    "join_star",
    """SELECT r_name, o_orderpriority, count(*) AS n, sum(l_quantity)::BIGINT AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
def join_star(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_quantity").join(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    place = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = rows.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("r_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("qty"))


@query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def join_semi(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("join_anti", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def join_anti(spark, d):
    return table(spark, d, "part").join(table(spark, d, "lineitem").where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("join_full", "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k")
def join_full(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "k", "full")


@query("rollup_cube", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) + 2 * grouping(l_linestatus) AS g, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rollup_cube(spark, d):
    g = (F.grouping("l_returnflag") + 2 * F.grouping("l_linestatus")).cast("long")
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(g.alias("g"), F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))


@query(
    "ranking_windows",
    "SELECT o_orderkey, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd, dense_rank() OVER w AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)",
)
def ranking_windows(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"), F.dense_rank().over(w).cast("long").alias("dr"))


@query("set_operations", "SELECT k, 'both' AS s FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'customers' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)")
def set_operations(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    both = c.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey"))
    only = c.select(F.col("c_nationkey").alias("k")).subtract(s.where("s_acctbal > 0").select("s_nationkey"))
    return both.withColumn("s", F.lit("both")).unionAll(only.withColumn("s", F.lit("customers")))


@query("lateral_top", "SELECT c_custkey, o_orderkey FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def lateral_top(spark, d):
    """The two largest orders of each customer."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r <= 2").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")


@query("json_fields", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props)) AS n_keys FROM events")
def json_fields(spark, d):
    props = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", F.get(F.map_values(props), F.lit(0)).alias("first_value"), F.size(props).cast("long").alias("n_keys"))
