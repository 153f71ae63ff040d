"""Windows in time over the events: the batch form of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sampleloom.queries.tables import levels
from sampleloom.registry import query


@query("tumbling_energy", "SELECT user_id AS track, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, sum(CAST(round(value * 1000) AS BIGINT))::BIGINT AS milli FROM events GROUP BY 1, 2")
def tumbling_energy(spark, d):
    rows = levels(spark, d).groupBy("track", F.window("ts", "1 day").alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 1000).cast("long")).alias("milli")).select("track", F.col("w.start").alias("start"), "n", "milli")


@query(
    "sliding_energy",
    "SELECT track, start, count(*) AS n FROM (SELECT user_id AS track, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start FROM events) GROUP BY 1, 2",
)
def sliding_energy(spark, d):
    rows = levels(spark, d).groupBy("track", F.window("ts", "12 hours", "6 hours").alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n")).select("track", F.col("w.start").alias("start"), "n")


@query(
    "sessions",
    """WITH g AS (SELECT user_id AS track, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT track, ts, sum(fresh) OVER (PARTITION BY track ORDER BY ts) AS s FROM g)
SELECT track, min(ts) AS start, max(ts) + INTERVAL 8 HOUR AS stop, count(*) AS n FROM s GROUP BY track, s""",
)
def sessions(spark, d):
    """Runs of events with gaps under eight hours."""
    rows = levels(spark, d).groupBy("track", F.session_window("ts", "8 hours").alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n")).select("track", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


@query(
    "asof_level",
    "SELECT a.event_id, b.value AS level FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts >= b.ts",
)
def asof_level(spark, d):
    """The level of the last click before each purchase: one ordered pass, no pairwise comparison."""
    from pyspark.sql import Window

    order = Window.partitionBy("track").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = levels(spark, d).where(F.col("kind").isin("click", "purchase"))
    rows = rows.withColumn("level", F.last(F.when(F.col("kind") == "click", F.col("value")), ignorenulls=True).over(order))
    return rows.where("kind = 'purchase'").select("event_id", "level")
