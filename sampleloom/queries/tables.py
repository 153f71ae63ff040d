"""Views of the driver's tables in the engine's own schemas, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sampleloom.core.positions import prefix_sum

VALUES = 64
#: A pretended rate: a block of 32 samples is 100 ms, a chunk two blocks.
RATE, BLOCK = 320, 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as mono chunks: track = label, position = rank within it times 64."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("track"), "embedding")
    placed = prefix_sum(rows, ["track"], ["vec_id"], F.floor(F.col("vec_id") / 4096), F.size("embedding").cast("long"), "pos")
    return placed.select("track", "pos", F.size("embedding").alias("n"), F.lit(False).alias("discont"), F.array("embedding").alias("pcm"), "vec_id")


CHUNKS_SQL = """
chunks AS (
  SELECT label AS track, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 64 AS pos, embedding FROM embeddings
), samples AS (
  SELECT track, vec_id, pos + i - 1 AS pos, v FROM (SELECT track, vec_id, pos, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM chunks)
)"""

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line items as packets: track = order, duration = quantity, sync = returned items and the first."""
    rows = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy(*_ORDER)
    rows = rows.select("l_orderkey", "l_quantity", "l_returnflag", *_ORDER, (F.row_number().over(order) - 1).cast("long").alias("seq"))
    return rows.select(F.col("l_orderkey").alias("track"), "seq", F.col("l_quantity").cast("long").alias("dur"), ((F.col("l_returnflag") == "R") | (F.col("seq") == 0)).alias("sync"))


PACKETS_SQL = f"""
packets AS (
  SELECT *, coalesce(sum(dur) OVER (PARTITION BY track ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pts FROM (
    SELECT l_orderkey AS track, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_ORDER)}) - 1 AS seq, CAST(l_quantity AS BIGINT) AS dur, l_returnflag AS flag FROM lineitem)
), synced AS (SELECT *, flag = 'R' OR seq = 0 AS sync FROM packets)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as timeline members: timeline = customer, length from the price."""
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_custkey").alias("timeline"), F.col("o_orderkey").alias("idx"), (F.floor("o_totalprice").cast("long") + 5000).alias("len"))


MEMBERS_SQL = "members AS (SELECT o_custkey AS timeline, o_orderkey AS idx, CAST(floor(o_totalprice) AS BIGINT) + 5000 AS len FROM orders)"


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversation turns as chapters: a millisecond per character; every third has an end of its own."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length(F.coalesce("text", F.lit(""))).cast("long") * 1_000_000).alias("span"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start_ns", F.coalesce(F.sum("span").over(before), F.lit(0).cast("long")))
    end = F.when(F.col("turn") % 3 == 0, F.col("start_ns") + F.col("span")).otherwise(F.lit(0).cast("long"))
    return rows.select("conv_id", F.col("turn").alias("idx"), "start_ns", end.alias("end_ns"))


CHAPTERS_SQL = """
chapters AS (
  SELECT conv_id, turn AS idx, start_ns, CASE WHEN turn % 3 = 0 THEN start_ns + span ELSE 0 END AS end_ns FROM (
    SELECT conv_id, turn, span, coalesce(sum(span) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ns
    FROM (SELECT conv_id, turn, length(coalesce(text, ''))::BIGINT * 1000000 AS span FROM conversations)))"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an irregular signal: track = user, level = value."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), "event_id", "ts", F.col("event_type").alias("kind"), "value", "props")
