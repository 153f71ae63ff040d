"""Stores and maps of the service, timelines' formats and starts, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sampleloom.core.schemas import DEFAULT_LAYOUTS
from sampleloom.plans import packets, planner, timeline
from sampleloom.queries.tables import levels, table
from sampleloom.registry import query


def _entries(spark, d):
    rows = levels(spark, d)
    return rows.select(F.col("track").alias("user_id"), F.col("event_id").alias("entry_id"), F.col("ts").alias("last_access"), (F.length("props").cast("long") * 100).alias("size"), "kind")


@query(
    "cache_collection",
    """WITH e AS (SELECT user_id, event_id, ts, length(props)::BIGINT * 100 AS size, event_id % 7 = 0 AS pinned, max(ts) OVER (PARTITION BY user_id) AS now FROM events),
k AS (SELECT *, coalesce(sum(size) FILTER (NOT pinned) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::BIGINT
  + coalesce(sum(size) FILTER (pinned) OVER (PARTITION BY user_id), 0)::BIGINT AS kept_bytes FROM e)
SELECT user_id, event_id, kept_bytes FROM k WHERE NOT pinned AND (kept_bytes > 30000 OR now - ts > INTERVAL 15 DAY)""",
)
def cache_collection(spark, d):
    """Entries that go for want of room or for their age; entries being filled stay."""
    rows = _entries(spark, d).withColumn("now", F.max("last_access").over(Window.partitionBy("user_id")))
    old = F.col("last_access") < F.col("now") - F.expr("INTERVAL 15 DAYS")
    return planner.evict(rows, ["user_id"], 30000, old, F.col("entry_id") % 7 == 0).select("user_id", F.col("entry_id").alias("event_id"), "kept_bytes")


@query(
    "cache_stats",
    """SELECT user_id, count(*) FILTER (event_type <> 'click') AS entries, coalesce(sum(length(props)::BIGINT * 100) FILTER (event_type <> 'click'), 0)::BIGINT AS bytes,
  count(*) FILTER (event_type = 'click' AND event_id % 3 <> 0) AS hits, count(*) FILTER (event_type = 'click' AND event_id % 3 = 0) AS misses FROM events GROUP BY 1""",
)
def cache_stats(spark, d):
    """Entries, bytes, hits and misses of each user's store; clicks are its lookups."""
    rows = _entries(spark, d)
    lookups = rows.where("kind = 'click'").withColumn("hit", F.col("entry_id") % 3 != 0)
    return planner.cache_stats(rows.where("kind <> 'click'"), lookups, ["user_id"])


@query(
    "bounded_map",
    """SELECT event_type, user_id, used FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY used DESC, user_id DESC) AS r FROM (
  SELECT event_type, user_id, max(event_id) AS used FROM events GROUP BY 1, 2)) WHERE r <= 10""",
)
def bounded_map(spark, d):
    """The ten users a small map per event type holds after all uses."""
    rows = levels(spark, d).select(F.col("kind").alias("event_type"), F.col("track").alias("user_id"), F.col("event_id").alias("used"))
    return planner.bounded_map(rows, ["event_type"], "user_id", "used", 10)


@query(
    "sidecar_trim",
    """WITH b AS (SELECT o_custkey AS folder, o_orderkey AS blob, o_orderkey || CASE WHEN o_orderkey % 11 = 0 THEN '.tmp' ELSE '.idx' END AS name, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderdate AS mtime FROM orders),
j AS (SELECT *, name LIKE '%.tmp' OR size > 300000 AS junk FROM b),
k AS (SELECT *, coalesce(sum(size) FILTER (NOT junk) OVER (PARTITION BY folder ORDER BY mtime DESC, name DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS kept FROM j)
SELECT folder, blob, CASE WHEN junk THEN 'leftover' ELSE 'budget' END AS reason FROM k WHERE junk OR kept > 500000""",
)
def sidecar_trim(spark, d):
    """Sidecars to delete: leftovers and oversized ones, then the oldest of each folder."""
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("folder"), F.col("o_orderkey").alias("blob"), F.floor("o_totalprice").cast("long").alias("size"), F.col("o_orderdate").alias("mtime"),
        F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 11 == 0, ".tmp").otherwise(".idx")).alias("name"),
    )
    return planner.trim_sidecars(rows, ["folder"], 500000, 300000).select("folder", "blob", "reason")


_PREFERRED = ("opus", "aac", "mp3", "flac", "aac", "wav")


@query(
    "capability_filter",
    """SELECT p_partkey, coalesce(array_to_string(list_filter(['opus', 'aac', 'mp3', 'flac', 'aac', 'wav'], lambda n: list_contains(
  CASE p_size % 4 WHEN 0 THEN ['wav', 'flac'] WHEN 1 THEN ['mp3', 'aac'] WHEN 2 THEN ['opus', 'wav', 'mp3'] ELSE ['ape'] END, n)), ','), '') AS offered FROM part""",
)
def capability_filter(spark, d):
    """Of a profile's formats those this build can make, repeats and order kept."""
    sets = F.array(*[F.array(*[F.lit(n) for n in names]) for names in (("wav", "flac"), ("mp3", "aac"), ("opus", "wav", "mp3"), ("ape",))])
    names = planner.capable(F.array(*[F.lit(n) for n in _PREFERRED]), F.get(sets, (F.col("p_size") % 4).cast("int")))
    return table(spark, d, "part").select("p_partkey", F.array_join(names, ",").alias("offered"))


_LAYOUT_SQL = "CASE channels " + " ".join(f"WHEN {n} THEN {mask}" for n, mask in DEFAULT_LAYOUTS.items()) + " END"


@query(
    "timeline_envelope",
    f"""WITH t AS (SELECT o_custkey AS timeline, CASE o_orderkey % 3 WHEN 0 THEN 44100 WHEN 1 THEN 48000 ELSE 32000 END AS rate, o_orderkey % 6 + 1 AS channels, CASE WHEN o_orderkey % 5 = 0 THEN 24 ELSE 16 END AS depth,
  o_orderkey % 13 = 0 AS f, CASE WHEN o_orderkey % 97 = 0 THEN -1 ELSE 5000 END AS samples, o_orderkey % 17 = 0 AS odd FROM orders),
e AS (SELECT timeline, max(rate) AS rate, max(channels) AS channels, max(depth) AS depth, bool_or(f) AS f, bool_or(samples < 0) AS open FROM t GROUP BY 1)
SELECT timeline, rate, channels, CASE WHEN f THEN 32 ELSE depth END AS bit_depth, CASE WHEN f THEN 'float' ELSE 'int' END AS sample_type, {_LAYOUT_SQL} AS layout,
  CASE WHEN open THEN 'invalid-request' WHEN EXISTS (SELECT 1 FROM t WHERE t.timeline = e.timeline AND t.channels = e.channels AND t.odd) THEN 'unsupported-format' END AS code FROM e""",
)
def timeline_envelope(spark, d):
    """The common format of each customer's orders as members; every 17th has unusual speakers, every 97th no length."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("timeline"), F.when(k % 3 == 0, 44100).when(k % 3 == 1, 48000).otherwise(32000).alias("rate"), (k % 6 + 1).alias("channels"), F.when(k % 5 == 0, 24).otherwise(16).alias("bit_depth"),
        F.when(k % 13 == 0, "float").otherwise("int").alias("sample_type"), F.when(k % 97 == 0, -1).otherwise(5000).alias("samples"), (k % 17 == 0).alias("odd"),
    )
    usual = F.create_map(*[F.lit(x) for pair in DEFAULT_LAYOUTS.items() for x in pair])[F.col("channels").cast("int")]
    rows = rows.withColumn("layout", F.when(F.col("odd"), 0x30000).otherwise(usual))
    return timeline.envelope(rows, ["timeline"]).withColumn("code", F.col("error.code")).drop("error")


@query(
    "prime_starts",
    """WITH s AS (SELECT o_orderkey, o_orderkey * 100 AS p0, CASE WHEN o_orderkey % 2 = 0 THEN 44100 ELSE 48000 END AS rate, CASE o_orderkey % 3 WHEN 0 THEN 4096 WHEN 1 THEN 960 ELSE 1152 END AS frame,
  (o_orderkey % 5) * 0.5::DOUBLE AS horizon, -(o_orderkey % 4) * 5000 AS least FROM orders),
e AS (SELECT *, (CAST(floor(rate * 0.1::DOUBLE) AS BIGINT) + frame - 1) // frame * frame AS enc, (CAST(floor(horizon * rate) AS BIGINT) + frame - 1) // frame * frame AS settle FROM s)
SELECT o_orderkey, greatest(-((-least) // frame * frame), p0 - enc - settle)::BIGINT AS chain_from, greatest(0, p0 - enc)::BIGINT AS encoder_from FROM e""",
)
def prime_starts(spark, d):
    """Where chain and encoder begin before a segment; some sources have audio before their first sample."""
    k = F.col("o_orderkey")
    rate, frame = F.when(k % 2 == 0, 44100).otherwise(48000), F.when(k % 3 == 0, 4096).when(k % 3 == 1, 960).otherwise(1152)
    chain, encoder = packets.prime_starts(k * 100, rate, frame, (k % 5) * F.lit(0.5), -(k % 4) * 5000)
    return table(spark, d, "orders").select("o_orderkey", chain.alias("chain_from"), encoder.alias("encoder_from"))
