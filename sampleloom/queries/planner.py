"""The ladder, its names, and the bookkeeping around results."""

from __future__ import annotations

from pyspark.sql import functions as F

from sampleloom.functions import text as fn
from sampleloom.plans import planner
from sampleloom.queries.tables import MEMBERS_SQL, levels, members, table
from sampleloom.registry import query

_REQUESTS_SQL = """
WITH requests AS (
  SELECT p_partkey AS request, s_suppkey AS source, CASE p_size % 5 WHEN 0 THEN 'auto' WHEN 1 THEN 'flac' WHEN 2 THEN 'opus' WHEN 3 THEN 'mp3' ELSE 'wav' END AS format,
    CASE s_nationkey % 4 WHEN 0 THEN 'flac' WHEN 1 THEN 'opus' WHEN 2 THEN 'mp3' ELSE 'wav' END AS container, CASE WHEN p_partkey % 4 = 0 THEN 48000 ELSE 0 END AS want_rate,
    CASE WHEN s_nationkey % 2 = 0 THEN 48000 ELSE 44100 END AS rate, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END AS want_channels, s_nationkey % 6 + 1 AS channels,
    CASE WHEN p_partkey % 9 = 0 THEN 128 ELSE 0 END AS bitrate, CASE WHEN p_partkey % 11 = 0 THEN 3.0 ELSE 0.0 END AS gain_db, CASE WHEN p_partkey % 13 = 0 THEN 500 ELSE 0 END AS from_sample,
    CASE WHEN p_partkey % 2 = 0 THEN 1411 ELSE 0 END AS max_kbps, (s_nationkey + 1)::BIGINT * 1000000 AS bytes, (s_suppkey % 7) * 4800000 AS samples
  FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier)
), judged AS (
  SELECT *, from_sample = 0 AND bitrate = 0 AND (format = 'auto' OR format = container) AND (want_rate = 0 OR want_rate = rate) AND (want_channels = 0 OR want_channels = channels) AND gain_db = 0
      AND (max_kbps = 0 OR (samples > 0 AND bytes * 8 * rate <= max_kbps * 1000 * samples)) AS direct,
    format IN ('auto', container) AND container <> 'wav' AND (want_rate = 0 OR want_rate = rate) AND (want_channels = 0 OR want_channels = channels) AND gain_db = 0 AND bitrate = 0 AS same
  FROM requests)"""


def _requests(spark, d):
    n = table(spark, d, "supplier").count()
    part = table(spark, d, "part").withColumn("k", F.col("p_partkey") % n)
    rows = part.join(table(spark, d, "supplier"), F.col("k") == F.col("s_suppkey"))
    p, s, nation = F.col("p_partkey"), F.col("s_suppkey"), F.col("s_nationkey").cast("long")
    pick = lambda c, names: F.get(F.array(*[F.lit(x) for x in names]), c.cast("int"))
    return rows.select(
        p.alias("request"),
        s.alias("source"),
        pick(F.col("p_size") % 5, ("auto", "flac", "opus", "mp3", "wav")).alias("format"),
        pick(nation % 4, ("flac", "opus", "mp3", "wav")).alias("container"),
        F.when(p % 4 == 0, 48000).otherwise(0).alias("want_rate"),
        F.when(nation % 2 == 0, 48000).otherwise(44100).alias("rate"),
        F.when(p % 3 == 0, 2).otherwise(0).alias("want_channels"),
        (nation % 6 + 1).alias("channels"),
        F.lit(0).alias("want_bits"),
        F.lit("int").alias("sample_type"),
        F.lit(16).alias("bit_depth"),
        F.when(p % 9 == 0, 128).otherwise(0).alias("bitrate"),
        F.when(p % 11 == 0, 3.0).otherwise(0.0).alias("gain_db"),
        F.when(p % 13 == 0, 500).otherwise(0).alias("from_sample"),
        F.when(p % 2 == 0, 1411).otherwise(0).alias("max_kbps"),
        ((nation + 1) * 1_000_000).alias("bytes"),
        (s % 7 * 4_800_000).alias("samples"),
    )


@query("ladder", _REQUESTS_SQL + " SELECT request, CASE WHEN direct THEN 'direct' WHEN same AND from_sample = 0 THEN 'remux' WHEN same AND container = 'opus' THEN 'cut' ELSE 'transcode' END AS rung FROM judged")
def ladder(spark, d):
    """Direct play, copied packets, cut packets, or a transcode: the first that serves each request."""
    rows = _requests(spark, d)
    same = (
        F.col("format").isin("auto")
        | (F.col("format") == F.col("container"))
    ) & (F.col("container") != "wav") & ((F.col("want_rate") == 0) | (F.col("want_rate") == F.col("rate"))) & (
        (F.col("want_channels") == 0) | (F.col("want_channels") == F.col("channels"))
    ) & (F.col("gain_db") == 0) & (F.col("bitrate") == 0)
    rung = planner.ladder(planner.direct_playable(rows), same & (F.col("from_sample") == 0), same & (F.col("container") == "opus"))
    return rows.select("request", rung.alias("rung"))


@query(
    "output_channels",
    _REQUESTS_SQL + " SELECT request, CASE WHEN channels <= 2 THEN channels WHEN container IN ('opus', 'mp3') THEN 2 END AS out_channels, container IN ('opus', 'mp3') AS lossy FROM requests",
)
def output_channels(spark, d):
    """Lossy outputs fold what is wider than stereo; lossless ones refuse."""
    rows = _requests(spark, d)
    return rows.select("request", planner.fold_to_stereo(F.col("container"), F.col("channels")).cast("int").alias("out_channels"), planner.is_lossy(F.col("container")).alias("lossy"))


@query(
    "cache_key",
    _REQUESTS_SQL
    + """ SELECT request, sha256('sampleloom-cache-1' || chr(10) || bytes || '-' || samples || chr(10) || 'format=' || format || '&rate=' || want_rate || chr(10) || 'decode-1,' || CASE WHEN gain_db <> 0 THEN 'gain-1,' ELSE '' END) AS key FROM requests""",
)
def cache_key(spark, d):
    rows = _requests(spark, d)
    versions = F.array_compact(F.array(F.lit("decode-1"), F.when(F.col("gain_db") != 0, "gain-1"), F.lit("decode-1")))
    params = F.concat(F.lit("format="), F.col("format"), F.lit("&rate="), F.col("want_rate").cast("string"))
    identity = F.concat_ws("-", F.col("bytes").cast("string"), F.col("samples").cast("string"))
    return rows.select("request", planner.cache_key(identity, params, versions).alias("key"))


@query(
    "timeline_digest",
    f"""WITH {MEMBERS_SQL} SELECT timeline, rtrim(translate(to_base64(unhex(sha256('[' || string_agg('{{"src":"o' || idx || '","from":0,"to":' || len || '}}', ',' ORDER BY idx) || ']'))), '+/', '-_'), '=') AS digest FROM members GROUP BY timeline""",
)
def timeline_digest(spark, d):
    rows = members(spark, d).select("timeline", "idx", F.concat(F.lit("o"), F.col("idx").cast("string")).alias("src"), F.lit(0).alias("from_sample"), F.col("len").alias("to_sample"))
    return planner.timeline_digest(rows, ["timeline"])


@query(
    "cache_eviction",
    """WITH e AS (SELECT user_id, event_id, ts, length(props)::BIGINT * 100 AS size FROM events),
k AS (SELECT user_id, event_id, sum(size) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS kept_bytes FROM e)
SELECT user_id, event_id, kept_bytes FROM k WHERE kept_bytes > 20000""",
)
def cache_eviction(spark, d):
    """Oldest entries go until the rest of each store keeps to its budget."""
    rows = levels(spark, d).select(F.col("track").alias("user_id"), F.col("event_id").alias("entry_id"), F.col("ts").alias("last_access"), (F.length("props").cast("long") * 100).alias("size"))
    return planner.evict(rows, ["user_id"], 20000).select("user_id", F.col("entry_id").alias("event_id"), "kept_bytes")


@query("job_claim", "SELECT user_id AS queue, min(event_id) AS job_id FROM events WHERE event_type = 'click' GROUP BY 1")
def job_claim(spark, d):
    rows = levels(spark, d).select(F.col("track").alias("queue"), F.col("event_id").alias("job_id"), F.when(F.col("kind") == "click", "queued").otherwise("done").alias("state"))
    return planner.claim_oldest(rows, ["queue"])


@query("live_edge", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r <= 3")
def live_edge(spark, d):
    rows = levels(spark, d).select(F.col("track").alias("user_id"), "event_id", F.col("ts").alias("seq"))
    return planner.live_edge(rows, ["user_id"]).select("user_id", "event_id")


@query(
    "root_changes",
    """WITH a AS (SELECT c_name AS name, c_mktsegment AS path FROM customer WHERE c_nationkey < 18), b AS (SELECT c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 'moved' ELSE c_mktsegment END AS path FROM customer WHERE c_nationkey > 6)
SELECT * FROM (SELECT name, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.path <> b.path THEN 'changed' END AS change FROM a FULL JOIN b USING (name)) WHERE change IS NOT NULL""",
)
def root_changes(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("path"), "c_nationkey", "c_custkey")
    new = rows.where("c_nationkey > 6").withColumn("path", F.when(F.col("c_custkey") % 5 == 0, "moved").otherwise(F.col("path")))
    return planner.diff_roots(rows.where("c_nationkey < 18"), new)


_BOUNDS = (1.0, 5.0, 25.0, 100.0)


@query(
    "metrics_histogram",
    "SELECT event_type, " + ", ".join(f"count(*) FILTER (value <= {b}) AS le_{str(b).replace('.', '_')}" for b in _BOUNDS) + ", count(value) AS le_inf FROM events GROUP BY event_type",
)
def metrics_histogram(spark, d):
    return planner.histogram(levels(spark, d).withColumnRenamed("kind", "event_type"), ["event_type"], F.col("value"), _BOUNDS)


@query(
    "latency_percentiles",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (i = floor(0.5 * (n - 1) + 0.5)) AS p50, max(value) FILTER (i = floor(0.95 * (n - 1) + 0.5)) AS p95, max(value) FILTER (i = floor(0.99 * (n - 1) + 0.5)) AS p99 FROM r GROUP BY event_type""",
)
def latency_percentiles(spark, d):
    return planner.nearest_rank(levels(spark, d).withColumnRenamed("kind", "event_type"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("error_classes", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 7 ELSE 1 END AS exit_class, CASE c_custkey % 4 WHEN 1 THEN 404 WHEN 2 THEN 403 ELSE 500 END AS status FROM customer")
def error_classes(spark, d):
    from sampleloom.core.errors import exit_class_of, status_of

    code = F.when(F.col("c_custkey") % 4 == 1, "not-found").when(F.col("c_custkey") % 4 == 2, "signature-expired").when(F.col("c_custkey") % 4 == 3, "no-such-code").otherwise("")
    return table(spark, d, "customer").select("c_custkey", exit_class_of(code).alias("exit_class"), status_of(code).alias("status"))


@query(
    "playlists",
    f"""WITH {MEMBERS_SQL} SELECT timeline, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || '#EXT-X-TARGETDURATION:' || CAST(floor(max(len / 44100) + 0.999999) AS BIGINT) || chr(10) || '#EXT-X-MEDIA-SEQUENCE:0' || chr(10)
  || '#EXT-X-PLAYLIST-TYPE:VOD' || chr(10) || '#EXT-X-INDEPENDENT-SEGMENTS' || chr(10) || '#EXT-X-MAP:URI="init.mp4"' || chr(10)
  || string_agg('#EXTINF:' || printf('%.5f', len / 44100) || ',' || chr(10) || 'seg' || idx || '.m4s' || chr(10), '' ORDER BY idx) || '#EXT-X-ENDLIST' || chr(10) AS playlist FROM members GROUP BY timeline""",
)
def playlists(spark, d):
    """A finished media playlist per timeline."""
    rows = members(spark, d).select("timeline", F.struct("idx", F.concat(F.lit("seg"), F.col("idx").cast("string"), F.lit(".m4s")).alias("uri"), (F.col("len") / 44100).alias("seconds")).alias("s"))
    return rows.groupBy("timeline").agg(F.array_sort(F.collect_list("s")).alias("s")).select("timeline", fn.media_playlist(F.col("s"), "init.mp4").alias("playlist"))


@query("gain_target", "SELECT vec_id, round(-18 - (-0.691 + 10 * log10(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)) / 64)), 4) AS gain_db FROM embeddings")
def gain_target(spark, d):
    """The gain that brings each chunk to -18 LUFS: the first pass of a two-pass job."""
    from sampleloom.operators.loudness import loudness_of

    power = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) / 64
    return table(spark, d, "embeddings").select("vec_id", F.round(fn.REPLAY_GAIN_REFERENCE - loudness_of(power), 4).alias("gain_db"))
