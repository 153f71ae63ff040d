"""Grids, remuxing, cutting and segmenting on packet metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from sampleloom.core.positions import div
from sampleloom.plans import packets as plan
from sampleloom.queries.tables import PACKETS_SQL, packets
from sampleloom.registry import query

_KEY = ["track"]
PREROLL, GRID = 16, 8


#: The packets of even tracks have one duration, those of odd tracks their own.
_GRIDDED_SQL = PACKETS_SQL.replace("CAST(l_quantity AS BIGINT) AS dur", f"CASE WHEN l_orderkey % 2 = 0 THEN {GRID} ELSE CAST(l_quantity AS BIGINT) END AS dur")


def _gridded(spark, d):
    return packets(spark, d).withColumn("dur", F.when(F.col("track") % 2 == 0, F.lit(GRID).cast("long")).otherwise(F.col("dur")))


@query("packet_positions", f"WITH {PACKETS_SQL} SELECT track, seq, dur, pts FROM packets")
def packet_positions(spark, d):
    return plan.with_pts(packets(spark, d), _KEY).select("track", "seq", "dur", "pts")


@query(
    "packet_grid",
    f"""WITH {_GRIDDED_SQL}, l AS (SELECT *, max(seq) OVER (PARTITION BY track) AS last FROM packets)
SELECT track, CASE WHEN count(*) > 1 AND count(DISTINCT dur) FILTER (seq < last) = 1 AND min(dur) FILTER (seq < last) > 0 THEN min(dur) FILTER (seq < last) ELSE 0 END AS grid FROM l GROUP BY track""",
)
def packet_grid(spark, d):
    """The common duration of each track's packets; every other track has packets of 8."""
    return plan.packet_grid(_gridded(spark, d), _KEY)


_TRACKS_SQL = f"""
WITH {PACKETS_SQL}, tracks AS (
  SELECT track, sum(dur)::BIGINT AS decoded, track % 5 AS delay, track % 3 AS padding, CASE WHEN track % 4 = 0 THEN -1 ELSE sum(dur)::BIGINT - track % 5 - track % 3 END AS samples,
         CASE track % 3 WHEN 0 THEN 'opus' WHEN 1 THEN 'flac' ELSE 'pcm' END AS codec FROM packets GROUP BY track)"""


def _tracks(spark, d, rows=packets):
    decoded = rows(spark, d).groupBy("track").agg(F.sum("dur").alias("decoded"))
    t = F.col("track")
    return decoded.select(
        "track",
        "decoded",
        (t % 5).alias("delay"),
        (t % 3).alias("padding"),
        F.when(t % 4 == 0, F.lit(-1).cast("long")).otherwise(F.col("decoded") - t % 5 - t % 3).alias("samples"),
        F.when(t % 3 == 0, "opus").when(t % 3 == 1, "flac").otherwise("pcm").alias("codec"),
    )


@query(
    "remux_trailer",
    _TRACKS_SQL
    + """, odd AS (SELECT track, decoded, delay, padding * 40 AS padding, CASE WHEN track % 7 = 0 THEN decoded + 50 ELSE samples END AS samples FROM tracks)
SELECT track, CASE WHEN samples < 0 THEN greatest(0, decoded - delay - padding) ELSE samples END AS samples,
       CASE WHEN samples < 0 THEN padding WHEN delay > 0 THEN greatest(0, decoded - delay - samples) ELSE padding END AS padding FROM odd""",
)
def remux_trailer(spark, d):
    """Lengths and paddings to declare, of tracks that state more samples or trims than they have, too."""
    samples = F.when(F.col("track") % 7 == 0, F.col("decoded") + 50).otherwise(F.col("samples"))
    samples, padding = plan.remux_trailer(F.col("decoded"), samples, F.col("delay"), F.col("padding") * 40)
    return _tracks(spark, d).select("track", samples.alias("samples"), padding.alias("padding"))


@query(
    "remux_eligibility",
    _TRACKS_SQL
    + """ SELECT track, CASE WHEN codec <> 'opus' AND track % 2 = 0 THEN 'codec differs' WHEN codec = 'pcm' THEN 'pcm is re-encoded' WHEN track % 7 = 0 THEN 'samples change'
  WHEN (delay > 0 OR padding > 0) AND codec IN ('flac', 'alac') THEN 'trims do not survive' END AS reason FROM tracks""",
)
def remux_eligibility(spark, d):
    target = F.when(F.col("track") % 2 == 0, "opus").otherwise(F.col("codec"))
    reason = plan.remux_reason(F.col("codec"), target, F.col("track") % 7 == 0, F.col("delay"), F.col("padding"))
    return _tracks(spark, d).select("track", reason.alias("reason"))


_SPANS_SQL = _TRACKS_SQL.replace(PACKETS_SQL, _GRIDDED_SQL) + f""", spans AS (
  SELECT track, delay, padding, samples, 0 AS idx, decoded // 8 AS f, decoded // 4 AS t FROM tracks
  UNION ALL SELECT track, delay, padding, samples, 1, CASE WHEN track % 11 = 0 THEN decoded // 6 ELSE decoded // 2 END, CASE WHEN track % 3 = 0 THEN decoded // 2 + decoded // 3 ELSE -1 END FROM tracks
), bounds AS (
  SELECT *, f + delay AS df, CASE WHEN t <> -1 THEN t + delay WHEN samples >= 0 THEN delay + samples ELSE -1 END AS dt,
         greatest((f + delay - {PREROLL}) // {GRID} * {GRID}, 0) AS sd,
         CASE WHEN t <> -1 THEN (t + delay + {GRID - 1}) // {GRID} * {GRID} WHEN samples >= 0 THEN delay + samples + padding ELSE -1 END AS snapped,
         idx = 1 AND t <> -1 AND samples >= 0 AS bounded FROM spans
), cut AS (
  SELECT *, CASE WHEN bounded THEN least(snapped, delay + samples + padding) ELSE snapped END AS su, bounded AND snapped > delay + samples + padding AS clamped FROM bounds
), judged AS (
  SELECT *, idx = 1 AND (t = -1 OR clamped) AS open,
         CASE WHEN t <> -1 AND t <= f THEN 'invalid-request' WHEN t = -1 AND samples >= 0 AND f = samples THEN 'invalid-request'
              WHEN samples >= 0 AND (f > samples OR t > samples) THEN 'invalid-request' WHEN idx = 1 AND f < lag(t) OVER w THEN 'invalid-request'
              WHEN lead(sd) OVER w < su THEN 'unsupported-format' WHEN clamped AND first(df - sd) OVER w = 0 THEN 'unsupported-format' END AS error
  FROM cut WINDOW w AS (PARTITION BY track ORDER BY idx)
), refused AS (
  SELECT track, CASE WHEN bool_or(error = 'invalid-request') THEN 'invalid-request' ELSE max(error) END AS error FROM judged GROUP BY track)"""


def _cut(spark, d):
    tracks, decoded, t = _tracks(spark, d, _gridded), F.col("decoded"), F.col("track")
    first = tracks.withColumns({"idx": F.lit(0), "from_sample": div(decoded, 8), "to_sample": div(decoded, 4)})
    stop = F.when(t % 3 == 0, div(decoded, 2) + div(decoded, 3)).otherwise(F.lit(-1).cast("long"))
    second = tracks.withColumns({"idx": F.lit(1), "from_sample": F.when(t % 11 == 0, div(decoded, 6)).otherwise(div(decoded, 2)), "to_sample": stop})
    return plan.cut_spans(first.unionByName(second).withColumn("grid", F.lit(GRID).cast("long")), _KEY, PREROLL)


@query("cut_windows", _SPANS_SQL + " SELECT track, idx, df, dt, sd, su, open, error FROM judged")
def cut_windows(spark, d):
    """Packet windows of two spans per track, with what forbids them."""
    return _cut(spark, d).select("track", "idx", "df", "dt", "sd", "su", "open", F.col("error.code").alias("error"))


@query(
    "cut_trailer",
    _SPANS_SQL
    + """, r AS (SELECT track, min_by(df - sd, idx) AS delay, max_by(CASE WHEN su < 0 THEN padding ELSE su - dt END, idx) AS padding, sum(su - sd)::BIGINT AS kept, bool_or(su < 0) AS unknown FROM judged GROUP BY track)
SELECT track, CASE WHEN error IS NULL THEN delay END AS delay, CASE WHEN error IS NULL THEN padding END AS padding,
       CASE WHEN error IS NULL THEN CASE WHEN unknown THEN -1 ELSE kept - delay - padding END END AS samples, error FROM r JOIN refused USING (track)""",
)
def cut_trailer(spark, d):
    return plan.cut_result(_cut(spark, d), _KEY)


@query(
    "cut_packets",
    _SPANS_SQL
    + """, inside AS (SELECT j.track, j.idx, p.seq, p.dur, p.pts < sd OR (NOT open AND p.pts + p.dur > su) AS across FROM judged j JOIN packets p ON p.track = j.track AND (open OR p.pts < su) AND p.pts + p.dur > sd),
stop AS (SELECT track, coalesce(error, CASE WHEN track IN (SELECT track FROM inside WHERE across) THEN 'unsupported-format' END) AS error FROM refused)
SELECT track, idx, seq, dur, coalesce(sum(dur) OVER (PARTITION BY track ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS new_pts, error FROM inside JOIN stop USING (track) WHERE error IS NULL
UNION ALL SELECT track, NULL, NULL, NULL, NULL, error FROM stop WHERE error IS NOT NULL""",
)
def cut_packets(spark, d):
    """The packets inside the windows, retimed; tracks with a packet across an edge, or a span that cannot be cut, are refused."""
    return plan.cut_packets(plan.with_pts(_gridded(spark, d), _KEY), _cut(spark, d), _KEY)


@query(
    "seek_sync",
    f"""WITH {PACKETS_SQL}, t AS (SELECT track, sum(dur)::BIGINT // 2 AS target FROM packets GROUP BY track)
SELECT t.track, t.target, max(s.pts) AS start FROM t JOIN synced s ON s.track = t.track AND s.sync AND s.pts <= t.target GROUP BY 1, 2""",
)
def seek_sync(spark, d):
    """The sync packet to start decoding from for the middle of each track."""
    rows = plan.with_pts(packets(spark, d), _KEY)
    targets = rows.groupBy("track").agg(div(F.sum("dur"), 2).alias("target"))
    return plan.seek_packets(rows, targets, _KEY)


_SEGMENTS_SQL = _TRACKS_SQL + """, planned AS (
  SELECT track, delay, decoded - delay AS samples, CASE WHEN delay = 0 THEN decoded - delay ELSE (decoded - delay + delay + 9) // 10 * 10 END AS total, 10 AS frame,
         greatest(CAST(floor(0.5 * 50 / 10 + 0.5) AS BIGINT), 1) * 10 AS segment FROM tracks
), segs AS (SELECT *, unnest(range(0, (total + segment - 1) // segment)) AS nth FROM planned)"""


def _segments(spark, d):
    t = _tracks(spark, d).select("track", "delay", (F.col("decoded") - F.col("delay")).alias("samples"))
    t = t.withColumn("total", plan.total_decode_samples(F.col("samples"), F.col("delay"), F.lit(10).cast("long")))
    return plan.segments(t.withColumn("segment", plan.snap_segment(0.5, F.lit(50), F.lit(10).cast("long"))))


@query(
    "segment_plan",
    _SEGMENTS_SQL
    + """ SELECT track, nth, least((nth + 1) * segment, total) - nth * segment AS decode_samples,
  greatest(least(least((nth + 1) * segment, total), delay + samples) - greatest(nth * segment, delay), 0) AS shown_samples FROM segs""",
)
def segment_plan(spark, d):
    return _segments(spark, d).select("track", "nth", "decode_samples", "shown_samples")


@query("segment_conservation", _TRACKS_SQL + " SELECT track, greatest(decoded - delay, 0) AS shown FROM tracks")
def segment_conservation(spark, d):
    """Presentation durations add up to the declared samples."""
    return _segments(spark, d).groupBy("track").agg(F.sum("shown_samples").alias("shown"))


@query(
    "peak_bandwidth",
    _TRACKS_SQL + " SELECT track, CASE WHEN track % 6 = 0 THEN 48000 * 2 * greatest(track % 2 * 24, 16) ELSE decoded * 8 END + 48000 // (track % 4 * 120 + 120) * 64 + 2000 AS bandwidth FROM tracks",
)
def peak_bandwidth(spark, d):
    """Declared rates, of tracks without a coded rate too; some frames do not divide the rate."""
    t = F.col("track")
    rate = F.when(t % 6 == 0, F.lit(0).cast("long")).otherwise(F.col("decoded") * 8)
    return _tracks(spark, d).select("track", plan.peak_bandwidth(rate, F.lit(48000), t % 4 * 120 + 120, F.lit(2), t % 2 * 24).alias("bandwidth"))
