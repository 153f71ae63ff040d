"""Concatenation, crossfades, slices, splits and chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sampleloom.core.positions import div, floor_div, output_length, sample_time_ns
from sampleloom.operators import samples
from sampleloom.plans import timeline
from sampleloom.queries.tables import CHAPTERS_SQL, CHUNKS_SQL, MEMBERS_SQL, chapters, chunks, members
from sampleloom.registry import query

CROSSFADE = 1000
_KEY = ["timeline"]

_PLACED_SQL = f"""
WITH {MEMBERS_SQL}, placed AS (
  SELECT *, coalesce(sum(len - {CROSSFADE}) OVER (PARTITION BY timeline ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM members
), totals AS (SELECT timeline, count(*) AS members, (sum(len) - (count(*) - 1) * {CROSSFADE})::BIGINT AS total FROM members GROUP BY timeline)"""


def _placed(spark, d):
    return timeline.boundaries(members(spark, d), _KEY, CROSSFADE)


def _totals(spark, d):
    return timeline.concat_track(members(spark, d), _KEY, CROSSFADE)


@query("concat_boundaries", _PLACED_SQL + ' SELECT timeline, idx, "offset", len FROM placed')
def concat_boundaries(spark, d):
    return _placed(spark, d).select("timeline", "idx", "offset", "len")


@query("concat_track", _PLACED_SQL + " SELECT timeline, members, total, NULL::VARCHAR AS error FROM totals")
def concat_track(spark, d):
    return _totals(spark, d).select("timeline", "members", "total", F.col("error.code").alias("error"))


@query(
    "concat_seek",
    _PLACED_SQL
    + """, t AS (SELECT timeline, total // 2 AS target FROM totals)
SELECT t.timeline, t.target, max_by(p.idx, p."offset") AS idx, t.target - max(p."offset") AS within FROM t JOIN placed p ON p.timeline = t.timeline AND p."offset" <= t.target GROUP BY 1, 2""",
)
def concat_seek(spark, d):
    """The member that plays in the middle of each timeline: an as-of lookup."""
    targets = _totals(spark, d).select("timeline", div(F.col("total"), 2).alias("target"))
    return timeline.member_at(_placed(spark, d), targets, _KEY)


_CUTS_SQL = _PLACED_SQL + """, pieces AS (
  SELECT timeline, 1 AS piece, 0 AS from_sample, total // 3 AS to_sample FROM totals
  UNION ALL SELECT timeline, 2, total // 3, 2 * total // 3 FROM totals UNION ALL SELECT timeline, 3, 2 * total // 3, -1 FROM totals)"""


def _pieces(spark, d):
    totals = _totals(spark, d)
    cuts = totals.select("timeline", F.explode(F.array(div(F.col("total"), 3), div(2 * F.col("total"), 3))).alias("cut"))
    return timeline.split_spans(cuts, _KEY)


@query("split_spans", _CUTS_SQL + " SELECT timeline, piece, from_sample, to_sample FROM pieces")
def split_spans(spark, d):
    return _pieces(spark, d)


@query(
    "split_members",
    _CUTS_SQL
    + """ SELECT p.timeline, piece, idx, greatest(from_sample, "offset") AS lo, least(CASE WHEN to_sample < 0 THEN 4611686018427387904 ELSE to_sample END, "offset" + len) AS hi
FROM pieces p JOIN placed m ON m.timeline = p.timeline AND m."offset" < CASE WHEN to_sample < 0 THEN 4611686018427387904 ELSE to_sample END AND m."offset" + len > from_sample""",
)
def split_members(spark, d):
    """Which members each piece of a split takes samples from."""
    return timeline.overlap_join(_pieces(spark, d), _placed(spark, d), _KEY).select("timeline", "piece", "idx", "lo", "hi")


@query(
    "timeline_clock",
    f"""{_PLACED_SQL} SELECT timeline, idx, ("offset" // 44100) * 1000000000 + ("offset" % 44100) * 1000000000 // 44100 AS start_ns, (len * 160 + 146) // 147 AS resampled,
  (len // 4096) * 4096 AS grid_floor, -((-len) // 4096 - (CASE WHEN len % 4096 = 0 THEN 0 ELSE 1 END)) AS grid_steps FROM placed""",
)
def timeline_clock(spark, d):
    """Clock time of each member's start, its length at 48 kHz, and its place on a grid."""
    from sampleloom.core.positions import ceil_div, floor_to

    return _placed(spark, d).select(
        "timeline",
        "idx",
        sample_time_ns(F.col("offset"), 44100).alias("start_ns"),
        output_length(F.col("len"), 44100, 48000).alias("resampled"),
        floor_to(F.col("len"), 4096).alias("grid_floor"),
        ceil_div(F.col("len"), 4096).alias("grid_steps"),
    )


@query(
    "slice_rebase",
    f"WITH {CHUNKS_SQL} SELECT track, min(pos - 100) AS first, max(pos - 100) AS last, count(*) AS n, sum(CAST(round(v::DOUBLE * 1e9) AS BIGINT) * ((pos - 100) % 97 + 1))::BIGINT AS mark FROM samples WHERE pos >= 100 AND pos < 1000 GROUP BY track",
)
def slice_rebase(spark, d):
    """Samples [100, 1000) of each track, rebased to 0."""
    rows = timeline.slice_rows(chunks(spark, d), 100, 1000)
    x = F.get("pcm", F.lit(0))
    mark = F.aggregate(F.transform(x, lambda v, i: F.round(v.cast("double") * 1e9).cast("long") * ((F.col("pos") + i) % 97 + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return rows.groupBy("track").agg(F.min("pos").alias("first"), F.max(F.col("pos") + F.col("n") - 1).alias("last"), F.sum("n").alias("n"), F.sum(mark).alias("mark"))


@query(
    "gapless_trim",
    f"WITH {CHUNKS_SQL} SELECT track, count(*) AS n, max(abs(v))::DOUBLE AS peak FROM samples WHERE pos >= 64 + 5 AND pos < 64 + 5 + 777 GROUP BY track",
)
def gapless_trim(spark, d):
    rows = timeline.gapless(chunks(spark, d), 69, 777)
    return rows.groupBy("track").agg(F.sum("n").alias("n"), F.max(F.array_max(samples.frame_peaks(F.col("pcm")))).cast("double").alias("peak"))


@query(
    "crossfade_blend",
    f"""WITH {CHUNKS_SQL}, z AS (
  SELECT a.track, a.vec_id, unnest(a.embedding) AS x, unnest(b.embedding) AS y, generate_subscripts(a.embedding, 1) - 1 AS k FROM chunks a JOIN chunks b ON b.track = a.track AND b.pos = a.pos + 64)
SELECT track, vec_id, sum(CAST(round(CAST(x::DOUBLE * cos(k * (pi() / 2 / 64)) + y::DOUBLE * sin(k * (pi() / 2 / 64)) AS REAL)::DOUBLE * 1e5) AS BIGINT))::BIGINT AS mark FROM z GROUP BY 1, 2""",
)
def crossfade_blend(spark, d):
    """Equal-power blend of each chunk into the next of its track."""
    rows = chunks(spark, d).select("track", "vec_id", "pos", F.get("pcm", F.lit(0)).alias("x"))
    head = rows.select("track", (F.col("pos") - 64).alias("pos"), F.col("x").alias("y"))
    both = rows.join(head, ["track", "pos"]).select("track", "vec_id", timeline.blend(F.col("x"), F.col("y"), 64).alias("b"))
    return both.select("track", "vec_id", F.aggregate("b", F.lit(0).cast("long"), lambda a, v: a + F.round(v.cast("double") * 1e5).cast("long")).alias("mark"))


@query(
    "chapter_rebase",
    f"""WITH {CHAPTERS_SQL}, w AS (SELECT conv_id, CAST(max(start_ns) // 4 // 1000000 AS BIGINT) AS f, CAST(max(start_ns) // 2 // 1000000 AS BIGINT) AS n FROM chapters GROUP BY conv_id),
r AS (SELECT c.conv_id, idx, start_ns, end_ns, f * 1000000 AS a, (f + n) * 1000000 AS b,
  CASE WHEN end_ns > 0 THEN end_ns ELSE coalesce(lead(start_ns) OVER (PARTITION BY c.conv_id ORDER BY idx), -1) END AS e FROM chapters c JOIN w ON w.conv_id = c.conv_id)
SELECT conv_id, idx, greatest(start_ns - a, 0) AS start_ns, CASE WHEN end_ns > 0 THEN least(end_ns, b) - a ELSE 0 END AS end_ns FROM r WHERE start_ns < b AND (e < 0 OR e > a)""",
)
def chapter_rebase(spark, d):
    """Chapters of the second quarter of each conversation and the half after it, at 1 kHz."""
    rows = chapters(spark, d)
    to_ms = lambda c: floor_div(c, 1_000_000)
    window = rows.groupBy("conv_id").agg(F.max("start_ns").alias("m")).select("conv_id", to_ms(div(F.col("m"), 4)).alias("f"), to_ms(div(F.col("m"), 2)).alias("k"))
    return timeline.rebase_chapters(rows.join(window, "conv_id"), ["conv_id"], F.col("f"), F.col("k"), F.lit(1000)).select("conv_id", "idx", "start_ns", "end_ns")


@query(
    "cue_positions",
    "SELECT o_orderkey AS id, (o_orderkey % 80) * 60 * 75 + (o_orderkey % 60) * 75 + o_orderkey % 75 AS frames, ((o_orderkey % 80) * 60 * 75 + (o_orderkey % 60) * 75 + o_orderkey % 75) * 588 AS samples, round(o_totalprice / 1000 * 44.1)::BIGINT AS fade FROM orders",
)
def cue_positions(spark, d):
    """MM:SS:FF texts parsed to frames and samples; crossfade seconds to samples."""
    from sampleloom.functions.cue import parse_time

    rows = spark.read.parquet(f"{d}/orders.parquet")
    text = F.format_string("%02d:%02d:%02d", F.col("o_orderkey") % 80, F.col("o_orderkey") % 60, F.col("o_orderkey") % 75)
    frames = parse_time(text)
    return rows.select(F.col("o_orderkey").alias("id"), frames.alias("frames"), timeline.cue_samples(frames, F.lit(44100)).alias("samples"), timeline.crossfade_samples(F.col("o_totalprice") / 1000, F.lit(44.1)).alias("fade"))
