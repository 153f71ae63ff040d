"""Timeline algebra on the metadata of members: concatenation, crossfades, slices, splits, chapters.

``members`` has the timeline's keys, ``idx`` (order), and ``len`` in samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.core.errors import error
from sampleloom.core.positions import div, sample_time_ns
from sampleloom.core.schemas import DEFAULT_LAYOUTS

MAX_MEMBERS = 1000
CROSSFADE_BYTES = 16 << 20
VERSION = "timeline-1"


def crossfade_samples(seconds: Column, rate: Column) -> Column:
    """Whole samples of a crossfade, rounded half away from zero."""
    return F.round(seconds * rate).cast("long")


def boundaries(members: DataFrame, keys: list[str], crossfade: int = 0) -> DataFrame:
    """Add ``offset`` of each member: neighbours overlap by ``crossfade`` samples."""
    before = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return members.withColumn("offset", F.coalesce(F.sum(F.col("len") - crossfade).over(before), F.lit(0).cast("long")))


def envelope(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rate, channels, bit_depth, sample_type, layout and an error or null: the format all members are brought to.

    The largest of each property; float (32 bits) if any member is.  The layout
    is the usual one for the channels: a member of as many channels must have
    it, since members are mixed up or down but not relabelled.
    """
    usual = F.create_map(*[F.lit(x) for pair in DEFAULT_LAYOUTS.items() for x in pair])
    layouts = F.collect_set(F.struct("channels", "layout"))
    out = tracks.groupBy(*keys).agg(
        F.max("rate").alias("rate"), F.max("channels").alias("channels"), F.max("bit_depth").alias("depth"), F.bool_or(F.col("sample_type") == "float").alias("float"),
        F.count_if(F.coalesce(F.col("samples"), F.lit(-1)) < 0).alias("open"), layouts.alias("layouts"),
    )
    out = out.withColumn("layout", usual[F.col("channels").cast("int")])
    other = F.exists("layouts", lambda f: (f["channels"] == F.col("channels")) & (f["layout"] != F.col("layout")))
    problem = F.when(F.col("open") > 0, error("invalid-request", "a member has no declared length")).when(other, error("unsupported-format", "speakers of a member are not the usual ones"))
    depth, kind = F.when(F.col("float"), 32).otherwise(F.col("depth")), F.when(F.col("float"), "float").otherwise("int")
    return out.select(*keys, "rate", "channels", depth.alias("bit_depth"), kind.alias("sample_type"), "layout", problem.alias("error"))


def concat_track(members: DataFrame, keys: list[str], crossfade: int = 0) -> DataFrame:
    """keys, members, total samples (sum of lengths less the overlaps) and an error or null.

    A member must hold the crossfades at both its ends, a crossfade must fit the
    blend buffer of two channels, and a timeline has at most MAX_MEMBERS.
    """
    at = Window.partitionBy(*keys)
    placed = members.withColumn("n", F.count(F.lit(1)).over(at)).withColumn("nth", F.row_number().over(at.orderBy("idx")))
    ends = (F.col("nth") > 1).cast("long") + (F.col("nth") < F.col("n")).cast("long")
    short = F.col("len") < ends * crossfade
    out = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), (F.sum("len") - (F.count(F.lit(1)) - 1) * crossfade).alias("total"), F.count_if(short).alias("short"))
    problem = (
        F.when(F.lit(crossfade > CROSSFADE_BYTES // 8), error("invalid-request", "crossfade exceeds the blend buffer"))
        .when(F.col("members") > MAX_MEMBERS, error("invalid-request", "too many members"))
        .when(F.col("short") > 0, error("invalid-request", "a member is shorter than its crossfades"))
    )
    return out.select(*keys, "members", "total", problem.alias("error"))


def member_at(members: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """targets with the member that is playing at ``target``: the last that starts at or before it (an as-of lookup).

    Both sides are one union ordered per timeline, so each row is seen once and
    nothing is compared pairwise.
    """
    starts = members.select(*keys, F.col("offset").alias("__at"), F.lit(0).alias("__kind"), F.struct("idx", "offset").alias("__m"), F.lit(None).cast("long").alias("target"))
    wanted = targets.select(*keys, F.col("target").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast("struct<idx:bigint,offset:bigint>").alias("__m"), "target")
    starts = starts.withColumn("__m", F.col("__m").cast("struct<idx:bigint,offset:bigint>"))
    order = Window.partitionBy(*keys).orderBy("__at", "__kind", "__m.idx").rowsBetween(Window.unboundedPreceding, 0)
    found = starts.unionByName(wanted).withColumn("__m", F.last("__m", ignorenulls=True).over(order)).where("__kind = 1")
    return found.select(*keys, "target", F.col("__m.idx").alias("idx"), (F.col("target") - F.col("__m.offset")).alias("within"))


def split_spans(cuts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, piece, from_sample, to_sample (-1: to the end) between the ``cut`` positions of each key; n cuts give n+1 pieces."""
    order = Window.partitionBy(*keys).orderBy("cut")
    ends = cuts.select(*keys, F.row_number().over(order).alias("piece"), F.coalesce(F.lag("cut").over(order), F.lit(0).cast("long")).alias("from_sample"), F.col("cut").alias("to_sample"))
    last = cuts.groupBy(*keys).agg((F.count(F.lit(1)) + 1).cast("int").alias("piece"), F.max("cut").alias("from_sample"), F.lit(-1).cast("long").alias("to_sample"))
    return ends.unionByName(last)


def overlap_join(spans: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Every (span, member) of the same key that share samples, with the shared range in the timeline; ``members`` has offset and len."""
    end = F.when(F.col("to_sample") < 0, F.lit((1 << 62))).otherwise(F.col("to_sample"))
    m_end = F.col("offset") + F.col("len")
    both = spans.join(members, keys).where((F.col("offset") < end) & (m_end > F.col("from_sample")))
    return both.withColumn("lo", F.greatest("from_sample", "offset")).withColumn("hi", F.least(end, m_end))


def slice_rows(chunks: DataFrame, start: int, stop: int = -1) -> DataFrame:
    """The samples of [start, stop) of every track, rebased to 0; chunks are cut where the range begins and ends."""
    n = F.col("n").cast("long")
    lo = F.greatest(F.lit(start) - F.col("pos"), F.lit(0))
    hi = F.when(F.lit(stop < 0), n).otherwise(F.least(F.lit(stop) - F.col("pos"), n))
    inside = (F.col("pos") + n > start) & (F.lit(stop < 0) | (F.col("pos") < stop))
    rows = chunks.where(inside).withColumns({"__lo": lo, "__take": hi - lo})
    rows = rows.withColumn("pcm", F.transform("pcm", lambda ch: F.slice(ch, (F.col("__lo") + 1).cast("int"), F.col("__take").cast("int"))))
    return rows.withColumns({"n": F.col("__take").cast("int"), "pos": F.col("pos") + F.col("__lo") - start}).drop("__lo", "__take")


def gapless(chunks: DataFrame, delay: int, samples: int) -> DataFrame:
    """The delivered timeline of a decoder's: without its delay, capped at the declared samples (-1: unknown)."""
    return slice_rows(chunks, delay, delay + samples if samples >= 0 else -1)


def rebase_chapters(chapters: DataFrame, keys: list[str], start: Column, limit: Column, rate: Column) -> DataFrame:
    """Chapters of the window of ``limit`` samples (negative: unbounded) from sample ``start``, on the window's clock.

    An end of 0 means: until the next chapter starts; it decides what is in the
    window but is not written into the result.
    """
    real_end = F.when(F.col("end_ns") > 0, F.col("end_ns")).otherwise(F.coalesce(F.lead("start_ns").over(Window.partitionBy(*keys).orderBy("idx")), F.lit(-1).cast("long")))
    rows = chapters.withColumns({"__real": real_end, "__from": sample_time_ns(start, rate), "__to": F.when(limit >= 0, sample_time_ns(start + limit, rate)).otherwise(F.lit(-1).cast("long"))})
    inside = ((F.col("__to") < 0) | (F.col("start_ns") < F.col("__to"))) & ((F.col("__real") < 0) | (F.col("__real") > F.col("__from")))
    end = F.when(F.col("end_ns") > 0, F.when(F.col("__to") >= 0, F.least("end_ns", "__to")).otherwise(F.col("end_ns")) - F.col("__from")).otherwise(F.lit(0).cast("long"))
    kept = rows.where(inside).withColumns({"end_ns": end, "start_ns": F.greatest(F.col("start_ns") - F.col("__from"), F.lit(0).cast("long"))})
    return kept.drop("__real", "__from", "__to")


def blend(tail: Column, head: Column, length: int) -> Column:
    """Equal-power crossfade of two arrays of ``length`` floats."""
    quarter = F.lit(3.141592653589793 / 2 / length)
    angles = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: k * quarter)
    faded = F.zip_with(tail, angles, lambda v, a: v.cast("double") * F.cos(a))
    risen = F.zip_with(head, angles, lambda v, a: v.cast("double") * F.sin(a))
    return F.zip_with(faded, risen, lambda a, b: (a + b).cast("float"))


def cue_samples(frames: Column, rate: Column) -> Column:
    """Samples of CD frames, 75 to a second."""
    return div(frames * rate, 75)
