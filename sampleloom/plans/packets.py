"""Planning on packet metadata alone: grids, remuxing, cutting, segmenting. No sample is decoded.

``packets`` has the track's keys, ``seq``, ``dur`` and (where seeking matters) ``sync``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.core.errors import error
from sampleloom.core.positions import ceil_div, ceil_to, div, floor_to

#: Codecs whose packets may be moved, and the samples decoded before a cut point.
PREROLL = {"opus": 3840, "aac-lc": 1024, "he-aac": 24576}
LOSSLESS_UNTRIMMED = ("flac", "alac")
MAX_CUT_SAMPLE = 1 << 61
DEFAULT_SEGMENT_SECONDS, MAX_SEGMENT_SECONDS = 4.0, 60.0


def with_pts(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``pts``: the running sum of durations."""
    before = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return packets.withColumn("pts", F.coalesce(F.sum("dur").over(before), F.lit(0).cast("long")))


def packet_grid(packets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, grid: the duration common to all packets but the last, else 0; a single packet has no grid."""
    last = F.max("seq").over(Window.partitionBy(*keys))
    inner = F.when(F.col("seq") < F.col("__last"), F.col("dur"))
    out = packets.withColumn("__last", last).groupBy(*keys).agg(F.min(inner).alias("lo"), F.max(inner).alias("hi"))
    return out.select(*keys, F.when((F.col("lo") == F.col("hi")) & (F.col("lo") > 0), F.col("lo")).otherwise(F.lit(0).cast("long")).alias("grid"))


def remux_reason(codec: Column, target_codec: Column, changes_samples: Column, delay: Column, padding: Column) -> Column:
    """Null if packets can be copied as they are, else why not."""
    trimmed = (delay > 0) | (padding > 0)
    return (
        F.when(codec != target_codec, "codec differs")
        .when(codec == "pcm", "pcm is re-encoded")
        .when(changes_samples, "samples change")
        .when(trimmed & codec.isin(*LOSSLESS_UNTRIMMED), "trims do not survive")
    )


def remux_trailer(decoded: Column, samples: Column, delay: Column, padding: Column) -> tuple[Column, Column]:
    """samples and padding to declare, neither below 0: an unknown length (-1) follows from the trims, else a delay fixes the padding."""
    zero = F.lit(0).cast("long")
    length = F.when(samples < 0, F.greatest(decoded - delay - padding, zero)).otherwise(samples)
    return length, F.when((samples >= 0) & (delay > 0), F.greatest(decoded - delay - samples, zero)).otherwise(padding)


def cut_spans(spans: DataFrame, keys: list[str], preroll: int) -> DataFrame:
    """The packet windows of cut spans.

    ``spans`` has keys, idx, from_sample, to_sample (-1: to the end), grid,
    delay, samples (-1: unknown) and padding.  Adds the sample bounds on the decoded
    timeline (df, dt), the packet bounds (sd, su; -1 where the end is unknown), whether
    the window is open at its end, and an error for spans that cannot be cut:
    invalid-request where no other way could serve them, unsupported-format
    where they need decoding.
    """
    order = Window.partitionBy(*keys).orderBy("idx")
    start, stop, samples = F.col("from_sample"), F.col("to_sample"), F.col("samples")
    to_end, known, last = stop == -1, samples >= 0, F.lead("idx").over(order).isNull()
    grid, end = F.greatest(F.col("grid"), F.lit(1)), F.col("delay") + samples + F.col("padding")
    rows = spans.withColumns({"df": start + F.col("delay"), "last": last, "after": F.lag("to_sample").over(order)})
    rows = rows.withColumn("dt", F.when(~to_end, stop + F.col("delay")).when(known, F.col("delay") + samples).otherwise(F.lit(-1).cast("long")))
    rows = rows.withColumn("sd", F.greatest(floor_to(F.col("df") - preroll, grid), F.lit(0).cast("long")))
    rows = rows.withColumn("su", F.when(~to_end, ceil_to(F.col("dt"), grid)).when(known, end).otherwise(F.lit(-1).cast("long")))
    rows = rows.withColumn("clamped", F.col("last") & ~to_end & known & (F.col("su") > end)).withColumn("su", F.when(F.col("clamped"), end).otherwise(F.col("su")))
    lead = F.first(F.col("df") - F.col("sd")).over(order)
    problem = (
        F.when((start < 0) | (stop < -1), error("invalid-request", "negative span"))
        .when(to_end & ~F.col("last"), error("invalid-request", "a span to the end is not the last"))
        .when((start >= MAX_CUT_SAMPLE) | (stop >= MAX_CUT_SAMPLE), error("invalid-request", "span off the timeline"))
        .when((~to_end & (stop <= start)) | (to_end & known & (start == samples)), error("invalid-request", "empty span"))
        .when(known & ((start > samples) | (stop > samples)), error("invalid-request", "span past the end"))
        .when(start < F.col("after"), error("invalid-request", "spans out of order"))
        .when(F.col("grid") <= 0, error("unsupported-format", "packet durations vary"))
        .when((F.col("delay") < 0) | (F.col("delay") >= MAX_CUT_SAMPLE) | (F.col("grid") >= MAX_CUT_SAMPLE), error("unsupported-format", "trims off the timeline"))
        .when(F.lead("sd").over(order) < F.col("su"), error("unsupported-format", "spans share packets"))
        .when(F.col("clamped") & (lead == 0), error("unsupported-format", "the last packet's length is not known"))
    )
    return rows.withColumn("open", F.col("last") & (to_end | F.col("clamped"))).withColumn("error", problem).drop("last", "after", "clamped")


def _refusal() -> Column:
    """The error of a track: that of the first span with an invalid request, or else of the first that needs decoding."""
    return F.min_by("error", F.when(F.col("error").isNotNull(), F.struct(F.col("error.code") != "invalid-request", "idx")))


def cut_result(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, delay, padding, samples to declare for the kept packets, or an error."""
    first = F.min_by(F.col("df") - F.col("sd"), "idx")
    unknown = F.col("su") < 0
    last = F.max_by(F.when(unknown, F.col("padding")).otherwise(F.col("su") - F.col("dt")), "idx")
    out = spans.groupBy(*keys).agg(
        first.alias("new_delay"), last.alias("new_padding"), F.sum(F.col("su") - F.col("sd")).alias("kept"), F.max(unknown).alias("unknown"), _refusal().alias("error")
    )
    fine = F.col("error").isNull()
    length = F.when(F.col("unknown"), F.lit(-1).cast("long")).otherwise(F.col("kept") - F.col("new_delay") - F.col("new_padding"))
    return out.select(
        *keys,
        F.when(fine, F.col("new_delay")).alias("delay"),
        F.when(fine, F.col("new_padding")).alias("padding"),
        F.when(fine, length).alias("samples"),
        F.col("error.code").alias("error"),
    )


def cut_packets(packets: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, idx, seq, dur, new_pts of the packets inside the windows that ``cut_spans`` gives, or keys and error of a track that cannot be cut.

    A packet across a window's edge refuses the cut of its track, as the windows'
    own errors do.  Windows are disjoint, so a packet's window is the last that
    starts before the packet ends: one pass over both in order.
    """
    bound = F.struct("idx", "sd", "su", "open")
    starts = windows.where("error IS NULL").select(*keys, F.col("sd").alias("at"), F.lit(1).alias("kind"), bound.alias("w"), *[F.lit(None).cast("long").alias(c) for c in ("seq", "dur", "pts")])
    ends = packets.select(*keys, (F.col("pts") + F.col("dur")).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(starts.schema["w"].dataType).alias("w"), "seq", "dur", "pts")
    so_far = Window.partitionBy(*keys).orderBy("at", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = starts.unionByName(ends).withColumn("w", F.last("w", ignorenulls=True).over(so_far)).where("kind = 0 AND w IS NOT NULL")
    kept = placed.where(F.col("w.open") | (F.col("pts") < F.col("w.su"))).withColumn("end", F.col("pts") + F.col("dur"))
    across = (F.col("pts") < F.col("w.sd")) | (~F.col("w.open") & (F.col("end") > F.col("w.su")))
    refused = windows.groupBy(*keys).agg(_refusal().getField("code").alias("error")).where("error IS NOT NULL")
    across = kept.where(across).select(*keys).distinct().join(refused, keys, "left_anti").withColumn("error", F.lit("unsupported-format"))
    refused = refused.unionByName(across)
    before = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.join(refused.select(*keys), keys, "left_anti").withColumn("new_pts", F.coalesce(F.sum("dur").over(before), F.lit(0).cast("long")))
    return kept.select(*keys, "w.idx", "seq", "dur", "new_pts", F.lit(None).cast("string").alias("error")).unionByName(refused, allowMissingColumns=True)


def seek_packets(packets: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, target, start: the position of the last sync packet at or before the target, in one pass over both in order."""
    marks = packets.where("sync").select(*keys, F.col("pts").alias("at"), F.lit(0).alias("kind"), F.col("pts").alias("start"))
    asked = targets.select(*keys, F.col("target").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("start"))
    so_far = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(asked).withColumn("start", F.last("start", ignorenulls=True).over(so_far))
    return found.where("kind = 1 AND start IS NOT NULL").select(*keys, F.col("at").alias("target"), "start")


def snap_segment(seconds: float, rate: Column, grid: Column) -> Column:
    """Samples of a segment: the nearest whole number of grid steps, one at least."""
    seconds = seconds or DEFAULT_SEGMENT_SECONDS
    if not 0 < seconds <= MAX_SEGMENT_SECONDS:
        raise ValueError("segment duration out of range")
    return F.greatest(F.floor(F.lit(seconds) * rate / grid + 0.5).cast("long"), F.lit(1).cast("long")) * grid


def total_decode_samples(samples: Column, delay: Column, frame: Column) -> Column:
    return F.when(delay == 0, samples).otherwise(ceil_div(samples + delay, frame) * frame)


def segments(tracks: DataFrame) -> DataFrame:
    """A row per segment of tracks that have total, segment, delay and samples: decode and presentation durations.

    Presentation durations add up to ``samples``.
    """
    count = ceil_div(F.col("total"), F.col("segment"))
    rows = tracks.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    lo, hi = F.col("nth") * F.col("segment"), F.least((F.col("nth") + 1) * F.col("segment"), F.col("total"))
    shown = F.greatest(F.least(hi, F.col("delay") + F.col("samples")) - F.greatest(lo, F.col("delay")), F.lit(0).cast("long"))
    return rows.withColumns({"decode_samples": hi - lo, "shown_samples": shown})


def peak_bandwidth(bitrate: Column, rate: Column, frame: Column, channels: Column, bits: Column) -> Column:
    """Bits per second to declare: the coded rate (or that of the samples where none is declared), 64 bits of box overhead per whole frame a second, and a margin."""
    base = F.when(bitrate == 0, rate * channels * F.greatest(bits, F.lit(16))).otherwise(bitrate)
    return (base + div(rate, frame) * 64 + 2000).cast("long")


#: Fixed value: seconds of output before a segment that the encoder is fed with.
PRIME_SECONDS = 0.1


def prime_starts(p0: Column, rate: Column, frame: Column, horizon_s: Column, floor: Column) -> tuple[Column, Column]:
    """Where the chain and the encoder begin, so that a segment from ``p0`` has the samples and packets of a whole run.

    Whole frames; the chain's horizon comes in front of the encoder's window,
    and only the chain may begin below 0, down to ``floor``.
    """
    whole = lambda n: F.floor((n + frame - 1) / frame).cast("long") * frame
    encoder = whole(F.floor(rate * F.lit(PRIME_SECONDS)).cast("long"))
    chain = encoder + whole(F.floor(horizon_s * rate).cast("long"))
    lowest = F.when(floor < 0, -F.floor(-floor / frame)).otherwise(F.floor(floor / frame)).cast("long") * frame
    return F.greatest(lowest, p0 - chain), F.greatest(F.lit(0).cast("long"), p0 - encoder)
