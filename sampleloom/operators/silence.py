"""Silence map: maximal runs of frames whose peak lies below a threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.operators.samples import frame_peaks

VERSION = "silence-1"


def quiet_runs(chunks: DataFrame, threshold_db: float, keys: tuple[str, ...] = ("source_id", "track_id")) -> DataFrame:
    """keys, from_sample, to_sample of every maximal quiet run.

    A chunk is first reduced to its own runs (array work inside the row), so
    only run borders are ordered per track.  Runs that meet at a chunk border
    become one.
    """
    threshold = F.lit(10 ** (threshold_db / 20)).cast("float")
    flags = chunks.select(*keys, "pos", F.transform(frame_peaks(F.col("pcm")), lambda p: p < threshold).alias("q"))
    at = F.sequence(F.lit(0), F.size("q") - 1)
    before = lambda i: F.coalesce(F.get("q", i - 1), F.lit(False))
    after = lambda i: F.coalesce(F.get("q", i + 1), F.lit(False))
    begins = F.filter(at, lambda i: F.get("q", i) & ~before(i))
    ends = F.filter(at, lambda i: F.get("q", i) & ~after(i))
    runs = flags.where(F.size("q") > 0).select(*keys, "pos", F.explode(F.arrays_zip(begins.alias("b"), ends.alias("e"))).alias("r"))
    runs = runs.select(*keys, (F.col("pos") + F.col("r.b")).alias("f"), (F.col("pos") + F.col("r.e") + 1).alias("t"))
    order = Window.partitionBy(*keys).orderBy("f")
    fresh = F.coalesce(F.lag("t").over(order) < F.col("f"), F.lit(True)).cast("int")
    marked = runs.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island").agg(F.min("f").alias("from_sample"), F.max("t").alias("to_sample")).drop("island")


def silence_spans(chunks: DataFrame, threshold_db: float = -50.0, min_frames: int = 22050, keys: tuple[str, ...] = ("source_id", "track_id")) -> DataFrame:
    runs = quiet_runs(chunks, threshold_db, keys)
    return runs.where(F.col("to_sample") - F.col("from_sample") >= min_frames)


def silence_totals(chunks: DataFrame, threshold_db: float = -50.0, min_frames: int = 22050, keys: tuple[str, ...] = ("source_id", "track_id")) -> DataFrame:
    """Per track: spans kept and their frames, runs dropped and their frames."""
    length = F.col("to_sample") - F.col("from_sample")
    kept = length >= min_frames
    zero = F.lit(0).cast("long")
    return quiet_runs(chunks, threshold_db, keys).groupBy(*keys).agg(
        F.count_if(kept).alias("spans"),
        F.coalesce(F.sum(F.when(kept, length)), zero).alias("total_samples"),
        F.count_if(~kept).alias("dropped"),
        F.coalesce(F.sum(F.when(~kept, length)), zero).alias("dropped_samples"),
    )
