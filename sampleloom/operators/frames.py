"""Recutting chunks into frames of one size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rechunk(chunks: DataFrame, size: int, keys: tuple[str, ...] = ("source_id", "track_id")) -> DataFrame:
    """Frames of ``size`` at multiples of it, the last shorter; a discontinuity starts a new grid.

    A chunk is cut at the borders it spans, the parts of a frame (few, and of
    bounded length) are put together.
    """
    splice = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = chunks.where("n > 0").withColumn("run", F.sum(F.col("discont").cast("int")).over(splice))
    rows = rows.withColumn("origin", F.when(F.col("run") > 0, F.min("pos").over(Window.partitionBy(*keys, "run"))).otherwise(F.lit(0).cast("long")))
    first = F.floor((F.col("pos") - F.col("origin")) / size)
    last = F.floor((F.col("pos") + F.col("n") - 1 - F.col("origin")) / size)
    parts = rows.withColumn("frame", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("origin") + F.col("frame") * size, F.col("pos"))
    hi = F.least(F.col("origin") + (F.col("frame") + 1) * size, F.col("pos") + F.col("n"))
    parts = parts.withColumn("part", F.transform("pcm", lambda ch: F.slice(ch, (lo - F.col("pos") + 1).cast("int"), (hi - lo).cast("int")))).withColumn("at", lo)
    whole = parts.groupBy(*keys, "run", "origin", "frame").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("p"))
    channels = F.sequence(F.lit(0), F.size(F.get("p", F.lit(0))["part"]) - 1)
    pcm = F.transform(channels, lambda c: F.flatten(F.transform("p", lambda x: F.get(x["part"], c))))
    out = whole.select(*keys, F.get("p", F.lit(0))["at"].alias("pos"), (F.col("run") > 0).alias("after_splice"), pcm.alias("pcm"))
    return out.withColumn("n", F.size(F.get("pcm", F.lit(0))))
