"""Kernels over segments and files built from the driver's tables. They have no SQL form; the tests compare with numpy."""

from __future__ import annotations

from pyspark.sql import functions as F

from sampleloom.operators import filters
from sampleloom.queries.tables import chunks
from sampleloom.registry import query
from sampleloom.sources import media

_RATE = 8000


@query("measure_tracks")
def measure_tracks(spark, d):
    """K-weighted loudness, its range, true and sample peak of every track, at a pretended 320 Hz to have windows enough."""
    out = filters.measure(chunks(spark, d), 320, keys=("track",))
    return out.select("track", *[F.round(c, 6).alias(c) for c in ("lufs", "lra", "true_peak_db", "sample_peak_db")])


@query("resample_tracks")
def resample_tracks(spark, d):
    """8 kHz to 11.025 kHz: frames and peak of every track."""
    out = filters.resample(chunks(spark, d), 8000, 11025, "fast", keys=("track",))
    return out.groupBy("track").agg(F.sum("n").alias("frames"), F.round(F.max(F.array_max(F.get("pcm", F.lit(0)))), 6).alias("peak"))


@query("file_round_trip")
def file_round_trip(spark, d):
    """Tracks encoded as FLAC files, then probed and decoded again."""
    rows = chunks(spark, d).select(F.col("track").cast("string").alias("source_id"), F.lit(0).alias("track_id"), "pos", "pcm")
    files = media.encode_files(rows, _RATE, "flac").select("source_id", F.lit("flac").alias("ext"), F.col("data").alias("content"))
    decoded = media.decode_chunks(files).groupBy("source_id").agg(F.sum("n").alias("frames"), F.round(F.max(F.array_max(F.transform(F.get("pcm", F.lit(0)), F.abs))), 6).alias("peak"))
    return media.probe(files).select("source_id", "container", "codec", "rate", "bit_depth", "samples").join(decoded, "source_id")
