"""A finished playlist as one medium: its segments in order, placed end to end."""

from __future__ import annotations

import os
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleloom.plans import timeline
from sampleloom.sources import media
from sampleloom.streaming.live import parse_playlist

MAX_SEGMENTS = 100_000


def read_playlist(spark: SparkSession, path: str) -> DataFrame:
    """idx, uri (made absolute), seconds, discontinuity of a media playlist; a master playlist leads to its first variant."""
    text = spark.read.text(path, wholetext=True).first()[0]
    p = parse_playlist(text)
    if p.variants:
        return read_playlist(spark, posixpath.join(os.path.dirname(path), p.variants[0]["uri"]))
    if len(p.segments) > MAX_SEGMENTS:
        raise ValueError("playlist has too many segments")
    base = os.path.dirname(path)
    rows = [(k, uri if "://" in uri or uri.startswith("/") else posixpath.join(base, uri), s, d) for k, (uri, s, d) in enumerate(p.segments)]
    return spark.createDataFrame(rows, "idx bigint, uri string, seconds double, discontinuity boolean")


def open_vod(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of the whole playlist: each segment decoded on its own and moved behind those before it.

    A chunk that starts a segment marked as a discontinuity is marked, too.
    """
    segments = read_playlist(spark, path)
    uris = [r["uri"] for r in segments.select("uri").collect()]
    files = spark.read.format("binaryFile").load(uris)
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    sources = files.join(segments, plain(F.col("path")) == plain(F.col("uri"))).select(F.col("idx").cast("string").alias("source_id"), F.regexp_extract("uri", r"\.([^./]*)$", 1).alias("ext"), "content")
    chunks = media.decode_chunks(sources, strict=True)
    lengths = chunks.groupBy("source_id").agg(F.sum("n").alias("len")).select(F.lit(0).alias("one"), F.col("source_id").cast("long").alias("idx"), "len")
    placed = timeline.boundaries(lengths, ["one"]).select(F.col("idx").cast("string").alias("source_id"), "offset")
    marks = segments.select(F.col("idx").cast("string").alias("source_id"), "discontinuity")
    out = chunks.join(placed, "source_id").join(marks, "source_id")
    return out.select(F.lit(path).alias("source_id"), "track_id", (F.col("pos") + F.col("offset")).alias("pos"), "n", (F.col("discontinuity") & (F.col("pos") == 0)).alias("discont"), "pcm")
