"""Functions for SQL: what Spark has no built-in form of, registered under names of their own."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleloom.functions import media


@F.pandas_udf(T.LongType())
def gcd(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or pd.isna(y) else math.gcd(int(x), int(y)) for x, y in zip(a, b)], dtype="Int64")


@F.pandas_udf(T.StringType())
def ulid(time_ms: pd.Series, entropy: pd.Series) -> pd.Series:
    """An identifier of a time and of text that stands for its random part, so a row has the same one in every run."""
    import hashlib

    return pd.Series([None if pd.isna(t) or e is None else media.mint_ulid(int(t), int.from_bytes(hashlib.sha256(e.encode()).digest()[:10], "big")) for t, e in zip(time_ms, entropy)])


FUNCTIONS = {"audio_gcd": gcd, "audio_ulid": ulid, "audio_hmac_sha256": media.hmac_sha256, "audio_crc16": media.crc16_of}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)


def verify_lengths(chunks: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """keys, declared, delivered, gaps of the tracks that did not deliver what they declared, or not without gaps.

    ``declared`` has keys and samples.  Chunks are counted, not compared pairwise: a track without overlaps or gaps
    covers as many positions as it has frames.
    """
    got = chunks.groupBy(*keys).agg(F.sum("n").alias("delivered"), (F.max(F.col("pos") + F.col("n")) - F.min("pos")).alias("span"), F.min("pos").alias("first"))
    both = declared.select(*keys, F.col("samples").alias("declared")).join(got, keys, "left")
    delivered = F.coalesce("delivered", F.lit(0).cast("long"))
    gaps = F.coalesce(F.col("span") - F.col("delivered") + F.col("first"), F.lit(0).cast("long"))
    return both.select(*keys, "declared", delivered.alias("delivered"), gaps.alias("gaps")).where((F.col("declared") != F.col("delivered")) | (F.col("gaps") != 0))
