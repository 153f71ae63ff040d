"""Gated loudness over sliding windows (ITU-R BS.1770, EBU R128 and Tech 3342)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOMENTARY, SHORT_TERM = 4, 30
OFFSET = -0.691
ABSOLUTE_GATE = 10 ** ((-70.0 - OFFSET) / 10)
#: Energies are summed as integers of this unit, so sums do not depend on the order of rows.
ENERGY_UNIT = 1e12
VERSION = "loudness-1"

Keys = tuple[str, ...]
_KEYS: Keys = ("source_id", "track_id")


def block_energy(chunks: DataFrame, block: int, keys: Keys = _KEYS) -> DataFrame:
    """keys, channel, block, energy (integer units) of every complete block of ``block`` frames.

    A chunk gives one partial sum per block it touches, so rows shrink before the shuffle.
    """
    n = F.size(F.get("pcm", F.lit(0)))
    first, last = F.floor(F.col("pos") / block), F.floor((F.col("pos") + n - 1) / block)
    rows = chunks.where(n > 0).select(*keys, "pos", n.alias("n"), "pcm", F.explode(F.sequence(first, last)).alias("block"))
    rows = rows.select(*keys, "pos", "n", "block", F.posexplode("pcm").alias("channel", "x"))
    lo = F.greatest(F.col("block") * block - F.col("pos"), F.lit(0))
    hi = F.least((F.col("block") + 1) * block - F.col("pos"), F.col("n").cast("long"))
    part = F.slice("x", (lo + 1).cast("int"), (hi - lo).cast("int"))
    energy = F.aggregate(part, F.lit(0).cast("long"), lambda s, v: s + F.round(v.cast("double") * v.cast("double") * ENERGY_UNIT).cast("long"))
    sums = rows.select(*keys, "channel", "block", (hi - lo).alias("n"), energy.alias("e")).groupBy(*keys, "channel", "block")
    return sums.agg(F.sum("n").alias("n"), F.sum("e").alias("energy")).where(F.col("n") == block).drop("n")


def channel_weight(speaker: str) -> float:
    return 0.0 if speaker == "LFE" else 1.41 if speaker in ("BL", "BR", "BC", "SL", "SR") else 1.0


def window_power(energy: DataFrame, blocks: int, block: int, weights: list[float] | None = None, keys: Keys = _KEYS) -> DataFrame:
    """keys, block, power of every full window of ``blocks`` blocks that ends with ``block``."""
    weight = F.lit(1.0) if weights is None else F.get(F.array(*[F.lit(w) for w in weights]), F.col("channel").cast("int"))
    summed = energy.groupBy(*keys, "block").agg(F.sum(weight * F.col("energy")).alias("e"))
    frame = Window.partitionBy(*keys).orderBy("block").rowsBetween(1 - blocks, 0)
    windows = summed.select(*keys, "block", F.sum("e").over(frame).alias("e"), F.count("e").over(frame).alias("m"))
    return windows.where(F.col("m") == blocks).select(*keys, "block", (F.col("e") / (ENERGY_UNIT * blocks * block)).alias("power"))


def loudness_of(power: Column) -> Column:
    return F.when(power > 0, OFFSET + 10 * F.log10(power)).otherwise(F.lit(float("-inf")))


def _gated(powers: DataFrame, ratio: float, strict: bool, keys: Keys) -> DataFrame:
    above = powers.where(F.col("power") > ABSOLUTE_GATE)
    mean = F.avg("power").over(Window.partitionBy(*keys))
    floor = above.withColumn("floor", mean * ratio)
    return floor.where(F.col("power") > F.col("floor") if strict else F.col("power") >= F.col("floor"))


def integrated(powers: DataFrame, keys: Keys = _KEYS) -> DataFrame:
    """keys, lufs of the windows louder than the absolute gate and than a tenth of their mean."""
    return _gated(powers, 0.1, True, keys).groupBy(*keys).agg(loudness_of(F.avg("power")).alias("lufs"))


def loudness_range(powers: DataFrame, keys: Keys = _KEYS) -> DataFrame:
    """keys, lra: distance of the nearest-rank 10 % and 95 % of the gated short-term powers; 0 below two windows."""
    gated = _gated(powers, 0.01, False, keys)
    ranked = gated.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("power")) - 1)
    ranked = ranked.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    at = lambda f: F.max(F.when(F.col("rank") == F.floor(f * (F.col("n") - 1) + 0.5), F.col("power")))
    found = ranked.groupBy(*keys).agg(at(0.10).alias("lo"), at(0.95).alias("hi"), F.max("n").alias("n"))
    return found.select(*keys, F.when(F.col("n") < 2, 0.0).otherwise(10 * F.log10(F.col("hi") / F.col("lo"))).alias("lra"))


def sample_peak(chunks: DataFrame, keys: Keys = _KEYS) -> DataFrame:
    peak = F.array_max(F.transform("pcm", lambda ch: F.array_max(F.transform(ch, F.abs))))
    return chunks.groupBy(*keys).agg(F.max(peak).alias("peak"))


def k_weight_coefficients(rate: float) -> list[tuple[list[float], list[float]]]:
    """The two biquads of the K filter at any rate, from its analogue prototype by the bilinear transform.

    Fixed values: centre frequencies, gain and quality factors of BS.1770.
    """
    f0, gain_db, q = 1681.974450955533, 3.999843853973347, 0.7071752369554196
    k = math.tan(math.pi * f0 / rate)
    vh = 10 ** (gain_db / 20)
    vb = vh**0.4996667741545416
    a0 = 1 + k / q + k * k
    shelf = ([(vh + vb * k / q + k * k) / a0, 2 * (k * k - vh) / a0, (vh - vb * k / q + k * k) / a0], [1.0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])
    f0, q = 38.13547087602444, 0.5003270373238773
    k = math.tan(math.pi * f0 / rate)
    a0 = 1 + k / q + k * k
    high = ([1.0, -2.0, 1.0], [1.0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])
    return [shelf, high]
