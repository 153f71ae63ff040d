"""Dynamics: the compressor's curve and envelope, the limiter's release, transient detection."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.operators.loudness import ENERGY_UNIT

#: The voice preset.
THRESHOLD_DB, RATIO, KNEE_DB, ATTACK_S, RELEASE_S, MAKEUP_DB = -20.0, 2.5, 6.0, 0.010, 0.250, 6.0
MAX_PEAK = 2.0
#: The limiter's ceiling, look-ahead and release.
CEILING_DB, LOOK_AHEAD_S, LIMITER_RELEASE_S = -1.0, 0.005, 0.050
#: Release time constants after which a decaying node has forgotten its past.
HORIZON_CONSTANTS = 40


def static_curve(peak: Column) -> Column:
    """Decibels of gain (0 or less) that a peak calls for: soft knee around the threshold."""
    over = 20 * F.log10(F.least(peak, F.lit(MAX_PEAK))) - THRESHOLD_DB
    slope = 1 / RATIO - 1
    half = KNEE_DB / 2
    knee = F.lit(slope) * (over + half) * (over + half) / (2 * KNEE_DB)
    return F.when(F.isnan(peak) | (peak <= 0), 0.0).when(over <= -half, 0.0).when(over >= half, over * slope).otherwise(knee)


def pole(seconds: float, rate: float) -> float:
    return 1 - math.exp(-1 / (seconds * rate))


def compress(planes: np.ndarray, rate: float, state_db: float = 0.0) -> tuple[np.ndarray, float]:
    """Compress channels x frames and return the envelope's last value, from which the next chunk goes on."""
    peak = np.fmin(np.nan_to_num(np.abs(planes.astype(np.float64)), nan=0.0).max(axis=0), MAX_PEAK)
    with np.errstate(divide="ignore"):
        over = 20 * np.log10(peak) - THRESHOLD_DB
    slope, half = 1 / RATIO - 1, KNEE_DB / 2
    target = np.where(over <= -half, 0.0, np.where(over >= half, over * slope, slope * np.square(np.maximum(over, -half) + half) / (2 * KNEE_DB)))
    attack, release = pole(ATTACK_S, rate), pole(RELEASE_S, rate)
    gains, g = np.empty(len(target)), state_db
    for k, t in enumerate(target.tolist()):
        g += (t - g) * (attack if t < g else release)
        gains[k] = g
    factor = (10 ** (gains / 20) * 10 ** (MAKEUP_DB / 20)).astype(np.float32)
    return planes * factor, g


def horizon_frames(release_seconds: list[float], rate: int) -> int:
    """Frames of real audio to run before a splice: the sum, not the maximum, over the decaying nodes of a chain."""
    return sum(math.ceil(HORIZON_CONSTANTS * s * rate) for s in release_seconds)


def release_envelope(rows: DataFrame, keys: tuple[str, ...], order: str, peak: Column, ceiling: float, look_ahead: int, release: float) -> DataFrame:
    """Add ``gain``: the smallest gain needed in the next ``look_ahead`` rows, recovering exponentially.

    The recursion g = min(m, g' + (1 - g') a) has the closed form
    1 - g[n] = max over k <= n of (1 - m[k]) (1 - a)^(n - k), a running maximum
    in the logarithm, so it is a window function.
    """
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, look_ahead)
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    loudest = F.max(peak).over(ahead)
    need = rows.withColumn("__m", F.when(loudest > ceiling, F.lit(ceiling) / loudest).otherwise(1.0))
    decay = math.log(1 - release)
    deepest = F.max(F.when(F.col("__m") < 1, F.log(1 - F.col("__m")) - F.col(order) * decay)).over(past)
    return need.withColumn("__u", deepest).withColumn("gain", 1 - F.coalesce(F.exp(F.col("__u") + F.col(order) * decay), F.lit(0.0))).drop("__m", "__u")


def running_max(x: np.ndarray, width: int) -> np.ndarray:
    """The maximum of every ``width`` neighbours, by windows that double."""
    n, have = len(x) - width + 1, 1
    while have * 2 <= width:
        x = np.maximum(x[:-have], x[have:])
        have *= 2
    return np.maximum(x[:n], x[width - have : width - have + n])


def limit(planes: np.ndarray, rate: float, ceiling_db: float = CEILING_DB) -> np.ndarray:
    """Look-ahead limiting of channels x frames: true-peak detector, minimum hold, release, two box averages in 2^-40 fixed point, clamp.

    The release is the closed form of ``release_envelope`` as a running maximum.
    """
    from sampleloom.operators.filters import frame_peaks

    ceiling = 10 ** (ceiling_db / 20)
    look = max(1, round(LOOK_AHEAD_S * rate))
    n = planes.shape[1]
    if not n:
        return planes
    hold = running_max(np.concatenate([frame_peaks(planes, int(rate)), np.zeros(look)]), look + 1)
    m = np.where(hold > ceiling, ceiling / np.maximum(hold, 1e-300), 1.0)
    fall = np.arange(n) * math.log(1 - pole(LIMITER_RELEASE_S, rate))
    with np.errstate(divide="ignore"):
        deepest = np.maximum.accumulate(np.log(1 - m) - fall)
    rel = np.minimum(m, 1 - np.exp(deepest + fall))
    first = look // 2 + 1
    smooth = rel
    for width in (first, look + 1 - first):
        if width > 1:
            fixed = np.floor(np.concatenate([np.full(width - 1, smooth[0]), smooth]) * (1 << 40)).astype(np.int64)
            total = np.concatenate(([0], np.cumsum(fixed)))
            smooth = (total[width:] - total[:-width]) / (width * float(1 << 40))
    return np.clip(planes * smooth.astype(np.float32), -ceiling, ceiling).astype(np.float32)


def attacks(chunks: DataFrame, window: int, ratio: float = 8.0, floor: float = 1e-6, refractory: int = 4, keys: tuple[str, ...] = ("source_id", "track_id")) -> DataFrame:
    """keys, k: sub-windows of ``window`` frames whose mean energy exceeds ``ratio`` times the one before.

    A jump within ``refractory`` sub-windows of the last one is not reported but
    starts the wait anew.  Chunks must begin at a multiple of ``window``.
    """
    x = F.get("pcm", F.lit(0))
    square = lambda s, v: s + F.round(v.cast("double") * v.cast("double") * ENERGY_UNIT).cast("long")
    parts = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(x) / window).cast("int") - 1),
        lambda i: F.struct((F.floor(F.col("pos") / window) + i).alias("k"), F.aggregate(F.slice(x, i * window + 1, F.lit(window)), F.lit(0).cast("long"), square).alias("e")),
    )
    rows = chunks.where(F.size(x) > 0).select(*keys, F.explode(parts).alias("p")).select(*keys, "p.k", "p.e")
    order = Window.partitionBy(*keys).orderBy("k")
    least = int(floor * window * ENERGY_UNIT)
    jumps = rows.withColumn("jump", F.col("e") > ratio * F.greatest(F.coalesce(F.lag("e").over(order), F.lit(0).cast("long")), F.lit(least))).where("jump")
    since = F.col("k") - F.lag("k").over(order) - 1
    return jumps.withColumn("since", F.coalesce(since, F.lit(refractory).cast("long"))).where(F.col("since") >= refractory).select(*keys, "k")
