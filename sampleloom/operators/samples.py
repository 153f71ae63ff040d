"""Sample arithmetic on planar chunks: array expressions that stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sampleloom.core.schemas import SPEAKERS

MAX_GAIN_DB = 120.0


def each(pcm: Column, function) -> Column:
    """Apply ``function`` to every sample of every channel."""
    return F.transform(pcm, lambda ch: F.transform(ch, function))


def gain_factor(db: float) -> float:
    if not -MAX_GAIN_DB <= db <= MAX_GAIN_DB:
        raise ValueError(f"gain {db} dB is out of range")
    return 10 ** (db / 20)


def to_float(pcm: Column, bit_depth: int) -> Column:
    scale = F.lit(1 / (1 << (bit_depth - 1))).cast("float")
    return each(pcm, lambda v: v.cast("float") * scale)


def widen(pcm: Column, from_bits: int, to_bits: int) -> Column:
    return each(pcm, lambda v: F.shiftleft(v, to_bits - from_bits))


def gain(pcm: Column, db: float) -> Column:
    factor = F.lit(gain_factor(db)).cast("float")
    return each(pcm, lambda v: v * factor)


def quantized(v: Column, bits: int) -> Column:
    """floor(v * 2^(bits-1) + 0.5) within the range of ``bits``; NaN becomes 0."""
    top = 1 << (bits - 1)
    x = F.floor(v.cast("double") * top + 0.5)
    return F.when(F.isnan(v), 0).otherwise(F.greatest(F.lit(-top), F.least(F.lit(top - 1), x))).cast("int")


def quantize(pcm: Column, bits: int) -> Column:
    return each(pcm, lambda v: quantized(v, bits))


def overs(pcm: Column) -> Column:
    """Samples strictly beyond full scale, over all channels."""
    return F.aggregate(pcm, F.lit(0), lambda n, ch: n + F.size(F.filter(ch, lambda v: F.abs(v) > 1.0)))


def db_of(v: Column) -> Column:
    """20 log10; minus infinity for silence."""
    return F.when(v > 0, 20 * F.log10(v)).otherwise(F.lit(float("-inf")))


def frame_peaks(pcm: Column) -> Column:
    """The largest magnitude over the channels, per frame."""
    magnitude = F.transform(pcm, lambda ch: F.transform(ch, lambda v: F.when(F.isnan(v), F.lit(0).cast("float")).otherwise(F.abs(v))))
    return F.aggregate(magnitude, F.array().cast("array<float>"), lambda m, ch: F.zip_with(m, ch, lambda a, b: F.greatest(a, b)))


#: Gains of a speaker in the left and right of a stereo fold (ITU-R BS.775).
_FOLD = {
    "FL": (1.0, 0.0), "FR": (0.0, 1.0), "FC": (math.sqrt(0.5), math.sqrt(0.5)), "LFE": (0.0, 0.0),
    "BL": (math.sqrt(0.5), 0.0), "BR": (0.0, math.sqrt(0.5)), "SL": (math.sqrt(0.5), 0.0), "SR": (0.0, math.sqrt(0.5)),
    "BC": (0.5, 0.5), "FLC": (1.0, 0.0), "FRC": (0.0, 1.0),
    "TFL": (math.sqrt(0.5), 0.0), "TFR": (0.0, math.sqrt(0.5)), "TFC": (0.5, 0.5), "TC": (0.5, 0.5),
    "TBL": (0.3536, 0.0), "TBR": (0.0, 0.3536), "TBC": (0.3536, 0.3536),
}


def speakers_of(mask: int) -> list[str]:
    return [name for bit, name in enumerate(SPEAKERS) if mask >> bit & 1]


def mix_matrix(source_mask: int, channels: int) -> list[list[float]]:
    """Rows of a fold to mono or stereo; a row is scaled to unit energy only if it exceeds it."""
    names = speakers_of(source_mask)
    if channels == 1 and len(names) == 1:
        return [[1.0]]
    if channels == 2 and len(names) == 1:
        return [[1.0], [1.0]]
    left, right = [_FOLD[n][0] for n in names], [_FOLD[n][1] for n in names]
    rows = [left, right] if channels == 2 else [[math.sqrt(0.5) * (a + b) for a, b in zip(left, right, strict=True)]]
    out = []
    for row in rows:
        energy = sum(c * c for c in row)
        out.append([c / math.sqrt(energy) for c in row] if energy > 1 else row)
    return out


def mix(pcm: Column, matrix: list[list[float]]) -> Column:
    """Each output channel is the sum of coefficient times input channel."""

    def scaled(k: int, c: float) -> Column:
        return F.transform(F.get(pcm, F.lit(k)), lambda v: v.cast("double") * c)

    def row(coefficients: list[float]) -> Column:
        used = [(k, c) for k, c in enumerate(coefficients) if c]
        if not used:
            return F.transform(F.get(pcm, F.lit(0)), lambda v: F.lit(0).cast("float"))
        total = None
        for k, c in used:
            part = scaled(k, c)
            total = part if total is None else F.zip_with(total, part, lambda a, b: a + b)
        return F.transform(total, lambda v: v.cast("float"))

    return F.array(*[row(r) for r in matrix])


def max_matrix_gain(matrix: list[list[float]]) -> float:
    return max(sum(abs(c) for c in row) for row in matrix)


def mask_names(mask: Column) -> Column:
    """Names of the speakers of a mask, joined by ``|``."""
    names = F.array(*[F.when(F.shiftright(mask, bit).bitwiseAND(F.lit(1)) == 1, F.lit(name)) for bit, name in enumerate(SPEAKERS)])
    return F.array_join(F.array_compact(names), "|")
