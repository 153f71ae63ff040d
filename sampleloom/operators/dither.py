"""Quantisation with dither that does not depend on chunking.

Noise is a pure function of seed, channel and position, so any partitioning
gives the same samples.  64-bit wrap-around arithmetic is not available in ANSI
SQL, hence numpy over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sampleloom.core.arrow import nested

_U = np.uint64
#: The constants of splitmix64, and the noise-shaping filter for 44.1 and 48 kHz.
GOLDEN = _U(0x9E3779B97F4A7C15)
FIRST_MULTIPLIER, SECOND_MULTIPLIER = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
SHAPING = (2.033, -2.165, 1.959, -1.590, 0.6149)
SHAPED_RATES = (44100, 48000)


#: Values worked on at a time, so that steps stay in the processor's cache.
_BLOCK = 1 << 13


def splitmix64(k: np.ndarray) -> np.ndarray:
    """The generator's output for every state, in place of a copy."""
    z = k + GOLDEN
    shifted = np.empty_like(z)
    for shift, multiplier in ((30, FIRST_MULTIPLIER), (27, SECOND_MULTIPLIER), (31, None)):
        np.right_shift(z, _U(shift), out=shifted)
        np.bitwise_xor(z, shifted, out=z)
        if multiplier is not None:
            np.multiply(z, multiplier, out=z)
    return z


def tpdf(seed: int, channel: int, positions: np.ndarray) -> np.ndarray:
    """Triangular noise in (-1, 1) of a channel at these positions."""
    with np.errstate(over="ignore"):
        base = _U(seed) ^ (_U(channel + 1) * GOLDEN)
        out = np.empty(len(positions))
        for a in range(0, len(out), _BLOCK):
            at = positions[a : a + _BLOCK].astype(_U)
            at *= _U(2)
            at += base
            first = splitmix64(at)
            at += _U(1)
            # both have 53 bits, so their difference is exact in integers and as a float
            difference = (first >> _U(11)).view(np.int64) - (splitmix64(at) >> _U(11)).view(np.int64)
            np.multiply(difference, 2.0**-53, out=out[a : a + _BLOCK])
        return out


def quantize(values: np.ndarray, bits: int, noise: np.ndarray | float = 0.0) -> tuple[np.ndarray, int]:
    """Integers of ``bits``, and how many values lay strictly beyond full scale."""
    top = 1 << (bits - 1)
    out, overs = np.empty(len(values), dtype=np.int32), 0
    for a in range(0, len(out), _BLOCK):
        x = values[a : a + _BLOCK].astype(np.float64)
        overs += int(np.count_nonzero(np.abs(x) > 1))
        broken = not np.isfinite(x).all()
        if broken:
            missing = np.isnan(x)
            x = np.nan_to_num(x, nan=0.0, posinf=2.0, neginf=-2.0)
        x *= top
        x += noise[a : a + _BLOCK] if isinstance(noise, np.ndarray) else noise
        x += 0.5
        np.floor(x, out=x)
        np.clip(x, -top, top - 1, out=x)
        if broken:
            x[missing] = 0
        out[a : a + _BLOCK] = x
    return out, overs


def shaped(values: np.ndarray, bits: int, noise: np.ndarray) -> np.ndarray:
    """Error feedback through the shaping filter; sequential by nature, so one whole channel at a time."""
    top = 1 << (bits - 1)
    out, past = np.empty(len(values), dtype=np.int32), [0.0] * len(SHAPING)
    for k, v in enumerate(np.nan_to_num(values.astype(np.float64), nan=0.0, posinf=2.0, neginf=-2.0) * top):
        want = v - sum(c * e for c, e in zip(SHAPING, past, strict=True))
        q = min(max(np.floor(want + noise[k] + 0.5), -top), top - 1)
        past = [min(max(q - want, -2.0 * top), 2.0 * top), *past[:-1]]
        out[k] = q
    return out


def dithered(chunks: DataFrame, bits: int, seed: int) -> DataFrame:
    """Chunks with ``pos`` and float ``pcm``; pcm becomes integers of ``bits`` with triangular dither."""
    at_pos, at_pcm = chunks.columns.index("pos"), chunks.columns.index("pcm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pos, channels in zip(batch.column(at_pos).to_pylist(), batch.column(at_pcm), strict=True):
                rows = []
                for c, x in enumerate(channels.values if channels.is_valid else []):
                    v = x.values.to_numpy(zero_copy_only=False)
                    rows.append(quantize(v, bits, tpdf(seed, c, np.arange(pos, pos + len(v))))[0])
                out.append(np.array(rows, dtype=np.int32).reshape(len(rows), -1) if rows else np.empty((0, 0), np.int32))
            columns = list(batch.columns)
            columns[at_pcm] = nested(out, pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    kinds = ", ".join(f"`{n}` {'array<array<int>>' if n == 'pcm' else t}" for n, t in chunks.dtypes)
    return chunks.mapInArrow(run, kinds)
