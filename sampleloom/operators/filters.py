"""Linear filters in numpy: biquads by blocks, windowed sincs, resampling, true peak; and the meters built on them."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleloom.operators import loudness
from sampleloom.operators.segments import map_segments

#: Attenuation (dB), pass band and stop band (parts of the lower Nyquist frequency) of the resampler's qualities.
QUALITIES = {"hq": (115.0, 0.91, 1.09), "fast": (72.0, 0.85, 1.15)}
TRUE_PEAK_TAPS, TRUE_PEAK_BETA = 12, 6.0
#: Windows of interpolation that share a matrix product.
_WINDOWS = 24


def _step(sections, x: float, state: np.ndarray) -> tuple[float, np.ndarray]:
    """One sample through biquads in transposed direct form."""
    out = state.copy()
    for k, (b, a) in enumerate(sections):
        y = b[0] * x + state[2 * k]
        out[2 * k] = b[1] * x - a[1] * y + state[2 * k + 1]
        out[2 * k + 1] = b[2] * x - a[2] * y
        x = y
    return x, out


@lru_cache(maxsize=16)
def _block_form(sections, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """H, O, A and C of ``block`` samples: output H x + O s, next state A s + C x."""
    order = 2 * len(sections)
    h, o, c = np.zeros(block), np.zeros((block, order)), np.zeros((order, block))
    state = np.zeros(order)
    for k in range(block):
        h[k], state = _step(sections, 1.0 if k == 0 else 0.0, state)
        c[:, block - 1 - k] = state  # an impulse k samples before the end leaves this state
    columns = []
    for j in range(order):
        s = np.eye(order)[j]
        for k in range(block):
            o[k, j], s = _step(sections, 0.0, s)
        columns.append(s)
    lag = np.arange(block)[:, None] - np.arange(block)[None, :]
    return np.where(lag >= 0, h[np.maximum(lag, 0)], 0.0), o, np.array(columns).T, c


def biquads(sections, x: np.ndarray, block: int = 256) -> np.ndarray:
    """Filter channels x frames from rest.

    The filter is linear, so a block's output is H x + O s and its next state
    A s + C x: all H x are one matrix product, and only states go block by block.
    """
    h, o, a, c = _block_form(tuple((tuple(n), tuple(d)) for n, d in sections), block)
    channels, n = x.shape
    padded = np.zeros((channels, -(-n // block) * block))
    padded[:, :n] = x
    blocks = padded.reshape(channels, -1, block)
    y, push = blocks @ h.T, blocks @ c.T
    s = np.zeros((channels, len(a)))
    for k in range(blocks.shape[1]):
        y[:, k] += s @ o.T
        s = s @ a.T + push[:, k]
    return y.reshape(channels, -1)[:, :n]


@lru_cache(maxsize=32)
def resample_bank(up: int, down: int, quality: str) -> np.ndarray:
    """Taps by phase (up x taps) of a Kaiser-windowed sinc between the pass and stop bands."""
    attenuation, passed, stopped = QUALITIES[quality]
    nyquist = min(1.0, up / down)
    width = (stopped - passed) * nyquist
    half = math.ceil((attenuation - 7.95) / (14.36 * width / 2) / 2) + 1
    beta = 0.1102 * (attenuation - 8.7)
    cut = (passed + stopped) / 2 * nyquist
    at = np.arange(-half + 1, half + 1)[None, :] - np.arange(up)[:, None] / up
    inside = np.clip(1 - (at / half) ** 2, 0, None)
    taps = cut * np.sinc(cut * at) * np.i0(beta * np.sqrt(inside)) / np.i0(beta)
    return taps / taps.sum(axis=1, keepdims=True)


def ratio(rate_in: int, rate_out: int) -> tuple[int, int]:
    g = math.gcd(rate_in, rate_out)
    return rate_out // g, rate_in // g


def resample_span(x: np.ndarray, start: int, first: int, last: int, up: int, down: int, quality: str) -> np.ndarray:
    """Output frames [first, last) of a track of which ``x`` (from frame ``start``) holds all frames that matter."""
    bank = resample_bank(up, down, quality)
    taps = bank.shape[1]
    half = taps // 2
    padded = np.pad(x, ((0, 0), (half + 1, half + 1))).astype(np.float32)
    out = np.empty((len(x), last - first), dtype=np.float32)
    # outputs of one phase use one row of taps, on windows that lie ``down`` frames apart
    for phase in range(min(up, last - first)):
        m = first + phase
        n = -(-(last - m) // up)
        at = m * down // up - start + 2
        for c in range(len(x)):
            short = max(at + (n - 1) * down + taps - padded.shape[1], 0)
            row = np.pad(padded[c], (0, short)) if short else padded[c]
            windows = np.lib.stride_tricks.as_strided(row[at:], (n, taps), (row.strides[0] * down, row.strides[0]))
            out[c, phase::up] = windows @ bank[m * down % up].astype(np.float32)
    return out


def resample(chunks: DataFrame, rate_in: int, rate_out: int, quality: str = "hq", segment: int = 1 << 17, keys: tuple[str, ...] = ("source_id", "track_id")) -> DataFrame:
    """Chunks at the new rate: delay-compensated, ceil(T * L / M) frames of a track of T, positions rescaled."""
    up, down = ratio(rate_in, rate_out)
    half = resample_bank(up, down, quality).shape[1] // 2 + 1

    def kernel(planes, start, lo, hi):
        first, last = -(-lo * up // down), -(-hi * up // down)
        if last > first:
            y = resample_span(planes, start, first, last, up, down, quality)
            for a in range(0, last - first, 4096):
                part = y[:, a : a + 4096]
                yield {"pos": first + a, "n": part.shape[1], "discont": False, "pcm": part}

    return map_segments(chunks, segment, half, half, kernel, "pos bigint, n int, discont boolean, pcm array<array<float>>", keys)


@lru_cache(maxsize=8)
def true_peak_bank(factor: int) -> np.ndarray:
    """Interpolation phases between samples (factor - 1 rows)."""
    half = TRUE_PEAK_TAPS // 2
    at = np.arange(-half + 1, half + 1)[None, :] - np.arange(1, factor)[:, None] / factor
    taps = np.sinc(at) * np.i0(TRUE_PEAK_BETA * np.sqrt(np.clip(1 - (at / half) ** 2, 0, None))) / np.i0(TRUE_PEAK_BETA)
    return taps / taps.sum(axis=1, keepdims=True)


def _oversampling(rate: int) -> int:
    return 4 if rate < 96000 else 2 if rate <= 192000 else 1


def true_peak_of(planes: np.ndarray, rate: int, before: bool = True, after: bool = True) -> float:
    """``before`` and ``after``: the track begins or ends here, so silence lies beyond; else only what has real neighbours counts.

    The largest magnitude of the samples and of the signal between them: 4 points a sample below 96 kHz, 2 up to and at 192 kHz."""
    factor = _oversampling(rate)
    peak = float(np.abs(planes).max(initial=0.0))
    if factor > 1 and planes.shape[1]:
        padded = np.pad(planes.astype(np.float64), ((0, 0), (TRUE_PEAK_TAPS * before, TRUE_PEAK_TAPS * after)))
        if padded.shape[1] < TRUE_PEAK_TAPS:
            return peak
        between = _between(padded, factor)
        peak = max(peak, float(between.max(initial=0.0)), -float(between.min(initial=0.0)))
    return peak


def _between(padded: np.ndarray, factor: int) -> np.ndarray:
    """channels x windows x phases: the points between the two middle samples of every window of TRUE_PEAK_TAPS.

    Neighbouring windows share a matrix product: a block of samples times a
    banded matrix gives all points of the windows that begin in it.
    """
    bank = true_peak_bank(factor)
    phases, width = len(bank), _WINDOWS + TRUE_PEAK_TAPS - 1
    band = np.zeros((width, _WINDOWS, phases))
    for k in range(_WINDOWS):
        band[k : k + TRUE_PEAK_TAPS, k] = bank.T
    channels, n = padded.shape
    windows = n - TRUE_PEAK_TAPS + 1
    blocks = -(-windows // _WINDOWS)
    out = np.empty((channels, blocks, _WINDOWS * phases))
    filled = np.zeros((blocks - 1) * _WINDOWS + width)
    for c in range(channels):
        filled[:n] = padded[c]
        rows = np.lib.stride_tricks.as_strided(filled, (blocks, width), (_WINDOWS * filled.strides[0], filled.strides[0]))
        np.matmul(np.ascontiguousarray(rows), band.reshape(width, -1), out=out[c])
    return out.reshape(channels, -1, phases)[:, :windows]


def frame_peaks(planes: np.ndarray, rate: int) -> np.ndarray:
    """Of each frame the largest magnitude over all channels of its sample and of the points up to the next one."""
    peak = np.nan_to_num(np.abs(planes.astype(np.float64)), nan=0.0).max(axis=0)
    factor = _oversampling(rate)
    if factor > 1 and planes.shape[1]:
        half = TRUE_PEAK_TAPS // 2
        padded = np.pad(np.nan_to_num(planes.astype(np.float64), nan=0.0), ((0, 0), (half - 1, half)))
        peak = np.maximum(peak, np.abs(_between(padded, factor)).max(axis=(0, 2)))
    return peak


def true_peak(chunks: DataFrame, rate: int, segment: int = 1 << 18, keys: tuple[str, ...] = ("source_id", "track_id"), bits: int = 0) -> DataFrame:
    """keys, true_peak of each track: the meter of peaks alone. ``bits``: pcm holds integers of this depth, not floats."""
    if rate <= 0:
        raise ValueError("the rate of a meter must be positive")
    scale = 1.0 / (1 << bits - 1) if bits else 1.0

    def kernel(planes, start, lo, hi):
        yield {"peak": scale * true_peak_of(planes, rate, start == 0, start + planes.shape[1] < hi + TRUE_PEAK_TAPS)}

    return map_segments(chunks, segment, TRUE_PEAK_TAPS, TRUE_PEAK_TAPS, kernel, "peak double", keys).groupBy(*keys).agg(F.max("peak").alias("true_peak"))


def weighted_energy(chunks: DataFrame, rate: int, seconds: int = 30, keys: tuple[str, ...] = ("source_id", "track_id")) -> DataFrame:
    """keys, channel, block, energy of the complete 100 ms blocks of the K-weighted signal, in the loudness operator's units."""
    block = max(rate // 10, 1)
    sections = loudness.k_weight_coefficients(rate)

    def kernel(planes, start, lo, hi):
        y = biquads(sections, planes.astype(np.float64))[:, lo - start : hi - start]
        whole = y.shape[1] // block
        energy = np.square(y[:, : whole * block]).reshape(len(y), whole, block).sum(axis=2)
        for c in range(len(y)):
            for k in range(whole):
                yield {"channel": c, "block": lo // block + k, "energy": int(round(energy[c, k] * loudness.ENERGY_UNIT))}

    # half a second is 80 time constants of the slower pole pair
    return map_segments(chunks, block * 10 * seconds, rate // 2, 0, kernel, "channel int, block bigint, energy bigint", keys)


def measure(chunks: DataFrame, rate: int, weights: list[float] | None = None, keys: tuple[str, ...] = ("source_id", "track_id")) -> DataFrame:
    """keys, lufs, lra, true_peak_db, sample_peak_db: the whole measurement of each track."""
    from sampleloom.operators.samples import db_of

    block = max(rate // 10, 1)
    energy = weighted_energy(chunks, rate, keys=keys)
    lufs = loudness.integrated(loudness.window_power(energy, loudness.MOMENTARY, block, weights, keys), keys)
    lra = loudness.loudness_range(loudness.window_power(energy, loudness.SHORT_TERM, block, weights, keys), keys)
    peaks = true_peak(chunks, rate, keys=keys).join(loudness.sample_peak(chunks, keys), list(keys))
    out = peaks.join(lufs, list(keys), "left").join(lra, list(keys), "left")
    silent = F.lit(float("-inf"))
    return out.select(*keys, F.coalesce("lufs", silent).alias("lufs"), F.coalesce("lra", F.lit(0.0)).alias("lra"), db_of(F.col("true_peak")).alias("true_peak_db"), db_of(F.col("peak").cast("double")).alias("sample_peak_db"))
