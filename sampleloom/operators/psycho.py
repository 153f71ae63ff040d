"""Spectra and a masking model: bark scale, threshold in quiet, spreading, band thresholds and perceptual entropy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BANDS = 49


def bark(hz: np.ndarray | float) -> np.ndarray:
    return 13 * np.arctan(0.00076 * np.asarray(hz)) + 3.5 * np.arctan((np.asarray(hz) / 7500) ** 2)


def quiet_threshold_db(hz: np.ndarray | float) -> np.ndarray:
    """Threshold in quiet, in dB of sound pressure."""
    k = np.maximum(np.asarray(hz, dtype=float), 20.0) / 1000
    return 3.64 * k**-0.8 - 6.5 * np.exp(-0.6 * (k - 3.3) ** 2) + 1e-3 * k**4


@lru_cache(maxsize=16)
def _bands(size: int, rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hz = np.arange(size // 2 + 1) * rate / size
    z = bark(hz)
    band = np.minimum((z / (z[-1] + 1e-9) * BANDS).astype(int), BANDS - 1)
    centre = np.array([z[band == b].mean() if (band == b).any() else np.nan for b in range(BANDS)])
    centre = np.interp(np.arange(BANDS), np.flatnonzero(~np.isnan(centre)), centre[~np.isnan(centre)])
    d = centre[:, None] - centre[None, :]
    spread = 10 ** (np.where(d >= 0, -10 * d, 27 * d) / 10)
    quiet = np.array([10 ** ((quiet_threshold_db(hz[band == b]).min() - 96) / 10) if (band == b).any() else 1.0 for b in range(BANDS)])
    return band, spread, quiet


def analyze(block: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Band thresholds, band energies and perceptual entropy of a block of samples."""
    size = len(block)
    band, spread, quiet = _bands(size, rate)
    spectrum = np.abs(np.fft.rfft(block * np.hanning(size)) * 2 / size) ** 2
    energy = np.bincount(band, weights=spectrum, minlength=BANDS)
    lines = np.bincount(band, minlength=BANDS)
    threshold = np.maximum(spread @ energy * 10**-1.45, quiet)
    entropy = float((lines * np.log2(1 + np.sqrt(energy / np.maximum(threshold, 1e-30)))).sum())
    return threshold, energy, entropy


def masking(chunks: DataFrame, rate: int, keys: tuple[str, ...] = ("source_id", "track_id")) -> DataFrame:
    """keys, pos, threshold, energy, entropy of the first channel of every chunk."""
    names = [*keys, "pos", "threshold", "energy", "entropy"]

    def run(batches):
        for batch in batches:
            rows = [analyze(np.array(p[0], dtype=np.float64), rate) for p in batch.column(len(keys) + 1).to_pylist()]
            columns = [*batch.columns[: len(keys) + 1], pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.list_(pa.float64())), pa.array([r[2] for r in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = ", ".join(f"`{k}` {t}" for k, t in chunks.select(*keys).dtypes)
    return chunks.select(*keys, "pos", "pcm").mapInArrow(run, f"{kinds}, pos bigint, threshold array<double>, energy array<double>, entropy double")
