"""Analytic anchors, invariance to partitioning, and round trips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from sampleloom.core import positions
from sampleloom.operators import dither, dynamics, filters, frames, loudness, samples, silence
from sampleloom.plans import timeline


def tone(seconds, rate=48000, hz=997.0, amplitude=1.0):
    return (amplitude * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)).astype(np.float32)


def chunk_frame(spark, tracks, size=4096, partitions=3):
    rows = []
    for name, planes in tracks.items():
        for a in range(0, planes.shape[1], size):
            part = planes[:, a : a + size]
            rows.append((name, 0, a, part.shape[1], False, part.tolist()))
    return spark.createDataFrame(rows, "source_id string, track_id int, pos bigint, n int, discont boolean, pcm array<array<float>>").repartition(partitions)


def test_loudness_anchors(spark):
    full, quiet, silent = tone(8), tone(8, amplitude=10 ** (-18 / 20)), np.zeros(8 * 48000, np.float32)
    tracks = {"one": np.array([full, silent]), "both": np.array([quiet, quiet]), "none": np.array([silent, silent])}
    got = {r["source_id"]: r for r in filters.measure(chunk_frame(spark, tracks), 48000).collect()}
    assert got["one"]["lufs"] == pytest.approx(-3.01, abs=0.05)
    assert got["both"]["lufs"] == pytest.approx(-18.0, abs=0.05)
    assert got["none"]["lufs"] == -math.inf and got["none"]["lra"] == 0
    assert got["both"]["lra"] == pytest.approx(0, abs=0.1)
    assert got["one"]["true_peak_db"] == pytest.approx(0, abs=0.05)


def test_loudness_range_of_two_levels(spark):
    x = np.concatenate([tone(20, amplitude=10 ** (-20 / 20)), tone(20, amplitude=10 ** (-30 / 20))])
    got = filters.measure(chunk_frame(spark, {"t": np.array([x, x])}, size=48000), 48000).first()
    assert got["lra"] == pytest.approx(10, abs=1)


def test_gating_ignores_a_pause(spark):
    x = tone(18)
    with_gap = np.concatenate([x[:240000], np.zeros(96000, np.float32), x[240000:]])
    got = {r["source_id"]: r["lufs"] for r in filters.measure(chunk_frame(spark, {"a": x[None], "b": with_gap[None]}, size=48000), 48000).collect()}
    assert abs(got["a"] - got["b"]) < 0.1


def test_segments_do_not_depend_on_chunks_or_partitions(spark):
    x = (np.random.default_rng(1).standard_normal((2, 100_000)) * 0.1).astype(np.float32)
    results = []
    for size, partitions, seconds in ((4096, 1, 30), (1000, 7, 1), (33333, 3, 2)):
        rows = filters.weighted_energy(chunk_frame(spark, {"t": x}, size, partitions), 8000, seconds=seconds).collect()
        results.append({(r["channel"], r["block"]): r["energy"] for r in rows})
    assert results[0].keys() == results[1].keys() == results[2].keys()
    for k, v in results[0].items():
        assert abs(v - results[1][k]) <= 2 + v * 1e-9 and abs(v - results[2][k]) <= 2 + v * 1e-9


def test_biquads_equal_the_recursion():
    rng = np.random.default_rng(0)
    sections = loudness.k_weight_coefficients(48000)
    x = rng.standard_normal(1000)
    state, want = np.zeros(4), []
    for v in x:
        y, state = filters._step(sections, v, state)
        want.append(y)
    assert np.allclose(filters.biquads(sections, x[None], 64)[0], want, atol=1e-9)


@pytest.mark.parametrize("rates", [(44100, 48000), (48000, 44100), (8000, 48000), (48000, 8000)])
def test_resampling_keeps_length_and_tone(spark, rates):
    a, b = rates
    x = tone(0.5, a, 440.0, 0.5)
    out = filters.resample(chunk_frame(spark, {"t": x[None]}, 3000), a, b, "fast", segment=5000).orderBy("pos").collect()
    y = np.concatenate([np.array(r["pcm"][0]) for r in out])
    up, down = filters.ratio(a, b)
    assert len(y) == -(-len(x) * up // down) and [r["pos"] for r in out] == np.cumsum([0] + [r["n"] for r in out])[:-1].tolist()
    inner = slice(len(y) // 8, -len(y) // 8)
    assert np.abs(y - tone(0.5, b, 440.0, 0.5)[: len(y)])[inner].max() < 2e-3


def test_silence_boundaries_and_partitions(spark):
    loud, gap = np.full(1000, 0.5, np.float32), lambda n: np.zeros(n, np.float32)
    x = np.concatenate([loud, gap(99), loud, gap(100), loud, gap(101), loud, gap(500)])
    want = {(2099, 2199), (3199, 3300), (4300, 4800)}
    for size, partitions in ((64, 1), (37, 3), (4096, 8)):
        rows = chunk_frame(spark, {"t": np.array([x, x])}, size, partitions)
        assert {(r["from_sample"], r["to_sample"]) for r in silence.silence_spans(rows, -50, 100).collect()} == want
        total = silence.silence_totals(rows, -50, 100).first()
        assert (total["spans"], total["total_samples"], total["dropped"], total["dropped_samples"]) == (3, 701, 1, 99)


def test_minimum_frames_are_rounded_up():
    assert positions.min_frames(700_000_000, 44100) == 30870
    assert positions.min_frames(333_000_000, 44100) == 14686


def test_split_and_concat_are_the_identity(spark):
    x = np.random.default_rng(2).standard_normal((2, 9000)).astype(np.float32)
    rows, parts = chunk_frame(spark, {"t": x}, 1024), []
    for a, b in ((0, 2500), (2500, 7000), (7000, -1)):
        piece = timeline.slice_rows(rows, a, b).orderBy("pos").collect()
        assert piece[0]["pos"] == 0
        parts += [np.array(r["pcm"], dtype=np.float32) for r in piece]
    assert (np.concatenate(parts, axis=1) == x).all()


def test_rechunk_with_a_discontinuity(spark):
    rows = spark.createDataFrame(
        [("t", 0, 0, 5, False, [[0.0, 1.0, 2.0, 3.0, 4.0]]), ("t", 0, 5, 3, False, [[5.0, 6.0, 7.0]]), ("t", 0, 20, 4, True, [[20.0, 21.0, 22.0, 23.0]])],
        "source_id string, track_id int, pos bigint, n int, discont boolean, pcm array<array<float>>",
    )
    got = [(r["pos"], r["pcm"][0]) for r in frames.rechunk(rows, 3).orderBy("pos").collect()]
    assert got == [(0, [0.0, 1.0, 2.0]), (3, [3.0, 4.0, 5.0]), (6, [6.0, 7.0]), (20, [20.0, 21.0, 22.0]), (23, [23.0])]


def test_dither_is_triangular_and_positional(spark):
    noise = dither.tpdf(7, 0, np.arange(200_000))
    assert abs(noise.mean()) < 0.01 and noise.var() == pytest.approx(1 / 6, rel=0.02) and np.abs(noise).max() < 1
    assert (dither.tpdf(7, 0, np.arange(50_000, 60_000)) == noise[50_000:60_000]).all()
    assert dither.quantize(np.array([np.nan, 2.0, -2.0, 0.5], np.float32), 8)[0].tolist() == [0, 127, -128, 64]
    assert len(dither.shaped(tone(0.01), 16, noise[:480])) == 480


def test_release_closed_form_equals_the_recursion(spark):
    rng = np.random.default_rng(3)
    peaks = rng.uniform(0, 1, 300)
    rows = spark.createDataFrame([("t", k, float(p)) for k, p in enumerate(peaks)], "track string, k bigint, peak double")
    got = [r["gain"] for r in dynamics.release_envelope(rows, ("track",), "k", F.col("peak"), 0.5, 4, 0.05).orderBy("k").collect()]
    g, want = 1.0, []
    for k in range(300):
        m = min(1.0, 0.5 / max(peaks[k : k + 5]))
        g = min(m, g + (1 - g) * 0.05)
        want.append(g)
    assert np.allclose(got, want, atol=1e-9)


def test_limiter_holds_its_ceiling_and_compressor_resumes():
    x = np.array([tone(0.3, amplitude=2.0), tone(0.3, hz=440, amplitude=0.3)])
    y = dynamics.limit(x, 48000)
    assert np.abs(y).max() <= 10 ** (-1 / 20) + 1e-6
    whole, _ = dynamics.compress(x, 48000)
    first, state = dynamics.compress(x[:, :5000], 48000)
    second, _ = dynamics.compress(x[:, 5000:], 48000, state)
    assert np.allclose(np.concatenate([first, second], axis=1), whole)
    assert dynamics.compress(np.array([[np.inf, 0.1, np.nan, 0.1]], np.float32), 48000)[1] < 0


def test_mix_matrices():
    assert samples.mix_matrix(0x4, 2) == [[1.0], [1.0]]
    mono = samples.mix_matrix(0x3, 1)[0]
    assert np.allclose(mono, [math.sqrt(0.5)] * 2)
    for row in samples.mix_matrix(0x3F, 2):
        assert sum(c * c for c in row) <= 1 + 1e-12
    assert samples.mix_matrix(0x3F, 2)[0][3] == 0
    assert samples.max_matrix_gain([[0.5, -0.7], [0.1, 0.2]]) == pytest.approx(1.2)


def test_limiter_equals_the_plain_recursion():
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((2, 6000)) * rng.uniform(0, 1.5, 6000)).astype(np.float32)
    rate, ceiling = 8000, 10 ** (dynamics.CEILING_DB / 20)
    look, peak = round(dynamics.LOOK_AHEAD_S * rate), filters.frame_peaks(x, rate)
    g, rel = 1.0, []
    for k in range(x.shape[1]):
        m = min(1.0, ceiling / peak[k : k + look + 1].max())
        g = min(m, g + (1 - g) * dynamics.pole(dynamics.LIMITER_RELEASE_S, rate))
        rel.append(g)
    want = np.array(rel)
    for width in (look // 2 + 1, look - look // 2):
        padded = np.concatenate([np.full(width - 1, want[0]), want])
        want = np.array([padded[k : k + width].mean() for k in range(len(want))])
    assert np.allclose(dynamics.limit(x, rate), np.clip(x * want, -ceiling, ceiling), atol=1e-6)


def test_frame_peaks_are_those_of_the_true_peak_meter():
    rng = np.random.default_rng(5)
    for rate, n in ((48000, 1), (48000, 11), (96000, 100), (48000, 1000), (200000, 50)):
        x = rng.standard_normal((2, n)).astype(np.float32)
        got = filters.frame_peaks(x, rate)
        assert got.shape == (n,) and (got >= np.abs(x).max(axis=0)).all()
        # the meter also sees the points before the first sample, the detector those from each sample on
        assert got.max() <= filters.true_peak_of(x, rate) + 1e-12
    sine = np.sin(2 * np.pi * (np.arange(400) + 0.5) / 4)[None]
    assert np.abs(sine).max() < 0.71 and 0.98 < filters.frame_peaks(sine, 48000)[100:300].max() < 1.02


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8, 50])
def test_running_max(width):
    x = np.random.default_rng(width).standard_normal(50)
    assert (dynamics.running_max(x, width) == [x[k : k + width].max() for k in range(51 - width)]).all()


def test_peak_meter_of_integers_and_floats(spark):
    x = np.random.default_rng(6).standard_normal((2, 3000)).clip(-1, 1).astype(np.float32) * np.float32(0.5)
    ints = np.round(x * 32768).astype(np.int32)
    schema = "source_id string, track_id int, pos bigint, pcm array<array<int>>"
    rows = spark.createDataFrame([("t", 0, a, ints[:, a : a + 700].tolist()) for a in range(0, 3000, 700)], schema)
    got = filters.true_peak(rows, 48000, bits=16).first()["true_peak"]
    assert got == pytest.approx(filters.true_peak_of(ints / 32768, 48000), abs=1e-6)
    with pytest.raises(ValueError):
        filters.true_peak(rows, 0)


def test_dither_by_blocks_equals_the_formula():
    x = np.random.default_rng(7).standard_normal(20000).astype(np.float32)
    noise, top = dither.tpdf(3, 1, np.arange(20000) + 5), 1 << 15
    got, overs = dither.quantize(x, 16, noise)
    assert (got == np.clip(np.floor(x.astype(np.float64) * top + noise + 0.5), -top, top - 1)).all() and overs == (np.abs(x) > 1).sum()
    base = (3 ^ (2 * int(dither.GOLDEN))) % 2**64

    def unit(z):
        z = (z + int(dither.GOLDEN)) % 2**64
        z = (z ^ z >> 30) * int(dither.FIRST_MULTIPLIER) % 2**64
        z = (z ^ z >> 27) * int(dither.SECOND_MULTIPLIER) % 2**64
        return ((z ^ z >> 31) >> 11) * 2.0**-53

    for k in (0, 9000, 19999):
        at = (base ^ 0) + 2 * (k + 5)
        assert noise[k] == unit(at % 2**64) - unit((at + 1) % 2**64)
