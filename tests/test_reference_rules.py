"""Rules that a green comparison hid before, because its SQL had been written from the code."""

import hashlib
import hmac

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F
from sampleloom.functions import text as fn
from sampleloom.operators import filters, loudness
from sampleloom.plans import packets as plan

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_true_peak_at_192_khz_is_oversampled():
    at = np.arange(2000)
    wave = np.sin(np.pi / 2 * at + np.pi / 4)[None, :]
    for rate, low, high in ((48_000, 0.99, 1.02), (96_000, 0.99, 1.02), (192_000, 0.99, 1.02), (192_001, 0.70, 0.71)):
        assert low < filters.true_peak_of(wave, rate, False, False) < high


def test_loudness_range_keeps_a_power_that_ties_with_the_gate(spark):
    """The lower power is exactly a hundredth of the mean of both."""
    rows = spark.createDataFrame([(1, 1.0), (1, 199.0)], "track int, power double")
    assert abs(loudness.loudness_range(rows, ["track"]).first()["lra"] - 10 * np.log10(199)) < 1e-9


def test_fixed_width_of_gains_and_peaks(spark):
    texts = one(spark, *[fn.format_gain(F.lit(x)).alias(f"g{k}") for k, x in enumerate((-3.1, -120.0, 250.0, 0.0))], *[fn.format_peak(F.lit(x)).alias(f"p{k}") for k, x in enumerate((0.5, -1.0, 12.0))])
    assert list(texts) == ["-03.10 dB", "-99.99 dB", "+99.99 dB", "+00.00 dB", "0.500000", "0.000000", "9.999999"]


def test_gain_is_bounded_by_the_ceiling_alone_and_albums_fall_back(spark):
    tags = F.create_map(F.lit("REPLAYGAIN_TRACK_GAIN"), F.array(F.lit("20 dB")), F.lit("REPLAYGAIN_TRACK_PEAK"), F.array(F.lit("1.0")))
    modes = ("fixed", "track", "album", "off")
    got = one(spark, *[fn.resolve_gain(F.lit(m), F.lit(5.0), tags).alias(m) for m in modes], fn.resolve_gain(F.lit("track"), F.lit(0.0), tags, 16.0).alias("voice"))
    assert list(got) == [5.0, 12.0, 12.0, 0.0, 16.0]


def test_bandwidth_divides_before_it_multiplies(spark):
    rate = lambda bits, depth: plan.peak_bandwidth(F.lit(bits), F.lit(44_100), F.lit(1024), F.lit(2), F.lit(depth))
    assert list(one(spark, rate(128_000, 16).alias("a"), rate(0, 0).alias("b"), rate(0, 24).alias("c"))) == [128_000 + 43 * 64 + 2000, 44_100 * 32 + 43 * 64 + 2000, 44_100 * 48 + 43 * 64 + 2000]


def test_grid_of_short_tracks(spark):
    rows = [(1, 0, 960), (2, 0, 960), (2, 1, 500), (3, 0, 0), (3, 1, 0), (4, 0, 960), (4, 1, 480), (4, 2, 960)]
    got = {r["t"]: r["grid"] for r in plan.packet_grid(spark.createDataFrame(rows, "t int, seq long, dur long"), ["t"]).collect()}
    assert got == {1: 0, 2: 960, 3: 0, 4: 0}


def test_trailers_never_fall_below_zero(spark):
    rows = spark.createDataFrame([(100, 200, 10, 5), (10, -1, 20, 5), (100, -1, 20, 5), (100, 60, 20, 5), (100, 60, 0, 5)], "d long, s long, l long, p long")
    samples, padding = plan.remux_trailer(F.col("d"), F.col("s"), F.col("l"), F.col("p"))
    assert [tuple(r) for r in rows.select(samples.alias("s"), padding.alias("p")).collect()] == [(200, 0), (0, 5), (75, 5), (60, 20), (60, 5)]


def spans_of(spark, rows):
    return spark.createDataFrame(rows, "t int, idx int, from_sample long, to_sample long, grid long, delay long, samples long, padding long")


def test_cut_refuses_what_the_packets_cannot_express(spark):
    packets = plan.with_pts(spark.createDataFrame([(t, k, 12 if (t, k) == (2, 3) else 8) for t in range(1, 4) for k in range(10)], "t int, seq long, dur long"), ["t"])
    spans = [(t, 0, 8, 24, 8, 0, 80, 0) for t in (1, 2, 3)] + [(1, 1, 40, -1, 8, 0, 80, 0), (2, 1, 40, -1, 8, 0, 84, 0), (3, 1, 30, -1, 8, 0, 80, 0)]
    cut = plan.cut_spans(spans_of(spark, spans), ["t"], 0)
    got = [tuple(r) for r in plan.cut_packets(packets, cut, ["t"]).orderBy("t", "seq").collect()]
    assert got[:7] == [(1, 0, 1, 8, 0, None), (1, 0, 2, 8, 8, None)] + [(1, 1, k, 8, 8 * (k - 3), None) for k in range(5, 10)]
    assert got[7] == (2, None, None, None, None, "unsupported-format") and {r[0] for r in got[8:]} == {3}


def test_cut_spans_are_validated(spark):
    big = 1 << 61
    bad = [
        (1, 0, -1, 8, 8, 0, 80, 0), (2, 0, 8, 8, 8, 0, 80, 0), (3, 0, 8, 4, 8, 0, 80, 0), (4, 0, 8, -2, 8, 0, 80, 0), (5, 0, 0, -1, 8, 0, 80, 0), (5, 1, 40, 48, 8, 0, 80, 0),
        (6, 0, 0, big, 8, 0, -1, 0), (7, 0, 80, -1, 8, 0, 80, 0), (8, 0, 0, 81, 8, 0, 80, 0), (9, 0, 0, 24, 8, 0, 80, 0), (9, 1, 16, 40, 8, 0, 80, 0),
    ]
    declined = [(11, 0, 0, 8, 0, 0, 80, 0), (12, 0, 0, 8, 8, -1, 80, 0), (13, 0, 0, 10, 8, 0, 80, 0), (13, 1, 12, 40, 8, 0, 80, 0), (14, 0, 0, 77, 8, 0, 78, 0)]
    fine = [(21, 0, 0, -1, 8, 4, -1, 3), (22, 0, 8, 78, 8, 4, 78, 0)]
    out = {r["t"]: r for r in plan.cut_result(plan.cut_spans(spans_of(spark, bad + declined + fine), ["t"], 16), ["t"]).collect()}
    assert {t for t, r in out.items() if r["error"] == "invalid-request"} == set(range(1, 10))
    assert {t for t, r in out.items() if r["error"] == "unsupported-format"} == {11, 12, 13, 14}
    assert tuple(out[21])[1:] == (4, 3, -1, None) and tuple(out[22])[1:] == (12, 0, 70, None)


def test_signatures_are_those_of_the_library(spark):
    """The registered query against the standard library: what is signed, and how long it holds."""
    import __spark_entry__

    rows = __spark_entry__.queries()["signed_urls"](spark, SF).collect()
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    assert len(rows) == len(urls)
    for r in rows:
        ttl = int(max(6 * 3600, 2 * r["page_id"]))
        message = "\n".join(x for x in (urls[r["page_id"]], "a=1&b=2", str(1_700_000_000 + ttl)) if x is not None)
        assert r["sig"] == hmac.new(b"key", message.encode(), hashlib.sha256).hexdigest()
        assert (r["soon"], r["late"]) == tuple(None if at <= ttl + 60 else "signature-expired" for at in (3600, 86400))
