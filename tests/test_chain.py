import numpy as np
import pytest
from sampleloom.operators import dynamics, psycho
from sampleloom.plans import chain
from test_signal import chunk_frame, tone


def test_only_needed_nodes():
    names = lambda **k: chain.Chain(chain.Spec(44100, 0x3, **k)).names
    assert names(out_bits=16) == []
    assert names(out_bits=24) == ["widen"]
    assert names(out_bits=8) == ["dither"]
    assert names() == ["convert"]
    assert names(out_bits=16, gain_db=-3.0) == ["convert", "gain", "dither"]
    assert names(out_bits=16, gain_db=3.0) == ["convert", "gain", "limiter", "dither"]
    assert names(out_rate=48000, out_channels=1, dynamics="voice", out_bits=16) == ["convert", "resample", "mix", "dynamics", "limiter", "dither"]
    full = chain.Chain(chain.Spec(44100, 0x3, out_rate=48000, dynamics="voice", out_bits=16))
    assert full.horizon > dynamics.horizon_frames([0.25, 0.05], 48000) and full.output_samples(44101) == 48002 and len(full.versions) == 5


def test_chain_does_not_depend_on_chunks(spark):
    x = np.array([tone(2, amplitude=1.4), tone(2, hz=440, amplitude=0.4)])
    c = chain.Chain(chain.Spec(48000, 0x3, "float", 32, out_channels=1, gain_db=2.0, dynamics="voice", out_bits=16, seed=3))
    results = []
    for size, partitions in ((4096, 1), (5000, 5)):
        rows = c.run(chunk_frame(spark, {"t": x}, size, partitions)).orderBy("pos").collect()
        results.append(np.concatenate([np.array(r["pcm"][0]) for r in rows]))
    assert len(results[0]) == 96000 and (results[0] == results[1]).all() and np.abs(results[0]).max() <= 32768 * 10 ** (-1 / 20) + 1


def test_transcode_plans(spark):
    rows = spark.createDataFrame(
        [("flac", 44100, 6, 16, 441000, 0, 0, 0, 0), ("opus", 44100, 6, 16, 441000, 0, 0, 0, 0), ("wav", 44100, 2, 16, 441000, 48000, 0, 24, 0), ("flac", 44100, 2, 16, 1, 0, 0, 0, 128000), ("xyz", 1, 1, 1, 1, 0, 0, 0, 0)],
        "fmt string, rate int, channels int, bit_depth int, samples bigint, want_rate int, want_channels int, want_bits int, bitrate int",
    )
    got = [(r["out_rate"], r["out_channels"], r["out_samples"], r["out_bitrate"], r["error"] and r["error"]["code"]) for r in chain.plan_transcode(rows).collect()]
    assert got[0] == (44100, 6, 441000, 44100 * 6 * 16, None)
    assert got[1] == (48000, 2, 480000, 128000, None)
    assert got[2][:3] == (48000, 2, 480000)
    assert got[3][4] == "invalid-request" and got[4][4] == "unsupported-format"


def test_two_pass_gain(spark):
    rows = spark.createDataFrame([("a", -23.0), ("b", float("-inf")), ("c", -70.0)], "t string, lufs double")
    assert [r["gain_db"] for r in chain.two_pass_gain(rows).orderBy("t").collect()] == [5.0, 0.0, 24.0]


def test_masking(spark):
    loud, soft = psycho.analyze(tone(0.05)[:2048].astype(float), 48000), psycho.analyze(np.zeros(2048), 48000)
    assert loud[2] > soft[2] == 0 and (loud[0] >= soft[0]).all()
    assert psycho.bark(1000) == pytest.approx(8.5, abs=0.3) and psycho.quiet_threshold_db(3300) < psycho.quiet_threshold_db(100)
    rows = psycho.masking(chunk_frame(spark, {"t": tone(0.2)[None]}, 2048), 48000).collect()
    assert len(rows) == 5 and len(rows[0]["threshold"]) == psycho.BANDS


def test_member_is_brought_to_the_timelines_format():
    same = chain.Chain(chain.member_spec(48000, 0x3, "int", 16, 48000, 2, "int", 16))
    assert same.names == []
    other = chain.Chain(chain.member_spec(44100, 0x4, "int", 16, 48000, 2, "int", 24))
    assert other.names[:3] == ["convert", "resample", "mix"] and other.names[-1] == "dither"
    wide = chain.Chain(chain.member_spec(48000, 0x3, "int", 16, 48000, 2, "float", 32))
    assert wide.names == ["convert"]
