import numpy as np
import pytest
from pyspark.sql import functions as F
from sampleloom.sources import containers, media, wavpack
from sampleloom.sources.pcm import Malformed
from test_sources import noise


@pytest.mark.parametrize("channels", [1, 2])
def test_words_round_trip(channels):
    rng = np.random.default_rng(channels)
    for scale in (0, 1, 3, 200, 1 << 20):
        for density in (0.02, 0.5, 1.0):
            x = (rng.standard_normal(400 * channels) * scale * (rng.random(400 * channels) < density)).astype(int).tolist()
            data = wavpack.write_words(x, [wavpack._Medians() for _ in range(channels)])
            assert wavpack.read_words(data, [wavpack._Medians() for _ in range(channels)], len(x)) == x


@pytest.mark.parametrize("terms", [(18, 17, 2), (1,), (8, 5), (-1,), (-2, 3), (-3, 18), ()])
def test_passes_undo_themselves(terms):
    x = np.cumsum(noise(6, 2, 300), axis=1)
    block = wavpack.encode_block(x, 0, 300, 44100, 16, wavpack.INITIAL | wavpack.FINAL, terms)
    assert (wavpack.decode_block(block)[0] == x).all()
    broken = bytearray(block)
    broken[len(block) * 3 // 4] ^= 4
    with pytest.raises((Malformed, EOFError)):
        wavpack.decode_block(bytes(broken))


@pytest.mark.parametrize("bits,channels", [(8, 1), (16, 2), (24, 2), (16, 5)])
def test_files_round_trip(bits, channels):
    smooth = (np.sin(np.arange(5000) / 30)[None] * (1 << bits - 2) * np.linspace(0.3, 1, channels)[:, None]).astype(np.int32)
    for x in (smooth, noise(bits, channels, 700), np.zeros((channels, 900), np.int32)):
        data = wavpack.write(x, 44100, bits, 2000)
        track, packets = containers.open_bytes(data)
        assert (track.channels, track.bit_depth, track.samples) == (channels, bits, x.shape[1])
        assert (np.concatenate([wavpack.decode_packet(data[a : a + n]) for _, _, _, a, n in packets], axis=1) == x).all()
    assert len(wavpack.write(smooth, 44100, bits)) < smooth.size * bits / 8 * 0.6


def test_table_round_trip(spark):
    x = noise(12, 2, 6000)
    rows = spark.createDataFrame([("t", 0, 0, 6000, False, (x / 32768).astype(np.float32).tolist())], "source_id string, track_id int, pos bigint, n int, discont boolean, pcm array<array<float>>")
    files = media.encode_files(rows, 44100, "wavpack").select("source_id", F.lit("wv").alias("ext"), F.col("data").alias("content"))
    out = media.decode_chunks(files).orderBy("pos").collect()
    assert (np.round(np.concatenate([np.array(r["pcm"]) for r in out], axis=1) * 32768).astype(int) == x).all()
