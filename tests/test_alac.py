import numpy as np
import pytest
from sampleloom.sources import alac, containers, mux
from sampleloom.sources.pcm import Track
from test_sources import noise


@pytest.mark.parametrize("bits,channels", [(16, 1), (16, 2), (24, 2), (20, 3), (32, 1)])
def test_frames_round_trip(bits, channels):
    c = alac.Config(512, bits, channels, 48000)
    assert alac.Config.parse(c.cookie()) == c
    smooth = (np.sin(np.arange(512) / 25)[None] * (1 << bits - 2) * np.linspace(0.5, 1, channels)[:, None]).astype(np.int32)
    sparse = np.zeros((channels, 512), np.int32)
    sparse[:, 200] = 5
    for x in (smooth, noise(bits, channels, 512), np.zeros((channels, 512), np.int32), sparse, noise(8, channels, 77), noise(bits, channels, 1)):
        packet = alac.encode_frame(x, c)
        assert (alac.decode_frame(packet, c) == x).all()
    assert len(alac.encode_frame(smooth, c)) < smooth.size * bits / 8 * (0.7 if bits < 32 else 0.85)


def test_in_mp4():
    c = alac.Config(512, 16, 2, 44100)
    x = noise(10, 2, 1200)
    packets = [(alac.encode_frame(x[:, a : a + 512], c), min(512, 1200 - a)) for a in range(0, 1200, 512)]
    data = mux.mux_mp4(Track("mp4", "alac", 44100, 2, "int", 16, config=c.cookie()), packets)
    track, rows = containers.open_bytes(data)
    config = alac.Config.parse(track.config)
    planes = np.concatenate([alac.decode_frame(data[a : a + n], config) for _, _, _, a, n in rows], axis=1)
    assert track.codec == "alac" and (planes == x).all()


def test_file_of_a_table(spark):
    from pyspark.sql import functions as F
    from sampleloom.sources import media

    x = noise(10, 2, 5000)
    rows = spark.createDataFrame([("t", 0, 0, 5000, False, (x / 32768).astype(np.float32).tolist())], "source_id string, track_id int, pos bigint, n int, discont boolean, pcm array<array<float>>")
    files = media.encode_files(rows, 44100, "alac").select("source_id", F.lit("m4a").alias("ext"), F.col("data").alias("content"))
    chunks = media.decode_chunks(files).orderBy("pos").collect()
    planes = np.concatenate([np.array(r["pcm"]) for r in chunks], axis=1)
    assert (np.round(planes * 32768).astype(int) == x).all()
