import numpy as np
import pytest
from pyspark.sql import functions as F
from sampleloom.plans.concat import concat
from sampleloom.streaming import meters
from test_signal import chunk_frame


def whole(rows):
    rows = sorted(rows, key=lambda r: r["pos"])
    assert [r["pos"] for r in rows] == np.cumsum([0] + [r["n"] for r in rows])[:-1].tolist()
    return np.concatenate([np.array(r["pcm"], dtype=np.float32) for r in rows], axis=1)


@pytest.mark.parametrize("size,partitions", [(1000, 1), (777, 5)])
def test_cut_and_rejoined_signal_is_identical(spark, size, partitions):
    x = np.random.default_rng(0).standard_normal((2, 9000)).astype(np.float32)
    chunks = chunk_frame(spark, {"s": x}, size, partitions)
    members = spark.createDataFrame([("t", 1, "s", 0, 2500), ("t", 2, "s", 2500, 2600), ("t", 3, "s", 2600, 9000), ("u", 1, "s", 100, 200)], "timeline string, idx bigint, source_id string, from_sample bigint, to_sample bigint")
    out = concat(chunks, members, ["timeline"]).collect()
    assert (whole([r for r in out if r["timeline"] == "t"]) == x).all()
    assert (whole([r for r in out if r["timeline"] == "u"]) == x[:, 100:200]).all()


@pytest.mark.parametrize("size,partitions", [(1000, 1), (333, 4)])
def test_crossfades_blend_and_keep_length(spark, size, partitions):
    rng = np.random.default_rng(1)
    tracks = {k: rng.standard_normal((1, n)).astype(np.float32) for k, n in (("a", 3000), ("b", 2500), ("c", 6000))}
    members = spark.createDataFrame([("t", k, s, 0, tracks[s].shape[1]) for k, s in enumerate("abc")], "timeline string, idx bigint, source_id string, from_sample bigint, to_sample bigint")
    y = whole(concat(chunk_frame(spark, tracks, size, partitions), members, ["timeline"], 1000).collect())
    assert y.shape == (1, 11500 - 2000)
    angle = np.arange(1000) * np.pi / 2000
    assert np.allclose(y[0, 2000:3000], tracks["a"][0, 2000:] * np.cos(angle) + tracks["b"][0, :1000] * np.sin(angle), atol=1e-6)
    assert (y[0, :2000] == tracks["a"][0, :2000]).all() and (y[0, 3000:3500] == tracks["b"][0, 1000:1500]).all() and (y[0, 4500:] == tracks["c"][0, 1000:]).all()


def test_windowed_energy_drops_late_rows(spark, tmp_path):
    """Three runs of one query: the row that comes hours behind the watermark changes nothing."""
    (tmp_path / "in").mkdir()
    out = []
    stream = spark.readStream.schema("track string, ts timestamp, value double").json(str(tmp_path / "in"))
    batches = [
        [("t", "2024-01-01 00:00:01", 1.0), ("t", "2024-01-01 00:00:30", 2.0)],
        [("t", "2024-01-01 01:00:00", 3.0)],
        [("t", "2024-01-01 00:00:02", 9.0), ("t", "2024-01-01 02:00:00", 1.0)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, "track string, ts string, value double").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        writer = meters.windowed_energy(stream, "1 minute").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
        query = writer.foreachBatch(lambda df, _: out.extend((r["n"], r["energy"]) for r in df.collect())).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert sorted(out) == [(1, 9.0), (2, 5.0)]


def test_sessions_of_a_batch(spark):
    rows = spark.createDataFrame([("t", "2024-01-01 00:00:00", 1.0), ("t", "2024-01-01 00:00:04", 1.0), ("t", "2024-01-01 00:01:00", 1.0)], "track string, ts string, value double")
    got = meters.sessions(rows.withColumn("ts", F.col("ts").cast("timestamp")), "10 seconds").collect()
    assert sorted(r["n"] for r in got) == [1, 2]
