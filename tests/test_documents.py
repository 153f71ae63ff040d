import json

import numpy as np
from pyspark.sql import functions as F
from sampleloom.functions import documents, text
from sampleloom.operators import silence
from sampleloom.plans import packets as plan
from sampleloom.sources import media, pcm, vod
from test_signal import chunk_frame
from test_sources import noise


def test_descriptors_round_trip(spark):
    rows = spark.createDataFrame([("s", "flac", 48000, 0.5), (None, None, None, None)], "src string, format string, rate int, gain double")
    coded = rows.select("*", documents.encode_descriptor(F.struct("src", "format", "rate", "gain")).alias("d"))
    back = coded.select("d", documents.decode_descriptor(F.col("d")).alias("x")).collect()
    assert "=" not in back[0]["d"] and (back[0]["x"]["src"], back[0]["x"]["rate"], back[0]["x"]["gain"]) == ("s", 48000, 0.5)
    assert back[1]["x"]["src"] is None
    bad = spark.createDataFrame([("***",)], "d string").select(documents.decode_descriptor(F.col("d")).alias("x")).first()
    assert bad["x"] is None or bad["x"]["src"] is None


def test_probe_and_silence_documents(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(pcm.write_wav(noise(16, 2, 441), 44100))
    tracks = media.probe(media.read_sources(spark, str(tmp_path)))
    d = json.loads(documents.probe_json(tracks).first()["document"])
    assert d["container"] == "wav" and d["tracks"][0]["durationSeconds"] == 0.01
    x = np.concatenate([np.full(100, 0.5, np.float32), np.zeros(50, np.float32), np.full(10, 0.5, np.float32), np.zeros(5, np.float32)])
    chunks = chunk_frame(spark, {"t": x[None]}, 64)
    keys = ["source_id", "track_id"]
    d = json.loads(documents.silence_map_json(silence.silence_spans(chunks, -50, 20), silence.silence_totals(chunks, -50, 20), keys, -50.0, 0.2, 100).first()["document"])
    assert d["spans"] == [{"fromSample": 100, "toSample": 150, "fromSeconds": 1.0, "toSeconds": 1.5}] and d["dropped"] == 1 and d["droppedSeconds"] == 0.05


def test_jobs_uploads_metrics(spark):
    events = [("a", 1, "running"), ("a", 2, "done"), ("a", 3, "running"), ("b", 1, "done"), ("c", 1, "canceled")]
    got = {r["job_id"]: r["state"] for r in documents.replay_jobs(spark.createDataFrame(events, "job_id string, at int, state string")).collect()}
    assert got == {"a": "done", "b": "queued", "c": "canceled"}
    uploads = spark.createDataFrame([("x", 0, False), ("y", 0, True), ("z", 95, False)], "id string, received_s bigint, consumed boolean")
    assert [r["id"] for r in documents.expired_uploads(uploads, F.lit(100), 60).collect()] == ["x"]
    rows = spark.createDataFrame([("b", "counter", {"k": 'v"'}, 2), ("a", "gauge", {}, 1)], "name string, kind string, labels map<string,string>, value bigint")
    assert documents.prometheus_text(rows).first()["text"] == '# TYPE a gauge\na 1\n# TYPE b counter\nb{k="v\\""} 2\n'


def test_lyrics_and_seek_index(spark):
    rows = spark.createDataFrame([("[ti:x]\n[00:12.50][01:02]Hello\r\n[00:01.005] first\nplain",)], "t string")
    got = rows.select(documents.synced_lyrics(F.col("t")).alias("l")).first()["l"]
    assert [(x["ms"], x["text"]) for x in got] == [(1005, "first"), (12500, "Hello"), (62000, "Hello")]
    packets = spark.createDataFrame([("t", k, 10, k % 3 == 0) for k in range(30)], "track string, seq bigint, dur bigint, sync boolean")
    index = documents.seek_index(plan.with_pts(packets, ["track"]), ["track"], 100).orderBy("pts").collect()
    assert [(r["pts"], r["seq"]) for r in index] == [(0, 0), (120, 12), (210, 21)]


def test_vod_is_the_concatenation_of_its_segments(spark, tmp_path):
    x = noise(16, 1, 9000)
    names = []
    for k, (a, b) in enumerate(((0, 4000), (4000, 4100), (4100, 9000))):
        names.append(f"s{k}.wav")
        (tmp_path / names[-1]).write_bytes(pcm.write_wav(x[:, a:b], 8000))
    (tmp_path / "v.m3u8").write_text("#EXTM3U\n" + "".join(f"{'#EXT-X-DISCONTINUITY' + chr(10) if k == 2 else ''}#EXTINF:1,\n{n}\n" for k, n in enumerate(names)) + "#EXT-X-ENDLIST\n")
    (tmp_path / "m.m3u8").write_text('#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=1,CODECS="x"\nv.m3u8\n')
    rows = vod.open_vod(spark, str(tmp_path / "m.m3u8")).orderBy("pos").collect()
    assert (np.round(np.concatenate([np.array(r["pcm"][0]) for r in rows]) * 32768).astype(int) == x[0]).all()
    assert [r["pos"] for r in rows if r["discont"]] == [4100]


def test_master_playlist(spark):
    rows = spark.createDataFrame([([(5, "a,b", "v")],)], "v array<struct<bandwidth:int,codecs:string,uri:string>>")
    assert rows.select(text.master_playlist(F.col("v")).alias("t")).first()["t"].endswith('#EXT-X-STREAM-INF:BANDWIDTH=5,CODECS="a,b"\nv\n')
