import json

import numpy as np
from sampleloom.__main__ import NOTHING, main
from sampleloom.functions import sql
from sampleloom.sources import flac, pcm
from test_signal import tone
from test_sources import noise


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    x = (np.array([tone(1.0, 48000, amplitude=0.5)] * 2) * 32767).astype(np.int32)
    (tmp_path / "in" / "a.wav").write_bytes(pcm.write_wav(x, 48000))
    assert main(["probe", str(tmp_path / "in")], spark) == 0
    assert json.loads(capsys.readouterr().out)["tracks"][0]["samples"] == 48000
    assert main(["analyze", str(tmp_path / "in")], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert abs(got["sample_peak_db"] + 6.02) < 0.05 and abs(got["lufs"] + 6.02) < 0.1
    assert main(["split", str(tmp_path / "in"), str(tmp_path / "out"), "--at", "1000", "40000"], spark) == 0
    parts = []
    for k in (1, 2, 3):
        data = (tmp_path / "out" / f"a-{k:02d}.flac").read_bytes()
        parts += [p for *_, p in flac.frames(data, flac.parse(data))]
    assert (np.concatenate(parts, axis=1) == x).all()
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.txt").write_text("hello")
    assert main(["probe", str(tmp_path / "none")], spark) == NOTHING


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT audio_gcd(44100L, 48000L) AS g, audio_crc16(CAST('123456789' AS BINARY)) AS c, audio_ulid(1700000000000L, 'a') AS u, audio_hmac_sha256('k', 'm') AS h").first()
    assert (row["g"], row["c"], len(row["u"]), len(row["h"])) == (300, 0xFEE8, 26, 64)


def test_delivery_is_verified(spark):
    chunks = spark.createDataFrame([("a", 0, 10), ("a", 10, 5), ("b", 0, 10), ("b", 12, 5), ("c", 3, 7)], "t string, pos bigint, n int")
    declared = spark.createDataFrame([("a", 15), ("b", 15), ("c", 7), ("d", 4)], "t string, samples bigint")
    got = {r["t"]: (r["delivered"], r["gaps"]) for r in sql.verify_lengths(chunks, declared, ["t"]).collect()}
    assert got == {"b": (15, 2), "c": (7, 3), "d": (0, 0)}
    assert noise(8, 1, 3).shape == (1, 3)
