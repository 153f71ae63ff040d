import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from sampleloom.functions import cue, media as media_functions
from sampleloom.sources import bits, containers, flac, media, pcm
from sampleloom.streaming import live, meters


def noise(bits_, channels, n, seed=0):
    return np.random.default_rng(seed).integers(-(1 << bits_ - 1), 1 << bits_ - 1, (channels, n)).astype(np.int32)


@pytest.mark.parametrize("depth,channels", [(8, 1), (16, 2), (20, 2), (24, 6), (32, 2)])
def test_pcm_round_trips(depth, channels):
    x = noise(depth, channels, 501)
    for write, parse in ((pcm.write_wav, pcm.parse_wav), (pcm.write_aiff, pcm.parse_aiff)):
        data = write(x, 44100, depth)
        t = parse(data)
        assert (t.rate, t.channels, t.bit_depth, t.samples) == (44100, channels, depth, 501)
        assert (pcm.decode(t, data[t.data_at : t.data_at + t.data_bytes]) == x).all()


@pytest.mark.parametrize("depth", [8, 16, 24])
def test_flac_round_trips(depth):
    smooth = (np.sin(np.arange(5000) / 30) * (1 << depth - 2)).astype(np.int32)
    for x in (noise(depth, 1, 3000), np.array([smooth, smooth + 1]), np.zeros((2, 100), np.int32), noise(depth, 2, 1)):
        data = flac.write(x, 48000, depth, 1152)
        t = flac.parse(data)
        assert (np.concatenate([p for *_, p in flac.frames(data, t)], axis=1) == x).all() and t.samples == x.shape[1]
    broken = bytearray(data)
    broken[-3] ^= 1
    with pytest.raises((pcm.Malformed, EOFError)):
        list(flac.frames(bytes(broken), t))


def test_flac_predictors_and_stereo_modes():
    """Frames with LPC, wasted bits and mid/side, built bit by bit."""
    w = bits.BitWriter()
    for v, n in ((0x7FFC, 15), (0, 1), (6, 4), (0, 4), (10, 4), (4, 3), (0, 1), (0, 8), (7, 8)):
        w.put(v, n)
    w.put(bits.crc8(w.bytes()), 8)
    w.put(32 << 1 | 1, 8)  # LPC order 1, wasted bits follow
    w.unary(0)
    w.put(100, 15)
    for v, n in ((11, 4), (10, 5), (1 << 10, 12), (0, 2), (0, 4), (0, 4)):
        w.put(v, n)
    for _ in range(7):
        w.unary(2)  # +1
    w.put(0, 8)
    w.put(-6, 17)
    body = w.bytes()
    planes, pos, size = flac.decode_frame(body + struct.pack(">H", bits.crc16(body)), pcm.Track("flac", "flac", 48000, 2))
    mid = np.arange(100, 108) * 2
    assert planes.tolist() == [(mid - 3).tolist(), (mid + 3).tolist()] and (pos, size) == (0, len(body) + 2)


def ogg_page(body, granule, flags=0, serial=1, lacing=None):
    lacing = lacing or [255] * (len(body) // 255) + [len(body) % 255]
    return b"OggS" + struct.pack("<BBqIIIB", 0, flags, granule, serial, 0, 0, len(lacing)) + bytes(lacing) + body


def box(kind, body):
    return struct.pack(">I", len(body) + 8) + kind + body


def ebml(kind, body):
    return kind + bytes([0x10 | len(body) >> 24, len(body) >> 16 & 255, len(body) >> 8 & 255, len(body) & 255]) + body


def samples():
    mp3 = b"".join(bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(413) for _ in range(3))
    adts = b"".join(bytes([0xFF, 0xF1, 0x50, 0x80, 0x02, 0x1F, 0xFC]) + bytes(9) for _ in range(4))
    head = b"OpusHead" + struct.pack("<BBHIHB", 1, 2, 312, 48000, 0, 0)
    ogg = ogg_page(head, 0, 2) + ogg_page(b"OpusTags" + struct.pack("<I", 0) + struct.pack("<I", 1) + struct.pack("<I", 7) + b"title=x", 0) + ogg_page(b"\xfc" + bytes(300), 1920)
    stbl = (
        box(b"stsd", struct.pack(">II", 0, 1) + box(b"mp4a", bytes(16) + struct.pack(">HH", 2, 16) + bytes(4) + struct.pack(">I", 44100 << 16) + b"esds"))
        + box(b"stts", struct.pack(">IIII", 0, 1, 3, 1024)) + box(b"stsc", struct.pack(">IIIII", 0, 1, 1, 2, 1)) + box(b"stsz", struct.pack(">IIIIII", 0, 0, 3, 10, 20, 30)) + box(b"stco", struct.pack(">IIII", 0, 2, 100, 200))
    )
    mdia = box(b"mdhd", struct.pack(">IIIII", 0, 0, 0, 44100, 3072)) + box(b"hdlr", bytes(8) + b"soun") + box(b"minf", box(b"stbl", stbl))
    mp4 = box(b"ftyp", b"M4A ") + box(b"moov", box(b"trak", box(b"mdia", mdia)))
    audio = ebml(b"\xe1", ebml(b"\xb5", struct.pack(">d", 48000)) + ebml(b"\x9f", b"\x02"))
    cluster = ebml(b"\x1f\x43\xb6\x75", ebml(b"\xe7", b"\x00") + b"".join(ebml(b"\xa3", b"\x81" + struct.pack(">h", t) + b"\x80abc") for t in (0, 20, 40)))
    mka = ebml(b"\x1a\x45\xdf\xa3", b"") + ebml(b"\x18\x53\x80\x67", ebml(b"\x16\x54\xae\x6b", ebml(b"\xae", ebml(b"\x86", b"A_OPUS") + audio)) + cluster)
    wavpack = b"".join(b"wvpk" + struct.pack("<IHBBIIIII", 24 + 8, 0x410, 0, 0, 200, k * 100, 100, 1 | 0x1800 | 9 << 23, 0) + bytes(8) for k in range(2))
    ape = b"MAC " + struct.pack("<HHIII", 3990, 0, 52, 24, 8) + bytes(32) + struct.pack("<HHIIIHHI", 2000, 0, 73728, 100, 2, 16, 2, 44100) + struct.pack("<II", 84, 90) + bytes(16)
    return {"mp3": (mp3, 3, 44100), "adts": (adts, 4, 44100), "ogg": (ogg, 1, 48000), "mp4": (mp4, 3, 44100), "mka": (mka, 3, 48000), "wavpack": (wavpack, 2, 44100), "ape": (ape, 2, 44100)}


@pytest.mark.parametrize("name", ["mp3", "adts", "ogg", "mp4", "mka", "wavpack", "ape"])
def test_headers_and_packets(name):
    data, count, rate = samples()[name]
    track, packets = containers.open_bytes(data)
    rows = list(packets)
    assert (track.container, track.rate, len(rows)) == (name, rate, count)
    assert [r[0] for r in rows] == np.cumsum([0] + [r[1] for r in rows])[:-1].tolist() or name in ("ape",)


def test_hostile_bytes_are_malformed_not_crashes():
    rng = np.random.default_rng(5)
    for data, *_ in list(samples().values()) + [(pcm.write_wav(noise(16, 2, 50), 8000), 0, 0), (pcm.write_aiff(noise(16, 1, 50), 8000), 0, 0), (flac.write(noise(16, 1, 50), 8000), 0, 0)]:
        for _ in range(60):
            x = bytearray(data[: rng.integers(0, len(data) + 1)])
            for k in rng.integers(0, max(len(x), 1), 3):
                if len(x):
                    x[k] = rng.integers(0, 256)
            try:
                track, packets = containers.open_bytes(bytes(x))
                for _, _ in zip(packets, range(100)):
                    pass
            except pcm.Malformed:
                continue


def test_files_to_tables_and_back(spark, tmp_path):
    x = noise(16, 2, 10_000, 1)
    for name, data in (("a.wav", pcm.write_wav(x, 44100)), ("b.aiff", pcm.write_aiff(x, 44100)), ("c.flac", flac.write(x, 44100)), ("d.bin", b"junk")):
        (tmp_path / name).write_bytes(data)
    sources = media.read_sources(spark, str(tmp_path))
    tracks = media.probe(sources).join(sources.select("source_id", "ext", "identity"), "source_id").orderBy("ext").collect()
    assert [(t["container"], t["samples"], t["rate"]) for t in tracks] == [("aiff", 10_000, 44100), ("flac", 10_000, 44100), ("wav", 10_000, 44100)]
    chunks = media.decode_chunks(sources)
    ints = chunks.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("pos", "pcm"))).alias("c")).collect()
    for r in ints:
        y = np.concatenate([np.array(c["pcm"]) for c in r["c"]], axis=1)
        assert (np.round(y * 32768).astype(int) == x).all()
    assert media.packets(sources).groupBy("source_id").agg(F.sum("dur").alias("d")).where("d = 10000").count() == 3
    files = media.encode_files(chunks, 44100, "wav").collect()
    assert all((pcm.decode(t := pcm.parse_wav(f["data"]), f["data"][t.data_at :]) == x).all() for f in files)


def test_data_source_reads_ranges_and_writes_files(spark, tmp_path):
    media.register(spark)
    x = noise(16, 1, 50_000, 2)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes(pcm.write_wav(x, 8000))
    rows = spark.read.format("sampleloom-pcm").option("frames", 10_000).load(str(tmp_path / "in"))
    assert rows.agg(F.sum("n")).first()[0] == 50_000
    part = rows.where("pos >= 20000 AND pos < 30000").orderBy("pos").collect()
    assert sum(r["n"] for r in part) == 10_000 and round(part[0]["pcm"][0][0] * 32768) == x[0, 20_000]
    spark.createDataFrame([("x.bin", b"abc"), ("y.bin", b"")], "name string, data binary").write.format("sampleloom-pcm").mode("append").save(str(tmp_path / "out"))
    assert (tmp_path / "out" / "x.bin").read_bytes() == b"abc"


def test_sniffers_agree(spark):
    data = [(n, d) for n, (d, *_) in samples().items()] + [("wav", pcm.write_wav(noise(8, 1, 9), 8000)), ("flac", flac.write(noise(8, 1, 9), 8000, 8)), (None, b""), (None, b"ID3")]
    data.append(("ape", b"ID3\x04\x00\x00\x00\x00\x00\x03abc" + samples()["ape"][0]))
    got = spark.createDataFrame(data, "want string, data binary").select("want", media_functions.sniff(F.col("data")).alias("got"), "data").collect()
    assert all(r["want"] == r["got"] == containers.sniff(bytes(r["data"])) for r in got)


CUE = """REM GENRE x
PERFORMER "The Band"
TITLE "Album"
FILE "a b.wav" WAVE
  TRACK 01 AUDIO
    TITLE "One"
    INDEX 01 00:00:00
  TRACK 02 AUDIO
    TITLE "Two"
    PREGAP 00:02:00
    FLAGS DCP
    INDEX 00 03:59:00
    INDEX 01 04:00:37
"""


def test_cue_sheets(spark):
    rows = cue.parse_sheets(spark.createDataFrame([("good", CUE), ("bad", "TRACK 01 AUDIO"), ("empty", None)], "path string, text string"))
    got = {r["path"]: r for r in rows.collect()}
    assert got["bad"]["error"] == "TRACK before FILE" and got["empty"]["tracks"] == []
    assert got["good"]["tracks"][1]["pregap"] == 150 and got["good"]["tracks"][1]["performer"] == "The Band"
    cuts = cue.track_cuts(cue.track_starts(rows.where("error IS NULL")), 44100).collect()
    assert [(r["file"], r["cut"]) for r in cuts] == [("a b.wav", (4 * 60 * 75 + 37) * 588)]


def playlist(first, names, ended=False):
    body = "".join(f"#EXTINF:4.0,\n{n}\n" for n in names)
    return f"#EXTM3U\n#EXT-X-TARGETDURATION:4\n#EXT-X-MEDIA-SEQUENCE:{first}\n{body}" + ("#EXT-X-ENDLIST\n" if ended else "")


def test_live_playlist_stream(spark, tmp_path):
    live.register(spark)
    path, out = tmp_path / "live.m3u8", []
    path.write_text(playlist(10, ["a", "b", "c", "d", "e"]))

    def run():
        stream = spark.readStream.format("sampleloom-live").load(str(path))
        keep = lambda df, _: out.extend(tuple(r) for r in df.orderBy("sequence").collect())
        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(60)

    run()
    assert [r[:2] for r in out] == [(12, "c"), (13, "d"), (14, "e")]
    path.write_text(playlist(13, ["d", "e", "f"]))
    run()
    assert [r[:2] for r in out[3:]] == [(15, "f")]


def test_playlist_text():
    p = live.parse_playlist('#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=5,CODECS="a,b"\nv.m3u8\n')
    assert p.variants == [{"BANDWIDTH": "5", "CODECS": "a,b", "uri": "v.m3u8"}]
    assert live.parse_playlist(playlist(3, ["x"], True)).ended
    with pytest.raises(ValueError):
        live.parse_playlist("hello")
    assert [live.backoff_s(k) for k in (0, 1, 9)] == [0.25, 0.5, 8.0]


def test_stateful_silence_over_batches(spark, tmp_path):
    peaks = [[1.0, 0.0, 0.0], [0.0, 0.0, 1.0], [0.0, 1.0, 0.0], [0.0, 0.0, 0.0], [1.0, 1.0, 1.0]]
    for k, p in enumerate(peaks):
        spark.createDataFrame([("t", 3 * k, p)], "track string, pos bigint, peaks array<float>").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("track string, pos bigint, peaks array<float>").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = []
    query = meters.silence_runs(stream, 0.5, 3).writeStream.foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect())).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(out) == [("t", 1, 5), ("t", 8, 12)]


def test_signatures_and_ids(spark):
    rows = spark.createDataFrame([("/a", "k")], "path string, key string")
    sig = media_functions.sign(F.col("path"), F.lit("a=1"), F.lit(100), F.col("key"))
    checked = rows.withColumn("sig", sig).select(
        media_functions.verify(F.col("path"), F.lit("a=1"), F.lit(100), F.col("sig"), F.col("key"), F.lit(160)).alias("ok"),
        media_functions.verify(F.col("path"), F.lit("a=1"), F.lit(100), F.col("sig"), F.col("key"), F.lit(161)).alias("late"),
        media_functions.verify(F.col("path"), F.lit("a=2"), F.lit(100), F.col("sig"), F.col("key"), F.lit(0)).alias("other"),
    ).first()
    assert tuple(checked) == (None, "signature-expired", "signature-invalid")
    assert bits.crc16(b"123456789") == 0xFEE8 and bits.crc8(b"123456789") == 0xF4
    ulid = media_functions.mint_ulid(1_700_000_000_000, 5)
    assert len(ulid) == 26 and ulid.endswith("05")


def offered(reader, start, end):
    return [r for p in reader.partitions(start, end) for r in p.rows]


def test_live_batches_can_be_read_again(tmp_path):
    path = tmp_path / "live.m3u8"
    path.write_text(playlist(10, list("abcde"), False))
    reader = live._Reader({"path": str(path)})
    start, end = reader.initialOffset(), reader.latestOffset()
    assert start["sequence"] == 12 and end["sequence"] == 15
    first = offered(reader, start, end)
    assert [r[0] for r in first] == [12, 13, 14]
    path.write_text(playlist(20, list("xy"), False))  # all that was offered has left the playlist
    assert offered(reader, start, end) == first
    later = reader.latestOffset()
    reader.commit(end)
    assert [r[:2] for r in offered(reader, end, later)] == [(20, "x"), (21, "y")]
    reader.commit(later)
    assert reader.held == {}


def test_live_restart_goes_on_at_the_new_edge(tmp_path):
    path = tmp_path / "live.m3u8"
    path.write_text(playlist(50, list("abc"), False))
    reader = live._Reader({"path": str(path)})
    before = (reader.initialOffset(), reader.latestOffset())[1]
    path.write_text(playlist(0, list("pqrst"), False))
    after = reader.latestOffset()
    assert [(r[0], r[1], r[3]) for r in offered(reader, before, after)] == [(2, "r", True), (3, "s", False), (4, "t", False)]
    # a new run of the query knows the offsets alone
    again = live._Reader({"path": str(path)})
    assert [r[0] for r in offered(again, before, after)] == [2, 3, 4]
    fresh = live._Reader({"path": str(path)})
    path.write_text(playlist(0, list("pqrstu"), False))
    assert [r[0] for r in offered(fresh, after, fresh.latestOffset())] == [5]


def test_variants_agree_and_reloads_have_a_floor():
    master = '#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=5,CODECS="{}"\na.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=9,CODECS="{}"\nb.m3u8\n'
    assert live.format_lock(live.parse_playlist(master.format("flac", "flac"))) == "flac"
    with pytest.raises(ValueError):
        live.format_lock(live.parse_playlist(master.format("flac", "opus")))
    assert [live.reload_s(live.Playlist(target=t), o) for t, o in ((6.0, 0.0), (6.0, 2.0), (0.0, 0.0), (6.0, 0.01))] == [6.0, 2.0, 0.2, 0.2]


def test_files_left_out_are_listed_with_their_reason(spark, tmp_path):
    (tmp_path / "good.wav").write_bytes(pcm.write_wav(np.zeros((1, 100), np.int32), 8000, 16))
    (tmp_path / "bad.wav").write_bytes(b"nothing of the kind")
    (tmp_path / "short.wav").write_bytes(b"RIFF")
    (tmp_path / "large.bin").write_bytes(bytes(5000))
    sources = media.read_sources(spark, str(tmp_path), max_bytes=4000)
    assert sources.count() == 3 and media.probe(sources).count() == 1
    got = {r["path"].rsplit("/", 1)[1]: r["error"]["code"] for r in media.unreadable_sources(sources).collect()}
    assert got == {"bad.wav": "unsupported-format", "short.wav": "unsupported-format"}
    large = media.refused_sources(spark, str(tmp_path), 4000).collect()
    assert [(r["length"], r["error"]["code"]) for r in large] == [(5000, "payload-too-large")]
    assert media.refused_sources(spark, str(tmp_path)).count() == 0
