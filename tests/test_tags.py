import struct

import numpy as np
from sampleloom.sources import flac, media, mux, pcm, tags
from sampleloom.sources.pcm import Track
from test_sources import noise, samples


def frame(name, body):
    return name + bytes(len(body) >> s & 127 for s in (21, 14, 7, 0)) + b"\0\0" + body


def id3(*frames):
    body = b"".join(frames)
    return b"ID3\x04\0\0" + bytes(len(body) >> s & 127 for s in (21, 14, 7, 0)) + body


def ape_tag(**items):
    body = b"".join(struct.pack("<II", len(v), 0) + k.encode() + b"\0" + v for k, v in items.items())
    return body + b"APETAGEX" + struct.pack("<IIII", 2000, len(body) + 32, len(items), 0) + bytes(8)


def atom(kind, text):
    return mux.box(kind, mux.box(b"data", struct.pack(">II", 1, 0), text))


def test_id3_and_ape():
    data = id3(frame(b"TIT2", b"\x03Song"), frame(b"TPE1", b"\x01" + "Zoë".encode("utf-16")), frame(b"TXXX", b"\x03replaygain_track_gain\0-3.10 dB"), frame(b"APIC", b"\0x")) + samples()["mp3"][0]
    got, chapters, art = tags.read_tags(data)
    assert got == {"TITLE": ["Song"], "ARTIST": ["Zoë"], "REPLAYGAIN_TRACK_GAIN": ["-3.10 dB"]} and art and not chapters
    got, _, art = tags.read_tags(samples()["wavpack"][0] + ape_tag(Title=b"One", Artist=b"A\0B", Track=b"3"))
    assert got == {"TITLE": ["One"], "ARTIST": ["A", "B"], "TRACKNUMBER": ["3"]} and not art


def test_mp4_atoms_and_chapters():
    base = mux.mux_mp4(Track("mp4", "flac", 44100, 2, config=bytes(34)), [(b"abc", 1024)])
    ilst = mux.box(b"ilst", atom(b"\xa9nam", b"Book"), atom(b"trkn", b"\0\0\0\x05\0\0"), atom(b"covr", b"x"), mux.box(b"----", mux.full_box(b"name", b"iTunNORM"), mux.box(b"data", struct.pack(">II", 1, 0), b"7")))
    chpl = mux.full_box(b"chpl", bytes(4) + b"\x02", struct.pack(">QB", 0, 3) + b"One", struct.pack(">QB", 10_000_000, 3) + b"Two")
    udta = mux.box(b"udta", mux.full_box(b"meta", ilst), chpl)
    at = base.index(b"moov") - 4
    size = struct.unpack_from(">I", base, at)[0]
    data = base[:at] + struct.pack(">I", size + len(udta)) + base[at + 4 : at + size] + udta + base[at + size :]
    got, chapters, art = tags.read_tags(data)
    assert got == {"TITLE": ["Book"], "TRACKNUMBER": ["5"], "ITUNNORM": ["7"]} and art
    assert chapters == [(0, 0, "One"), (1_000_000_000, 0, "Two")]


def test_table_of_tags(spark, tmp_path):
    wav = pcm.write_wav(noise(16, 1, 10), 8000)
    info = b"LIST" + struct.pack("<I", 4 + 8 + 6) + b"INFOINAM" + struct.pack("<I", 6) + b"Hello\0"
    (tmp_path / "a.wav").write_bytes(wav[:4] + struct.pack("<I", len(wav) - 8 + len(info)) + wav[8:] + info)
    (tmp_path / "b.bin").write_bytes(b"ID3\x04")
    native = flac.write(noise(16, 1, 10), 8000)
    comment = struct.pack("<I", 0) + struct.pack("<I", 1) + struct.pack("<I", 7) + b"title=F"
    head = struct.unpack_from(">I", native, 4)[0] & 0x7FFFFFFF
    (tmp_path / "c.flac").write_bytes(native[:4] + struct.pack(">I", head) + native[8:42] + struct.pack(">I", 0x84000000 | len(comment)) + comment + native[42:])
    sources = media.read_sources(spark, str(tmp_path))
    got = {r["ext"]: r["tags"] for r in tags.tags_of(sources).join(sources.select("source_id", "ext"), "source_id").collect()}
    assert got == {"wav": {"TITLE": ["Hello"]}, "bin": {}, "flac": {"TITLE": ["F"]}}


def test_broken_tags_do_not_crash():
    rng = np.random.default_rng(0)
    for data in (id3(frame(b"TIT2", b"\x03Song")) + samples()["mp3"][0], samples()["wavpack"][0] + ape_tag(Title=b"One"), samples()["mp4"][0]):
        for _ in range(80):
            x = bytearray(data)
            for k in rng.integers(0, len(x), 4):
                x[k] = rng.integers(0, 256)
            try:
                tags.read_tags(bytes(x[: rng.integers(1, len(x) + 1)]))
            except (struct.error, IndexError, ValueError):
                continue
