import struct

import numpy as np
import pytest
from sampleloom.sources import containers, flac, media, mux
from sampleloom.sources.pcm import Malformed, Track
from test_sources import noise, samples


def packets_of(data):
    track, rows = containers.open_bytes(data)
    return track, [(held[0] if held else data[a : a + n], dur) for _, dur, _, a, n, *held in rows]


def test_adts_to_mp4_and_back():
    data, *_ = samples()["adts"]
    track, rows = packets_of(data)
    moved = mux.mux_mp4(track, rows)
    there, again = packets_of(moved)
    assert (there.container, there.codec, there.rate, again) == ("mp4", "aac-lc", 44100, rows)
    assert mux.mux_adts(track, again) == data


def test_opus_and_flac_in_ogg():
    data, *_ = samples()["ogg"]
    track, rows = packets_of(data)
    rows.append((b"\xfc" + bytes(70_000), 960))
    there, again = packets_of(mux.mux_ogg(track, rows))
    assert again == rows and there.delay == 312 and there.tags == {"TITLE": ["x"]}
    x = noise(16, 2, 9000)
    native = flac.write(x, 44100, 16, 1024)
    track, rows = packets_of(native)
    moved = mux.mux_ogg(track, rows)
    there, again = packets_of(moved)
    assert (there.container, there.codec, again) == ("ogg", "flac", rows)
    planes = np.concatenate([flac.decode_frame(d, there)[0] for d, _ in again], axis=1)
    assert (planes == x).all()
    assert mux.ogg_checksum(moved[:22] + bytes(4) + moved[26 : 27 + moved[26] + sum(moved[27 : 27 + moved[26]])]) == struct.unpack_from("<I", moved, 22)[0]


def test_fragments_carry_times_and_sizes():
    track = Track("mp4", "flac", 44100, 2, config=bytes(34))
    head = mux.init_segment(track)
    assert containers.open_bytes(head)[0].codec == "flac"
    part = mux.media_segment([(b"abc", 1024), (b"de", 512)], 7, 4096)
    found = {k: part[a:b] for k, a, b in containers.boxes(part, 0, len(part))}
    assert found[b"mdat"] == b"abcde"
    traf = dict((k, (a, b)) for k, a, b in containers.boxes(part, *containers._find(part, 0, len(part), b"moof", b"traf")))
    assert struct.unpack_from(">Q", part, traf[b"tfdt"][0] + 4)[0] == 4096
    count, offset = struct.unpack_from(">Ii", part, traf[b"trun"][0] + 4)
    assert count == 2 and part[offset : offset + 5] == b"abcde"


def test_remux_table(spark, tmp_path):
    (tmp_path / "a.aac").write_bytes(samples()["adts"][0])
    (tmp_path / "b.wav").write_bytes(__import__("sampleloom.sources.pcm", fromlist=["x"]).write_wav(noise(16, 1, 100), 8000))
    sources = media.read_sources(spark, str(tmp_path))
    out = mux.remux(media.probe(sources), media.packets(sources), "mp4").collect()
    assert len(out) == 1 and containers.open_bytes(bytes(out[0]["data"]))[0].codec == "aac-lc"
    with pytest.raises(Malformed):
        mux.mux_ogg(Track("x", "pcm", 8000, 1), [])


def test_opus_in_matroska_and_mp3_frames():
    data, *_ = samples()["ogg"]
    track, rows = packets_of(data)
    rows = [(bytes([0xFC]) + bytes([k % 256]) * 20, 960) for k in range(600)]
    there, again = packets_of(mux.mux_mka(track, rows))
    assert (there.container, there.codec, there.rate, there.channels, there.delay) == ("mka", "opus", 48000, 2, 312)
    assert [d for d, _ in again] == [d for d, _ in rows] and {n for _, n in again[:-1]} == {960}
    data, *_ = samples()["mp3"]
    track, rows = packets_of(data)
    assert mux.mux_mp3(track, rows) == data
    x = noise(16, 2, 4000)
    track, rows = packets_of(flac.write(x, 48000, 16, 960))
    there, again = packets_of(mux.mux_mka(track, rows))
    assert there.codec == "flac" and np.concatenate([flac.decode_frame(d, track)[0] for d, _ in again], axis=1).tolist() == x.tolist()
