"""Writing packets into containers without touching the audio: remuxing, cutting and segmenting end here."""

from __future__ import annotations

import struct
from collections.abc import Iterable

from pyspark.sql import DataFrame

from sampleloom.sources.containers import AAC_RATES
from sampleloom.sources.pcm import Malformed, Track

#: Packets as (data, duration).
Packets = Iterable[tuple[bytes, int]]


def _crc32_ogg() -> list[int]:
    table = []
    for k in range(256):
        r = k << 24
        for _ in range(8):
            r = (r << 1 ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
        table.append(r)
    return table


_OGG_CRC = _crc32_ogg()


def ogg_checksum(page: bytes) -> int:
    r = 0
    for b in page:
        r = (r << 8 & 0xFFFFFFFF) ^ _OGG_CRC[r >> 24 ^ b]
    return r


def _ogg_page(lacing: list[int], body: bytes, flags: int, granule: int, serial: int, number: int) -> bytes:
    head = b"OggS" + struct.pack("<BBqIIIB", 0, flags, granule, serial, number, 0, len(lacing)) + bytes(lacing)
    page = bytearray(head + body)
    struct.pack_into("<I", page, 22, ogg_checksum(bytes(page)))
    return bytes(page)


def mux_ogg(track: Track, packets: Packets, serial: int = 1) -> bytes:
    """Opus or FLAC in Ogg; a page ends with a packet, and a packet longer than a page goes on in the next."""
    comment = b"\x0a\0\0\0sampleloom" + struct.pack("<I", sum(map(len, track.tags.values())))
    comment += b"".join(struct.pack("<I", len(t)) + t for t in (f"{k}={v}".encode() for k, vs in track.tags.items() for v in vs))
    if track.codec == "opus":
        headers = [track.config, b"OpusTags" + comment]
    elif track.codec == "flac":
        info = b"fLaC" + struct.pack(">I", len(track.config)) + track.config
        headers = [b"\x7fFLAC\x01\x00\x00\x01" + info, struct.pack(">I", 0x84000000 | len(comment)) + comment]
    else:
        raise Malformed(f"no Ogg mapping for {track.codec}")
    out, number, granule = [], 0, 0
    rows = [(h, 0) for h in headers] + list(packets)
    for k, (data, dur) in enumerate(rows):
        granule += dur
        lacing = [255] * (len(data) // 255) + [len(data) % 255]
        for a in range(0, len(lacing), 255):
            part = lacing[a : a + 255]
            done = a + 255 >= len(lacing)
            flags = (1 if a else 0) | (2 if k == 0 and a == 0 else 0) | (4 if k == len(rows) - 1 and done else 0)
            out.append(_ogg_page(part, data[a * 255 : a * 255 + sum(part)], flags, granule if done else -1, serial, number))
            number += 1
    return b"".join(out)


def mux_adts(track: Track, packets: Packets) -> bytes:
    """AAC-LC access units with a header each."""
    profile, index, channels = (track.config[0] >> 3) - 1, (track.config[0] & 7) << 1 | track.config[1] >> 7, track.config[1] >> 3 & 15
    out = []
    for data, _ in packets:
        n = len(data) + 7
        out.append(bytes([0xFF, 0xF1, profile << 6 | index << 2 | channels >> 2, (channels & 3) << 6 | n >> 11, n >> 3 & 255, (n & 7) << 5 | 0x1F, 0xFC]) + data)
    return b"".join(out)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _descriptor(tag: int, body: bytes) -> bytes:
    return bytes([tag, len(body)]) + body


def _sample_entry(track: Track) -> bytes:
    name, extra = {
        "aac-lc": (b"mp4a", lambda: full_box(b"esds", _descriptor(3, b"\0\0\0" + _descriptor(4, bytes([0x40, 0x15]) + bytes(11) + _descriptor(5, track.config)) + _descriptor(6, b"\x02")))),
        "opus": (b"Opus", lambda: box(b"dOps", b"\0" + track.config[9:10] + struct.pack(">HIh", *struct.unpack("<HIh", track.config[10:18])) + track.config[18:19])),
        "flac": (b"fLaC", lambda: full_box(b"dfLa", struct.pack(">I", 0x80000000 | len(track.config)) + track.config)),
        "alac": (b"alac", lambda: full_box(b"alac", track.config)),
        "mp3": (b".mp3", lambda: b""),
    }.get(track.codec, (None, None))
    if name is None:
        raise Malformed(f"no MP4 mapping for {track.codec}")
    return box(name, bytes(6), struct.pack(">HQHHIHH", 1, 0, track.channels, track.bit_depth if track.sample_type == "int" else 16, 0, (track.rate & 0xFFFF), 0), extra())


def _moov(track: Track, tables: list[bytes], samples: int, extends: bytes = b"") -> bytes:
    unity = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    mvhd = full_box(b"mvhd", struct.pack(">IIIIIH", 0, 0, track.rate, samples, 0x10000, 0x0100), bytes(10), unity, bytes(24), struct.pack(">I", 2))
    tkhd = full_box(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, samples), bytes(12), struct.pack(">HH", 0x0100, 0), unity, bytes(8), flags=3)
    edit = box(b"edts", full_box(b"elst", struct.pack(">IIiI", 1, max(samples - track.delay - track.padding, 0), track.delay, 0x10000))) if track.delay or track.padding else b""
    mdhd = full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, track.rate, samples, 0x55C4, 0))
    hdlr = full_box(b"hdlr", struct.pack(">I4s", 0, b"soun"), bytes(12), b"sampleloom\0")
    dinf = box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1)))
    stbl = box(b"stbl", full_box(b"stsd", struct.pack(">I", 1), _sample_entry(track)), *tables)
    mdia = box(b"mdia", mdhd, hdlr, box(b"minf", full_box(b"smhd", bytes(4)), dinf, stbl))
    return box(b"moov", mvhd, box(b"trak", tkhd, edit, mdia), extends)


def _runs(values: list[int]) -> bytes:
    runs: list[list[int]] = []
    for v in values:
        if runs and runs[-1][1] == v:
            runs[-1][0] += 1
        else:
            runs.append([1, v])
    return struct.pack(">I", len(runs)) + b"".join(struct.pack(">II", n, v) for n, v in runs)


def mux_mp4(track: Track, packets: Packets) -> bytes:
    """A progressive file: the index in front, one chunk of samples behind it."""
    rows = list(packets)
    sizes, durations = [len(d) for d, _ in rows], [n for _, n in rows]
    head = box(b"ftyp", b"M4A \0\0\0\0M4A isom")

    def moov(offset: int) -> bytes:
        tables = [
            full_box(b"stts", _runs(durations)),
            full_box(b"stsc", struct.pack(">IIII", 1, 1, len(rows), 1) if rows else struct.pack(">I", 0)),
            full_box(b"stsz", struct.pack(">II", 0, len(rows)), struct.pack(f">{len(rows)}I", *sizes)),
            full_box(b"co64", struct.pack(">IQ", 1, offset) if rows else struct.pack(">I", 0)),
        ]
        return _moov(track, tables, sum(durations))

    index = moov(len(head) + len(moov(0)) + 8)
    return head + index + box(b"mdat", *[d for d, _ in rows])


def init_segment(track: Track) -> bytes:
    """The header that fragments of a track share."""
    none = struct.pack(">I", 0)
    tables = [full_box(b"stts", none), full_box(b"stsc", none), full_box(b"stsz", none + none), full_box(b"stco", none)]
    extends = box(b"mvex", full_box(b"trex", struct.pack(">IIIII", 1, 1, 0, 0, 0)))
    return box(b"ftyp", b"iso6\0\0\0\0iso6cmfc") + _moov(track, tables, 0, extends)


def media_segment(packets: Packets, number: int, decode_time: int) -> bytes:
    """One fragment: its packets with durations and sizes, starting at ``decode_time`` samples."""
    rows = list(packets)
    table = b"".join(struct.pack(">II", dur, len(data)) for data, dur in rows)

    def moof(offset: int) -> bytes:
        tfhd = full_box(b"tfhd", struct.pack(">I", 1), flags=0x020000)
        tfdt = full_box(b"tfdt", struct.pack(">Q", decode_time), version=1)
        trun = full_box(b"trun", struct.pack(">Ii", len(rows), offset), table, flags=0x000301)
        return box(b"moof", full_box(b"mfhd", struct.pack(">I", number)), box(b"traf", tfhd, tfdt, trun))

    size = len(moof(0))
    return moof(size + 8) + box(b"mdat", *[d for d, _ in rows])


def _element(kind: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + (1 << 56 | len(body)).to_bytes(8, "big") + body


def _number(kind: int, value: int) -> bytes:
    return _element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def mux_mka(track: Track, packets: Packets, cluster_ms: int = 5000) -> bytes:
    """Matroska: one track, clusters of a few seconds, times in milliseconds."""
    codec = {"opus": b"A_OPUS", "flac": b"A_FLAC", "aac-lc": b"A_AAC", "mp3": b"A_MPEG/L3"}.get(track.codec)
    if codec is None:
        raise Malformed(f"no Matroska mapping for {track.codec}")
    config = b"fLaC" + struct.pack(">I", 0x80000000 | len(track.config)) + track.config if track.codec == "flac" else track.config
    doc = b"webm" if track.codec == "opus" else b"matroska"
    head = _element(0x1A45DFA3, _number(0x4286, 1), _number(0x42F7, 1), _number(0x42F2, 4), _number(0x42F3, 8), _element(0x4282, doc), _number(0x4287, 4), _number(0x4285, 2))
    audio = _element(0xE1, _element(0xB5, struct.pack(">d", track.rate)), _number(0x9F, track.channels), *([_number(0x6264, track.bit_depth)] if track.sample_type == "int" else []))
    delay = [_number(0x56AA, track.delay * 1_000_000_000 // track.rate)] if track.delay else []
    entry = _element(0xAE, _number(0xD7, 1), _number(0x73C5, 1), _number(0x83, 2), _element(0x86, codec), *([_element(0x63A2, config)] if config else []), *delay, audio)
    clusters, blocks, base, pos = [], [], 0, 0
    for data, dur in packets:
        ms = pos * 1000 // track.rate
        if blocks and ms - base >= min(cluster_ms, 32000):
            clusters.append(_element(0x1F43B675, _number(0xE7, base), *blocks))
            blocks, base = [], ms
        blocks.append(_element(0xA3, b"\x81" + struct.pack(">hB", ms - base, 0x80) + data))
        pos += dur
    if blocks:
        clusters.append(_element(0x1F43B675, _number(0xE7, base), *blocks))
    info = _element(0x1549A966, _number(0x2AD7B1, 1_000_000), _element(0x4D80, b"sampleloom"), _element(0x5741, b"sampleloom"))
    return head + _element(0x18538067, info, _element(0x1654AE6B, entry), *clusters)


def mux_mp3(track: Track, packets: Packets) -> bytes:
    """MPEG frames one after another."""
    if track.codec != "mp3":
        raise Malformed(f"no MPEG stream of {track.codec}")
    return b"".join(d for d, _ in packets)


MUXERS = {"ogg": mux_ogg, "adts": mux_adts, "mp4": mux_mp4, "mka": mux_mka, "mp3": mux_mp3}


def aac_config(rate: int, channels: int) -> bytes:
    return struct.pack(">H", 2 << 11 | AAC_RATES.index(rate) << 7 | channels << 3)


def remux(tracks: DataFrame, packets: DataFrame, container: str) -> DataFrame:
    """source_id, data: each source's packets in another container, in the order of ``seq``.

    ``tracks`` and ``packets`` are the tables of ``sources.media``.  A source
    whose codec the container does not take gives no row.
    """
    import pyarrow as pa

    if container not in MUXERS:
        raise ValueError(f"no muxer for {container}")
    facts = tracks.select("source_id", "codec", "rate", "channels", "sample_type", "bit_depth", "delay", "padding", "codec_config")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"source_id": pa.array([], pa.string()), "data": pa.array([], pa.binary())}
        if left.num_rows and right.num_rows:
            t = left.to_pylist()[0]
            track = Track(container, t["codec"], t["rate"], t["channels"], t["sample_type"], t["bit_depth"], delay=t["delay"], padding=t["padding"], config=t["codec_config"])
            rows = sorted(zip(right["seq"].to_pylist(), right["data"].to_pylist(), right["dur"].to_pylist(), strict=True))
            try:
                out = {"source_id": [t["source_id"]], "data": [MUXERS[container](track, [(d, n) for _, d, n in rows])]}
            except Malformed:
                pass
        return pa.table(out)

    return facts.groupBy("source_id").cogroup(packets.select("source_id", "seq", "data", "dur").groupBy("source_id")).applyInArrow(run, "source_id string, data binary")
