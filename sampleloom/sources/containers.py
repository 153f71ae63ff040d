"""Headers and packets of the other containers, read without decoding.

Each parser gives a ``Track`` and an iterator of (pts, duration, sync, offset,
size); offsets point into the file, so packets can be copied or counted without
touching the audio.  Ogg packets may lie on several pages, so theirs come with
their bytes as a sixth field.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from sampleloom.sources import flac, pcm
from sampleloom.sources.pcm import Malformed, Track

Packet = tuple[int, int, bool, int, int] | tuple[int, int, bool, int, int, bytes]

#: MPEG audio bit rates (kbit/s) by version and layer, rates by version.
_MPEG_KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_MPEG_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: AAC rates by index.
AAC_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
#: WavPack rates by index.
_WAVPACK_RATES = (6000, 8000, 9600, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000, 64000, 88200, 96000, 192000)


def id3v2_bytes(data: bytes) -> int:
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    size = 0
    for b in data[6:10]:
        size = size << 7 | b & 127
    return size + 10 + (10 if data[5] & 16 else 0)


def mpeg_header(data: bytes, at: int) -> tuple[int, int, int, int, int] | None:
    """rate, channels, samples, bytes, bit rate of the MPEG frame at an offset, or None."""
    if at + 4 > len(data) or data[at] != 255 or data[at + 1] < 224:
        return None
    b1, b2, b3 = data[at + 1], data[at + 2], data[at + 3]
    version, layer = b1 >> 3 & 3, 4 - (b1 >> 1 & 3)
    if version == 1 or layer == 4 or b2 >> 4 in (0, 15) or (b2 >> 2 & 3) == 3:
        return None
    rate = _MPEG_RATES[version][b2 >> 2 & 3]
    kbps = _MPEG_KBPS[1 if version == 3 else 2, layer][b2 >> 4]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    slot = 4 if layer == 1 else 1
    size = (samples // 8 * kbps * 1000 // rate // slot + (b2 >> 1 & 1)) * slot
    return rate, 1 if b3 >> 6 == 3 else 2, samples, size, kbps * 1000


def _mp3(data: bytes) -> tuple[Track, Iterator[Packet]]:
    at = id3v2_bytes(data)
    while at < len(data) and not (mpeg_header(data, at) and ((n := at + mpeg_header(data, at)[3]) >= len(data) or mpeg_header(data, n))):
        at += 1
    head = mpeg_header(data, at)
    if head is None:
        raise Malformed("no MPEG frames")
    rate, channels, samples, size, _ = head
    track = Track("mp3", "mp3", rate, channels, "float", 32, 0, data_at=at)
    info = at + 4 + ((17 if channels == 1 else 32) if samples == 1152 else (9 if channels == 1 else 17))
    if data[info : info + 4] in (b"Xing", b"Info"):
        flags, p = struct.unpack_from(">I", data, info + 4)[0], info + 8
        count = struct.unpack_from(">I", data, p)[0] if flags & 1 else -1
        p += 4 * bool(flags & 1) + 4 * bool(flags & 2) + 100 * bool(flags & 4) + 4 * bool(flags & 8)
        gap = int.from_bytes(data[p + 21 : p + 24], "big") if data[p : p + 4] in (b"LAME", b"Lavf", b"Lavc") else 0
        track.delay, track.padding = (gap >> 12) + 529 if gap else 0, max((gap & 4095) - 529, 0)
        track.samples = count * samples - track.delay - track.padding if count >= 0 else -1
        at += size

    def packets():
        pos, here = 0, at
        while (h := mpeg_header(data, here)) and here + h[3] <= len(data):
            yield pos, h[2], True, here, h[3]
            pos, here = pos + h[2], here + h[3]

    return track, packets()


def _adts(data: bytes) -> tuple[Track, Iterator[Packet]]:
    start = id3v2_bytes(data)
    if start + 7 > len(data) or data[start] != 255 or data[start + 1] & 0xF6 != 0xF0:
        raise Malformed("no ADTS sync")
    rate = AAC_RATES[data[start + 2] >> 2 & 15]
    channels = (data[start + 2] & 1) << 2 | data[start + 3] >> 6
    profile = (data[start + 2] >> 6) + 1
    config = struct.pack(">H", profile << 11 | (data[start + 2] >> 2 & 15) << 7 | channels << 3)

    def packets():
        pos, at = 0, start
        while at + 7 <= len(data) and data[at] == 255 and data[at + 1] & 0xF6 == 0xF0:
            size = (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
            head = 7 if data[at + 1] & 1 else 9
            if size < head or at + size > len(data):
                return
            dur = 1024 * ((data[at + 6] & 3) + 1)
            yield pos, dur, True, at + head, size - head
            pos, at = pos + dur, at + size

    return Track("adts", "aac-lc", rate, channels, "float", 32, 0, config=config, data_at=start), packets()


def ogg_pages(data: bytes) -> Iterator[tuple[int, int, int, list[tuple[int, int]], bool]]:
    """serial, granule, flags, segments (offset, size) of packets or parts, and whether the last part goes on."""
    at = 0
    while at + 27 <= len(data) and data[at : at + 4] == b"OggS":
        flags, granule, serial, _, _, n = struct.unpack_from("<BqIIIB", data, at + 5)
        lacing, body, parts, size = data[at + 27 : at + 27 + n], at + 27 + n, [], 0
        for k, x in enumerate(lacing):
            size += x
            if x < 255 or k == n - 1:
                parts.append((body, size))
                body, size = body + size, 0
        yield serial, granule, flags, parts, bool(n and lacing[-1] == 255)
        at = body


def ogg_packets(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """bytes, offset of the first part and granule (-1 unless the packet ends its page) of the first stream's packets."""
    first, held, held_at = None, b"", -1
    for serial, granule, _, parts, more in ogg_pages(data):
        first = serial if first is None else first
        if serial != first:
            continue
        for k, (at, size) in enumerate(parts):
            held, held_at = held + data[at : at + size], at if held_at < 0 else held_at
            if k < len(parts) - 1 or not more:
                yield held, held_at, granule if k == len(parts) - 1 else -1
                held, held_at = b"", -1


def opus_duration(packet: bytes) -> int:
    """Samples at 48 kHz of an Opus packet, from its first byte (and second, where frames are counted)."""
    if not packet:
        return 0
    toc = packet[0]
    mode = toc >> 3
    frame = (480, 960, 1920, 2880)[mode & 3] if mode < 12 else (480, 960)[mode & 1] if mode < 16 else 120 << (mode & 3)
    kind = toc & 3
    return frame * (1 if kind == 0 else 2 if kind < 3 else packet[1] & 63 if len(packet) > 1 else 0)


def _ogg(data: bytes) -> tuple[Track, Iterator[Packet]]:
    stream = ogg_packets(data)
    head = next(stream, (b"", 0, 0))[0]
    last = max((g for _, g, *_ in ogg_pages(data)), default=-1)
    if head[:8] == b"OpusHead" and len(head) >= 19:
        skip = struct.unpack_from("<H", head, 10)[0]
        track = Track("ogg", "opus", 48000, head[9], "float", 32, 0, samples=last - skip if last >= 0 else -1, delay=skip, config=head)
        tags = next(stream, (b"",))[0]
        track.tags = flac.parse_comments(tags[8:]) if tags[:8] == b"OpusTags" else {}

        def packets():
            pos = 0
            for body, at, _ in stream:
                dur = opus_duration(body)
                yield pos, dur, True, at, len(body), body
                pos += dur

        return track, packets()
    if head[:7] == b"\x01vorbis" and len(head) >= 30:
        channels, rate = struct.unpack_from("<BI", head, 11)
        track = Track("ogg", "vorbis", rate, channels, "float", 32, 0, samples=last, config=head)
        tags = next(stream, (b"",))[0]
        track.tags = flac.parse_comments(tags[7:]) if tags[:7] == b"\x03vorbis" else {}
        next(stream, None)
        short, long = 1 << (head[28] & 15), 1 << (head[28] >> 4)
        return track, ((0, 0, True, at, len(body), body) for body, at, _ in stream if short <= long)
    if head[:5] == b"\x7fFLAC" and len(head) >= 51:
        track = flac.parse(head[9:] if head[13] & 128 else head[9:13] + bytes([head[13] | 128]) + head[14:])
        track.container = "ogg"

        def flac_packets():
            pos = 0
            for body, at, _ in stream:
                if body[:2] in (b"\xff\xf8", b"\xff\xf9"):
                    planes, _, _ = flac.decode_frame(body, track)
                    yield pos, planes.shape[1], True, at, len(body), body
                    pos += planes.shape[1]

        return track, flac_packets()
    raise Malformed("unknown Ogg mapping")


def boxes(data: bytes, lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
    """type, body start, end of the MP4 boxes in a range."""
    while lo + 8 <= hi:
        size, kind = struct.unpack_from(">I4s", data, lo)
        head = 8
        if size == 1 and lo + 16 <= hi:
            size, head = struct.unpack_from(">Q", data, lo + 8)[0], 16
        size = size or hi - lo
        if size < head or lo + size > hi:
            return
        yield kind, lo + head, lo + size
        lo += size


def _find(data: bytes, lo: int, hi: int, *path: bytes) -> tuple[int, int] | None:
    for kind, a, b in boxes(data, lo, hi):
        if kind == path[0]:
            return (a, b) if len(path) == 1 else _find(data, a, b, *path[1:])
    return None


def _mp4(data: bytes) -> tuple[Track, Iterator[Packet]]:
    moov = _find(data, 0, len(data), b"moov")
    if moov is None:
        raise Malformed("MP4 without moov")
    for kind, a, b in boxes(data, *moov):
        handler = _find(data, a, b, b"mdia", b"hdlr") if kind == b"trak" else None
        if handler is None or data[handler[0] + 8 : handler[0] + 12] != b"soun":
            continue
        table = _find(data, a, b, b"mdia", b"minf", b"stbl")
        header = _find(data, a, b, b"mdia", b"mdhd")
        if table is None or header is None:
            break
        scale = struct.unpack_from(">I", data, header[0] + (20 if data[header[0]] else 12))[0]
        entry = _find(data, *table, b"stsd")[0] + 8
        name = data[entry + 4 : entry + 8]
        channels, bits = struct.unpack_from(">HH", data, entry + 24)
        codec = {b"mp4a": "aac-lc", b"alac": "alac", b"Opus": "opus", b"fLaC": "flac", b".mp3": "mp3"}.get(name, name.decode("latin-1").strip())
        lossless = codec in ("alac", "flac")
        track = Track("mp4", codec, scale, channels, "int" if lossless else "float", bits if lossless else 32, bits if lossless else 0, config=data[entry + 36 : entry + struct.unpack_from(">I", data, entry)[0]])
        track.samples = struct.unpack_from(">Q" if data[header[0]] else ">I", data, header[0] + (24 if data[header[0]] else 16))[0]
        return track, _mp4_packets(data, table)
    raise Malformed("MP4 without an audio track")


def _mp4_packets(data: bytes, table: tuple[int, int]) -> Iterator[Packet]:
    part = {kind: a for kind, a, _ in boxes(data, *table)}
    durations = [x for n, x in struct.iter_unpack(">II", data[part[b"stts"] + 8 : part[b"stts"] + 8 + 8 * struct.unpack_from(">I", data, part[b"stts"] + 4)[0]]) for _ in range(n)]
    fixed, count = struct.unpack_from(">II", data, part[b"stsz"] + 4)
    sizes = [fixed] * count if fixed else list(struct.unpack_from(f">{count}I", data, part[b"stsz"] + 12))
    wide = b"co64" in part
    at = part[b"co64" if wide else b"stco"]
    offsets = struct.unpack_from(f">{struct.unpack_from('>I', data, at + 4)[0]}{'Q' if wide else 'I'}", data, at + 8)
    runs = list(struct.iter_unpack(">III", data[part[b"stsc"] + 8 : part[b"stsc"] + 8 + 12 * struct.unpack_from(">I", data, part[b"stsc"] + 4)[0]]))
    sync = None
    if b"stss" in part:
        sync = {n - 1 for n in struct.unpack_from(f">{struct.unpack_from('>I', data, part[b'stss'] + 4)[0]}I", data, part[b"stss"] + 8)}
    k = pos = run = 0
    for chunk, offset in enumerate(offsets, 1):
        while run + 1 < len(runs) and runs[run + 1][0] <= chunk:
            run += 1
        for _ in range(runs[run][1]):
            if k >= count:
                return
            yield pos, durations[k], sync is None or k in sync, offset, sizes[k]
            pos, offset, k = pos + durations[k], offset + sizes[k], k + 1


def _vint(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """EBML number (with its length marker if ``keep``) and the offset behind it; -1 for an unknown size."""
    first = data[at]
    n = 9 - first.bit_length() if first else 9
    value = int.from_bytes(data[at : at + n], "big")
    if not keep:
        value &= (1 << 7 * n) - 1
        value = -1 if value == (1 << 7 * n) - 1 else value
    return value, at + n


#: The EBML elements that are entered or read.
_ENTER = {0x18538067: "Segment", 0x1654AE6B: "Tracks", 0xAE: "TrackEntry", 0xE1: "Audio", 0x1F43B675: "Cluster", 0xA0: "BlockGroup"}
_READ = {0x86: "codec", 0x63A2: "config", 0xB5: "rate", 0x9F: "channels", 0x6264: "bits", 0xE7: "time", 0xA3: "block", 0xA1: "block", 0x2AD7B1: "scale", 0x56AA: "delay"}


def _mka_elements(data: bytes, lo: int, hi: int) -> Iterator[tuple[str, int, int]]:
    while lo + 2 <= hi:
        kind, at = _vint(data, lo, True)
        size, at = _vint(data, at, False)
        end = hi if size < 0 else min(at + size, hi)
        if kind in _ENTER or kind == 0x1549A966:
            yield from _mka_elements(data, at, end)
        elif kind in _READ:
            yield _READ[kind], at, end
        lo = end


def _mka(data: bytes) -> tuple[Track, Iterator[Packet]]:
    if data[:4] != b"\x1a\x45\xdf\xa3":
        raise Malformed("not an EBML file")
    size, at = _vint(data, 4, False)
    head: dict = {"rate": 8000.0, "channels": 1, "bits": 0, "scale": 1_000_000, "codec": "", "config": b"", "delay": 0}
    blocks, time = [], 0
    for name, a, b in _mka_elements(data, at + size, len(data)):
        raw = data[a:b]
        if name == "block":
            if b - a > 4:
                blocks.append((time + struct.unpack_from(">h", data, a + 1)[0], a + 4, b - a - 4))
        elif name == "time":
            time = int.from_bytes(raw, "big")
        elif name == "rate":
            head["rate"] = struct.unpack(">f" if len(raw) == 4 else ">d", raw)[0]
        else:
            head[name] = raw if name == "config" else raw.decode("latin-1").rstrip("\0") if name == "codec" else int.from_bytes(raw, "big")
    codec = {"A_OPUS": "opus", "A_FLAC": "flac", "A_VORBIS": "vorbis", "A_AAC": "aac-lc", "A_MPEG/L3": "mp3", "A_PCM/INT/LIT": "pcm"}.get(head["codec"], head["codec"])
    rate = int(head["rate"])
    ticks = lambda t: t * head["scale"] * rate // 1_000_000_000
    track = Track("mka", codec, rate, head["channels"], "int" if head["bits"] else "float", head["bits"] or 32, head["bits"], config=head["config"], delay=head["delay"] * rate // 1_000_000_000)
    nexts = [b[0] for b in blocks[1:]] + [blocks[-1][0] if blocks else 0]
    return track, ((ticks(t), ticks(n) - ticks(t), True, a, size) for (t, a, size), n in zip(blocks, nexts, strict=True))


def _wavpack(data: bytes) -> tuple[Track, Iterator[Packet]]:
    if data[:4] != b"wvpk" or len(data) < 32:
        raise Malformed("not a WavPack stream")
    total, _, _, flags = struct.unpack_from("<IIII", data, 12)
    index, channels, at = flags >> 23 & 15, 0, 0
    while at + 32 <= len(data) and data[at : at + 4] == b"wvpk":
        size, f = struct.unpack_from("<I", data, at + 4)[0], struct.unpack_from("<I", data, at + 24)[0]
        channels, at = channels + (1 if f & 4 else 2), at + size + 8
        if f & 0x1000:
            break
    bits = 8 * ((flags & 3) + 1) - (flags >> 13 & 31)
    track = Track("wavpack", "wavpack", _WAVPACK_RATES[index] if index < 15 else 44100, channels, "float" if flags & 128 else "int", 32 if flags & 128 else bits, bits, samples=-1 if total == 0xFFFFFFFF else total)

    def packets():
        at = 0
        while at + 32 <= len(data) and data[at : at + 4] == b"wvpk":
            begin, (pos, n) = at, struct.unpack_from("<II", data, at + 16)
            final = False
            while not final and at + 32 <= len(data) and data[at : at + 4] == b"wvpk":  # blocks of one packet share its position
                final = bool(struct.unpack_from("<I", data, at + 24)[0] & 0x1000)
                at += struct.unpack_from("<I", data, at + 4)[0] + 8
            if n:
                yield pos, n, True, begin, at - begin

    return track, packets()


def _ape(data: bytes) -> tuple[Track, Iterator[Packet]]:
    if data[:4] != b"MAC " or len(data) < 76 or struct.unpack_from("<H", data, 4)[0] < 3980:
        raise Malformed("not an APE file of version 3.98 or later")
    desc, head, table = struct.unpack_from("<III", data, 8)
    _, _, per, last, frames, bits, channels, rate = struct.unpack_from("<HHIIIHHI", data, desc)
    offsets = list(struct.unpack_from(f"<{table // 4}I", data, desc + head))[:frames]
    track = Track("ape", "ape", rate, channels, "int", bits, bits, samples=(frames - 1) * per + last if frames else 0, config=data[desc : desc + head])
    ends = offsets[1:] + [len(data)] * bool(offsets)
    return track, ((k * per, per if k < frames - 1 else last, True, a, b - a) for k, (a, b) in enumerate(zip(offsets, ends, strict=True)))


def _asf(data: bytes) -> tuple[Track, Iterator[Packet]]:
    if data[:16] != bytes.fromhex("3026B2758E66CF11A6D900AA0062CE6C"):
        raise Malformed("not an ASF file")
    size, at, track, packet = struct.unpack_from("<Q", data, 16)[0], 30, None, 0
    while at + 24 <= min(size, len(data)):
        guid, n = data[at : at + 16], struct.unpack_from("<Q", data, at + 16)[0]
        if guid == bytes.fromhex("9107DCB7B7A9CF118EE600C00C205365") and data[at + 24 : at + 40] == bytes.fromhex("409E69F84D5BCF11A8FD00805F5C442B"):
            kind, channels, rate, _, _, _ = struct.unpack_from("<HHIIHH", data, at + 78)
            extra = struct.unpack_from("<H", data, at + 94)[0]
            track = Track("asf", {0x160: "wma1", 0x161: "wma2"}.get(kind, f"wave-{kind:#x}"), rate, channels, "float", 32, 0, config=data[at + 96 : at + 96 + extra])
        elif guid == bytes.fromhex("A1DCAB8C47A9CF118EE400C00C205365"):
            packet = struct.unpack_from("<I", data, at + 92)[0]
        at += max(n, 24)
    if track is None:
        raise Malformed("ASF without an audio stream")
    body = size + 50
    return track, ((0, 0, True, a, packet) for a in range(body, len(data) - packet + 1, packet)) if packet else iter(())


def _wav(data: bytes) -> tuple[Track, Iterator[Packet]]:
    return _pcm_packets(pcm.parse_wav(data))


def _aiff(data: bytes) -> tuple[Track, Iterator[Packet]]:
    return _pcm_packets(pcm.parse_aiff(data))


def _pcm_packets(track: Track, frames: int = 4096) -> tuple[Track, Iterator[Packet]]:
    frame = track.width * track.channels
    return track, ((p, min(frames, track.samples - p), True, track.data_at + p * frame, min(frames, track.samples - p) * frame) for p in range(0, track.samples, frames))


def _flac(data: bytes) -> tuple[Track, Iterator[Packet]]:
    track = flac.parse(data)
    return track, ((pos, planes.shape[1], True, at, size) for pos, at, size, planes in flac.frames(data, track))


PARSERS = {"wav": _wav, "aiff": _aiff, "flac": _flac, "ogg": _ogg, "mp4": _mp4, "mka": _mka, "adts": _adts, "mp3": _mp3, "wavpack": _wavpack, "ape": _ape, "asf": _asf}


def sniff(data: bytes, ext: str = "") -> str | None:
    """Container of a file's bytes; the same rules as the SQL expression in ``functions.media``."""
    from sampleloom.functions.media import EXTENSION_HINTS, SIGNATURES

    at = id3v2_bytes(data)
    for name, offset, magic in SIGNATURES:
        if data[at + offset : at + offset + len(magic) // 2].hex().upper() == magic:
            if (name, data[at + 8 : at + 12]) in (("wav", b"WAVE"), ("aiff", b"AIFF"), ("aiff", b"AIFC")) or name not in ("wav", "aiff"):
                return name
    head = data[at : at + 2]
    if len(head) == 2 and head[0] == 255 and head[1] & 0xF6 == 0xF0:
        return "adts"
    if len(head) == 2 and head[0] == 255 and head[1] >= 224 and head[1] >> 1 & 3:
        return "mp3"
    return EXTENSION_HINTS.get(ext.lower().lstrip("."))


_BROKEN = (struct.error, IndexError, KeyError, TypeError, ValueError, EOFError, OverflowError, ZeroDivisionError, StopIteration)


def _guarded(kind: str, packets: Iterator[Packet]) -> Iterator[Packet]:
    try:
        yield from packets
    except _BROKEN as e:
        raise e if isinstance(e, Malformed) else Malformed(f"{kind}: {e}") from e


def open_bytes(data: bytes, ext: str = "") -> tuple[Track, Iterator[Packet]]:
    """Track and packets of a file; Malformed if it is none of the containers or breaks its container's rules."""
    kind = sniff(data, ext)
    if kind is None:
        raise Malformed("unknown container")
    try:
        track, packets = PARSERS[kind](data)
    except _BROKEN as e:
        raise e if isinstance(e, Malformed) else Malformed(f"{kind}: {e}") from e
    return track, _guarded(kind, packets)
