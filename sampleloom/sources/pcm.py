"""PCM containers: RIFF/RF64 WAVE and AIFF/AIFC, read and written."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from sampleloom.core.schemas import DEFAULT_LAYOUTS


@dataclass
class Track:
    container: str
    codec: str
    rate: int
    channels: int
    sample_type: str = "int"
    bit_depth: int = 16
    source_bit_depth: int = 16
    layout: int = 0
    samples: int = -1
    delay: int = 0
    padding: int = 0
    config: bytes = b""
    tags: dict[str, list[str]] = field(default_factory=dict)
    chapters: list[tuple[int, int, str]] = field(default_factory=list)
    warnings: list[tuple[int, str]] = field(default_factory=list)
    #: PCM only: where the samples are, bytes of a sample on disk, byte order, and whether bytes are unsigned.
    data_at: int = 0
    data_bytes: int = 0
    width: int = 2
    big_endian: bool = False
    unsigned: bool = False

    def __post_init__(self):
        self.layout = self.layout or DEFAULT_LAYOUTS.get(self.channels, 0)


class Malformed(ValueError):
    """The bytes are not what their container promises."""


def _chunks(data: bytes, at: int, order: str, long_sizes: dict[bytes, int] | None = None):
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from(order + "I", data, at + 4)[0]
        if size == 0xFFFFFFFF and long_sizes:
            size = long_sizes.get(name, size)
        yield name, at + 8, size
        at += 8 + size + (size & 1)


def parse_wav(data: bytes) -> Track:
    if data[:4] not in (b"RIFF", b"RF64") or data[8:12] != b"WAVE":
        raise Malformed("not a WAVE file")
    track, body, tags, sizes = None, None, {}, {}
    for name, at, size in _chunks(data, 12, "<", sizes):
        if name == b"ds64" and size >= 24:
            sizes[b"data"] = struct.unpack_from("<Q", data, at + 8)[0]
        elif name == b"fmt " and size >= 16:
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at)
            valid, layout = bits, 0
            if kind == 0xFFFE and size >= 40:
                valid, layout, kind = struct.unpack_from("<HIH", data, at + 18)
            if kind not in (1, 3) or not channels or not rate or bits % 8 or not bits:
                raise Malformed(f"unsupported WAVE format {kind} of {bits} bits")
            real = kind == 3
            track = Track("wav", "pcm", rate, channels, "float" if real else "int", 32 if real else valid or bits, bits if real else valid or bits, layout, width=bits // 8, unsigned=bits == 8 and not real)
        elif name == b"data":
            body = (at, min(size, len(data) - at))
            if at + size > len(data) and sizes.get(name, size) == size and track:
                track.warnings.append((at, "data is cut short"))
        elif name == b"LIST" and data[at : at + 4] == b"INFO":
            for key, a, n in _chunks(data[: at + size], at + 4, "<"):
                tags.setdefault(key.decode("latin-1"), []).append(data[a : a + n].rstrip(b"\0").decode("utf-8", "replace"))
    if track is None or body is None:
        raise Malformed("WAVE without fmt or data")
    track.tags = tags
    return _sized(track, *body)


def _sized(track: Track, at: int, size: int) -> Track:
    frame = track.width * track.channels
    track.data_at, track.samples = at, size // frame
    track.data_bytes = track.samples * frame
    return track


def _extended(data: bytes) -> float:
    """An 80-bit float, as AIFF stores its rate."""
    exponent, mantissa = struct.unpack(">HQ", data)
    return mantissa * 2.0 ** ((exponent & 0x7FFF) - 16383 - 63) * (-1 if exponent & 0x8000 else 1)


def parse_aiff(data: bytes) -> Track:
    if data[:4] != b"FORM" or data[8:12] not in (b"AIFF", b"AIFC"):
        raise Malformed("not an AIFF file")
    track, body = None, None
    for name, at, size in _chunks(data, 12, ">"):
        if name == b"COMM" and size >= 18:
            channels, _, bits = struct.unpack_from(">hIh", data, at)
            rate, kind = _extended(data[at + 8 : at + 18]), data[at + 18 : at + 22] if data[8:12] == b"AIFC" else b"NONE"
            if kind not in (b"NONE", b"twos", b"sowt", b"fl32", b"FL32", b"fl64", b"FL64") or channels < 1 or rate < 1:
                raise Malformed(f"unsupported AIFF compression {kind!r}")
            real = kind.lower() in (b"fl32", b"fl64")
            track = Track("aiff", "pcm", int(rate), channels, "float" if real else "int", 32 if real else bits, bits, width=-(-bits // 8), big_endian=kind != b"sowt")
        elif name == b"SSND":
            skip = struct.unpack_from(">I", data, at)[0]
            body = (at + 8 + skip, min(size - 8 - skip, len(data) - at - 8 - skip))
    if track is None or body is None:
        raise Malformed("AIFF without COMM or SSND")
    return _sized(track, *body)


def decode(track: Track, raw: bytes) -> np.ndarray:
    """Channels x frames of raw interleaved samples: int32 right-justified, or float32."""
    order = ">" if track.big_endian else "<"
    if track.sample_type == "float":
        flat = np.frombuffer(raw, dtype=f"{order}f{track.width}").astype(np.float32)
    elif track.width == 1:
        flat = np.frombuffer(raw, dtype=np.uint8).astype(np.int32) - 128 if track.unsigned else np.frombuffer(raw, dtype=np.int8).astype(np.int32)
    elif track.width == 3:
        b = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        b = b if track.big_endian else b[:, ::-1]
        flat = (b[:, 0] << 24 | b[:, 1] << 16 | b[:, 2] << 8) >> 8
    else:
        flat = np.frombuffer(raw, dtype=f"{order}i{track.width}").astype(np.int32)
    if track.sample_type == "int" and track.bit_depth < 8 * track.width:
        flat = flat >> (8 * track.width - track.bit_depth)
    return flat.reshape(-1, track.channels).T


def encode(planes: np.ndarray, bits: int, big_endian: bool = False, unsigned8: bool = True) -> bytes:
    """Interleaved bytes of channels x frames: float32 as it is, integers of ``bits`` in whole bytes."""
    flat = planes.T.reshape(-1)
    order = ">" if big_endian else "<"
    if planes.dtype == np.float32:
        return flat.astype(f"{order}f4").tobytes()
    width = -(-bits // 8)
    flat = flat.astype(np.int64) << (8 * width - bits)
    if width == 1:
        return (flat + 128).astype(np.uint8).tobytes() if unsigned8 else flat.astype(np.int8).tobytes()
    if width == 3:
        b = np.stack([flat >> s & 255 for s in ((16, 8, 0) if big_endian else (0, 8, 16))], axis=1)
        return b.astype(np.uint8).tobytes()
    return flat.astype(f"{order}i{width}").tobytes()


def write_wav(planes: np.ndarray, rate: int, bits: int = 16, layout: int = 0) -> bytes:
    real = planes.dtype == np.float32
    channels, width = len(planes), 4 if real else -(-bits // 8)
    body = encode(planes, bits)
    plain = channels <= 2 and (real or bits == 8 * width)
    fmt = struct.pack("<HHIIHH", (3 if real else 1) if plain else 0xFFFE, channels, rate, rate * channels * width, channels * width, 8 * width)
    if not plain:
        guid = struct.pack("<H", 3 if real else 1) + bytes.fromhex("000000001000800000AA00389B71")
        fmt += struct.pack("<HHI", 22, 32 if real else bits, layout or DEFAULT_LAYOUTS.get(channels, 0)) + guid
    parts = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", len(parts)) + parts


def write_aiff(planes: np.ndarray, rate: int, bits: int = 16) -> bytes:
    real = planes.dtype == np.float32
    exponent = rate.bit_length() - 1
    rate80 = struct.pack(">HQ", 16383 + exponent, rate << 63 - exponent)
    comm = struct.pack(">hIh", len(planes), planes.shape[1], 32 if real else bits) + rate80 + (b"fl32\0\0" if real else b"")
    body = struct.pack(">II", 0, 0) + encode(planes, bits, big_endian=True, unsigned8=False)
    parts = (b"AIFC" if real else b"AIFF") + b"COMM" + struct.pack(">I", len(comm)) + comm + b"SSND" + struct.pack(">I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"FORM" + struct.pack(">I", len(parts)) + parts
