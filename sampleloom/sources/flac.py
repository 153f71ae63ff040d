"""FLAC: stream header, frames, decoding and encoding."""

from __future__ import annotations

import hashlib
import struct

import numpy as np

from sampleloom.sources.bits import BitReader, BitWriter, crc8, crc16
from sampleloom.sources.pcm import Malformed, Track

#: Block sizes and rates by code, sample sizes by code.
BLOCK_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, **{k: 1 << k for k in range(8, 16)}}
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
#: Coefficients of the fixed predictors by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def parse(data: bytes) -> Track:
    """The track of a native stream; ``data_at`` is its first frame."""
    if data[:4] != b"fLaC":
        raise Malformed("not a FLAC stream")
    at, track, last = 4, None, False
    while not last and at + 4 <= len(data):
        head = struct.unpack_from(">I", data, at)[0]
        last, kind, size = bool(head >> 31), head >> 24 & 127, head & 0xFFFFFF
        body = data[at + 4 : at + 4 + size]
        if kind == 0 and len(body) >= 34:
            packed = int.from_bytes(body[10:18], "big")
            bits = (packed >> 36 & 31) + 1
            samples = packed & (1 << 36) - 1
            track = Track("flac", "flac", packed >> 44, (packed >> 41 & 7) + 1, "int", bits, bits, samples=samples or -1, config=body[:34])
        elif kind == 4 and track is not None:
            track.tags = parse_comments(body)
        at += 4 + size
    if track is None:
        raise Malformed("FLAC without stream information")
    track.data_at, track.data_bytes = at, len(data) - at
    return track


def parse_comments(body: bytes) -> dict[str, list[str]]:
    """Vorbis comments; keys in upper case."""
    tags: dict[str, list[str]] = {}
    at = 4 + struct.unpack_from("<I", body)[0]
    for _ in range(struct.unpack_from("<I", body, at)[0]):
        size = struct.unpack_from("<I", body, at + 4)[0]
        key, _, value = body[at + 8 : at + 8 + size].decode("utf-8", "replace").partition("=")
        tags.setdefault(key.upper(), []).append(value)
        at += 4 + size
    return tags


def _coded_number(r: BitReader) -> int:
    """The frame or sample number, in the UTF-8 manner."""
    first = r.take(8)
    if first < 0x80:
        return first
    extra = 1
    while first << extra & 0x40:
        extra += 1
    value = first & (0x3F >> extra)
    for _ in range(extra):
        value = value << 6 | r.take(8) & 0x3F
    return value


def _residual(r: BitReader, size: int, order: int) -> np.ndarray:
    wide = 5 if r.take(2) else 4
    parts = 1 << r.take(4)
    out = []
    for p in range(parts):
        n = size // parts - (order if p == 0 else 0)
        k = r.take(wide)
        if k == (1 << wide) - 1:
            bits = r.take(5)
            out += [r.signed(bits) for _ in range(n)]
        else:
            out += r.rice(n, k)
    return np.array(out, dtype=np.int64)


def _predict(warm: list[int], residual: np.ndarray, coefficients: tuple | list, shift: int) -> np.ndarray:
    out = list(warm)
    order = len(coefficients)
    for e in residual.tolist():
        total = 0
        for j in range(order):
            total += coefficients[j] * out[-1 - j]
        out.append(e + (total >> shift))
    return np.array(out, dtype=np.int64)


def _integrate(warm: list[int], residual: np.ndarray) -> np.ndarray:
    """Undo a fixed predictor: its residuals are differences of its order, so running sums give the samples back."""
    levels = [np.array(warm, dtype=np.int64)]
    while len(levels[-1]) > 1:
        levels.append(np.diff(levels[-1]))
    out = residual
    for level in reversed(levels if warm else []):
        out = level[-1] + np.cumsum(out)
    return np.concatenate([np.array(warm, dtype=np.int64), out])


def _subframe(r: BitReader, size: int, bits: int) -> np.ndarray:
    r.take(1)
    kind, wasted = r.take(6), 0
    if r.take(1):
        wasted = r.unary() + 1
    bits -= wasted
    if kind == 0:
        out = np.full(size, r.signed(bits), dtype=np.int64)
    elif kind == 1:
        out = np.array([r.signed(bits) for _ in range(size)], dtype=np.int64)
    elif 8 <= kind <= 12:
        order = kind - 8
        warm = [r.signed(bits) for _ in range(order)]
        residual = _residual(r, size, order)
        out = _integrate(warm, residual)
    elif kind >= 32:
        order = kind - 31
        warm = [r.signed(bits) for _ in range(order)]
        precision, shift = r.take(4) + 1, r.signed(5)
        coefficients = [r.signed(precision) for _ in range(order)]
        out = _predict(warm, _residual(r, size, order), coefficients, max(shift, 0))
    else:
        raise Malformed(f"reserved subframe {kind}")
    return out << wasted


def decode_frame(data: bytes, track: Track) -> tuple[np.ndarray, int, int]:
    """channels x frames of the frame at the start of ``data``, its number, and its bytes."""
    r = BitReader(data)
    if r.take(15) != 0x7FFC:
        raise Malformed("no frame here")
    variable, block, rate, mode, bits = r.take(1), r.take(4), r.take(4), r.take(4), r.take(3)
    r.take(1)
    number = _coded_number(r)
    size = r.take(8) + 1 if block == 6 else r.take(16) + 1 if block == 7 else BLOCK_SIZES.get(block)
    if size is None or mode > 10:
        raise Malformed("reserved frame header")
    r.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
    at = r.position // 8
    if crc8(data[:at]) != r.take(8):
        raise Malformed("frame header checksum")
    depth = SAMPLE_BITS.get(bits, track.bit_depth)
    channels = 2 if mode >= 8 else mode + 1
    planes = [_subframe(r, size, depth + (1 if mode in (8, 10) and c == 1 or mode == 9 and c == 0 else 0)) for c in range(channels)]
    if mode == 8:
        planes[1] = planes[0] - planes[1]
    elif mode == 9:
        planes[0] = planes[0] + planes[1]
    elif mode == 10:
        mid, side = planes[0] * 2 + (planes[1] & 1), planes[1]
        planes = [(mid + side) >> 1, (mid - side) >> 1]
    r.align()
    at = r.position // 8
    if crc16(data[:at]) != r.take(16):
        raise Malformed("frame checksum")
    return np.array(planes).astype(np.int32), number if variable else number * size, at + 2


def frames(data: bytes, track: Track):
    """(position, offset, bytes, channels x frames) of every frame."""
    at, pos = track.data_at, 0
    longest = int.from_bytes(track.config[7:10], "big") or 1 << 20
    while at + 6 <= len(data):
        planes, _, size = decode_frame(data[at : at + longest], track)
        yield pos, at, size, planes
        at, pos = at + size, pos + planes.shape[1]


def _rice(values: np.ndarray, order: int, size: int, w: BitWriter) -> None:
    """Residuals in partitions, each with the parameter that makes it shortest."""
    folded = np.where(values < 0, -2 * values - 1, 2 * values)
    level = 0
    while level < 4 and size % (2 << level) == 0 and size >> level + 1 > order:
        level += 1
    w.put(0, 2)
    w.put(level, 4)
    at = 0
    for p in range(1 << level):
        n = (size >> level) - (order if p == 0 else 0)
        part = folded[at : at + n]
        at += n
        costs = [int((part >> k).sum()) + n * (k + 1) for k in range(15)]
        k = int(np.argmin(costs))
        w.put(k, 4)
        w.rice(part, k)


def encode_frame(planes: np.ndarray, number: int, bits: int) -> bytes:
    """One frame with fixed predictors; the order with the smallest residuals is taken per channel."""
    size = planes.shape[1]
    w = BitWriter()
    w.put(0x7FFC, 15)
    w.put(0, 1)
    w.put(7, 4)
    w.put(0, 4)
    w.put(len(planes) - 1, 4)
    w.put({v: k for k, v in SAMPLE_BITS.items()}.get(bits, 0), 3)
    w.put(0, 1)
    for b in chr(number).encode("utf-8", "surrogatepass") if number < 0x110000 else _long_number(number):
        w.put(b, 8)
    w.put(size - 1, 16)
    w.put(crc8(w.bytes()), 8)
    for x in planes.astype(np.int64):
        if (x == x[0]).all():
            w.put(0, 8)
            w.put(int(x[0]), bits)
            continue
        best, order = None, 0
        for o in range(min(5, size)):
            d = np.diff(x, o) if o else x
            cost = int(np.abs(d).sum())
            if best is None or cost < best:
                best, order = cost, o
        w.put((8 + order) << 1, 8)
        for v in x[:order].tolist():
            w.put(v, bits)
        _rice(np.diff(x, order) if order else x, order, size, w)
    body = w.bytes()
    return body + struct.pack(">H", crc16(body))


def _long_number(n: int) -> bytes:
    extra = 4 if n < 1 << 26 else 5 if n < 1 << 31 else 6
    out = [0x80 | n >> 6 * k & 0x3F for k in range(extra - 1, -1, -1)]
    return bytes([(0xFF00 >> extra + 1) & 0xFF | n >> 6 * extra, *out])


def write(planes: np.ndarray, rate: int, bits: int = 16, block: int = 4096) -> bytes:
    channels, n = planes.shape
    body = [encode_frame(planes[:, a : a + block], k, bits) for k, a in enumerate(range(0, n, block))]
    width = -(-bits // 8)
    flat = planes.T.reshape(-1).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width]
    packed = rate << 44 | channels - 1 << 41 | bits - 1 << 36 | n
    sizes = [len(b) for b in body] or [0]
    info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(flat.tobytes()).digest()
    return b"fLaC" + struct.pack(">I", 0x80000000 | len(info)) + info + b"".join(body)
