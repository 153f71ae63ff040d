"""WavPack: blocks of decorrelated, adaptively coded integers; lossless, one or two channels a block."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from sampleloom.sources.pcm import Malformed

#: Block flags, sub-block numbers, constants of the word code.
MONO, HYBRID, JOINT, FLOAT, INITIAL, FINAL, FALSE_STEREO = 0x4, 0x8, 0x10, 0x80, 0x800, 0x1000, 0x40000000
_TERMS, _WEIGHTS, _SAMPLES, _ENTROPY, _EXTENDED, _BITS = 0x02, 0x03, 0x04, 0x05, 0x09, 0x0A
_MOST_ONES, _DIVISORS = 16, (128, 64, 32)
RATES = (6000, 8000, 9600, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000, 64000, 88200, 96000, 192000)


def power_of(v: int) -> int:
    """The number of a 16-bit logarithm (8 bits of fraction), as histories are stored."""
    if v < 0:
        return -power_of(-v)
    mantissa, shift = 256 + round(256 * 2 ** ((v & 255) / 256)) - 256, v >> 8
    return mantissa >> 9 - shift if shift <= 9 else mantissa << shift - 9


class _Reader:
    """Bits of each byte from the lowest up, as a text."""

    def __init__(self, data: bytes):
        self.text = format(int.from_bytes(data + b"\1", "little"), "b")[:0:-1]
        self.at = 0

    def take(self, n: int) -> int:
        if not n:
            return 0
        if self.at + n > len(self.text):
            raise EOFError("out of bits")
        self.at += n
        return int(self.text[self.at - n : self.at][::-1], 2)

    def ones(self, most: int) -> int:
        zero = self.text.find("0", self.at, self.at + most)
        if zero < 0:
            if self.at + most > len(self.text):
                raise EOFError("out of bits")
            self.at += most
            return most
        n, self.at = zero - self.at, zero + 1
        return n

    def gamma(self) -> int:
        n = self.ones(33)
        return n if n < 2 else self.take(n - 1) | 1 << n - 1


class _Writer:
    def __init__(self):
        self.parts: list[str] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.parts.append(format(value, f"0{n}b")[::-1])

    def gamma(self, value: int) -> None:
        n = value.bit_length()
        self.parts.append("1" * n + "0")
        self.put(value & (1 << max(n - 1, 0)) - 1, max(n - 1, 0))

    def bytes(self) -> bytes:
        text = "".join(self.parts)
        text += "1" * (-len(text) % 16)
        return int(text[::-1], 2).to_bytes(len(text) // 8, "little") if text else b""


@dataclass
class _Medians:
    """Three running medians of a channel cut the magnitudes into zones."""

    m: list[int] = field(default_factory=lambda: [0, 0, 0])

    def width(self, k: int) -> int:
        return (self.m[k] >> 4) + 1

    def zone_of(self, size: int) -> int:
        if size < self.width(0):
            return 0
        size -= self.width(0)
        return 1 if size < self.width(1) else 2 + (size - self.width(1)) // self.width(2)

    def enter(self, zone: int) -> tuple[int, int]:
        """First magnitude and width of a zone; the medians below it rise, its own falls."""
        low = sum(self.width(k) for k in range(min(zone, 2))) + max(zone - 2, 0) * self.width(2)
        width = self.width(min(zone, 2))
        for k in range(min(zone, 3)):
            self.m[k] += (self.m[k] + _DIVISORS[k]) // _DIVISORS[k] * 5
        if zone < 3:
            self.m[zone] -= (self.m[zone] + _DIVISORS[zone] - 2) // _DIVISORS[zone] * 2
        return low, width


def read_words(data: bytes, channels: list[_Medians], count: int) -> list[int]:
    """Numbers of the channels in turn.

    A count of ones gives a word's zone in its upper bits, and in its lowest
    whether the next word lies beyond zone 0; if not, that word has no count.
    """
    r, out, zeros, held = _Reader(data), [], 0, None
    while len(out) < count:
        c = channels[len(out) % len(channels)]
        if held is None and all(x.m[0] < 2 for x in channels):
            if zeros:
                zeros -= 1
            else:
                zeros = r.gamma()
                if zeros:
                    for x in channels:
                        x.m = [0, 0, 0]
            if zeros:
                out.append(0)
                continue
        if held == 0:
            zone, held = 0, None
        else:
            n = r.ones(_MOST_ONES)
            n += r.gamma() if n == _MOST_ONES else 0
            zone, held = (n >> 1) + (held or 0), n & 1
        low, width = c.enter(zone)
        top, code = width - 1, 0
        if top:
            spare = (1 << top.bit_length()) - width
            code = r.take(top.bit_length() - 1)
            if code >= spare:
                code = (code << 1) - spare + r.take(1)
        out.append(~(low + code) if r.take(1) else low + code)
    return out


def write_words(values: list[int], channels: list[_Medians]) -> bytes:
    w, k, held = _Writer(), 0, None
    size = lambda v: ~v if v < 0 else v
    while k < len(values):
        if held is None and all(x.m[0] < 2 for x in channels):
            run = next((j for j, v in enumerate(values[k:]) if v), len(values) - k)
            w.gamma(run)
            if run:
                for x in channels:
                    x.m = [0, 0, 0]
                k += run
                if k == len(values):
                    break
        c = channels[k % len(channels)]
        zone = c.zone_of(size(values[k]))
        low, width = c.enter(zone)
        if held == 0:
            held = None
        else:
            beyond = int(k + 1 < len(values) and channels[(k + 1) % len(channels)].zone_of(size(values[k + 1])) > 0)
            n = 2 * (zone - (held or 0)) + beyond
            if n < _MOST_ONES:
                w.parts.append("1" * n + "0")
            else:
                w.parts.append("1" * _MOST_ONES)
                w.gamma(n - _MOST_ONES)
            held = beyond
        top, code = width - 1, size(values[k]) - low
        if top:
            bits, spare = top.bit_length(), (1 << top.bit_length()) - width
            if code < spare:
                w.put(code, bits - 1)
            else:
                w.put(code + spare >> 1, bits - 1)
                w.put(code + spare & 1, 1)
        w.put(int(values[k] < 0), 1)
        k += 1
    return w.bytes()


@dataclass
class _Pass:
    """One decorrelation pass over one or two channels."""

    term: int
    delta: int
    weights: list[int] = field(default_factory=lambda: [0, 0])
    history: list[list[int]] = field(default_factory=lambda: [[0] * 8, [0] * 8])

    def run(self, planes: list[list[int]], decode: bool) -> list[list[int]]:
        return self._cross(planes, decode) if self.term < 0 else [self._own(x, c, decode) for c, x in enumerate(planes)]

    def _own(self, x: list[int], c: int, decode: bool) -> list[int]:
        w, h, out, term, delta = self.weights[c], list(self.history[c]), [], self.term, self.delta
        for j, v in enumerate(x):
            guess = 2 * h[0] - h[1] if term == 17 else 3 * h[0] - h[1] >> 1 if term == 18 else h[j & 7]
            shift = w * guess + 512 >> 10
            sample, residual = (v + shift, v) if decode else (v, v - shift)
            if guess and residual:
                w += delta if (guess < 0) == (residual < 0) else -delta
            if term > 8:
                h[1], h[0] = h[0], sample
            else:
                h[j + term & 7] = sample
            out.append(sample if decode else residual)
        return out

    def _cross(self, planes: list[list[int]], decode: bool) -> list[list[int]]:
        """A channel is predicted from the other: -1 the left from the right before, -2 the reverse, -3 both so."""
        (wa, wb), a, b = self.weights, self.history[0][0], self.history[1][0]
        left, right = [], []

        def code(v: int, guess: int, w: int) -> tuple[int, int, int]:
            shift = w * guess + 512 >> 10
            sample, residual = (v + shift, v) if decode else (v, v - shift)
            if guess and residual:
                w += self.delta if (guess < 0) == (residual < 0) else -self.delta
            return sample, residual, max(-1024, min(1024, w))

        for x, y in zip(*planes, strict=True):
            if self.term == -1:
                s, r, wa = code(x, a, wa)
                t, q, wb = code(y, s, wb)
                a = t
            elif self.term == -2:
                t, q, wb = code(y, b, wb)
                s, r, wa = code(x, t, wa)
                b = s
            else:
                s, r, wa = code(x, a, wa)
                t, q, wb = code(y, b, wb)
                a, b = t, s
            left.append(s if decode else r)
            right.append(t if decode else q)
        return [left, right]


def _weight(b: int) -> int:
    w = (b - 256 if b > 127 else b) * 8
    return w + (w + 64 >> 7) if w > 0 else w


def _checksum(planes: list[list[int]]) -> int:
    crc = 0xFFFFFFFF
    for row in zip(*planes, strict=True):
        for v in row:
            crc = crc * 3 + v & 0xFFFFFFFF
    return crc


def decode_block(block: bytes) -> tuple[np.ndarray, int]:
    """channels x frames of one block, and its flags."""
    if block[:4] != b"wvpk" or len(block) < 32:
        raise Malformed("not a WavPack block")
    n, flags, crc = struct.unpack_from("<III", block, 20)
    if flags & (HYBRID | FLOAT):
        raise Malformed("hybrid or float WavPack")
    width = 1 if flags & (MONO | FALSE_STEREO) else 2
    passes: list[_Pass] = []
    medians = [_Medians() for _ in range(width)]
    bits, at = b"", 32
    while at + 2 <= len(block):
        kind, words = block[at], block[at + 1]
        at += 2
        if kind & 0x80:
            words |= struct.unpack_from("<H", block, at)[0] << 8
            at += 2
        body = block[at : at + 2 * words - (1 if kind & 0x40 else 0)]
        at += 2 * words
        kind &= 0x1F
        if kind == _TERMS:
            passes = [_Pass((b & 31) - 5, b >> 5) for b in reversed(body)]
            if any(p.term == 0 or p.term < -3 or 8 < p.term < 17 or p.term > 18 or (p.term < 0 and width == 1) for p in passes):
                raise Malformed("WavPack term")
        elif kind == _WEIGHTS:
            values = iter(body)
            for p, first in zip(reversed(passes), values, strict=False):
                p.weights = [_weight(first), _weight(next(values, 0)) if width == 2 else 0]
        elif kind == _SAMPLES:
            values = iter([power_of(v) for v in struct.unpack(f"<{len(body) // 2}h", body[: len(body) // 2 * 2])])
            for p in reversed(passes):
                if p.term > 8:
                    for c in range(width):
                        p.history[c][:2] = [next(values, 0), next(values, 0)]
                elif p.term < 0:
                    p.history[0][0], p.history[1][0] = next(values, 0), next(values, 0)
                else:
                    for k in range(p.term):
                        for c in range(width):
                            p.history[c][k] = next(values, 0)
        elif kind == _ENTROPY:
            values = [power_of(v) for v in struct.unpack_from(f"<{3 * width}H", body)]
            for c in range(width):
                medians[c].m = values[3 * c : 3 * c + 3]
        elif kind == _EXTENDED and any(body):
            raise Malformed("extended integers in WavPack")
        elif kind == _BITS:
            bits = body
    words = read_words(bits, medians, n * width)
    planes = [words[c::width] for c in range(width)]
    for p in passes:
        planes = p.run(planes, True)
    if flags & JOINT and width == 2:
        right = [y - (x >> 1) for x, y in zip(*planes, strict=True)]
        planes = [[x + y for x, y in zip(planes[0], right, strict=True)], right]
    if _checksum(planes) != crc:
        raise Malformed("WavPack checksum")
    out = np.array(planes, dtype=np.int64).reshape(width, n) << (flags >> 13 & 31)
    return (np.repeat(out, 2, axis=0) if flags & FALSE_STEREO else out).astype(np.int32), flags


def decode_packet(packet: bytes) -> np.ndarray:
    """All channels of a packet: one block, or several for more than two channels."""
    parts, at = [], 0
    while at + 32 <= len(packet):
        size = struct.unpack_from("<I", packet, at + 4)[0] + 8
        parts.append(decode_block(packet[at : at + size])[0])
        at += size
    return np.concatenate(parts)


def _sub_block(kind: int, body: bytes) -> bytes:
    odd, words = len(body) & 1, (len(body) + 1) // 2
    head = bytes([kind | 0x40 * odd, words]) if words < 256 else bytes([kind | 0x80 | 0x40 * odd, words & 255]) + struct.pack("<H", words >> 8)
    return head + body + bytes(odd)


def encode_block(planes: np.ndarray, first: int, total: int, rate: int, bits: int, edge: int, terms: tuple[int, ...] = (18, 17, 2), delta: int = 2) -> bytes:
    """One block of one or two channels; every block starts with empty histories, so it can be decoded alone."""
    width, n = planes.shape
    flags = -(-bits // 8) - 1 | edge | RATES.index(rate) << 23 if rate in RATES else -(-bits // 8) - 1 | edge | 15 << 23
    flags |= (MONO if width == 1 else JOINT) | (-bits % 8) << 13
    x = [p.tolist() for p in planes]
    crc = _checksum(x)
    if width == 2:
        side = [a - b for a, b in zip(*x, strict=True)]
        x = [side, [b + (s >> 1) for b, s in zip(x[1], side, strict=True)]]
    passes = [_Pass(t, delta) for t in terms]
    for p in reversed(passes):
        x = p.run(x, False)
    medians = [_Medians() for _ in range(width)]
    words = write_words([v for row in zip(*x, strict=True) for v in row], medians)
    body = _sub_block(_TERMS, bytes(t + 5 | delta << 5 for t in reversed(terms))) + _sub_block(_WEIGHTS, bytes(len(terms) * width))
    body += _sub_block(_ENTROPY, bytes(6 * width)) + _sub_block(_BITS, words)
    return b"wvpk" + struct.pack("<IHBBIIIII", 24 + len(body), 0x410, 0, 0, total, first, n, flags, crc) + body


def write(planes: np.ndarray, rate: int, bits: int = 16, frames: int = 22050) -> bytes:
    """A file of channels x frames; depths that are no whole bytes are kept in the shift of the flags."""
    channels, total = planes.shape
    out = []
    for a in range(0, total, frames):
        for c in range(0, channels, 2):
            edge = (INITIAL if c == 0 else 0) | (FINAL if c + 2 >= channels else 0)
            out.append(encode_block(planes[c : c + 2, a : a + frames], a, total, rate, bits, edge))
    return b"".join(out)
