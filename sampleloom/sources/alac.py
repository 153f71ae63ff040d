"""ALAC: frames of adaptively predicted, adaptively coded samples, decoded and encoded."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from sampleloom.sources.bits import BitReader, BitWriter
from sampleloom.sources.pcm import Malformed

#: Parameters of the adaptive code.
_Q_SHIFT, _MEAN_CLAMP, _LONGEST_PREFIX = 9, 0xFFFF, 9
_SINGLE, _PAIR, _END = 0, 1, 7


@dataclass(frozen=True)
class Config:
    """What the cookie says of a stream."""

    frame: int = 4096
    bits: int = 16
    channels: int = 2
    rate: int = 44100
    history: int = 40
    initial: int = 10
    limit: int = 14

    @classmethod
    def parse(cls, cookie: bytes) -> Config:
        if cookie[4:8] in (b"frma", b"alac"):  # inside its MP4 boxes
            at = cookie.find(b"alac", 8)
            cookie = cookie[at + 8 :] if at >= 0 else cookie[12:]
        if len(cookie) < 24:
            raise Malformed("ALAC cookie is too short")
        frame, _, bits, history, initial, limit, channels, _, _, _, rate = struct.unpack_from(">IBBBBBBHIII", cookie)
        if not frame or bits not in (16, 20, 24, 32) or not 1 <= channels <= 8:
            raise Malformed("ALAC cookie")
        return cls(frame, bits, channels, rate, history, initial, limit)

    def cookie(self) -> bytes:
        return struct.pack(">IBBBBBBHIII", self.frame, 0, self.bits, self.history, self.initial, self.limit, self.channels, 255, 0, 0, self.rate)


def _get(r: BitReader, k: int, multiplier: int, raw: int) -> int:
    """One number: a run of ones, then (unless it is too long) k bits, where 0 and 1 take a bit less."""
    zero = r.text.find("0", r.position, r.position + _LONGEST_PREFIX)
    if zero < 0:
        r.position += _LONGEST_PREFIX
        return r.take(raw)
    prefix, r.position = zero - r.position, zero + 1
    if k <= 1:
        return prefix * multiplier if k == 1 else prefix
    v = r.take(k - 1)
    if v == 0:
        return prefix * multiplier
    return prefix * multiplier + (v << 1 | r.take(1)) - 1


def _put(w: BitWriter, value: int, k: int, multiplier: int, raw: int) -> None:
    prefix, rest = divmod(value, multiplier) if multiplier else (value, 0)
    if prefix >= _LONGEST_PREFIX:
        w.put((1 << _LONGEST_PREFIX) - 1, _LONGEST_PREFIX)
        w.put(value, raw)
        return
    w.put((1 << prefix) - 1, prefix)
    w.put(0, 1)
    if k > 1:
        if rest == 0:
            w.put(0, k - 1)
        else:
            w.put(rest + 1, k)


class _Mean:
    """The running mean that picks the parameter of the next number."""

    def __init__(self, c: Config, factor: int):
        self.c, self.mean, self.weight = c, c.initial, c.history * factor // 4

    def number(self) -> tuple[int, int]:
        k = min(((self.mean >> _Q_SHIFT) + 3).bit_length() - 1, self.c.limit)
        return k, (1 << k) - 1

    def seen(self, n: int) -> None:
        self.mean = _MEAN_CLAMP if n > _MEAN_CLAMP else self.mean + self.weight * n - (self.weight * self.mean >> _Q_SHIFT)

    def zeros(self) -> tuple[int, int] | None:
        """Parameter of a run of zeros, if the mean is low enough for one."""
        if self.mean << 2 >= 1 << _Q_SHIFT:
            return None
        k = 8 - self.mean.bit_length() + (self.mean + 16 >> 6)
        return k, (1 << k) - 1 & (1 << self.c.limit) - 1


def _read_residuals(r: BitReader, n: int, bits: int, c: Config, factor: int) -> list[int]:
    mean, out, after_run = _Mean(c, factor), [], 0
    while len(out) < n:
        k, multiplier = mean.number()
        v = _get(r, k, multiplier, bits) + after_run
        out.append((v + 1 >> 1) * (-1 if v & 1 else 1))
        mean.seen(v)
        after_run = 0
        run = mean.zeros()
        if run and len(out) < n:
            zeros = _get(r, *run, 16)
            if zeros > n - len(out):
                raise Malformed("run past the frame")
            out += [0] * zeros
            after_run = 0 if zeros >= _MEAN_CLAMP else 1
            mean.mean = 0
    return out


def _write_residuals(w: BitWriter, values: list[int], bits: int, c: Config, factor: int) -> None:
    mean, at, after_run = _Mean(c, factor), 0, 0
    while at < len(values):
        v = values[at]
        v = -2 * v - 1 if v < 0 else 2 * v
        at += 1
        k, multiplier = mean.number()
        _put(w, v - after_run, k, multiplier, bits)
        mean.seen(v)
        after_run = 0
        run = mean.zeros()
        if run and at < len(values):
            zeros = 0
            while at < len(values) and values[at] == 0 and zeros < _MEAN_CLAMP:
                zeros, at = zeros + 1, at + 1
            _put(w, zeros, *run, 16)
            after_run = 0 if zeros >= _MEAN_CLAMP else 1
            mean.mean = 0


def _sign(x: int) -> int:
    return (x > 0) - (x < 0)


def _wrap(x: int, bits: int) -> int:
    half = 1 << bits - 1
    return (x + half & (1 << bits) - 1) - half


def _predicted(residuals: list[int] | None, samples: list[int] | None, coefficients: list[int], shift: int, bits: int) -> list[int]:
    """Samples of residuals, or residuals of samples: both sides run the same adaptive predictor.

    After each sample the coefficients move a step against the sign of the error, the oldest first, until the error is used up.
    """
    order, decode = len(coefficients), residuals is not None
    source = residuals if decode else samples
    history: list[int] = []
    out = []
    half = 1 << shift - 1 if shift else 0
    a = list(coefficients)
    for j, x in enumerate(source):
        if j == 0:
            error = value = x
        elif order == 31 or j <= order:
            value = _wrap(x + history[-1], bits) if decode else x
            error = x if decode else _wrap(x - history[-1], bits)
        else:
            base = history[j - order - 1]
            recent = history[: j - order - 1 : -1]
            guess = base + (sum(k * (h - base) for k, h in zip(a, recent, strict=True)) + half >> shift)
            value = _wrap(x + guess, bits) if decode else x
            error = x if decode else _wrap(x - guess, bits)
            left, way = error, _sign(error)
            if way:
                for k in range(order - 1, -1, -1):
                    d = base - recent[k]
                    step = way * _sign(d)
                    a[k] -= step
                    left -= (order - k) * (step * d >> shift)
                    if left * way <= 0:
                        break
        history.append(value)
        out.append(value if decode else error)
    return out


def decode_frame(packet: bytes, c: Config) -> np.ndarray:
    """channels x frames of one packet."""
    r, planes = BitReader(packet), []
    while len(planes) < c.channels:
        kind = r.take(3)
        if kind == _END:
            break
        if kind not in (_SINGLE, 3, _PAIR):
            raise Malformed(f"ALAC element {kind}")
        r.take(16)
        partial, shifted, raw = r.take(1), 8 * r.take(2), r.take(1)
        n = r.take(32) if partial else c.frame
        if n > c.frame:
            raise Malformed("ALAC frame too long")
        width = 2 if kind == _PAIR else 1
        if raw:
            rows = [[r.signed(c.bits) for _ in range(width)] for _ in range(n)]
            planes += [list(x) for x in zip(*rows, strict=True)] if rows else [[] for _ in range(width)]
            continue
        bits = c.bits - shifted + width - 1
        mix_bits, mix_weight = r.take(8), r.signed(8)
        heads = []
        for _ in range(width):
            mode, shift, factor, order = r.take(4), r.take(4), r.take(3), r.take(5)
            heads.append((mode, shift, factor, [r.signed(16) for _ in range(order)]))
        low = [[r.take(shifted) for _ in range(width)] for _ in range(n)] if shifted else []
        parts = []
        for mode, shift, factor, coefficients in heads:
            residuals = _read_residuals(r, n, bits, c, factor)
            if mode:
                residuals = _predicted(residuals, None, [0] * 31, 0, bits)
            parts.append(_predicted(residuals, None, coefficients, shift, bits))
        if width == 2 and mix_weight:
            left = [u + v - (mix_weight * v >> mix_bits) for u, v in zip(*parts, strict=True)]
            parts = [left, [x - v for x, v in zip(left, parts[1], strict=True)]]
        if shifted:
            parts = [[x << shifted | y[k] for x, y in zip(p, low, strict=True)] for k, p in enumerate(parts)]
        planes += parts
    return np.array(planes, dtype=np.int64).astype(np.int32)


def encode_frame(planes: np.ndarray, c: Config, order: int = 8, shift: int = 9) -> bytes:
    """One packet: pairs of channels mixed to middle and side, predictors that start from the last difference."""
    n = planes.shape[1]
    w = BitWriter()
    start = [160 << shift >> 7, -190 << shift >> 7, 170 << shift >> 7, *[-130 << shift >> 7, 80 << shift >> 7, -25 << shift >> 7, 0, 0]][:order]
    pairs = [planes[k : k + 2].tolist() for k in range(0, len(planes), 2)]
    for tag, part in enumerate(pairs):
        width = len(part)
        shifted = 8 if c.bits > 20 else 0
        w.put(_PAIR if width == 2 else _SINGLE, 3)
        w.put(tag, 4)
        w.put(0, 12)
        w.put(int(n != c.frame), 1)
        w.put(shifted // 8, 2)
        w.put(0, 1)
        if n != c.frame:
            w.put(n, 32)
        bits = c.bits - shifted + width - 1
        mix_bits, weight = (2, 2) if width == 2 else (0, 0)
        low = [[x & (1 << shifted) - 1 for x in p] for p in part]
        high = [[x >> shifted for x in p] for p in part]
        if width == 2:
            side = [a - b for a, b in zip(*high, strict=True)]
            high = [[b + (weight * s >> mix_bits) for b, s in zip(high[1], side, strict=True)], side]
        w.put(mix_bits, 8)
        w.put(weight, 8)
        for _ in range(width):
            for v, size in ((0, 4), (shift, 4), (4, 3), (order, 5)):
                w.put(v, size)
            for k in start:
                w.put(k, 16)
        if shifted:
            for row in zip(*low, strict=True):
                for x in row:
                    w.put(x, shifted)
        for p in high:
            _write_residuals(w, _predicted(None, p, start, shift, bits), bits, c, 4)
    w.put(_END, 3)
    return w.bytes()
