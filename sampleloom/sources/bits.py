"""Bits of byte strings, most significant first, and checksums over bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


class BitReader:
    """Bits as a text of zeros and ones: searching and slicing it runs in C."""

    def __init__(self, data: bytes):
        self.text = format(int.from_bytes(b"\1" + data, "big"), "b")[1:]
        self.position = 0

    def take(self, n: int) -> int:
        if not n:
            return 0
        end = self.position + n
        if end > len(self.text):
            raise EOFError("out of bits")
        value = int(self.text[self.position : end], 2)
        self.position = end
        return value

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> n - 1 else v

    def unary(self) -> int:
        """Zero bits up to the next one bit, which is consumed."""
        one = self.text.find("1", self.position)
        if one < 0:
            raise EOFError("out of bits")
        zeros, self.position = one - self.position, one + 1
        return zeros

    def rice(self, n: int, k: int) -> list[int]:
        """n signed numbers of a Rice code with parameter k."""
        find, text, at, out = self.text.find, self.text, self.position, []
        for _ in range(n):
            one = find("1", at)
            if one < 0:
                raise EOFError("out of bits")
            v = one - at
            at = one + 1
            if k:
                v = v << k | int(text[at : at + k], 2)
                at += k
            out.append(v >> 1 ^ -(v & 1))
        self.position = at
        return out

    def align(self) -> None:
        self.position += -self.position % 8


class BitWriter:
    def __init__(self):
        self._parts: list[str] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self._parts.append(format(value & (1 << n) - 1, f"0{n}b"))

    def unary(self, zeros: int) -> None:
        self._parts.append("0" * zeros + "1")

    def rice(self, values: np.ndarray, k: int) -> None:
        """Numbers from 0 up in a Rice code with parameter k, laid out all at once."""
        ones = values >> k
        ends = np.cumsum(ones + 1 + k)
        bits = np.full(int(ends[-1]) if len(ends) else 0, 48, dtype=np.uint8)
        bits[ends - k - 1] = 49
        for j in range(k):
            bits[ends - 1 - j] += (values >> j & 1).astype(np.uint8)
        self._parts.append(bits.tobytes().decode("ascii"))

    def bytes(self) -> bytes:
        text = "".join(self._parts)
        text += "0" * (-len(text) % 8)
        self._parts = [text]
        return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""


def _crc_table(polynomial: int, bits: int) -> list[int]:
    top, full = 1 << (bits - 1), (1 << bits) - 1
    table = []
    for k in range(256):
        r = k << (bits - 8)
        for _ in range(8):
            r = (r << 1 ^ polynomial if r & top else r << 1) & full
        table.append(r)
    return table


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    r = 0
    for b in data:
        r = _CRC8[r ^ b]
    return r


_BLOCK = 4096


@lru_cache(maxsize=1)
def _crc16_by_place() -> np.ndarray:
    """What a byte adds to the checksum from each place of a block, counted from its end: the checksum is linear."""
    table = np.empty((_BLOCK, 256), dtype=np.uint16)
    table[0] = first = np.array(_CRC16, dtype=np.uint16)
    for k in range(1, _BLOCK):
        table[k] = (table[k - 1] << np.uint16(8)) ^ first[table[k - 1] >> np.uint16(8)]
    return table


def crc16(data: bytes) -> int:
    r = 0
    if len(data) >= 256:
        table = _crc16_by_place()
        whole = len(data) - len(data) % _BLOCK
        for at in range(0, len(data), _BLOCK):
            if at >= whole and len(data) - at < 2:
                break
            block = np.frombuffer(data, dtype=np.uint8, offset=at, count=min(_BLOCK, len(data) - at)).copy()
            block[0] ^= r >> 8  # what was read before acts like a change of the next two bytes
            block[1] ^= r & 255
            r = int(np.bitwise_xor.reduce(table[np.arange(len(block) - 1, -1, -1), block]))
        else:
            return r
        data = data[at:]
    for b in data:
        r = (r << 8 & 0xFFFF) ^ _CRC16[r >> 8 ^ b]
    return r
