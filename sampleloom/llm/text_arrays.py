"""Words of Arrow text batches as numpy arrays.

Texts are lower-cased in A-Z and cut at ASCII white space without creating a
Python string per word.  A word is named by a 64-bit hash: its bytes, eight at a
time, go through a bijective mixer that starts from the word's length, for all
words side by side.  Where a name stands for the word itself (SpanMemory), a second hash
from another start must agree too.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 19


def _return_freed_memory() -> None:
    """Let the allocator map arrays of 1 MB and more on their own, so that a worker gives them back when they are freed."""
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)
    except (OSError, AttributeError):  # not glibc: nothing to set
        return


_return_freed_memory()

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_CHECK = _U(0xD1342543DE82EF95)
#: Longer spans are hashed one by one.
_LONG = 512
_low_bytes = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=_U)

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, dtype=bool)
_space[[32, 9, 10, 11, 12, 13]] = True

#: White space and all other ASCII that is neither a letter nor a digit.
SYMBOLS = _space.copy()
SYMBOLS[[c for c in range(128) if not chr(c).isalnum()]] = True


MARKS = ".,;:!?*#%$&|"
_mark = np.zeros(256, dtype=bool)
_mark[[ord(c) for c in MARKS]] = True
_letter = np.zeros(256, dtype=bool)
_letter[97:123] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64-bit words."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Words:
    """Words of rows lo..hi-1 of a batch. Word k is data[starts[k]:ends[k]]; row r has words first[r]..first[r+1]-1."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    checks: np.ndarray | None = None


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string_view(column.type) or isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column.cast(pa.large_string())
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None:
        return np.zeros(len(column) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes together, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: tuple[np.uint64, ...] = (_GOLDEN,)) -> list[np.ndarray]:
    """For each seed, a 64-bit hash of data[start:end] of each span."""
    size = ends - starts
    out = [mix(size.astype(_U) + seed) for seed in seeds]
    eights = np.ndarray(len(data) + 1, dtype="<u8", buffer=np.concatenate([data, np.zeros(8, dtype=np.uint8)]), strides=(1,))
    long = np.flatnonzero(size > _LONG)
    todo, at = np.flatnonzero((size > 0) & (size <= _LONG)), 0
    while len(todo):
        left = size[todo] - at
        chunk = eights[starts[todo] + at] & _low_bytes[np.minimum(left, 8)]
        for h in out:
            h[todo] = mix(h[todo] ^ chunk)
        todo, at = todo[left > 8], at + 8
    for k in long.tolist():
        for h, seed in zip(out, seeds, strict=True):
            h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].data, seed=int(seed))
    return out


def hash_and_check(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The hash of each span and a second one that does not follow from it."""
    return hash_spans(data, starts, ends, (_GOLDEN, _CHECK))


def gather_runs(values: np.ndarray, lo: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[lo[k] : lo[k] + length[k]] for every k, end to end."""
    total = int(length.sum())
    at = np.repeat(lo - np.concatenate(([0], np.cumsum(length)[:-1])), length) if total else np.zeros(0, dtype=np.int64)
    return values[at + np.arange(total)]


class SpanMemory:
    """Remembers what was computed for a span, named by two hashes: a run of numbers.  It is emptied when it holds ``limit`` spans."""

    def __init__(self, limit: int):
        self._limit = limit
        self._clear()

    def _clear(self) -> None:
        self._keys = np.zeros(0, dtype=_U)
        self._checks = np.zeros(0, dtype=_U)
        self._row = np.zeros(0, dtype=np.int64)
        self._lo = np.zeros(0, dtype=np.int64)
        self._length = np.zeros(0, dtype=np.int64)
        self._values: np.ndarray = np.zeros(0, dtype=np.int32)

    def resolve(self, hashes: np.ndarray, checks: np.ndarray, compute) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values, and start and length of each span's run in them; ``compute(indices)`` gives the runs of spans not seen before, end to end, and their lengths."""
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self._keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self._keys)
        known[inside] = self._keys[at[inside]] == keys[inside]
        clash = np.zeros(len(keys), dtype=bool)
        clash[known] = self._checks[at[known]] != checks[first[known]]
        clash[inverse[checks != checks[first][inverse]]] = True
        if clash.any():
            return self._apart(clash[inverse], hashes, checks, compute)
        if not known.all():
            if len(self._keys) + int((~known).sum()) > self._limit and len(self._keys):
                self._clear()
                at, known = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
            runs, length = compute(first[~known])
            lo = len(self._values) + np.concatenate(([0], np.cumsum(length)[:-1])).astype(np.int64)
            row = len(self._lo) + np.arange(len(length))
            self._keys = np.insert(self._keys, at[~known], keys[~known])
            self._checks = np.insert(self._checks, at[~known], checks[first[~known]])
            self._row = np.insert(self._row, at[~known], row)
            self._lo, self._length = np.concatenate([self._lo, lo]), np.concatenate([self._length, length])
            self._values = np.concatenate([self._values, runs])
        row = self._row[np.searchsorted(self._keys, keys)][inverse]
        return self._values, self._lo[row], self._length[row]

    def _apart(self, odd: np.ndarray, hashes: np.ndarray, checks: np.ndarray, compute) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans that share their first hash with another span are computed each time."""
        rest, own = np.flatnonzero(~odd), np.flatnonzero(odd)
        lo, length = np.zeros(len(odd), dtype=np.int64), np.zeros(len(odd), dtype=np.int64)
        values, lo[rest], length[rest] = self.resolve(hashes[rest], checks[rest], lambda k: compute(rest[k]))
        runs, length[own] = compute(own)
        lo[own] = len(values) + np.concatenate(([0], np.cumsum(length[own])[:-1]))
        return np.concatenate([values, runs]), lo, length


def find_words(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, gaps: np.ndarray = _space, cut_marks: bool = False, check: bool = False) -> Words:
    """The words of rows lo..hi-1; ``cut_marks`` also cuts between an ASCII letter and a mark of MARKS, ``check`` adds the second hash."""
    at = offsets[lo : hi + 1] - offsets[lo]
    data = _lower[data[offsets[lo] : offsets[hi]]]
    n = len(data)
    solid = ~gaps[data]
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[at] = True
    gap = np.ones(n + 1, dtype=bool)
    gap[:n] = ~solid
    before = np.empty(n, dtype=bool)
    before[:1] = True
    before[1:] = gap[: n - 1]
    head, tail = before | fresh[:n], gap[1:] | fresh[1:]
    if cut_marks:
        mark, letter = _mark[data], _letter[data]
        between = (mark[1:] & letter[:-1]) | (letter[1:] & mark[:-1])
        head[1:] |= between
        tail[: n - 1] |= between
    starts = np.flatnonzero(solid & head)
    ends = np.flatnonzero(solid & tail) + 1
    named = hash_and_check(data, starts, ends) if check else hash_spans(data, starts, ends)
    return Words(lo, hi, data, starts, ends, np.searchsorted(starts, at), *named)


def words_of(column: pa.Array, limit: int = SLICE_BYTES, gaps: np.ndarray = _space, cut_marks: bool = False, check: bool = False) -> Iterator[Words]:
    offsets, data = text_buffers(column)
    for lo, hi in row_slices(offsets, limit):
        yield find_words(data, offsets, lo, hi, gaps, cut_marks, check)
