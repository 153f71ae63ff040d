"""Benchmark decontamination by latent semantic retrieval and checks of what it finds.

*   Passages of all documents are TF-IDF vectors over hashed words.  One pass
    sums C'C W (C counts, W a fixed random matrix) and the document frequencies;
    from these a Nystroem decomposition of the weighted Gram matrix gives the
    leading right singular vectors of the TF-IDF matrix (randomised SVD in a
    single pass).  What the driver receives has a fixed size.
*   Overlapping windows of documents and of benchmark items (over their whole
    length) are compared.  A document window is a candidate for an item if it
    shares enough words with the item, the words around it allow a common
    subsequence of the length it needs, with or without the item's answer near it
    (an upper bound, so nothing is lost), and its latent vector is near that of
    one of the item's windows by cosine.
*   A candidate stands when the longest common subsequence of the item's and
    the document's words covers most of the item, or a good part of it together
    with the item's closing words (its answer).

Items come in blocks of bounded size and blocks in groups.  One pass over the
documents searches the blocks of a group one after another, and only documents
in which an item is found leave a row, so the driver holds a group at a time and a
benchmark of any size gives the same rows.  Items too short for a window are looked up as whole
word sequences.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleloom.llm.near_dedup import shingle_set
from sampleloom.llm.shared import materialise, read_table
from sampleloom.llm.text_arrays import SYMBOLS, Words, gather_runs, mix, row_slices, words_of

FEATURES, RANK = 4096, 40
PASSAGE = 64
#: The commonest words of so many passages are multiplied as a dense matrix, the others one by one.
DENSE, PASSAGES = 256, 4096
STEP, WINDOW, ITEM_STEP = 6, 12, 3
COSINE = 0.2
SURE, LIKELY = 0.8, 0.5
SHARED = 0.4
#: Bounds are taken for so many words of a document at a time (a multiple of STEP).
SPAN = 4 * STEP
#: Words held by most items are counted one by one; (span, item) cells are counted so many at a time, and pairs examined.
COMMON, CELLS, PAIRS = 32, 1 << 22, 1 << 13
#: Items of up to so many words are compared side by side, in pieces of so many words of documents.
BITS, NEAR_WORDS = 64, 1 << 19
ANSWER_WORDS = 5
#: A block of items goes to all workers: so many items and bytes of text at most (one item may exceed the bytes alone).
BLOCK_ITEMS, BLOCK_BYTES = 2000, 4 << 20
#: Blocks of items that one pass over the documents searches.
GROUP_BLOCKS = 4
#: Rows and item numbers of findings that may be broadcast (32 MB).
BROADCAST_NUMBERS = 1_000_000
SLICE = 1 << 19

_U = np.uint64


def feature_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(52)).astype(np.int64)


def sketch_matrix(features: int = FEATURES, rank: int = RANK) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((features, rank)).astype(np.float32)


def _edges(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the consecutive passages of ``width`` words (the last of a row may be shorter), and each one's row."""
    n = -(-np.diff(w.first) // width)
    row = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return w.first[row] + nth * width, row


def _run_sums(values: np.ndarray, rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sums of the ``rows`` of values over consecutive runs of these lengths, one step for each place in the longest run."""
    order = np.argsort(-length, kind="stable")
    first, out = (np.cumsum(length) - length)[order], np.zeros((len(length), values.shape[1]), values.dtype)
    longer = np.searchsorted(-length[order], -np.arange(length.max(initial=0)))  # runs that reach a place
    for k, n in enumerate(longer.tolist()):
        out[:n] += values[rows[first[:n] + k]]
    back = np.empty_like(out)
    back[order] = out
    return back


def _add_products(z: np.ndarray, df: np.ndarray, passage: np.ndarray, feature: np.ndarray, n: int, sketch: np.ndarray) -> None:
    """Add C'C W of ``n`` passages to z and the number of passages that hold a feature to df."""
    often = np.argsort(-np.bincount(feature, minlength=FEATURES), kind="stable")[:DENSE]
    place = np.full(FEATURES, -1)
    place[often] = np.arange(DENSE)
    column = place[feature]
    dense = column >= 0
    c = np.bincount(passage[dense] * DENSE + column[dense], minlength=n * DENSE).reshape(n, DENSE).astype(np.float32)
    df[often] += np.count_nonzero(c, axis=0)
    y = c @ sketch[often]
    passage, feature = passage[~dense], feature[~dense]
    key = np.sort(passage * FEATURES + feature)
    df += np.bincount(key[np.flatnonzero(np.diff(key, prepend=-1))] % FEATURES, minlength=FEATURES)
    y += _run_sums(sketch, feature, np.bincount(passage, minlength=n))
    times = np.bincount(feature, minlength=FEATURES)
    seen = np.flatnonzero(times)
    z[seen] += _run_sums(y, passage[np.argsort(feature.astype(np.uint16), kind="stable")], times[seen])
    z[often] += c.T @ y


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, df and the feature's row of C'C W, summed over this task; the last row counts passages."""
    sketch = sketch_matrix()
    z, df, n = np.zeros((FEATURES, RANK)), np.zeros(FEATURES, dtype=np.int64), 0
    for batch in batches:
        for w in words_of(batch.column(0), SLICE, SYMBOLS):
            begin, _ = _edges(w, PASSAGE)
            n += len(begin)
            edges = np.append(begin, len(w.hashes))
            for a in range(0, len(begin), PASSAGES):
                own = edges[a : a + PASSAGES + 1]
                passage = np.repeat(np.arange(len(own) - 1), np.diff(own))
                _add_products(z, df, passage, feature_of(w.hashes[own[0] : own[-1]]), len(own) - 1, sketch)
    columns = [pa.array(np.arange(FEATURES + 1)), pa.array(np.append(df, n))]
    columns += [pa.array(np.append(c, 0.0)) for c in z.T.copy()]
    yield pa.RecordBatch.from_arrays(columns, names=["feature", "df", *[f"z{k}" for k in range(RANK)]])


def fit_space(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The latent vector of each hashed word (FEATURES x RANK), its weight included."""
    kinds = "feature long, df long, " + ", ".join(f"z{k} double" for k in range(RANK))
    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(_summed, kinds).groupBy("feature")
    z, df = np.zeros((FEATURES, RANK)), np.zeros(FEATURES + 1)
    for r in parts.agg(F.sum("df").alias("df"), *[F.sum(f"z{k}").alias(f"z{k}") for k in range(RANK)]).collect():  # FEATURES + 1 rows
        df[r["feature"]] = r["df"]
        if r["feature"] < FEATURES:
            z[r["feature"]] = r[2:]
    idf = np.log((1 + df[FEATURES]) / (1 + df[:FEATURES])) + 1
    return latent_vectors(z, idf)


def latent_vectors(z: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Right singular vectors of C diag(idf) from z = C'C W by Nystroem's method, times the weights."""
    w = sketch_matrix(*z.shape).astype(np.float64)
    weighted = idf[:, None] * z
    core = w.T @ z
    core = (core + core.T) / 2
    values, vectors = np.linalg.eigh(core)
    good = values > max(values.max(initial=0.0), 1e-12) * 1e-10
    root = weighted @ (vectors[:, good] / np.sqrt(values[good]))
    u, s, _ = np.linalg.svd(root, full_matrices=False)
    v = np.zeros(z.shape)
    strong = s > s.max(initial=0.0) * 1e-7
    v[:, np.flatnonzero(strong)] = u[:, strong] / s[strong]  # equal weight of all latent directions: else the commonest words decide
    return (idf[:, None] * v).astype(np.float32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, one machine word operation per word of ``b``."""
    at: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        hit = row & at.get(x, 0)
        if hit:
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def common_subsequences(size: np.ndarray, bits: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The same for many pairs side by side: sizes of the first ones (BITS at most), the places in them of the words of the second ones, end to end."""
    nth = np.arange(len(bits)) - np.repeat(np.cumsum(length) - length, length)
    steps = np.zeros((int(length.max(initial=0)), len(size)), dtype=_U)
    steps[nth, np.repeat(np.arange(len(size)), length)] = bits
    full = ~_U(0) >> (BITS - size).astype(_U)
    row = full.copy()
    for step in steps:
        hit = row & step
        row = (row + hit | row - hit) & full
    return size - np.bitwise_count(row)


def _contains(words: np.ndarray, part: np.ndarray) -> bool:
    at = np.flatnonzero(words[: len(words) - len(part) + 1] == part[0]) if len(part) and len(part) <= len(words) else []
    return any((words[k : k + len(part)] == part).all() for k in at)


def _sequences(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` words from each position on."""
    acc = np.full(len(at), _U(length), dtype=_U)
    for k in range(length):
        acc = mix(acc * _U(0x9FB21C651E98DF25) + h[at + k])
    return acc


def _least(part: float, size: np.ndarray) -> np.ndarray:
    """The fewest words that may be ``part`` of so many."""
    return np.ceil(part * size - 1e-9).astype(np.int64)


class Items:
    """A block of benchmark items as arrays."""

    def __init__(self, rows: list[tuple[int, str]], space: np.ndarray):
        self.ids = [r[0] for r in rows]
        words = next(words_of(pa.array([r[1] or "" for r in rows], pa.string()), 1 << 40, SYMBOLS)) if rows else None
        self.words = [words.hashes[words.first[k] : words.first[k + 1]] for k in range(len(rows))] if rows else []
        self.long = [k for k, own in enumerate(self.words) if len(own) >= WINDOW]
        vectors, windows = [], np.zeros(len(self.words), dtype=np.int64)
        for k in self.long:
            own = self.words[k]
            table = space[feature_of(own)]
            # document windows start at every STEP words, so each is at most a word away from a window of the item
            starts = sorted({*range(0, len(own) - WINDOW + 1, ITEM_STEP), len(own) - WINDOW})
            vectors += [table[b : b + WINDOW].sum(axis=0) for b in starts]
            windows[k] = len(starts)
        v = np.array(vectors, dtype=np.float32).reshape(-1, space.shape[1])
        self.windows = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        self.window_count, self.window_first = windows, np.cumsum(windows) - windows
        self.size = np.array([len(own) for own in self.words], dtype=np.int64)
        held = [np.unique(own, return_counts=True) for own in (self.words[k] for k in self.long)]
        every = np.concatenate([h for h, _ in held]) if held else np.zeros(0, _U)
        self.vocabulary, inverse, spread = np.unique(every, return_inverse=True, return_counts=True)
        order = np.argsort(-spread, kind="stable")[:COMMON]
        self.common = np.full(len(spread), -1)
        self.common[order] = np.arange(len(order))
        item = np.repeat(np.array(self.long, dtype=np.int64), [len(h) for h, _ in held])
        times = np.concatenate([n for _, n in held]) if held else np.zeros(0, np.int64)
        self.common_times = np.zeros((len(self.words), COMMON), dtype=np.int32)
        often = self.common[inverse] >= 0
        self.common_times[item[often], self.common[inverse[often]]] = times[often]
        self.rare_word, self.rare_item = inverse[~often], item[~often]
        # a word's places in an item of up to BITS words, as bits of a machine word
        at = gather_runs(np.arange(self.size.max(initial=0)), np.zeros(len(self.long), dtype=np.int64), self.size[self.long])
        item = np.repeat(np.array(self.long, dtype=np.int64), self.size[self.long])
        key = item * (len(self.vocabulary) + 1) + np.searchsorted(self.vocabulary, np.concatenate([self.words[k] for k in self.long] or [self.vocabulary]))
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.diff(key[order], prepend=-1))
        self.held = key[order][heads]
        self.bits = np.bitwise_or.reduceat(_U(1) << (at[order] % BITS).astype(_U), heads) if len(heads) else np.zeros(0, _U)
        last = np.array([self.words[k][-ANSWER_WORDS:] for k in self.long], dtype=_U).reshape(-1, ANSWER_WORDS)
        self.answer_words = np.zeros((ANSWER_WORDS, len(self.vocabulary) + 1), dtype=bool)
        for k in range(ANSWER_WORDS):
            self.answer_words[k, np.searchsorted(self.vocabulary, last[:, k])] = True
        names = _sequences(last.ravel(), np.arange(len(last)) * ANSWER_WORDS, ANSWER_WORDS)
        order = np.argsort(names, kind="stable")
        self.answers, self.answer_item = names[order], np.array(self.long, dtype=np.int64)[order]
        self.short: dict[int, dict[int, list[int]]] = {}
        for k, own in enumerate(self.words):
            if 0 < len(own) < WINDOW:
                self.short.setdefault(len(own), {}).setdefault(int(shingle_set(own, len(own))[0]), []).append(k)

    def places(self, h: np.ndarray) -> np.ndarray:
        """The number of each word in the vocabulary; words not in it are numbered after all others."""
        word = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[word] == h, word, len(self.vocabulary))

    def bits_of(self, item: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The places of each word in its item, 0 if the item does not hold it."""
        key = item * (len(self.vocabulary) + 1) + place
        at = np.minimum(np.searchsorted(self.held, key), len(self.held) - 1)
        return np.where(self.held[at] == key, self.bits[at], _U(0))

    def groups(self, n_spans: int) -> Iterator[np.ndarray]:
        """Numbers of the items with windows, so many at a time that their counts stay bounded."""
        step = max(1, CELLS // max(n_spans, 1))
        for a in range(0, len(self.long), step):
            yield np.array(self.long[a : a + step])


def _answered(w: Words, items: Items, place: np.ndarray, span_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(span, item number), sorted: all spans with a window around which the item's answer may stand."""
    at = np.flatnonzero(items.answer_words[0][place[: max(len(place) - ANSWER_WORDS + 1, 0)]])
    for k in range(1, ANSWER_WORDS):
        at = at[items.answer_words[k][place[at + k]]]
    row = np.searchsorted(w.first, at, side="right") - 1
    inside = at + ANSWER_WORDS <= w.first[row + 1]
    at, row = at[inside], row[inside]
    names = _sequences(w.hashes, at, ANSWER_WORDS)
    lo, hi = (np.searchsorted(items.answers, names, side=x) for x in ("left", "right"))
    item = gather_runs(items.answer_item, lo, hi - lo)
    at, row = np.repeat(at, hi - lo), np.repeat(row, hi - lo)
    begin, end, size = w.first[row], w.first[row + 1], items.size[item]
    first = np.maximum(at + ANSWER_WORDS - WINDOW - size - begin, 0) // SPAN
    last = np.minimum(at + size, end - 1) - begin
    n = last // SPAN - first + 1
    numbers = np.arange(span_first[-1])
    key = np.unique(gather_runs(numbers, span_first[row] + first, n) * len(items.words) + np.repeat(item, n))
    return key // len(items.words), key % len(items.words)


def _candidates(w: Words, items: Items, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, first word and item number of windows that may hold the item, for a group of items at a time.

    First whole spans of words are ruled out: no common subsequence is longer than the item's words around them, and
    of a common word at most as many count as the item has.  They must be a SURE part, or a LIKELY one near the answer.
    """
    begin, row = _edges(w, SPAN)
    n = len(begin)
    size = np.diff(np.append(begin, len(place)))
    span_first = np.searchsorted(row, np.arange(len(w.first)))
    row_lo, row_hi, numbers = span_first[row], span_first[row + 1], np.arange(n)
    answer_span, answer_item = _answered(w, items, place, span_first)
    known = place < len(items.vocabulary)
    span, word = np.repeat(numbers, size)[known], place[known]
    often = items.common[word] >= 0
    common = np.bincount(span[often] * COMMON + items.common[word[often]], minlength=n * COMMON).reshape(n, COMMON).astype(np.int32)
    common_sum = np.concatenate([np.zeros((1, COMMON), np.int32), np.cumsum(common, axis=0, dtype=np.int32)])
    span, word = span[~often], word[~often]
    for group in items.groups(n):
        here = (items.rare_item >= group[0]) & (items.rare_item <= group[-1])
        order = np.argsort(items.rare_word[here], kind="stable")
        holders = np.searchsorted(group, items.rare_item[here][order])
        length = np.bincount(items.rare_word[here], minlength=len(items.vocabulary))
        first = np.cumsum(length) - length
        cell = gather_runs(holders, first[word], length[word]) * n + np.repeat(span, length[word])
        rare = np.zeros((len(group), n + 1), np.int32)
        np.cumsum(np.bincount(cell, minlength=len(group) * n).reshape(len(group), n), axis=1, out=rare[:, 1:])
        times = items.common_times[group]
        sure, likely = _least(SURE, items.size[group]), _least(LIKELY, items.size[group])
        # spans that hold the words around a window, as many as the item has on either side
        before, after = -(-items.size[group] // SPAN), (SPAN - STEP + WINDOW - 1 + items.size[group]) // SPAN
        rest = sure - times.sum(axis=1)
        keys = [answer_span[a := np.isin(answer_item, group)] * len(group) + np.searchsorted(group, answer_item[a])]
        near_answer = keys[0]
        for back, ahead in sorted(set(zip(before.tolist(), after.tolist(), strict=True))):
            own = np.flatnonzero((before == back) & (after == ahead))
            lo, hi = np.maximum(row_lo, numbers - back), np.minimum(row_hi, numbers + ahead + 1)
            part = rare[own]
            which, at = np.nonzero(part[:, hi] - part[:, lo] >= rest[own][:, None])
            keys.append(at * len(group) + own[which])
        key = np.unique(np.concatenate(keys))
        least = np.where(np.isin(key, near_answer), likely[key % len(group)], sure[key % len(group)])
        for a in range(0, len(key), PAIRS):
            at, which = np.divmod(key[a : a + PAIRS], len(group))
            lo, hi = np.maximum(row_lo[at], at - before[which]), np.minimum(row_hi[at], at + after[which] + 1)
            ok = rare[which, hi] - rare[which, lo] + np.minimum(common_sum[hi] - common_sum[lo], times[which]).sum(axis=1) >= least[a : a + PAIRS]
            at, item = at[ok], group[which[ok]]
            windows = -(-size[at] // STEP)
            nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            own_row, item, at = np.repeat(row[at], windows), np.repeat(item, windows), np.repeat(begin[at], windows) + nth * STEP
            width = np.minimum(at + WINDOW, w.first[own_row + 1]) - at
            found = items.bits_of(np.repeat(item, width), gather_runs(place, at, width)) > 0
            total = np.concatenate(([0], np.cumsum(found)))
            ends = np.cumsum(width)
            ok = total[ends] - total[ends - width] >= np.ceil(SHARED * width)
            yield own_row[ok], at[ok], item[ok]


def _nearest(w: Words, items: Items, space: np.ndarray, row: np.ndarray, at: np.ndarray, item: np.ndarray) -> np.ndarray:
    """The largest cosine of each window to one of its item's windows."""
    own, first, inverse = np.unique(at, return_index=True, return_inverse=True)
    length = np.minimum(own + WINDOW, w.first[row[first] + 1]) - own
    v = np.add.reduceat(space[feature_of(gather_runs(w.hashes, own, length))], np.cumsum(length) - length, axis=0)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    n = items.window_count[item]
    to = gather_runs(np.arange(len(items.windows)), items.window_first[item], n)
    cosine = np.einsum("ij,ij->i", v[np.repeat(inverse, n)], items.windows[to])
    return np.maximum.reduceat(cosine, np.cumsum(n) - n)


def find_hits(w: Words, items: Items, space: np.ndarray) -> list[tuple[int, int, float]]:
    """(row, item number, share of the item covered) of every item that stands in a row of the slice."""
    hits: dict[tuple[int, int], float] = {}
    h = w.hashes
    if not len(h):
        return []
    if len(items.windows):
        place = items.places(h)
        for row, at, item in _candidates(w, items, place):
            for a, b in row_slices(np.append(0, np.cumsum(2 * items.size[item] + WINDOW)), NEAR_WORDS):
                near = a + np.flatnonzero(_nearest(w, items, space, row[a:b], at[a:b], item[a:b]) >= COSINE)
                for r, k, share in _shares(w, items, place, row[near], at[near], item[near], hits):
                    hits[r, k] = max(share, hits.get((r, k), 0))
    for length, wanted in items.short.items():
        if len(h) >= length:
            acc = _sequences(h, np.arange(len(h) - length + 1), length)
            for at in np.flatnonzero(np.isin(acc, np.array(list(wanted), dtype=_U))):
                r = int(np.searchsorted(w.first, at, side="right")) - 1
                if at + length <= w.first[r + 1]:
                    hits.update({(r, k): 1.0 for k in wanted[int(acc[at])]})
    return [(r, k, share) for (r, k), share in sorted(hits.items())]


def _shares(w: Words, items: Items, place: np.ndarray, row: np.ndarray, at: np.ndarray, item: np.ndarray, hits: dict[tuple[int, int], float]) -> Iterator[tuple[int, int, float]]:
    """(row, item number, share) of the items found around their windows that stand the checks; long ones that ``hits`` has whole are left out."""
    size, out = items.size[item], np.zeros(len(at))
    lo, hi = np.maximum(w.first[row], at - size), np.minimum(w.first[row + 1], at + WINDOW + size)
    bits = items.bits_of(np.repeat(item, hi - lo), gather_runs(place, lo, hi - lo))
    ends = np.cumsum(hi - lo)
    total = np.concatenate(([0], np.cumsum(bits > 0)))
    may = total[ends] - total[ends - (hi - lo)] >= _least(LIKELY, size)
    side = np.flatnonzero(may & (size <= BITS))
    if len(side):
        out[side] = common_subsequences(size[side], gather_runs(bits, (ends - (hi - lo))[side], (hi - lo)[side]), (hi - lo)[side]) / size[side]
    for k in np.flatnonzero(may).tolist():
        key, near, own = (int(row[k]), int(item[k])), w.hashes[lo[k] : hi[k]], items.words[item[k]]
        if size[k] > BITS and hits.get(key, 0) < 1:
            out[k] = common_subsequence(own, near) / len(own)
        if out[k] >= SURE or out[k] >= LIKELY and _contains(near, own[-ANSWER_WORDS:]):
            yield *key, float(out[k])


def _finding(blocks: list[list[tuple[int, str]]], space: np.ndarray):
    schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("item_ids", pa.list_(pa.int64())), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = [Items(b, space) for b in blocks]
        for batch in batches:
            for w in words_of(batch.column(2), SLICE, SYMBOLS):
                found, best = _by_row(w, loaded, space)
                hit = pa.array([k for k, f in enumerate(found) if f], pa.int64())
                columns = [batch.column(0).slice(w.lo, w.hi - w.lo), batch.column(1).slice(w.lo, w.hi - w.lo), pa.array(found, pa.list_(pa.int64())), pa.array(best, pa.float64())]
                yield pa.RecordBatch.from_arrays([c.take(hit) for c in columns], schema=schema)

    return run


def _by_row(w: Words, loaded: list[Items], space: np.ndarray) -> tuple[list[list[int]], list[float]]:
    found: list[set] = [set() for _ in range(w.hi - w.lo)]
    best = [0.0] * (w.hi - w.lo)
    for items in loaded:
        for r, k, share in find_hits(w, items, space):
            found[r].add(items.ids[k])
            best[r] = max(best[r], share)
    return [sorted(f, key=lambda x: (x is None, x)) for f in found], best


def item_blocks(benchmark: DataFrame, block_items: int | None = None, block_bytes: int = BLOCK_BYTES, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, in the order of their ids; a block at a time is on the driver."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").orderBy("i", "t")
    block_items = block_items or BLOCK_ITEMS
    block, size = [], 0
    for r in rows.toLocalIterator():
        n = len(r["t"].encode())
        if block and (len(block) == block_items or size + n > block_bytes):
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += n
    if block:
        yield block


def findings(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row (hash of the text), item_ids, share of the documents in which an item is found; rows that agree in id and text are one.

    It is marked for a broadcast while it is small, which is counted; else joins shuffle it.
    """
    space = fit_space(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), _row_of(F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    kinds = "id long, row long, item_ids array<long>, share double"
    blocks, parts = item_blocks(benchmark), []
    while group := list(itertools.islice(blocks, GROUP_BLOCKS)):
        parts.append(materialise(rows.mapInArrow(_finding(group, space), kinds), "findings"))
    if not parts:
        return docs.sparkSession.createDataFrame([], kinds)
    found = functools.reduce(DataFrame.unionByName, parts)
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids"))))
    found = materialise(found.groupBy("id", "row").agg(ids.alias("item_ids"), F.max("share").alias("share")), "found")
    size = found.agg(F.sum(1 + F.size("item_ids"))).first()[0] or 0
    return F.broadcast(found) if size <= BROADCAST_NUMBERS else found


def _row_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, item_ids (sorted, empty if clean), share (of the best covered item).

    Null or empty texts are clean, null items and items without words are
    skipped, an empty benchmark finds nothing.  Rows are independent, also where they
    repeat an id or have none.  Other columns are not read.
    """
    found = findings(docs, benchmark, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), _row_of(F.col(text_col)).alias("doc_row"))
    joined = rows.join(found, rows["doc"].eqNullSafe(found["id"]) & (rows["doc_row"] == found["row"]), "left")
    return joined.select(F.col("doc").alias("id"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("share", F.lit(0.0)).alias("share"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows in which no item is found, with all their columns."""
    found = findings(docs, benchmark, id_col, text_col)
    mine = docs[id_col].cast("long").eqNullSafe(found["id"]) & (_row_of(docs[text_col]) == found["row"])
    return docs.join(found, mine, "left_anti")


def op6_query(spark, sf_dir: str) -> DataFrame:
    out = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), (F.size("item_ids") > 0).alias("contaminated"), "item_ids", F.round("share", 6).alias("share"))
