"""A hidden Markov language model with word classes.

A word belongs to the class its hash names, the end of a text to a class of its
own.  Latent states emit classes; within its class a word has its smoothed share
of the training count.  So the states' parameters have a fixed size, while word
counts grow with the corpus and never leave the executors.

*   Word counts: words are counted per block of documents, summed per word over
    all blocks, and every block receives the counts of its own words back by a join.
*   Training: Baum-Welch, every round over the whole of all training documents,
    from a start that no data shapes, until the likelihood settles (ROUNDS at
    most).  The classes of all training tokens are written once, two bytes each.
    Each task sums the expected counts of its documents, the sums meet in
    a grouped aggregation.
    Expected counts are gathered over pieces of at most PIECE tokens.
*   Scoring: the scaled forward recursion over the whole text gives the exact
    likelihood of its classes, to which the words' shares are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleloom.llm.language_id import held_out_column
from sampleloom.llm.shared import materialise, read_table
from sampleloom.llm.text_arrays import words_of

CLASSES = 4096
STATES = 6
PIECE = 256
ROUNDS = 22
#: Training ends when a round adds less than this part to the log likelihood.
SETTLED = 1e-5
BLOCK_BYTES = 16 << 20
#: Bytes of text scored, and trained on, side by side.
SLICE, TRAIN_SLICE = 1 << 21, 1 << 22
SMOOTH = 0.1

_END = CLASSES
_TRANSITION, _FIRST, _LATER, _LIKELIHOOD = -100, -1, -2, -3


class Params:
    """start (of a text), later (of a piece inside a text), transition[i, j], emission[class, state]."""

    def __init__(self, start, later, transition, emission):
        self.start, self.later, self.transition, self.emission = start, later, transition, emission

    @classmethod
    def from_counts(cls, start, later, transition, emission) -> Params:
        unit = lambda x: x / x.sum()
        emission = emission + SMOOTH
        transition = transition + SMOOTH
        return cls(unit(start + SMOOTH), unit(later + SMOOTH), transition / transition.sum(axis=1, keepdims=True), emission / emission.sum(axis=0))

    @classmethod
    def initial(cls, states: int, seed: int = 7) -> Params:
        rng = np.random.default_rng(seed)
        even = np.ones(states)
        return cls.from_counts(even, even, np.full((states, states), 1.0) + 20 * np.eye(states), rng.gamma(2.0, size=(CLASSES + 1, states)))


def class_sequences(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all tokens (each row's words, then its end) and the edges of the rows."""
    edges = first + np.arange(len(first))
    out = np.full(int(edges[-1]), _END, dtype=np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out[np.arange(len(hashes)) + row] = (hashes % np.uint64(CLASSES)).astype(np.int64)
    return out, edges


def forward(params: Params, classes: np.ndarray, edges: np.ndarray, piece: int = 128) -> np.ndarray:
    """log10 likelihood of each row's classes.

    A row's first ``piece`` tokens are a vector; each later piece is the matrix
    that it multiplies the vector before it by.  All pieces run side by side, then
    each row's matrices are applied in order, so the result is that of the plain recursion.
    """
    size = np.diff(edges)
    n_pieces = np.maximum(-(-size // piece), 1)
    heads = np.cumsum(n_pieces) - n_pieces
    row = np.repeat(np.arange(len(size)), n_pieces)
    nth = np.arange(len(row)) - heads[row]
    begin, length = edges[:-1][row] + nth * piece, np.minimum(size[row] - nth * piece, piece)
    vector, total = _advance(params, classes, begin[heads], length[heads], params.start[:, None])
    later = np.flatnonzero(nth)
    matrix, scale = _advance(params, classes, begin[later], length[later], params.transition.T)
    place = np.zeros(len(row), dtype=np.int64)
    place[later] = np.arange(len(later))
    for k in range(1, int(n_pieces.max(initial=0))):
        rows = np.flatnonzero(n_pieces > k)
        at = place[heads[rows] + k]
        now = np.einsum("jni,in->jn", matrix[:, at], vector[:, rows])
        norm = now.sum(axis=0)
        vector[:, rows] = now / norm
        total[rows] += scale[at] + np.log10(norm)
    return total


def _advance(params: Params, classes: np.ndarray, begin: np.ndarray, length: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state, piece, column) after each piece, scaled to a sum of 1, and log10 of the scale; ``enter`` has the states' weights at the first token in columns."""
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    n_states, width = len(params.start), enter.shape[1]
    out, total = np.zeros((n_states, len(order), width)), np.zeros(len(order))
    emission, from_all = np.ascontiguousarray(params.emission.T), np.ascontiguousarray(params.transition.T)
    now = np.zeros(0)
    for t in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -t, side="left"))
        before = (from_all @ now[:, :n].reshape(n_states, -1)).reshape(n_states, n, width) if t else enter[:, None, :]
        now = emission[:, classes[begin[:n] + t]][:, :, None] * before
        scale = now.sum(axis=(0, 2))
        now /= scale[:, None]
        total[:n] += np.log10(scale)
        ended = slice(int(np.searchsorted(-length, -t - 1, side="left")), n)
        out[:, ended] = now[:, ended]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    out = out[:, back]
    return (out[:, :, 0] if width == 1 else out), total[back]


class Counts:
    """Expected counts of one E-step."""

    def __init__(self, states: int):
        self.start, self.later = np.zeros(states), np.zeros(states)
        self.transition, self.emission = np.zeros((states, states)), np.zeros((CLASSES + 1, states))
        self.likelihood = 0.0

    def add(self, params: Params, classes: np.ndarray, edges: np.ndarray, piece: int = PIECE) -> None:
        """Forward and backward over pieces of at most ``piece`` tokens, all pieces side by side."""
        size = np.diff(edges)
        n_pieces = -(-size // piece)
        row = np.repeat(np.arange(len(size)), n_pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
        begin = edges[:-1][row] + nth * piece
        length = np.minimum(size[row] - nth * piece, piece)
        order = np.argsort(-length, kind="stable")
        begin, length, head = begin[order], length[order], nth[order] == 0
        longest = int(length[0]) if len(length) else 0
        if not longest:
            return
        # token t of all pieces that have one stands at at[t]..at[t+1]-1; states are rows
        live = np.searchsorted(-length, -np.arange(longest), side="left")
        at = np.concatenate(([0], np.cumsum(live)))
        where = classes[np.concatenate([begin[:n] + t for t, n in enumerate(live)])]
        seen = np.take(np.ascontiguousarray(params.emission.T, dtype=np.float32), where, axis=1)
        start, later = (x.astype(np.float32)[:, None] for x in (params.start, params.later))
        onto, alpha, scale = params.transition.astype(np.float32), np.empty_like(seen), np.empty(len(where), dtype=np.float32)
        from_all, now = np.ascontiguousarray(onto.T), np.zeros(0)
        for t, n in enumerate(live):
            here = slice(at[t], at[t] + n)
            now = seen[:, here] * (from_all @ now[:, :n] if t else np.where(head, start, later))
            np.sum(now, axis=0, out=scale[here])
            now /= scale[here]
            alpha[:, here] = now
        self.likelihood += float(np.log(scale).sum(dtype=np.float64))
        seen /= scale
        beta, pairs = np.ones((len(params.start), len(length)), dtype=np.float32), np.zeros_like(self.transition)
        for t in range(longest - 1, -1, -1):
            if t + 1 < longest:
                m, then = live[t + 1], slice(at[t + 1], at[t + 2])
                onward = seen[:, then] * beta[:, :m]
                pairs += alpha[:, at[t] : at[t] + m] @ onward.T
                beta[:, :m] = onto @ onward
            here = slice(at[t], at[t + 1])
            if t % 32 == 0:  # a token's mass is 1; this undoes what single precision lets it drift
                beta[:, : live[t]] /= (alpha[:, here] * beta[:, : live[t]]).sum(axis=0)
            alpha[:, here] *= beta[:, : live[t]]
        self.transition += params.transition * pairs
        self.start += alpha[:, : live[0]][:, head].sum(axis=1, dtype=np.float64)
        self.later += alpha[:, : live[0]][:, ~head].sum(axis=1, dtype=np.float64)
        for s, mass in enumerate(alpha):
            self.emission[:, s] += np.bincount(where, weights=mass, minlength=CLASSES + 1)

    def params(self) -> Params:
        return Params.from_counts(self.start, self.later, self.transition, self.emission)


def _expectation(params: Params):
    names = ["row", *[f"s{k}" for k in range(len(params.start))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(len(params.start))
        for batch in batches:
            for classes, sizes in zip(batch.column(0), batch.column(1), strict=True):
                edges = np.concatenate(([0], np.cumsum(np.frombuffer(sizes.as_buffer(), dtype="<i8"))))
                counts.add(params, np.frombuffer(classes.as_buffer(), dtype="<u2").astype(np.int64), edges)
        rows = np.concatenate([np.arange(CLASSES + 1), [_FIRST, _LATER, _LIKELIHOOD], _TRANSITION - np.arange(len(params.start))])
        table = np.concatenate([counts.emission, counts.start[None], counts.later[None], np.full((1, len(params.start)), counts.likelihood), counts.transition])
        yield pa.RecordBatch.from_arrays([pa.array(rows), *[pa.array(c) for c in table.T.copy()]], names=names)

    return run


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """classes (two bytes a token) and the number of tokens of each text, of a slice of texts in each row."""
    for batch in batches:
        for w in words_of(batch.column(0), TRAIN_SLICE):
            classes, edges = class_sequences(w.hashes, w.first)
            row = [pa.array([x.tobytes()], pa.binary()) for x in (classes.astype("<u2"), np.diff(edges).astype("<i8"))]
            yield pa.RecordBatch.from_arrays(row, names=["classes", "sizes"])


def train(texts: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> Params:
    """Parameters from ``texts(key, text)``; the driver receives the summed counts of each round."""
    params, last = Params.initial(states), None
    if texts.isEmpty():
        return params
    kinds = "row long, " + ", ".join(f"s{k} double" for k in range(states))
    tokens = materialise(texts.select("text").mapInArrow(_classed, "classes binary, sizes binary"), "token-classes")
    for _ in range(rounds):
        parts = tokens.mapInArrow(_expectation(params), kinds)
        total = Counts(states)
        for r in parts.groupBy("row").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(states)]).collect():  # CLASSES + states + 4 rows
            row, values = r["row"], np.array(r[1:])
            if row >= 0:
                total.emission[row] = values
            elif row == _FIRST:
                total.start = values
            elif row == _LATER:
                total.later = values
            elif row == _LIKELIHOOD:
                total.likelihood = values[0]
            else:
                total.transition[_TRANSITION - row] = values
        params = total.params()
        if last is not None and total.likelihood - last < SETTLED * abs(last):
            break
        last = total.likelihood
    return params


def _block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, h, n of the words of each block; n counts training documents only. Blocks come one after another."""
    now, parts = None, []

    def flush():
        keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64)
        n = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.int64)
        unique, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, weights=n, minlength=len(unique)).astype(np.int64)
        for a in range(0, len(unique), 1 << 16):
            b = min(a + (1 << 16), len(unique))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, now)), pa.array(unique[a:b].view(np.int64)), pa.array(total[a:b])], names=["block", "h", "n"])

    for batch in batches:
        for lo, hi, block in _runs(batch.column(0).to_numpy()):
            if block != now:
                yield from flush()
                now, parts = block, []
            learn = batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
            for w in words_of(batch.column(2).slice(lo, hi - lo)):
                row = np.repeat(np.arange(w.hi - w.lo), np.diff(w.first))
                unique, inverse = np.unique(w.hashes, return_inverse=True)
                parts.append((unique, np.bincount(inverse, weights=learn[w.lo : w.hi][row], minlength=len(unique)).astype(np.int64)))
    yield from flush()


def _runs(blocks: np.ndarray) -> list[tuple[int, int, int]]:
    cut = np.flatnonzero(np.diff(blocks)) + 1
    edges = np.concatenate(([0], cut, [len(blocks)])).astype(int)
    return [(int(a), int(b), int(blocks[a])) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def _buckets(keys: np.ndarray) -> np.ndarray:
    """Where the sorted keys of each value of the leading bits start."""
    bits = max(1, len(keys).bit_length())
    return np.concatenate(([0], np.cumsum(np.bincount((keys >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits))))


def _find(keys: np.ndarray, buckets: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of hashes that are all among the sorted keys, in steps from the start of their bucket."""
    bits = (len(buckets) - 1).bit_length() - 1
    at = buckets[(wanted >> np.uint64(64 - bits)).astype(np.int64)]
    todo = np.flatnonzero(keys[at] != wanted)
    while len(todo):
        at[todo] += 1
        todo = todo[keys[at[todo]] != wanted[todo]]
    return at


def _scorer(params: Params, class_total: np.ndarray, n_tokens: int, n_types: int, n_ends: int):
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    base_total = np.log10(n_tokens + n_types + 1)

    def score(w, keys: np.ndarray, counts: np.ndarray, buckets: np.ndarray):
        c = counts[_find(keys, buckets, w.hashes)] if len(keys) else np.zeros(len(w.hashes), np.int64)
        cls = (w.hashes % np.uint64(CLASSES)).astype(np.int64)
        log_c = np.log10(c + 1)
        sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[w.first])
        n = np.diff(w.first)
        base = sums(log_c) + np.log10(n_ends + 1) - (n + 1) * base_total
        total = forward(params, *class_sequences(w.hashes, w.first)) + sums(log_c - class_total[cls])
        return n + 1, sums(c > 0) + (n_ends > 0), base, total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts, buckets, parts = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for batch in batches:
            blocks, is_doc = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy().astype(np.int64)
            for lo, hi, mark in _runs(blocks * 2 + is_doc):
                if mark >> 1 != now:
                    now, keys, counts, parts = mark >> 1, np.zeros(0, np.uint64), np.zeros(0, np.int64), []
                part = batch.slice(lo, hi - lo)
                if not mark & 1:
                    parts.append((part.column(5).to_numpy().view(np.uint64), part.column(6).to_numpy()))
                    continue
                if parts:
                    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
                    order = np.argsort(keys)
                    keys, counts, parts = keys[order], counts[order], []
                    buckets = _buckets(keys)
                for w in words_of(part.column(4), SLICE):
                    rows = part.slice(w.lo, w.hi - w.lo)
                    columns = [rows.column(2), rows.column(3), *[pa.array(x) for x in score(w, keys, counts, buckets)]]
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def score_texts(docs: DataFrame, held_out, states: int = STATES, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a boolean column; the rows where it is false are the
    training set.  Null text counts as empty: its only token is the end.  With
    no training rows every count is zero, and the model is the untrained start.
    Rows that repeat an id are texts of their own.  Scores are rounded to nine
    decimals, since expected counts are sums of doubles.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out.alias("held_out"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count(F.when(~F.col("held_out"), 1)).alias("ends")).first()
    n_blocks = (size["bytes"] or 0) // block_bytes + 1
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)))

    dealt = blocked.select("block", (~F.col("held_out")).alias("learn"), "text").repartition("block").sortWithinPartitions("block")
    words = dealt.mapInArrow(_block_words, "block long, h long, n long")
    words = materialise(words, "block-words")
    sums = materialise(words.groupBy("h").agg(F.sum("n").alias("c")), "word-counts")
    heads = sums.where("c > 0").groupBy(F.pmod("h", F.lit(CLASSES)).alias("class")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"))
    class_total, n_tokens, n_types = np.zeros(CLASSES), size["ends"], int(size["ends"] > 0)
    for r in heads.collect():  # CLASSES rows at most
        class_total[r["class"]] = r["c"] + r["v"]
        n_tokens, n_types = n_tokens + r["c"], n_types + r["v"]

    params = train(rows.where(~F.col("held_out")).select(F.col("id").alias("key"), "text"), states, rounds=rounds)
    none = lambda kind: F.lit(None).cast(kind)
    # both sides are tables, so Spark can split the rows of a word that very many blocks hold
    counted = words.select("block", "h").join(sums, "h")
    lookups = counted.select("block", F.lit(0).alias("kind"), none("long").alias("id"), none("boolean").alias("held_out"), none("string").alias("text"), "h", "c")
    texts = blocked.select("block", F.lit(1).alias("kind"), "id", "held_out", "text", none("long").alias("h"), none("long").alias("c"))
    stream = lookups.unionByName(texts).repartition("block").sortWithinPartitions("block", "kind")
    scorer = _scorer(params, np.log10(class_total + 1), n_tokens, n_types, size["ends"])
    out = stream.mapInArrow(scorer, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    digits = lambda c: F.round(c, 9).alias(c)
    return out.select("id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), digits("base_score"), digits("score"))


def op9_query(spark, sf_dir: str) -> DataFrame:
    out = score_texts(read_table(spark, sf_dir, "documents"), held_out_column("doc_id", 7))
    return out.withColumnRenamed("id", "doc_id")
