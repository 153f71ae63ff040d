"""Token counts of whole texts by a compiled finite-state tokenizer.

The vocabulary of a byte-pair model with pieces and scores is compiled into an
Aho-Corasick automaton, whose states are the prefixes of pieces.  Reading one
more character, the transducer moves to the next state and settles which piece
ends the encoding of the prefix read so far: of the pieces that end here, it is
the only one whose pair with the piece before it encodes to that very pair
(adjacent pairs decide whether a sequence of pieces is an encoding).  The
transition's annotation is one token on top of the count at that piece's start,
or a token per byte for a character outside the vocabulary.

No piece has a space after another character, and a line feed is in no piece.
So a text falls into units (spaces and the word behind them, or a line feed)
that all start in the initial state: the state map of a unit is a constant plus
a count.  Counts of units compose by addition, so the counts of all chunks and
documents come from one parallel prefix sum over the units of a batch.  Unit
counts are kept in a bounded memory; new units run through the transducer side
by side, one character per step, and each keeps only as many steps as the
longest piece has characters.

A long unit (a text without spaces) is cut into chunks that run side by side,
each from a guess: the state some characters before it if the unit began there.
A chunk maps its entry state to an exit state and a count; the maps compose
where each entry equals the exit before it.  Chunks whose guess was wrong run
again from the exit before them, until all agree, so the count is exact.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleloom.llm.packing import tokenizer_path
from sampleloom.llm.shared import read_table
from sampleloom.llm.text_arrays import SpanMemory, hash_and_check, row_slices, text_buffers

MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
MEMORY_UNITS = 1_500_000
LANES = 4096
#: Units of more characters are cut into chunks; a chunk's guess starts WARM characters before it.
CHUNK, WARM = 1024, 256
#: Pairs of pieces whose encoding is remembered.
MEMORY_PAIRS = 4_000_000

SPACE = "▁"
_SHIFT = 21
_START = (1 << _SHIFT) - 1


class Transducer:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        ids: dict[str, int] = {}
        for k in range(model.get_piece_size()):
            if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)):
                piece = model.id_to_piece(k)
                self.score[piece], ids[piece] = model.get_score(k), k
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in ids):
            raise ValueError("a piece of this model spans a space or a line feed")
        self.n_pieces = model.get_piece_size()
        self.text_of = {k: p for p, k in ids.items()}
        self._compile(ids)
        self._pair_keys = np.zeros(0, dtype=np.int64)
        self._pair_ok = np.zeros(0, dtype=bool)

    def _compile(self, ids: dict[str, int]) -> None:
        """States and transitions of the automaton; ``piece`` ends in a state, ``shorter`` is the next state on its suffix path that ends a piece."""
        step: list[dict[int, int]] = [{}]
        piece = [-1]
        for text, k in ids.items():
            state = 0
            for ch in map(ord, text):
                if ch not in step[state]:
                    step[state][ch] = len(step)
                    step.append({})
                    piece.append(-1)
                state = step[state][ch]
            piece[state] = k
        fail, shorter = [0] * len(step), [0] * len(step)
        queue = deque(step[0].values())
        while queue:
            state = queue.popleft()
            shorter[state] = fail[state] if piece[fail[state]] >= 0 else shorter[fail[state]]
            for ch, to in step[state].items():
                back = fail[state]
                while back and ch not in step[back]:
                    back = fail[back]
                fail[to] = step[back].get(ch, 0)
                queue.append(to)
        moves = sorted((state << _SHIFT | ch, to) for state, out in enumerate(step) for ch, to in out.items())
        self._move_key = np.array([k for k, _ in moves], dtype=np.int64)
        self._move_to = np.array([to for _, to in moves], dtype=np.int64)
        self._fail, self._shorter, self._piece = (np.array(x, dtype=np.int64) for x in (fail, shorter, piece))
        self._length = np.ones(self.n_pieces, dtype=np.int64)
        for text, k in ids.items():
            self._length[k] = len(text)
        self.longest = int(self._length.max(initial=1))

    def encode(self, text: str) -> list[str]:
        """The pieces of a short text, by merging the best pair again and again (the leftmost of equals)."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _spell(self, token: int) -> str:
        return self.text_of[token] if token < self.n_pieces else chr(token - self.n_pieces)

    def _pair_holds(self, key: int) -> bool:
        before, token = key >> _SHIFT, key & _START
        pair = [self._spell(token)] if before == _START else [self._spell(before), self._spell(token)]
        return self.encode("".join(pair)) == pair

    def _pairs_hold(self, keys: np.ndarray) -> np.ndarray:
        unique, inverse = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self._pair_keys, unique)
        inside = np.minimum(at, max(len(self._pair_keys) - 1, 0))
        known = self._pair_keys[inside] == unique if len(self._pair_keys) else np.zeros(len(unique), dtype=bool)
        if not known.all():
            if len(self._pair_keys) + int((~known).sum()) > MEMORY_PAIRS:
                self._pair_keys, self._pair_ok = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
                at, known = np.zeros(len(unique), dtype=np.int64), np.zeros(len(unique), dtype=bool)
            found = np.fromiter((self._pair_holds(k) for k in unique[~known].tolist()), dtype=bool)
            self._pair_keys = np.insert(self._pair_keys, at[~known], unique[~known])
            self._pair_ok = np.insert(self._pair_ok, at[~known], found)
        return self._pair_ok[np.searchsorted(self._pair_keys, unique)][inverse]

    def _move(self, state: np.ndarray, ch: np.ndarray) -> np.ndarray:
        out = np.zeros(len(state), dtype=np.int64)
        todo = np.arange(len(state))
        while len(todo):
            key = state[todo] << _SHIFT | ch[todo]
            at = np.minimum(np.searchsorted(self._move_key, key), len(self._move_key) - 1)
            hit = self._move_key[at] == key
            out[todo[hit]] = self._move_to[at[hit]]
            todo = todo[~hit]
            stuck = state[todo] == 0
            todo = todo[~stuck]
            state = state.copy()
            state[todo] = self._fail[state[todo]]
        return out

    def count(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each span of code points (spaces already spelled as the model spells them)."""
        out = np.zeros(len(starts), dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        n_long = int(np.searchsorted(-lengths[order], -CHUNK, side="left"))
        for k in order[:n_long].tolist():
            out[k] = self._fold(points[starts[k] : starts[k] + lengths[k]])
        for k in range(n_long, len(order), LANES):
            lanes = order[k : k + LANES]
            out[lanes] = self._run(points, starts[lanes], lengths[lanes], self._fresh(len(lanes)))[0].total
        return out

    def _fresh(self, n: int) -> Lanes:
        """The state in front of a text."""
        last = np.full((self.longest, n), -1, dtype=np.int64)
        last[0] = _START
        return Lanes(np.zeros(n, dtype=np.int64), last, np.zeros((self.longest, n), dtype=np.int64), np.zeros(n, dtype=np.int64))

    def _run(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, enter: Lanes, mark: int = 0) -> tuple[Lanes, Lanes | None]:
        """Lanes in falling order of length, one character of all lanes per step: their states at the end, and after ``mark`` characters."""
        ring = self.longest + 1
        back = -np.arange(self.longest)
        last = np.zeros((ring, len(starts)), dtype=np.int64)
        total = np.zeros((ring, len(starts)), dtype=np.int64)
        last[back % ring], total[back % ring] = enter.last, enter.behind
        state = enter.state
        leave, marked = self._fresh(len(starts)), None

        def put(lanes: Lanes, at: int, lo: int, hi: int) -> None:
            rows = (at + back) % ring
            lanes.state[lo:hi], lanes.last[:, lo:hi], lanes.total[lo:hi] = state[lo:hi], last[rows, lo:hi], total[at % ring, lo:hi]
            lanes.behind[:, lo:hi] = total[rows, lo:hi] - total[at % ring, lo:hi]

        for at in range(1, int(lengths[0]) + 1 if len(lengths) else 0):
            n = int(np.searchsorted(-lengths, -at, side="right"))
            ch = points[starts[:n] + at - 1].astype(np.int64)
            state = self._move(state[:n], ch)
            ending = np.where(self._piece[state] >= 0, state, self._shorter[state])
            todo = np.arange(n)
            now, before = at % ring, (at - 1) % ring
            while True:
                out_of = ending[todo] == 0
                plain = todo[out_of]  # no piece ends here: the character is spelled in bytes
                if len(plain):
                    last[now, plain] = self.n_pieces + ch[plain]
                    total[now, plain] = total[before, plain] + 1 + (ch[plain] > 0x7F) + (ch[plain] > 0x7FF) + (ch[plain] > 0xFFFF)
                todo = todo[~out_of]
                if not len(todo):
                    break
                token = self._piece[ending[todo]]
                begin = (at - self._length[token]) % ring
                ok = self._pairs_hold(last[begin, todo] << _SHIFT | token)
                good = todo[ok]
                last[now, good] = token[ok]
                total[now, good] = total[begin[ok], good] + 1
                todo = todo[~ok]
                ending[todo] = self._shorter[ending[todo]]
            if at == mark:
                marked = self._fresh(len(starts))
                put(marked, at, 0, n)
            put(leave, at, int(np.searchsorted(-lengths, -at, side="left")), n)
        return leave, marked

    def _fold(self, points: np.ndarray) -> int:
        """Tokens of a long unit: the state maps of its chunks, composed."""
        begin = np.arange(0, len(points), CHUNK)
        n = len(begin)
        lengths = np.minimum(begin + CHUNK, len(points)) - begin
        enter, leave = self._fresh(n), self._fresh(n)
        first = self._run(points, begin[:1], lengths[:1], self._fresh(1))[0]
        leave.put(np.array([0]), first)
        warm = np.arange(1, n)
        for k in range(0, len(warm), LANES):
            lanes = warm[k : k + LANES]
            left, entered = self._run(points, begin[lanes] - WARM, lengths[lanes] + WARM, self._fresh(len(lanes)), WARM)
            left.total -= entered.total
            enter.put(lanes, entered)
            leave.put(lanes, left)
        seen: dict[tuple, Lanes] = {}
        while True:
            wrong = 1 + np.flatnonzero(~leave.take(np.arange(n - 1)).same(enter.take(warm)))
            if not len(wrong):
                return int(leave.total.sum())
            enter.put(wrong, leave.take(wrong - 1))
            fresh = []
            for k in wrong.tolist():
                key = points[begin[k] : begin[k] + lengths[k]].tobytes(), enter.key(k)
                if key in seen:
                    leave.put(np.array([k]), seen[key])
                else:
                    fresh.append((k, key))
            for a in range(0, len(fresh), LANES):
                lanes = np.array([k for k, _ in fresh[a : a + LANES]])
                now = enter.take(lanes)
                now.total[:] = 0
                left = self._run(points, begin[lanes], lengths[lanes], now)[0]
                leave.put(lanes, left)
                for j, (_, key) in enumerate(fresh[a : a + LANES]):
                    seen[key] = left.take(np.array([j]))


@dataclass
class Lanes:
    """States of the transducer: the automaton's, the tokens that end at the last positions, their counts less the count here, and the count here."""

    state: np.ndarray
    last: np.ndarray
    behind: np.ndarray
    total: np.ndarray

    def take(self, at: np.ndarray) -> Lanes:
        return Lanes(self.state[at], self.last[:, at], self.behind[:, at], self.total[at])

    def put(self, at: np.ndarray, other: Lanes) -> None:
        self.state[at], self.last[:, at], self.behind[:, at], self.total[at] = other.state, other.last, other.behind, other.total

    def same(self, other: Lanes) -> np.ndarray:
        return (self.state == other.state) & (self.last == other.last).all(axis=0) & (self.behind == other.behind).all(axis=0)

    def key(self, k: int) -> bytes:
        return self.state[k].tobytes() + self.last[:, k].tobytes() + self.behind[:, k].tobytes()


class TokenCounter:
    """Token counts of the rows of string columns."""

    def __init__(self, path: str, memory_units: int = MEMORY_UNITS):
        self.transducer = Transducer(path)
        self._memory = SpanMemory(memory_units)

    def _count_units(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The counts of the spans of bytes, by the transducer."""
        size = ends - starts
        flat = data[np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))]
        points = np.frombuffer(flat.tobytes().decode().replace(" ", SPACE).encode("utf-32-le"), dtype=np.uint32)
        leads = np.concatenate(([0], np.cumsum((flat & 0xC0) != 0x80)))
        edges = leads[np.concatenate(([0], np.cumsum(size)))]
        return self.transducer.count(points, edges[:-1], np.diff(edges))

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens per row; null and empty texts have none."""
        column = pc.replace_substring(column.fill_null(""), SPACE, " ")  # the model reads both alike
        offsets, data = text_buffers(column)
        out = np.zeros(len(offsets) - 1, dtype=np.int64)
        for lo, hi in row_slices(offsets):
            at = offsets[lo : hi + 1] - offsets[lo]
            filled = np.flatnonzero(np.diff(at))
            if not len(filled):
                continue
            # each text gets the space that the model puts in front
            body = np.insert(data[offsets[lo] : offsets[hi]], at[filled], 32)
            fresh = at[filled] + np.arange(len(filled))
            space, feed = body == 32, body == 10
            begin = feed.copy()
            begin[1:] |= (space[1:] & ~space[:-1]) | feed[:-1]
            begin[fresh] = True
            starts = np.flatnonzero(begin)
            ends = np.append(starts[1:], len(body))
            compute = lambda k: (self._count_units(body, starts[k], ends[k]).astype(np.int32), np.ones(len(k), np.int64))  # noqa: B023, E731
            values, first, _ = self._memory.resolve(*hash_and_check(body, starts, ends), compute)
            scan = np.concatenate(([0], np.cumsum(values[first], dtype=np.int64)))
            edge = np.append(np.searchsorted(starts, fresh), len(starts))
            out[lo + filled] = np.diff(scan[edge])
        return out


_counters: dict[str, TokenCounter] = {}


def _counting(path: str | None):
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = path or tokenizer_path(MODEL)
        if where not in _counters:
            _counters[where] = TokenCounter(where)
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(_counters[where].counts(batch.column(1)))], schema=schema)

    return run


def count_tokens(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens of every row; null text counts as empty (no tokens). Rows are independent; other columns are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_counting(model), "id long, n_bytes long, n_tokens long")


def op10_query(spark, sf_dir: str) -> DataFrame:
    out = count_tokens(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))
