"""Packing token sequences into fixed windows by best-fit decreasing.

A document longer than a window is first cut into full windows.  What is left of
each document is shorter than a window, so all that matters for packing is how
many rests there are of each length: a histogram of ``window`` entries at most,
however large the corpus.  Best-fit decreasing runs on that histogram.  Open
windows of equal remaining capacity are one leaf of a segment tree over
capacities, and the tightest leaf that holds the next length is found in a
logarithmic number of steps; a whole run of equal rests is placed at once.  The
result (runs of ranks to runs of windows) equals best-fit decreasing over the
single rests, and each rest finds its window by its rank within its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.llm.shared import materialise, read_table
from sampleloom.llm.text_arrays import SpanMemory, gather_runs, words_of

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
CACHE_WORDS = 1_500_000
RANK_ROWS, LEAST_SALTS = 1 << 18, 64
#: Runs of five numbers that may be broadcast (4 MB); more are joined by length.
BROADCAST_RUNS = 100_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of whole texts, with a bounded memory of the ids of words between ASCII white space.

    The vocabulary's normaliser lower-cases and folds white space, and its
    splitter never lets a token span white space or a border between a letter
    and a mark such as a full stop, so a text's ids are those of its words and
    marks in order.  New words are encoded together, kept apart by the end
    marker that the library always cuts at.  Texts with ``<|``, which may spell
    a marker, are encoded whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._marker = "<|endoftext|>"
        self._marker_id = self._tokenizer.token_to_id(self._marker)
        self._memory = SpanMemory(cache_words)

    def _encode(self, text: str) -> np.ndarray:
        return np.asarray(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int32)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, end to end, and how many each has."""
        flat, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for k in range(0, len(words), 2048):
            ids = self._encode(self._marker.join(words[k : k + 2048]))
            cuts = np.flatnonzero(ids == self._marker_id)
            lengths.append(np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1)
            flat.append(np.delete(ids, cuts))
        return np.concatenate(flat), np.concatenate(lengths)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """Row number and ids of every text of a batch."""
        for w in words_of(column, cut_marks=True, check=True):
            data = w.data.tobytes()
            odd = np.zeros(w.hi - w.lo, dtype=bool)
            plain = np.arange(len(w.starts))
            if b"<|" in data:
                row = np.repeat(np.arange(w.hi - w.lo), np.diff(w.first))
                marked = np.flatnonzero((w.data[:-1] == 60) & (w.data[1:] == 124))
                odd[row[np.searchsorted(w.starts, marked, side="right") - 1]] = True
                plain = np.flatnonzero(~odd[row])
            new = lambda at: self.encode_words([data[a:b].decode() for a, b in zip(w.starts[plain[at]].tolist(), w.ends[plain[at]].tolist(), strict=True)])  # noqa: B023, E731
            lengths = np.zeros(len(w.starts), dtype=np.int64)
            ids = np.zeros(0, np.int32)
            if len(plain):
                values, lo, lengths[plain] = self._memory.resolve(w.hashes[plain], w.checks[plain], new)
                ids = gather_runs(values, lo, lengths[plain])
            ends = np.concatenate(([0], np.cumsum(lengths)))[w.first]
            for r in range(w.hi - w.lo):
                yield w.lo + r, (self._encode(column[w.lo + r].as_py()) if odd[r] else ids[ends[r] : ends[r + 1]])


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str | None = None) -> WordTokenizer:
    """The tokenizer of this worker process for a vocabulary file."""
    where = path or tokenizer_path(TOKENIZER)
    if where not in _tokenizers:
        _tokenizers[where] = WordTokenizer(where)
    return _tokenizers[where]


def _cutter(path: str | None, window: int, end_id: int, with_ids: bool):
    names = ["id", "piece", "start", "length", "crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_tokenizer(path)
        end = np.array([end_id], dtype=np.int32)
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), {n: [] for n in names}
            for row, ids in coder.encode(batch.column(1)):
                coded = np.concatenate([ids, end]).astype("<u4")
                for k, start in enumerate(range(0, len(coded), window)):
                    piece = coded[start : start + window].tobytes()
                    values = [keys[row], k, start, len(piece) // 4, zlib.crc32(piece), len(coded), *([piece] if with_ids else [])]
                    for n, v in zip(names, values, strict=True):
                        out[n].append(v)
                if len(out["id"]) >= 512:
                    yield pa.RecordBatch.from_pydict(out, schema=schema)
                    out = {n: [] for n in names}
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def cut_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, piece, start, length, crc32, doc_tokens (and ids, little-endian 32-bit) of every piece of every document."""
    kinds = "id long, piece long, start long, length long, crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_cutter(tokenizer, window, end_id, with_ids), kinds)


class CapacityTree:
    """A segment tree over remaining capacities; a leaf counts the open windows that have that much left."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.total = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        node = self.size + capacity
        while node:
            self.total[node] += n
            node >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least ``length`` that an open window has."""
        node = self.size + length
        if self.total[node]:
            return length
        while node > 1:
            if not node & 1 and self.total[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.total[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def best_fit(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first window, offset) and the number of windows opened."""
    tree = CapacityTree(window)
    open_runs: dict[int, list[tuple[int, int]]] = {}
    runs, opened = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity = window
                tree.add(window, -(-left // (window // length)))
                open_runs.setdefault(window, []).append((opened, tree.total[tree.size + window]))
                opened += tree.total[tree.size + window]
            # the tightest window stays the tightest until it is too small, so it is filled as far as it goes
            layers = min(capacity // length, left)
            first, n = open_runs[capacity].pop()
            take = min(n, left // layers)
            for layer in range(layers):
                runs.append((length, rank, take, first, window - capacity + layer * length))
                rank += take
            left -= take * layers
            if take < n:
                open_runs[capacity].append((first + take, n - take))
            tree.add(capacity, -take)
            rest = capacity - layers * length
            if rest:
                tree.add(rest, take)
                open_runs.setdefault(rest, []).append((first, take))
    return runs, opened


def _ranked(rows: DataFrame, by: list[str], amount, order: list[str]) -> DataFrame:
    """Add ``rank``: the sum of ``amount`` over the rows of the same ``by`` that come before, without one task per group."""
    salts = max(LEAST_SALTS, min(4096, rows.count() // RANK_ROWS + 1))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    inner = Window.partitionBy(*by, "salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = salted.groupBy(*by, "salt").agg(F.sum(amount).alias("amount"))
    outer = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*by, "salt", F.coalesce(F.sum("amount").over(outer), F.lit(0)).alias("base"))
    ranked = salted.withColumn("inner", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    return ranked.join(bases, [*by, "salt"]).withColumn("rank", F.col("base") + F.col("inner")).drop("base", "inner", "salt")


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (as ``cut_documents`` gives them).

    Rests of equal length are ranked by id and piece; pieces that agree in these
    too are interchangeable.  Sequences of rests come first, then the full
    windows, numbered without gaps.  No pieces give no sequences.
    """
    spark = pieces.sparkSession
    rests = pieces.where(F.col("length") < window)
    histogram = {r["length"]: r["n"] for r in rests.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # ``window`` rows at most
    runs, opened = best_fit(histogram, window)
    table = spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "length long, first_rank long, n long, first_window long, offset long")
    order = ["id", "piece", "crc32"]
    one = F.lit(1)
    ranked = _ranked(rests, ["length"], one, order)
    # runs of a length are consecutive in rank: the run of a rank is the last that starts at or before it
    by_length = table.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first_rank", "n", "first_window", "offset"))).alias("runs"))
    if len(runs) <= BROADCAST_RUNS:
        by_length = F.broadcast(by_length)
    placed = ranked.join(by_length, "length").withColumn(
        "run", F.expr("element_at(filter(runs, r -> r.first_rank <= rank AND rank < r.first_rank + r.n), 1)")
    )
    columns = pieces.columns
    placed = placed.select(*columns, (F.col("run.first_window") + F.col("rank") - F.col("run.first_rank")).alias("sequence_id"), F.col("run.offset").alias("offset"))
    full = _ranked(pieces.where(F.col("length") == window), [], one, order)
    full = full.select(*columns, (F.col("rank") + opened).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    Null text counts as empty: such a document is its end id alone.  Rows that
    repeat a document are packed once each; a null id stays null.  Other columns
    are not read.
    """
    return pack(materialise(cut_documents(docs, tokenizer, window, end_id, with_ids), "pieces"), window)


def op4_query(spark, sf_dir: str) -> DataFrame:
    return op4_rows(read_table(spark, sf_dir, "documents"))


def op4_rows(docs: DataFrame) -> DataFrame:
    return pack_documents(docs).select(F.col("id").alias("doc_id"), "start", "length", F.col("crc32").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
