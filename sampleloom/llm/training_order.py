"""Training order: a keyed permutation of all sequences, written as fixed-stride binary shards.

The tokens of the documents of an input partition, each document closed by the
end id, are cut into sequences of ``window`` ids (only a partition's last one is
shorter).  Sequences are numbered 0..n-1 in the order of the input.  A Feistel
network over the smallest domain of an even number of bits that holds n, walked
until it lands below n again, gives each number a slot of its own.  Nothing is
drawn or sorted at random; the key alone repeats the order.

A shard is one file of ``shard_rows`` consecutive slots, and a task writes a range
of consecutive shards.  All records have the same size, so slot s is at byte (s mod shard_rows) * stride of shard
s div shard_rows, and a reader may stop and resume anywhere.  A record is: slot (8
bytes), first document (8), position of the first id in it (8), ids (4), their
CRC-32 (4), ``window`` ids (2 bytes each, unused ones zero), a line feed; numbers
are little-endian.  Spark's text writer writes the shards, so the task of a lost
executor is repeated and committed once, on any file system that Spark knows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleloom.llm import packing
from sampleloom.llm.shared import materialise, new_path, read_table

WINDOW = 2048
SHARD_ROWS = 8192
#: Records that one task writes at most, where more tasks than ``spark.sql.shuffle.partitions`` are needed for it (270 MB).
TASK_ROWS = 1 << 16
KEY = 20260101
ROUNDS = 6
_HEAD = "<qqqiI"
_HEAD_BYTES = struct.calcsize(_HEAD)
_NONE = -(1 << 63)


def stride_of(window: int) -> int:
    return _HEAD_BYTES + 2 * window + 1


def permute(numbers: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The slots of sequence numbers below ``n``: a Feistel network with cycle-walking."""
    bits = np.int64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
    mask = (np.int64(1) << bits) - 1
    keys = np.random.default_rng(key).integers(1, 1 << 30, size=(rounds, 2))
    out = numbers.astype(np.int64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for a, b in keys:
            mixed = (right * (a | 1) + b) % np.int64((1 << 31) - 1)
            mixed = (mixed * 69621 + (mixed >> 7)) % np.int64((1 << 31) - 1)
            left, right = right, left ^ (mixed & mask)
        out[todo] = left << bits | right
        todo = todo[out[todo] >= n]
    return out


def _planes(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Low and high bytes of two-byte ids; apart, each compresses better."""
    return (ids & 255).astype(np.uint8).tobytes(), (ids >> 8).astype(np.uint8).tobytes()


def _joined(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, dtype=np.uint8).astype("<u2") | (np.frombuffer(high, dtype=np.uint8).astype("<u2") << 8)


def _sequencer(tokenizer: str | None, window: int, end_id: int):
    schema = pa.schema([("part", pa.int64()), ("nth", pa.int64()), ("first_id", pa.int64()), ("first_at", pa.int64()), ("n", pa.int32()), ("crc32", pa.int64()), ("low", pa.binary()), ("high", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = packing.word_tokenizer(tokenizer)
        part, nth = TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=np.int32)
        held: list[np.ndarray] = []
        size, first = 0, (None, 0)
        rows: list[tuple] = []

        def sequence(ids: np.ndarray, at: tuple):
            nonlocal nth
            if int(ids.max(initial=0)) > 0xFFFF:
                raise ValueError(f"id {int(ids.max())} does not fit the two bytes of a record")
            ids = ids.astype("<u2")
            rows.append((part, nth, *at, len(ids), zlib.crc32(ids.tobytes()), *_planes(ids)))
            nth += 1

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for row, ids in coder.encode(batch.column(1)):
                ids, begin = np.concatenate([ids, end]), 0
                while begin < len(ids):
                    if not size:
                        first = (keys[row], begin)
                    piece = ids[begin : begin + window - size]
                    held.append(piece)
                    size, begin = size + len(piece), begin + len(piece)
                    if size == window:
                        sequence(np.concatenate(held), first)
                        held, size = [], 0
                if len(rows) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows.clear()
        if size:
            sequence(np.concatenate(held), first)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _slotter(bases: np.ndarray, n: int, key: int, shard_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = permute(bases[batch.column(0).to_numpy()] + batch.column(1).to_numpy(), n, key)
            press = zstandard.ZstdCompressor().compress  # the shuffle's own compression does not shorten ids
            planes = [pa.array([press(x) for x in batch.column(k).to_pylist()], pa.binary()) for k in (6, 7)]
            yield pa.RecordBatch.from_arrays([pa.array(slot // shard_rows), pa.array(slot), *batch.columns[2:6], *planes], names=["shard", "slot", *batch.schema.names[2:]])

    return run


def _recorder(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, *columns = (c.to_pylist() for c in batch.columns)
            records = []
            unpress = zstandard.ZstdDecompressor().decompress
            for slot, first_id, first_at, n, crc, low, high in zip(*columns, strict=True):
                ids = _joined(unpress(low), unpress(high))
                head = struct.pack(_HEAD, slot, _NONE if first_id is None else first_id, first_at, n, crc)
                records.append(head + ids.tobytes() + bytes(2 * (window - n)))
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(records, pa.binary())], names=["shard", "record"])

    return run


def write_training_order(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    window: int = WINDOW,
    end_id: int = packing.END_ID,
    shard_rows: int = SHARD_ROWS,
    key: int = KEY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> int:
    """Write the shards of all documents below ``path`` and return the number of sequences.

    Null text counts as empty and gives the end id alone; a null id is kept as
    none.  Rows that repeat a document are sequences of their own.  No documents
    give no shards.  An id above 65,535 is an error.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kinds = "part long, nth long, first_id long, first_at long, n int, crc32 long, low binary, high binary"
    made = materialise(rows.mapInArrow(_sequencer(tokenizer, window, end_id), kinds), "sequences")
    # a row per task of the stage above, whose tasks the driver already tracks one by one
    sizes = {r["part"]: r["size"] for r in made.groupBy("part").agg(F.count(F.lit(1)).alias("size")).collect()}
    bases, n = np.zeros(max(sizes, default=0) + 1, dtype=np.int64), 0
    for part in sorted(sizes):
        bases[part], n = n, n + sizes[part]
    kinds = "shard long, slot long, first_id long, first_at long, n int, crc32 long, low binary, high binary"
    slotted = made.mapInArrow(_slotter(bases, n, key, shard_rows), kinds)
    n_shards = -(-n // shard_rows)
    n_tasks = max(1, min(n_shards, max(-(-n // TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    per_task = max(1, -(-n_shards // n_tasks))
    ordered = slotted.repartitionById(n_tasks, F.floor(F.col("shard") / per_task).cast("int")).sortWithinPartitions("slot")
    records = ordered.mapInArrow(_recorder(window), "shard long, record binary")
    records.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").text(path)
    return n


def _reader(window: int, shard_rows: int, with_ids: bool):
    names = ["shard", "slot", "byte_offset", "first_doc_id", "first_token", "n_tokens", "ids_crc32", "sound", *(["ids"] if with_ids else [])]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *([pa.list_(pa.int32())] if with_ids else [])]
    stride = stride_of(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = memoryview(value.as_buffer())
                rows = []
                for at in range(0, len(content), stride):
                    slot, first_id, first_at, n, crc = struct.unpack_from(_HEAD, content, at)
                    body = content[at + _HEAD_BYTES : at + _HEAD_BYTES + 2 * n]
                    sound = slot == shard * shard_rows + at // stride and zlib.crc32(body) == crc and content[at + stride - 1] == 10
                    row = (shard, slot, at, None if first_id == _NONE else first_id, first_at, n, zlib.crc32(body), sound)
                    rows.append(row + ((np.frombuffer(body, dtype="<u2").astype(np.int32),) if with_ids else ()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def read_shards(spark: SparkSession, path: str, window: int = WINDOW, shard_rows: int = SHARD_ROWS, from_slot: int = 0, with_ids: bool = False) -> DataFrame:
    """The records of the slots from ``from_slot`` on; earlier shards are not opened. ``sound`` tells if place, CRC-32 and end of a record are right."""
    kinds = "shard long, slot long, byte_offset long, first_doc_id long, first_token long, n_tokens long, ids_crc32 long, sound boolean"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.where(F.col("shard") >= from_slot // shard_rows).select(F.col("shard").cast("long").alias("shard"), "content")
    out = files.mapInArrow(_reader(window, shard_rows, with_ids), kinds + (", ids array<int>" if with_ids else ""))
    return out.where(F.col("slot") >= from_slot) if from_slot else out


def op8_query(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "training-order")
    write_training_order(read_table(spark, sf_dir, "documents"), path)
    return read_shards(spark, path)
