"""Exact deduplication by a minimal perfect hash over historical distinct digests.

Every distinct SHA-256 digest of the history owns one slot.  Digests fall into
small buckets by hash; a bucket is cut into sub-buckets of at most eight keys by
a split seed, and each sub-bucket has a seed under which its keys map one to one
onto consecutive slots.  A slot holds the full digest, the locator of the winner
(its document id) and the number of copies.  A lookup computes one slot from the
stored seeds and compares all digest bytes, so a digest outside the history can
never pass for a member.

Buckets are rows of an ordinary table.  Documents reach their bucket by a join
on the bucket number, so the index may grow with the corpus without ever being
broadcast, and a digest that a third of all documents share is split by adaptive
skew handling because the document side needs no grouping after the join.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleloom.llm.shared import materialise, text_or_empty

KEYS_PER_BUCKET = 3
KEYS_PER_SEED = 8
MAX_CHUNKS = 1024

_SLOT = T.StructType(
    [T.StructField("digest", T.BinaryType()), T.StructField("winner", T.LongType()), T.StructField("copies", T.LongType())]
)
_BUCKET = T.StructType(
    [
        T.StructField("bucket", T.LongType()),
        T.StructField("split_seed", T.LongType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("seeds", T.ArrayType(T.LongType())),
        T.StructField("slots", T.ArrayType(_SLOT)),
    ]
)


def digest_of(text: str | Column) -> Column:
    """SHA-256 of the UTF-8 text as 32 bytes; null text counts as empty."""
    return F.unhex(F.sha2(text_or_empty(text), 256))


def _seeded(seed: Column, digest: Column, size: Column) -> Column:
    return F.pmod(F.xxhash64(seed, digest), size)


def _start(seed: int) -> int:
    return xxhash.xxh64_intdigest(struct.pack("<q", seed), seed=42)


def _place(start: int, digest: bytes, size: int) -> int:
    h = xxhash.xxh64_intdigest(digest, seed=start)
    return (h - (1 << 64) if h >> 63 else h) % size


def _bijection(keys: list[bytes]) -> tuple[int, list[int]]:
    """The first seed that maps the keys one to one onto 0..len(keys)-1, and their places."""
    size, seed = len(keys), 0
    while True:
        start, places, taken = _start(seed), [], 0
        for key in keys:
            place = _place(start, key, size)
            if taken >> place & 1:
                break
            taken |= 1 << place
            places.append(place)
        else:
            return seed, places
        seed += 1


def solve_bucket(entries: list[dict]) -> tuple[int, list[int], list[int], list[dict]]:
    """Split seed, sub-bucket starts, sub-bucket seeds and the entries in slot order."""
    parts, split_seed = [entries], 0
    n_parts = -(-len(entries) // KEYS_PER_SEED)
    while n_parts > 1:
        start, parts = _start(split_seed), [[] for _ in range(n_parts)]
        for e in entries:
            parts[_place(start, e["digest"], n_parts)].append(e)
        if max(map(len, parts)) <= KEYS_PER_SEED:
            break
        split_seed += 1
        if split_seed % 64 == 0:
            n_parts += 1
    starts, seeds, slots = [0], [], []
    for part in parts:
        seed, places = _bijection([e["digest"] for e in part])
        ordered: list = [None] * len(part)
        for place, e in zip(places, part, strict=True):
            ordered[place] = e
        seeds.append(seed)
        slots += ordered
        starts.append(len(slots))
    return split_seed, starts, seeds, slots


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slot = pa.struct([("digest", pa.binary()), ("winner", pa.int64()), ("copies", pa.int64())])
    schema = pa.schema(
        [("bucket", pa.int64()), ("split_seed", pa.int64()), ("starts", pa.list_(pa.int32())), ("seeds", pa.list_(pa.int64())), ("slots", pa.list_(slot))]
    )
    for batch in batches:
        out: dict = {name: [] for name in schema.names}
        for bucket, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for name, value in zip(schema.names, (bucket, *solve_bucket(entries)), strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def build_index(history: DataFrame) -> tuple[DataFrame, int]:
    """The index over ``history(id, digest)`` and its number of buckets.

    The index has a row per non-empty bucket; ``base`` is the global number of
    its first slot, so slots run from 0 to the number of distinct digests less one.
    The number of buckets follows an estimate of that number.
    """
    spark = history.sparkSession
    distinct = history.agg(F.approx_count_distinct("digest").alias("n")).first()["n"]
    n_buckets = max(1, -(-distinct // KEYS_PER_BUCKET))
    keys = history.groupBy("digest").agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("copies"))
    buckets = (
        keys.groupBy(F.pmod(F.xxhash64("digest"), F.lit(n_buckets)).alias("bucket"))
        .agg(F.collect_list(F.struct("digest", "winner", "copies")).alias("slots"))
        .mapInArrow(_solve, _BUCKET)
    )
    buckets = materialise(buckets, "mph")
    per_chunk = -(-n_buckets // MAX_CHUNKS)
    chunk = F.col("bucket").cast("long") - F.pmod("bucket", F.lit(per_chunk))
    sizes = buckets.groupBy(chunk.alias("chunk")).agg(F.sum(F.size("slots")).alias("n")).orderBy("chunk").collect()  # MAX_CHUNKS rows at most
    first, at = {}, 0
    for row in sizes:
        first[row["chunk"]], at = at, at + row["n"]
    offsets = spark.createDataFrame(list(first.items()) or [(0, 0)], "chunk long, chunk_base long")
    from pyspark.sql import Window

    before = Window.partitionBy("chunk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    index = (
        buckets.withColumn("chunk", chunk)
        .join(F.broadcast(offsets), "chunk")  # MAX_CHUNKS rows at most
        .withColumn("base", F.col("chunk_base") + F.coalesce(F.sum(F.size("slots")).over(before), F.lit(0)))
        .drop("chunk", "chunk_base")
    )
    return index, n_buckets


def lookup(rows: DataFrame, index: DataFrame, n_buckets: int) -> DataFrame:
    """Add slot, winner and copies to ``rows(id, digest)``; all three are null outside the history."""
    probe = rows.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(n_buckets)))
    joined = probe.join(index, "bucket", "left")
    sub = _seeded(F.col("split_seed"), F.col("digest"), F.size("seeds")).cast("int")
    joined = joined.withColumn("sub", F.when(F.col("split_seed").isNotNull(), sub))
    lo, hi = F.get("starts", F.col("sub")), F.get("starts", F.col("sub") + 1)
    local = F.when(hi > lo, lo + _seeded(F.get("seeds", F.col("sub")), F.col("digest"), hi - lo)).cast("int")
    joined = joined.withColumn("local", local).withColumn("entry", F.get("slots", F.col("local")))
    member = F.col("entry.digest") == F.col("digest")
    return joined.select(
        *rows.columns,
        F.when(member, F.col("base") + F.col("local")).alias("slot"),
        F.when(member, F.col("entry.winner")).alias("winner"),
        F.when(member, F.col("entry.copies")).alias("copies"),
    )


def exact_duplicates(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, digest, winner, copies, member.

    With a ``history`` the repeats of its texts are members: their winner is the
    historical document and copies counts history and batch together; all other
    rows group among themselves.  Without one, the batch's own distinct digests
    are the history, and every row is resolved by its slot.

    Null text counts as the empty text.  The largest id wins; a null id never
    wins unless its whole group has none.  Rows that repeat an id keep a row
    each and count each.  An empty table gives an empty result.  Columns other
    than the id and the text are not read.
    """
    rows = materialise(docs.select(F.col(id_col).alias("id"), digest_of(text_col).alias("digest")), "digests")
    if history is None:
        index, n = build_index(rows)
        return lookup(rows, index, n).select("id", "digest", "winner", "copies", F.lit(False).alias("member"))
    index, n = build_index(materialise(history.select(F.col(id_col).alias("id"), digest_of(text_col).alias("digest")), "history"))
    found = materialise(lookup(rows, index, n), "found")
    counts = found.groupBy("digest").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("here"))
    both = found.join(counts, "digest")
    member = F.col("copies").isNotNull()
    return both.select(
        "id",
        "digest",
        F.when(member, F.col("winner")).otherwise(F.col("last")).alias("winner"),
        (F.coalesce("copies", F.lit(0)) + F.col("here")).alias("copies"),
        member.alias("member"),
    )


def keep_rows(docs: DataFrame, wanted: DataFrame, key: Column, id_col: str = "doc_id") -> DataFrame:
    """A row of ``docs`` for each different (id, key) of ``wanted``; ``key`` is that of a row of ``docs``.

    A null id matches a null id.  Of rows that agree in id and key, the one whose
    JSON sorts first stays.
    """
    wanted = materialise(wanted.groupBy("id", "key").agg(F.count(F.lit(1)).alias("m")), "wanted")
    matching = lambda rows: docs.join(rows.hint("shuffle_hash"), docs[id_col].eqNullSafe(rows["id"]) & (key == rows["key"]), "left_semi")
    once, often = matching(wanted.where("m = 1")), wanted.where("m > 1")
    if often.isEmpty():
        return once
    row = F.struct(*[docs[c] for c in docs.columns])
    kept = matching(often).groupBy(docs[id_col].alias("i"), key.alias("k")).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return once.unionByName(kept.select("row.*"))


def drop_exact_copies(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each text, with all its columns: the row with the largest id (a row without an id only if none has one).

    With a ``history``, texts that it holds go altogether.
    """
    out = exact_duplicates(docs, history, id_col, text_col)
    winners = out.where(~F.col("member") & F.col("id").eqNullSafe(F.col("winner"))).select("id", F.col("digest").alias("key"))
    return keep_rows(docs, winners, digest_of(docs[text_col]), id_col)


def op1_query(spark, sf_dir: str) -> DataFrame:
    from sampleloom.llm.shared import read_table

    out = exact_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("winner").alias("keep_id"),
        F.col("copies").alias("group_size"),
        F.col("id").eqNullSafe(F.col("winner")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
