"""Near-duplicate documents by one-permutation hashing with optimal densification.

1.  Each document becomes its set of distinct word shingles (64-bit hashes).
    Documents with equal sets form a class; only one representative goes on, so
    a group of thousands of copies is one member from here.
2.  One permutation of a set is cut into ``bands * rows`` bins; empty bins take
    the value of a bin found by their own probe sequence.  A band's bins
    hash to its bucket.
3.  A bucket of several representatives gives star-shaped edges to one centre.
    Edges are confirmed on the full sets.  Where a bucket still spans several
    components, the member with the most links becomes the next centre, and
    last the members outside the largest component are compared with the rest
    of the bucket, in blocks of bounded size.  So every two members of a bucket end in one
    component, are compared, or are ruled out by size or by the number of
    their shingles that no other open document has.  No bucket is
    capped and no link between different sets of a bucket is lost.

With 40 bands of 5 rows, two sets of similarity 0.8 share a bucket with
probability 1 - 1.3e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleloom.llm.components import components
from sampleloom.llm.exact_dedup import keep_rows
from sampleloom.llm.shared import materialise, read_table, text_or_empty
from sampleloom.llm.text_arrays import mix, words_of

WORDS, PERCENT, BANDS, ROWS = 5, 80, 40, 5
CHUNK = 256

_U = np.uint64
_PROBES = (16, 256, 4096)


def shingle_set(hashes: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word hashes; a short document is one shingle."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(n, words)
    acc = np.full(n - width + 1, _U(width), dtype=_U)
    for k in range(width):
        acc = mix(acc * _U(0x9FB21C651E98DF25) + hashes[k : n - width + 1 + k])
    return np.unique(acc)


def _probe_table(bins: int, width: int) -> np.ndarray:
    at = np.arange(bins, dtype=_U)[:, None] * _U(1 << 20) + np.arange(1, width + 1, dtype=_U)[None, :]
    return ((mix(at * _U(0x9E3779B97F4A7C15)) >> _U(32)) * _U(bins) >> _U(32)).astype(np.int32)


_probes: dict[tuple[int, int], np.ndarray] = {}


def signature(values: np.ndarray, bins: int) -> np.ndarray:
    """The densified one-permutation signature of a non-empty set of sorted hashes."""
    bin_of = ((values >> _U(32)) * _U(bins) >> _U(32)).astype(np.int64)
    head = np.flatnonzero(np.diff(bin_of, prepend=-1))
    out = np.zeros(bins, dtype=_U)
    full = np.zeros(bins, dtype=bool)
    out[bin_of[head]] = values[head]
    full[bin_of[head]] = True
    if len(head) == 1:
        out[:] = values[head[0]]
        return out
    empty = np.flatnonzero(~full)
    source = out.copy()
    for width in _PROBES:
        if not len(empty):
            return out
        if (bins, width) not in _probes:
            _probes[bins, width] = _probe_table(bins, width)
        table = _probes[bins, width][empty]
        hit = full[table]
        first = hit.argmax(axis=1)
        found = hit[np.arange(len(empty)), first]
        out[empty[found]] = source[table[np.arange(len(empty)), first][found]]
        empty = empty[~found]
    if len(empty):  # out of probes (odds below 1e-8 with two full bins): the next full bin
        filled = np.flatnonzero(full)
        out[empty] = source[filled[np.searchsorted(filled, empty) % len(filled)]]
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    acc = np.arange(1, bands + 1, dtype=_U)
    for k in range(rows):
        acc = mix(acc * _U(0x9FB21C651E98DF25) + sig[k::rows][:bands])
    return acc


def _sketcher(words: int, bands: int, rows: int):
    schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows_of = batch.column(0), batch.column(2)
            for w in words_of(batch.column(1)):
                n, digests, keys = [], [], []
                for r in range(w.hi - w.lo):
                    values = shingle_set(w.hashes[w.first[r] : w.first[r + 1]], words)
                    n.append(len(values))
                    digests.append(xxhash.xxh3_128_digest(values.tobytes()))
                    if len(values):
                        keys.append(band_keys(signature(values, bands * rows), bands, rows).view(np.int64))
                    else:
                        keys.append(np.zeros(0, dtype=np.int64))
                lengths = np.array([0, *map(len, keys)]).cumsum().astype(np.int32)
                flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64))
                columns = [*(c.slice(w.lo, w.hi - w.lo) for c in (ids, rows_of)), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(lengths), flat)]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def _set_maker(words: int):
    schema = pa.schema([("id", pa.int64()), ("members", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch.column(1)):
                sets = [shingle_set(w.hashes[w.first[r] : w.first[r + 1]], words).view(np.int64) for r in range(w.hi - w.lo)]
                lengths = np.array([0, *map(len, sets)]).cumsum().astype(np.int32)
                members = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.hi - w.lo).cast(pa.int64()), members], schema=schema)

    return run


def _pairs(rows: DataFrame, other: str, percent: int) -> DataFrame:
    """Distinct pairs a < b of id and ``other`` whose sizes allow the similarity."""
    fits = F.least("n", f"{other}_n") * 100 >= F.greatest("n", f"{other}_n") * percent
    if "common" in rows.columns:
        most = F.least("common", f"{other}_common")
        fits = fits & (most * 100 >= (F.col("n") + F.col(f"{other}_n") - most) * percent)
    return rows.where(fits & (F.col("id") != F.col(other))).select(F.least("id", other).alias("a"), F.greatest("id", other).alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, distance, linked of every pair, from the full sets."""
    left = sets.select(F.col("id").alias("a"), F.col("members").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb") - both).alias("either"))
    return joined.select("a", "b", (1 - F.col("both") / F.col("either")).alias("distance"), (F.col("both") * 100 >= F.col("either") * percent).alias("linked"))


def near_duplicates(
    docs: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, row (hash of its text), n (size of its shingle set), component (smallest id reachable by links), kept.

    Documents are linked when 100 * intersection >= ``percent`` * union of their
    sets of ``words``-word shingles.  A document with fewer words is one shingle;
    null text and text without words have an empty set and are linked with
    nothing.  Rows are documents of their own, also where they repeat an id or have
    none (a component without any id has none).  One document of each component is kept: the
    smallest id, and of its texts there the one of the lowest hash; rows that
    agree in id and text are kept or not together.  Other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_or_empty(text_col)).alias("row"))
    sketch = texts.mapInArrow(_sketcher(words, bands, rows), "id long, row long, n long, digest binary, keys array<long>")
    sketch = materialise(sketch, "sketch")
    classes = _classes(sketch)
    mine = sketch["id"].eqNullSafe(classes["rep"]) & (sketch["digest"] == classes["digest"])
    reps = sketch.join(classes.hint("shuffle_hash"), mine).select(classes["node"].alias("id"), "n", "keys")
    banded = reps.select("id", "n", F.explode(F.array_distinct("keys")).alias("key")).withColumn("n", F.col("n").cast("int"))
    centre = F.min_by(F.struct("id", "n"), F.struct(F.xxhash64("id", "key"), "id"))
    shared = banded.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), centre.alias("c")).where("lo <> hi")
    # written out, here and below, so that joins shuffle both sides and Spark can split a bucket that holds very many rows
    shared = materialise(shared.select("key", F.col("c.id").alias("centre"), F.col("c.n").alias("centre_n")), "centres")
    buckets = materialise(banded.join(shared, "key").distinct(), "buckets")

    candidates = classes.join(buckets.select(F.col("id").alias("cand")).distinct(), F.col("node") == F.col("cand"), "left_semi")
    candidates = candidates.select("node", "rep", "rep_row")
    wanted = texts.join(candidates.hint("shuffle_hash"), texts["id"].eqNullSafe(candidates["rep"]) & (texts["row"] == candidates["rep_row"]))
    sets = wanted.select(F.col("node").alias("id"), "text").mapInArrow(_set_maker(words), "id long, members array<long>").dropDuplicates(["id"])
    sets = materialise(sets, "sets")
    compared = materialise(_confirmed(_pairs(buckets, "centre", percent), sets, percent), "pairs-first")
    links = compared.where("linked").select("a", "b")
    found = components(links)

    open_rows = _open_buckets(buckets, found)
    if not open_rows.isEmpty():
        buckets = _linkable(open_rows, sets, percent)
        pairs = _hub_pairs(_open_buckets(buckets, found), links, percent).join(compared.select("a", "b"), ["a", "b"], "left_anti")
        links = links.union(materialise(_confirmed(pairs, sets, percent), "pairs-hub").where("linked").select("a", "b"))
        found = components(links)
        open_rows = _open_buckets(buckets, found)
        if not open_rows.isEmpty():
            links = links.union(materialise(_straggler_links(_clusters(open_rows, links), sets, percent), "links-last"))
            found = components(links)

    found = found.union(found.select(F.col("component").alias("id"), "component").distinct())
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "rep_row")).alias("first")  # an id comes before none
    keepers = classes.join(found, classes["node"] == found["id"]).groupBy("component").agg(first)
    members = found.join(keepers, "component").select(F.col("id").alias("member"), "first")
    classed = sketch.select("id", "row", "n", "digest").join(classes.select("digest", "node", "rep", "rep_row"), "digest", "left")
    resolved = classed.join(members, F.col("node") == F.col("member"), "left")
    empty = F.col("n") == 0
    rep = F.when(empty, F.col("id")).otherwise(F.when(F.col("first").isNull(), F.col("rep")).otherwise(F.col("first.rep")))
    rep_row = F.when(F.col("first").isNull(), F.col("rep_row")).otherwise(F.col("first.rep_row"))
    return resolved.select("id", "row", "n", rep.alias("component"), (empty | F.col("id").eqNullSafe(rep) & (F.col("row") == rep_row)).alias("kept"))


def _classes(sketch: DataFrame) -> DataFrame:
    """digest, node, rep, rep_row of each class of equal sets: its smallest id, the hash of that row's text, and the number it goes by in links.

    The number is the id, unless another class has that id too or the class has none: then it is a hash of the digest.
    """
    classes = sketch.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("low"))
    classes = materialise(classes.select("digest", "rep", F.col("low.row").alias("rep_row")), "classes")
    again = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR rep IS NULL").select(F.col("rep").alias("again"))
    named = classes.join(again, classes["rep"].eqNullSafe(again["again"]), "left_anti").withColumn("node", F.col("rep"))
    unnamed = classes.join(again, classes["rep"].eqNullSafe(again["again"]), "left_semi").withColumn("node", F.xxhash64("digest"))
    return materialise(named.unionByName(unnamed), "nodes")


def _open_buckets(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of buckets that span several components, with their component."""
    labelled = buckets.drop("component").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    spans = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    spans = materialise(spans, "open-keys")
    return materialise(labelled.join(spans, "key", "left_semi"), "open")


def _linkable(open_rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows that can have a link in an open bucket, with ``common``: how many shingles of the set another open document has.

    An intersection has ``common`` shingles at most, so a document with fewer than ``percent`` of its set in common has no link here.
    """
    ids = open_rows.select(F.col("id").alias("open_id")).distinct()
    members = sets.join(ids, F.col("id") == F.col("open_id"), "left_semi").select("id", F.explode("members").alias("member"))
    alone = members.groupBy("member").agg(F.count(F.lit(1)).alias("df"), F.first("id").alias("id")).where("df = 1")
    alone = alone.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("alone"))
    rows = open_rows.join(alone, "id", "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    return materialise(rows.where(F.col("common") * 100 >= F.col("n") * percent), "linkable")


def _hubs(open_rows: DataFrame, links: DataFrame) -> DataFrame:
    """key and the hub of each bucket: its member with the most links."""
    degree = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    ranked = open_rows.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    hubs = ranked.groupBy("key").agg(F.max_by(F.struct("id", "n", "common", "component"), F.struct("degree", F.xxhash64("id"), "id")).alias("h"))
    hubs = hubs.select("key", *[F.col(f"h.{c}").alias(h) for c, h in (("id", "hub"), ("n", "hub_n"), ("common", "hub_common"), ("component", "hub_component"))])
    return materialise(hubs, "hubs")


def _hub_pairs(open_rows: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    return _pairs(open_rows.join(_hubs(open_rows, links), "key").where("component <> hub_component"), "hub", percent)


def _clusters(open_rows: DataFrame, links: DataFrame) -> DataFrame:
    """hub, id, component: the members of all open buckets that share a hub, once each."""
    return materialise(open_rows.join(_hubs(open_rows, links), "key").select("hub", "id", "component").distinct(), "clusters")


def _straggler_links(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links a, b between a cluster's largest component, and its other members, and among these.

    Members and stragglers are dealt into chunks; a block holds one chunk of
    either and compares them in place, so only links become rows and no group
    exceeds ``2 * CHUNK`` sets or so.
    """
    sizes = clusters.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("hub")
    sizes = sizes.agg(F.max_by("component", F.struct("m", "component")).alias("largest"), F.sum("m").alias("all"), F.max("m").alias("top"))
    parts = lambda n: F.ceil(n / F.lit(CHUNK)).cast("int")
    sizes = sizes.select("hub", "largest", parts(F.col("all")).alias("m_parts"), F.greatest(F.lit(1), parts(F.col("all") - F.col("top"))).alias("s_parts"))
    sizes = materialise(sizes, "cluster-sizes")
    rows = clusters.join(sizes, "hub").join(sets, "id")
    mine = lambda n: F.array(F.pmod(F.xxhash64("id"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    member = rows.select("hub", "id", "component", F.lit(False).alias("straggler"), "members", mine("m_parts").alias("i"), every("s_parts").alias("j"))
    straggler = rows.where("component <> largest").select(
        "hub", "id", "component", F.lit(True).alias("straggler"), "members", every("m_parts").alias("i"), mine("s_parts").alias("j")
    )
    dealt = member.union(straggler).withColumn("i", F.explode("i")).withColumn("j", F.explode("j"))
    return dealt.groupBy("hub", "i", "j").applyInArrow(_block_links(percent), "a long, b long").distinct()


def _block_links(percent: int):
    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        ids, labels, late = (block[c].to_numpy() for c in ("id", "component", "straggler"))
        lists = block["members"].chunk(0) if block.num_rows else pa.array([], pa.list_(pa.int64()))
        bounds = lists.offsets.to_numpy().astype(np.int64)
        _, code = np.unique(lists.values.to_numpy()[bounds[0] : bounds[-1]], return_inverse=True)
        bounds = bounds - bounds[0]
        sizes = np.diff(bounds)
        a, b = [], []
        for s in np.flatnonzero(late):
            mark = np.zeros(len(code) + 1, dtype=np.int64)
            mark[code[bounds[s] : bounds[s + 1]]] = 1
            running = np.concatenate(([0], np.cumsum(mark[code])))
            both = running[bounds[1:]] - running[bounds[:-1]]
            good = (both * 100 >= (sizes + sizes[s] - both) * percent) & ~late & (labels != labels[s])
            a.append(np.minimum(ids[good], ids[s]))
            b.append(np.maximum(ids[good], ids[s]))
        empty = np.zeros(0, dtype=np.int64)
        return pa.table({"a": np.concatenate([empty, *a]), "b": np.concatenate([empty, *b])})

    return run


def drop_near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are kept, one of each component, with all their columns; rows that agree in id and text are one."""
    out = near_duplicates(docs, words, percent, id_col=id_col, text_col=text_col)
    return keep_rows(docs, out.where("kept").select("id", F.col("row").alias("key")), F.xxhash64(text_or_empty(docs[text_col])), id_col)


def op2_query(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(read_table(spark, sf_dir, "documents"), words=2)
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )
