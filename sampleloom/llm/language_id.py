"""Language identification by the nearest of several centroids per language.

A text is lower-cased, its runs of other characters than letters become single
spaces, and it is the vector of its byte n-grams (one to three bytes, hashed to DIMS
dimensions), with dampened counts, inverse document frequencies and unit length.
Document frequencies cover all training documents.  The centroids of each
language come from spherical k-means on a bounded sample of its training
documents (``fit_docs`` in all).  The nearest centroid by cosine gives the
language; a text much farther from it than all but the outliers of the sample is
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleloom.llm.shared import read_table
from sampleloom.llm.text_arrays import row_slices, text_buffers

DIMS = 4096
ORDERS = (1, 2, 3)
FIT_DOCS = 2400
CENTROIDS = 4
ROUNDS = 8
#: A limit per label is broadcast up to so many labels.
BROADCAST_LABELS = 10_000
#: A text is rejected below this part of a low quantile of the cosines of the language's sample.
REJECT_BELOW, OUTLIERS = 0.4, 0.01
UNKNOWN = "und"

def gram_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """First row and the counts of hashed n-grams (rows x DIMS) of runs of rows."""
    column = pc.replace_substring_regex(pc.utf8_lower(column), r"[^\p{L}\p{M}]+", " ")
    offsets, data = text_buffers(column)
    for lo, hi in row_slices(offsets):
        for a in range(lo, hi, 128):
            b = min(a + 128, hi)
            text = data[offsets[a] : offsets[b]].astype(np.uint32)
            at = offsets[a : b + 1] - offsets[a]
            row = np.repeat(np.arange(b - a), np.diff(at))
            stop = at[1:][row] if len(row) else row
            counts = np.zeros((b - a) * DIMS, dtype=np.int64)
            gram = np.zeros(len(text), dtype=np.uint32)
            for order in range(1, max(ORDERS) + 1):
                gram = gram[: len(text) - order + 1] * np.uint32(257) + text[order - 1 :] + np.uint32(1)
                if order in ORDERS and len(gram):
                    place = ((gram * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
                    whole = np.arange(len(gram)) + order <= stop[: len(gram)]
                    counts += np.bincount((row[: len(gram)] * DIMS + place)[whole], minlength=len(counts))
            yield a, counts.reshape(b - a, DIMS)


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (np.log1p(counts) * idf).astype(np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIMS, dtype=np.int64), 0
    for batch in batches:
        for _, counts in gram_counts(batch.column(0)):
            df += (counts > 0).sum(axis=0)
            n += len(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(np.append(df, n))], names=["dim", "df"])


def _vectors(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, counts in gram_counts(batch.column(2)):
                v = unit_vectors(counts, idf)
                part = batch.slice(at, len(counts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in v], pa.binary())], names=["key", "lang", "vector"])

    return run


def spherical_kmeans(v: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, float]:
    """Unit centroids, started from the mean and then the vectors farthest from those chosen, and the OUTLIERS quantile of the cosines of vectors to their own."""
    chosen = [v.mean(axis=0)]
    while len(chosen) < min(k, len(v)):
        chosen.append(v[int(np.argmin((v @ np.array(chosen).T).max(axis=1)))])
    c = np.array(chosen)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        mine = (v @ c.T).argmax(axis=1)
        c = np.array([v[mine == j].mean(axis=0) if (mine == j).any() else c[j] for j in range(len(c))])
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32), float(np.quantile((v @ c.T).max(axis=1), OUTLIERS))


class Model:
    """Labels, centroids (one row each), the label of each, the floor of each label, and the weights of the dimensions."""

    def __init__(self, labels: list[str], centroids: np.ndarray, owner: np.ndarray, floors: np.ndarray, idf: np.ndarray):
        self.labels, self.centroids, self.owner, self.floors, self.idf = labels, centroids, owner, floors, idf

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Label, cosine and rejection of every text."""
        letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        best, score = np.full(len(column), -1), np.zeros(len(column))
        if self.labels:
            for at, counts in gram_counts(column):
                cos = unit_vectors(counts, self.idf) @ self.centroids.T
                nearest = cos.argmax(axis=1)
                best[at : at + len(counts)] = self.owner[nearest]
                score[at : at + len(counts)] = np.clip(cos[np.arange(len(cos)), nearest], 0, 1)
        best[~letters] = -1
        score[best < 0] = 0
        rejected = (best < 0) | (score < (self.floors[best] if self.labels else 1))
        return [self.labels[b] if b >= 0 else UNKNOWN for b in best], score, rejected


def fit(train: DataFrame, fit_docs: int = FIT_DOCS, centroids: int = CENTROIDS, rounds: int = ROUNDS) -> Model:
    """A model from ``train(key, lang, text)``; rows without a language or a letter teach nothing.

    The sample takes from each language the documents of the lowest key hashes,
    by a threshold that lets through ``fit_docs`` over all languages (a few more
    or less).  It is what the driver receives, with the sums of frequencies.
    """
    train = train.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = sorted(sizes)
    if not labels:
        return Model([], np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros(0), np.ones(DIMS))
    sums = train.select("text").mapInArrow(_frequencies, "dim long, df long").groupBy("dim").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(DIMS + 1)
    for r in sums:
        df[r["dim"]] = r["df"]
    idf = np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 1
    grid, share = 1 << 30, max(1, fit_docs // len(labels))
    limits = train.sparkSession.createDataFrame([(x, min(grid, -(-share * grid // sizes[x]))) for x in labels], "lang string, upto long")
    limits = F.broadcast(limits) if len(labels) <= BROADCAST_LABELS else limits
    chosen = train.join(limits, "lang").where(F.pmod(F.xxhash64("key"), F.lit(grid)) < F.col("upto")).select("key", "lang", "text")
    rows = chosen.mapInArrow(_vectors(idf), "key long, lang string, vector binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["key"] is not None, r["key"] or 0, r["vector"]))
    parts, owner, floors = [], [], []
    for k, label in enumerate(labels):
        own = [np.frombuffer(r["vector"], dtype=np.float32) for r in rows if r["lang"] == label]
        if own:
            c, low = spherical_kmeans(np.array(own), centroids, rounds)
            parts.append(c)
            owner += [k] * len(c)
        floors.append(REJECT_BELOW * low if own else 1.0)
    return Model(labels, np.concatenate(parts) if parts else np.zeros((0, DIMS), np.float32), np.array(owner), np.array(floors), idf)


def held_out_column(id_col: str, parts: int):
    """True where crc32 of the id as text leaves 2; a row without an id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == 2, F.lit(False))


def _labelling(model: Model):
    schema = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = model.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], schema=schema)

    return run


def _keeping(model: Model, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~model.predict(batch.column(text_at))[2]))

    return run


def train_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    rows = docs.where(~held_out_column(id_col, 4))
    return rows.select(F.col(id_col).cast("long").alias("key"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, rejected of every row.

    A null text or one without a letter is ``und`` with score 0 and rejected.
    Ties go to the label that sorts first.  A model without labels calls all
    ``und``.  Rows are independent; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_labelling(model), "id long, lang_pred string, score double, rejected boolean")


def drop_unidentified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    return docs.mapInArrow(_keeping(model, docs.columns.index(text_col)), docs.schema)


def op7_query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(train_rows(docs))
    out = identify(docs, model)
    return out.select(F.col("id").alias("doc_id"), held_out_column("id", 4).alias("held_out"), "lang_pred", "score", "rejected")
