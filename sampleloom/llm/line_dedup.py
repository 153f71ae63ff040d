"""Line deduplication with DataFrame functions only.

Lines are exploded with their position, normalised and hashed to 128 bits.  A
key is repeated when enough documents hold it; its lines go everywhere but in
the document with the smallest id.  Only hashes and ids are shuffled for the
count and for the lookup; texts move once, when each document meets the list
of positions it loses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleloom.llm.shared import ASCII_SPACE, ascii_lower, materialise, read_table, text_or_empty

MIN_POINTS = 10
MIN_DOCS = 2


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def drop_repeated_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_points: int = MIN_POINTS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, text (lines that stay), n_lines, n_dropped.

    A line is repeated when its key has ``min_points`` code points or more and
    ``min_docs`` documents or more hold it.  Null text counts as one empty line,
    and a document may lose all its lines (its text is then empty).  Repetition
    inside one document alone drops nothing.  Rows that repeat an id are holders
    by that one id, but each row loses its own lines only.  Rows without an id are
    never the first holder and count as one document together.  Other columns
    are not read.
    """
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    base = base.withColumn("row", F.xxhash64("text"))  # with the id, this names a row; rows that agree in both lose the same
    lines = F.transform(F.split("text", "\n", -1), line_key)
    exploded = base.select("id", "row", F.posexplode(lines).alias("pos", "key")).where(F.length("key") >= min_points)
    hashed = exploded.select("id", "row", "pos", _hashed(F.col("key")).alias("h")).select("id", "row", "pos", "h.h1", "h.h2")
    if min_docs == 2:
        held = hashed.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max(F.col("id").isNull()).alias("no_id"))
        repeated = held.where((F.col("first_id") != F.col("last_id")) | (F.col("no_id") & F.col("first_id").isNotNull()))
    else:
        held = hashed.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one")).groupBy("h1", "h2")
        repeated = held.agg(F.min("id").alias("first_id"), F.sum("one").alias("n")).where(F.col("n") >= min_docs)
    # written out, so that the join shuffles both sides and Spark can split the rows of a line that very many documents hold
    repeated = materialise(repeated.select("h1", "h2", "first_id"), "repeated-lines")
    losses = (
        hashed.join(repeated, ["h1", "h2"])
        .where(~F.col("id").eqNullSafe(F.col("first_id")))
        .groupBy(F.col("id").alias("loser"), F.col("row").alias("loser_row"))
        .agg(F.collect_set("pos").alias("lost"))
    )
    joined = base.join(losses.hint("shuffle_hash"), base["id"].eqNullSafe(losses["loser"]) & (base["row"] == losses["loser_row"]), "left")
    # explode() of a single array makes the parts a column; inside transform() the split would run once per line
    parted = joined.select("id", "text", "lost", F.explode(F.array(F.split("text", "\n", -1))).alias("parts"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "lost")
    return parted.select(
        "id",
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda p: F.get("parts", p)), "\n")).alias("text"),
        F.size("parts").cast("long").alias("n_lines"),
        F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_dropped"),
    )


def op3_query(spark, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), held AS (
  SELECT key, min(doc_id) AS first_id FROM keyed
  WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.doc_id, k.pos, k.line, h.first_id IS NOT NULL AND k.doc_id <> h.first_id AS lost
  FROM keyed k LEFT JOIN held h USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
