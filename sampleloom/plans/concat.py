"""Running a timeline: members' chunks placed end to end, neighbours blended where they overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.plans.timeline import boundaries

_OUT = "pos bigint, n int, discont boolean, pcm array<array<float>>"
_CHUNK = 4096


def _blended(group: pa.Table, length: int) -> np.ndarray:
    """channels x length of an equal-power crossfade; parts of the outgoing member have ``late`` set."""
    channels = len(group["pcm"][0].as_py())
    sides = np.zeros((2, channels, length))
    for row in group.select(["late", "at", "pcm"]).to_pylist():
        x = np.array(row["pcm"], dtype=np.float32).reshape(channels, -1)
        sides[int(row["late"]), :, row["at"] : row["at"] + x.shape[1]] = x
    angle = np.arange(length) * (np.pi / 2 / length)
    return (sides[1] * np.cos(angle) + sides[0] * np.sin(angle)).astype(np.float32)


def concat(chunks: DataFrame, members: DataFrame, keys: list[str], crossfade: int = 0) -> DataFrame:
    """keys and chunks of each timeline.

    ``members`` has keys, idx, source_id, from_sample and to_sample: the part of
    a source that plays.  With a crossfade, only the zones where two members
    overlap are brought together, each in a group of its own; everything else
    moves to its place row by row.  A timeline of N members delivers the sum of
    their lengths less N - 1 crossfades.
    """
    placed = boundaries(members.withColumn("len", F.col("to_sample") - F.col("from_sample")), keys, crossfade)
    order = Window.partitionBy(*keys).orderBy("idx")
    placed = placed.withColumn("nth", F.row_number().over(order) - 1).withColumn("last", F.lead("idx").over(order).isNull())
    rows = chunks.select("source_id", F.col("pos").alias("p"), F.col("n").cast("long").alias("m"), "pcm").join(placed, "source_id")
    begin, end = F.greatest(F.col("p"), F.col("from_sample")), F.least(F.col("p") + F.col("m"), F.col("to_sample"))
    rows = rows.withColumn("a", begin - F.col("from_sample")).withColumn("b", end - F.col("from_sample")).where("b > a")
    fade = F.lit(crossfade).cast("long")
    zero = F.lit(0).cast("long")
    head = F.when(F.col("nth") > 0, fade).otherwise(zero)
    tail = F.when(F.col("last"), F.col("len")).otherwise(F.col("len") - fade)
    part = lambda kind, lo, hi: F.struct(F.lit(kind).alias("kind"), F.greatest(F.col("a"), lo).alias("lo"), F.least(F.col("b"), hi).alias("hi"))
    parts = F.filter(F.array(part(0, zero, head), part(1, head, tail), part(2, tail, F.col("len"))), lambda s: s["hi"] > s["lo"])
    rows = rows.withColumn("part", F.explode(parts))
    rows = rows.withColumn("skip", (F.col("part.lo") + F.col("from_sample") - F.col("p") + 1).cast("int")).withColumn("take", (F.col("part.hi") - F.col("part.lo")).cast("int"))
    rows = rows.withColumn("pcm", F.transform("pcm", lambda ch: F.slice(ch, F.col("skip"), F.col("take"))))
    body = rows.where("part.kind = 1").select(*keys, (F.col("offset") + F.col("part.lo")).alias("pos"), F.col("take").alias("n"), F.lit(False).alias("discont"), "pcm")
    if not crossfade:
        return body
    late = F.col("part.kind") == 2
    start = F.when(late, F.col("len") - fade).otherwise(zero)
    zones = rows.where("part.kind <> 1").select(
        *keys, (F.col("offset") + start).alias("zone"), late.alias("late"), (F.col("part.lo") - start).cast("int").alias("at"), "pcm"
    )
    kinds = ", ".join(f"`{k}` {t}" for k, t in zones.select(*keys).dtypes)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        y, zone = _blended(group, crossfade), key[-1].as_py()
        cuts = range(0, crossfade, _CHUNK)
        out = {k: pa.array([v.as_py()] * len(cuts), v.type) for k, v in zip(keys, key, strict=False)}
        out |= {"pos": pa.array([zone + a for a in cuts], pa.int64()), "n": pa.array([min(_CHUNK, crossfade - a) for a in cuts], pa.int32()), "discont": pa.array([False] * len(cuts))}
        out["pcm"] = pa.array([y[:, a : a + _CHUNK].tolist() for a in cuts], pa.list_(pa.list_(pa.float32())))
        return pa.table(out)

    return body.unionByName(zones.groupBy(*keys, "zone").applyInArrow(run, f"{kinds}, {_OUT}"))
