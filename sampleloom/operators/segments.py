"""Stateful kernels over long tracks, in parallel.

A track is cut into segments of fixed length at fixed positions.  A kernel
receives a segment with real audio before and after it (the halo), long enough
that what its state remembers from farther back has decayed below rounding, so
its output does not depend on how chunks are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sampleloom.core.arrow import table
from sampleloom.core.schemas import struct

#: Of (planes, first position of planes, from, to): planes hold the halo, [from, to) is the segment's own part of the track.
Kernel = Callable[[np.ndarray, int, int, int], Iterable[dict]]


def map_segments(chunks: DataFrame, frames: int, before: int, after: int, kernel: Kernel, out: str, keys: tuple[str, ...] = ("source_id", "track_id")) -> DataFrame:
    """Run ``kernel`` on every segment of ``frames`` frames; its rows get the keys in front. ``out`` is the DDL of its rows.

    A chunk goes to the segments it lies in or is a halo of, usually one.
    Positions without a chunk inside a segment are silent.
    """
    n = F.size(F.get("pcm", F.lit(0)))
    lo, hi = F.floor((F.col("pos") - after) / frames), F.floor((F.col("pos") + n - 1 + before) / frames)
    rows = chunks.where(n > 0).select(*keys, "pos", "pcm", F.explode(F.sequence(F.greatest(lo, F.lit(0)), hi)).alias("segment"))
    kinds = ", ".join(f"`{k}` {t}" for k, t in chunks.select(*keys).dtypes)
    schema = f"{kinds}, {out}"
    arrow = to_arrow_schema(struct(schema))  # parsed here: workers have no session

    def run(key: tuple, group: pa.Table) -> pa.Table:
        segment = key[-1].as_py()
        pos = group["pos"].to_numpy()
        order = np.argsort(pos, kind="stable")
        parts = [group["pcm"][int(k)].values for k in order]
        planes = [np.array([c.values.to_numpy(zero_copy_only=False) for c in p], dtype=np.float32) for p in parts]
        start = max(segment * frames - before, 0)
        end = min((segment + 1) * frames + after, int(max(p + x.shape[1] for p, x in zip(pos[order], planes, strict=True))))
        whole = np.zeros((planes[0].shape[0], max(end - start, 0)), dtype=np.float32)
        for p, x in zip(pos[order], planes, strict=True):
            a, b = max(p, start), min(p + x.shape[1], end)
            if b > a:
                whole[:, a - start : b - start] = x[:, a - p : b - p]
        own = min((segment + 1) * frames, end)
        found = list(kernel(whole, start, segment * frames, own)) if own > segment * frames else []
        names = [k.as_py() for k in key[:-1]]
        return table([dict(zip(keys, names, strict=True)) | r for r in found], arrow)

    return rows.groupBy(*keys, "segment").applyInArrow(run, schema)
