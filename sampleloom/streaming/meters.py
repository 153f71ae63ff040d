"""Meters over unbounded tracks: windowed energy with a watermark, and silence runs with state per track."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RUNS = "track string, from_sample bigint, to_sample bigint"
_STATE = "pos bigint, run_from bigint"


def windowed_energy(levels: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Energy per track and time window of a stream of (track, ts, value); rows later than ``late`` are dropped."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = levels.withWatermark("ts", late).groupBy("track", window.alias("w"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * F.col("value")).alias("energy")).select("track", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "energy")


def sessions(levels: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    out = levels.withWatermark("ts", late).groupBy("track", F.session_window("ts", gap).alias("w"))
    return out.agg(F.count(F.lit(1)).alias("n")).select("track", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def silence_runs(chunks: DataFrame, threshold: float, min_frames: int) -> DataFrame:
    """Quiet runs of streams of (track, pos, peaks array<float>): a run is emitted when a loud frame ends it.

    The state of a track is two numbers, however long its run: where it has got
    to, and where the open run began (-1: none).  Chunks of one batch are put
    in order; a gap in positions ends a run.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pos, run = state.get if state.exists else (-1, -1)
        out = []

        def close(at: int) -> None:
            if run >= 0 and at - run >= min_frames:
                out.append((key[0], run, at))

        rows = pd.concat(list(batches)).sort_values("pos")
        for start, peaks in zip(rows["pos"], rows["peaks"], strict=True):
            if run >= 0 and start != pos:
                close(pos)
                run = -1
            for k, peak in enumerate(peaks):
                if peak < threshold:
                    run = start + k if run < 0 else run
                elif run >= 0:
                    close(start + k)
                    run = -1
            pos = start + len(peaks)
        state.update((int(pos), int(run)))
        yield pd.DataFrame(out, columns=["track", "from_sample", "to_sample"])

    return chunks.groupBy("track").applyInPandasWithState(step, RUNS, _STATE, "append", GroupStateTimeout.NoTimeout)
