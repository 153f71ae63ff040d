"""Connected components of an undirected graph by alternating large-star and small-star steps.

Every step is a grouped minimum and a join back, so neither the links nor the
members of a component ever meet in one task or on the driver, and a hub with
very many neighbours is split by adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleloom.llm.shared import discard, materialise


def _fingerprint(edges: DataFrame) -> tuple:
    mixed = F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mixed)).first())


def components(links: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every node that has a link; ``links`` has a and b, not null."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, "links")
    seen = _fingerprint(edges)
    while seen[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("low"))
        near = materialise(low, "low")  # so that the join shuffles both sides and Spark can split a hub's links
        large = both.join(near, both["u"] == near["node"]).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = materialise(large, "large-star")
        low = materialise(large.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")), "low")
        joined = large.join(low, large["u"] == low["node"]).where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = joined.union(low.select(F.col("node").alias("u"), F.col("low").alias("v"))).distinct()
        last, edges = edges, materialise(small, "small-star")
        discard(last, near, large, low)
        before, seen = seen, _fingerprint(edges)
        if before == seen:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
