"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asoflow.llm.store import sorted_merge, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every node that has an edge.

    edges: columns a and b (long). Returns id, component. Alternates the large-star and
    small-star steps until the edges stop changing; each round is one shuffle by node, its
    output is linear in the edges and it is written to the shared folder. Loops, repeated
    edges and null ends are allowed; a null end is ignored, and an empty input gives no rows.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(sorted_merge(least), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.where("m < u").select("u", F.col("m").alias("v"))
        ).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sorted_merge(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))
        ).distinct()
        now = stored(small)
        after = _mark(now)
        if after == mark:
            break
        mark = after
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
    return tuple(row)
