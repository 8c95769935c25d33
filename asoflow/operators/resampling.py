"""Cluster bootstrap with a fixed number of draws: an exact multinomial over clusters that no task holds whole."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asoflow.sources.scratch import written

_BITS = 8  # of the hash that a level splits by
_BUCKET = 2048  # clusters of one bucket, about


def _dealt(counts: DataFrame, draws: DataFrame, seed: int, level: int) -> DataFrame:
    """Draws (rep, prefix, m) split over the prefixes one level down, in proportion to their clusters: a multinomial, which is one binomial after another."""
    children = counts.groupBy((F.shiftrightunsigned("prefix", _BITS) if level > 1 else F.lit(0).cast("long")).alias("prefix")).agg(F.sort_array(F.collect_list(F.struct(F.col("prefix").alias("child"), "c"))).alias("parts"))  # 256 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for rep, prefix, m, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = np.array([p["c"] for p in parts], float)
                rng = np.random.default_rng([seed, level, rep, prefix & ((1 << 63) - 1)])
                out += [(rep, p["child"], int(k)) for p, k in zip(parts, rng.multinomial(m, c / c.sum()), strict=True) if k]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64()))], ["rep", "prefix", "m"])

    return draws.join(children, "prefix").select("rep", "prefix", "m", "parts").mapInArrow(run, "rep long, prefix long, m long")


def bootstrap_replicates(clusters: DataFrame, key: Sequence[str], sums: Sequence[str], replicates: int, seed: int = 42) -> DataFrame:
    """For each replicate the sums over as many clusters, drawn with replacement, as there are: rep, draws, one column for each of sums.

    clusters: one row for each. Their hashes are cut into ranges; a replicate's draws are split over the ranges by
    counts, level by level, until a range holds about 2,000 clusters, and there over the clusters. So the multiplicities of a
    replicate are those of independent draws and add up to the number of clusters. All replicates go down in the same
    passes; a task holds one range of clusters and its draws. The draws follow from seed, replicate and range, so a rerun agrees.
    """
    rows = written(clusters.select(*key, *[F.col(s).cast("double").alias(s) for s in sums], F.xxhash64(*key).alias("h")))
    total = rows.count()
    levels = 1
    while total > _BUCKET << (_BITS * levels):
        levels += 1
    draws = rows.sparkSession.range(1, replicates + 1).select(F.col("id").alias("rep"), F.lit(0).cast("long").alias("prefix"), F.lit(total).cast("long").alias("m"))
    for level in range(1, levels + 1):
        counts = rows.groupBy(F.shiftrightunsigned("h", 64 - _BITS * level).alias("prefix")).agg(F.count("*").alias("c"))
        draws = written(_dealt(counts, draws, seed, level))

    def draw(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if own.empty or asked.empty:
            return pd.DataFrame(columns=["rep", "draws", *sums])
        own, asked = own.sort_values(["h", *key]), asked.sort_values("rep")
        prefix = int(asked["prefix"].iloc[0]) & ((1 << 63) - 1)
        even, values = np.full(len(own), 1 / len(own)), own[list(sums)].to_numpy(float)
        found = [np.random.default_rng([seed, 0, int(rep), prefix]).multinomial(int(m), even) @ values for rep, m in zip(asked["rep"], asked["m"], strict=True)]
        return pd.DataFrame(found, columns=list(sums)).assign(rep=asked["rep"].to_numpy(), draws=asked["m"].to_numpy())[["rep", "draws", *sums]]

    placed = rows.withColumn("prefix", F.shiftrightunsigned("h", 64 - _BITS * levels))
    schema = "rep long, draws long, " + ", ".join(f"`{s}` double" for s in sums)
    parts = placed.groupBy("prefix").cogroup(draws.groupBy("prefix")).applyInPandas(draw, schema)
    return parts.groupBy("rep").agg(F.sum("draws").alias("draws"), *[F.sum(s).alias(s) for s in sums])


def exact_cluster_bootstrap(cells: DataFrame, cluster: Sequence[str], numerator: str, denominator: str, replicates: int, coverage: float = 0.95, min_clusters: int = 10, seed: int = 42) -> DataFrame:
    """Interval of a ratio of sums when whole clusters are drawn with replacement, as many as there are.

    One row: estimate, low, high (linear percentiles of the replicates' ratios), clusters, valid (replicates whose
    denominator isn't 0), least_draws and most_draws of a replicate. The interval is null with fewer than min_clusters
    or any replicate without a ratio.
    """
    sums = cells.groupBy(*cluster).agg(F.sum(numerator).alias("a"), F.sum(denominator).alias("b"))
    whole = sums.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("clusters"))
    reps = bootstrap_replicates(sums.fillna(0.0, ["a", "b"]), cluster, ["a", "b"], replicates, seed).withColumn("ratio", F.when(F.col("b") != 0, F.col("a") / F.col("b")))
    tail = (1 - coverage) / 2
    limits = reps.agg(F.percentile("ratio", tail).alias("low"), F.percentile("ratio", 1 - tail).alias("high"), F.count("ratio").alias("valid"), F.min("draws").alias("least_draws"), F.max("draws").alias("most_draws"))
    ok = (F.col("clusters") >= min_clusters) & (F.col("valid") == replicates)
    return whole.crossJoin(limits).select(F.round(F.try_divide("a", "b"), 6).alias("estimate"), F.when(ok, F.col("low")).alias("low"), F.when(ok, F.col("high")).alias("high"), "clusters", "valid", "least_draws", "most_draws")  # one row each
