"""Versioned observations from a partitioned source: rules of the history, captures and reads of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: columns of a record, besides the grain
FACT = ("row_id", "observation_id", "version", "grain", "units", "available")


def observation_violations(batch: DataFrame, before: DataFrame) -> DataFrame:
    """What a batch breaks of the rules of a history, given what is there: partition, offset, reason.

    Records hold partition, offset, event_id, row_id, observation_id, version, grain, units and available. Per partition
    offsets follow one another (offset_gap); a record again at its offset must be the same
    (receipt_mismatch). Over all partitions an event id has one content (event_collision), an
    observation's version one row (version_collision), a row id one version (row_collision), a grain one
    observation (grain_collision) and an observation one grain (grain_changed), and of two versions that
    follow one another the later isn't available before the earlier (availability_regression).
    The records of a key meet in a window of that key; a record is reported once for each rule it breaks.
    """
    body = F.sha2(F.to_json(F.struct("event_id", *FACT)), 256)
    rows = batch.withColumn("_new", F.lit(True)).unionByName(before.withColumn("_new", F.lit(False))).withColumns({"_body": body, "_fact": F.sha2(F.to_json(F.struct(*FACT)), 256)})
    order = ["_new", "partition", "offset"]

    def broken(keys: Sequence[str], value: str, reason: str) -> DataFrame:
        """Records whose value differs from that of the first record of their keys."""
        first = F.first(value).over(Window.partitionBy(*keys).orderBy(*order))
        return rows.withColumn("_f", first).where(F.col("_new") & ~F.col(value).eqNullSafe(F.col("_f"))).select("partition", "offset", F.lit(reason).alias("reason"))

    place = Window.partitionBy("partition").orderBy("offset")
    offsets = rows.groupBy("partition", "offset").agg(F.min("_new").alias("_new"))
    gaps = offsets.withColumn("_due", F.coalesce(F.lag("offset").over(place) + 1, F.lit(0))).where(F.col("_new") & (F.col("offset") != F.col("_due"))).select("partition", "offset", F.lit("offset_gap").alias("reason"))
    chain = Window.partitionBy("observation_id").orderBy("version", *order)
    ahead = rows.withColumns({"_v": F.lag("version").over(chain), "_a": F.lag("available").over(chain), "_n": F.lag("_new").over(chain)})
    back = ahead.where((F.col("version") == F.col("_v") + 1) & (F.col("available") < F.col("_a")) & (F.col("_new") | F.col("_n"))).select("partition", "offset", F.lit("availability_regression").alias("reason"))
    found = [
        gaps, broken(["partition", "offset"], "_body", "receipt_mismatch"), broken(["event_id"], "_body", "event_collision"), broken(["observation_id", "version"], "_fact", "version_collision"),
        broken(["row_id"], "version", "row_collision"), broken(["grain"], "observation_id", "grain_collision"), broken(["observation_id"], "grain", "grain_changed"), back,
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def boundaries(history: DataFrame) -> DataFrame:
    """The next offset of each partition."""
    return history.groupBy("partition").agg((F.max("offset") + 1).alias("next_offset"))


def captured(history: DataFrame, path: str) -> None:
    """Write a history's rows and its boundaries side by side; a reader can so tell whether it has them all."""
    history.write.mode("overwrite").parquet(f"{path}/rows")
    boundaries(history).write.mode("overwrite").parquet(f"{path}/boundaries")


def restored(spark, path: str) -> DataFrame:
    """A captured history; an error unless its rows reach exactly to its boundaries, without gaps."""
    rows, told = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/boundaries")
    there = rows.groupBy("partition").agg((F.max("offset") + 1).alias("_next"), F.count_distinct("offset").alias("_n"))
    off = told.join(there, "partition", "full").where(~F.col("next_offset").eqNullSafe(F.col("_next")) | (F.col("_n") != F.col("_next")))
    if not off.isEmpty():
        raise ValueError("the capture isn't whole")
    return rows


def history_as_of(history: DataFrame, origin: Column) -> DataFrame:
    """The highest version of each grain that was available at the origin."""
    seen = history.where(F.col("available") <= origin)
    return seen.groupBy("grain").agg(F.max("version").alias("version"), F.max_by("units", "version").alias("units"))


def quantity_total(latest: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Sum of units; unknown (null) with status unknown_quantity if any is."""
    known = F.count("*") == F.count("units")
    return latest.groupBy(*group).agg(F.count("*").alias("n"), F.when(known, F.sum("units")).alias("total"), F.when(known, "known").otherwise("unknown_quantity").alias("status"))
