"""Replay of a capture as windows over offsets: the batch twin of the stream in asoflow.streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classify_deliveries(df: DataFrame, event_id: str = "event_id", business: str = "grain", body: str = "body", offset: str = "offset") -> DataFrame:
    """status of each delivery: accepted, duplicate_event, event_conflict, duplicate_business or business_conflict. The first delivery of an id counts, and the first accepted one of a business key. Keys are events and business keys: no window spans the capture."""
    by_id = Window.partitionBy(event_id).orderBy(offset)
    seen = df.withColumns({"_k": F.row_number().over(by_id), "_first": F.first(body).over(by_id)})
    repeat = F.when(F.col("_k") > 1, F.when(F.col(body) == F.col("_first"), "duplicate_event").otherwise("event_conflict"))
    seen = seen.withColumn("_repeat", repeat)
    fresh = Window.partitionBy(business, F.col("_repeat").isNull()).orderBy(offset)
    seen = seen.withColumns({"_b": F.row_number().over(fresh), "_bfirst": F.first("value").over(fresh)})
    again = F.when(F.col("_b") > 1, F.when(F.col("value") == F.col("_bfirst"), "duplicate_business").otherwise("business_conflict"))
    return seen.withColumn("status", F.coalesce("_repeat", again, F.lit("accepted"))).drop("_k", "_first", "_repeat", "_b", "_bfirst")


def timing_status(df: DataFrame, partition: Sequence[str], event_time: str, watermark: str, offset: str = "offset") -> DataFrame:
    """late: at or before the watermark declared so far; out_of_order: before an earlier delivery's time; else on_time. Order is per capture partition."""
    before = Window.partitionBy(*partition).orderBy(offset).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*partition).orderBy(offset).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    status = F.when(F.to_date(event_time) <= F.max(watermark).over(upto), "late").when(F.col(event_time) < F.max(event_time).over(before), "out_of_order").otherwise("on_time")
    return df.withColumn("timing", status)


def aggregate_revisions(accepted: DataFrame, grain: Sequence[str], value: str, offset: str = "offset") -> DataFrame:
    """After every accepted fact a new revision of its grain: number, count and sum so far, and the revision before."""
    w = Window.partitionBy(*grain).orderBy(offset).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return accepted.withColumns(
        {"revision": F.count("*").over(w), "total": F.sum(value).over(w), "previous_offset": F.lag(offset).over(Window.partitionBy(*grain).orderBy(offset))}
    )


def aggregates_as_of(revisions: DataFrame, grain: Sequence[str], cutoff: Column, known: str) -> DataFrame:
    """Latest revision of each grain that was known at the cutoff."""
    seen = revisions.where(F.col(known) <= cutoff)
    return seen.groupBy(*grain).agg(F.max("revision").alias("revision"), F.max_by("total", "revision").alias("total"))


def accounting(df: DataFrame) -> DataFrame:
    """Deliveries by status, and whether they add up."""
    counts = df.agg(F.count("*").alias("delivered"), *[F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "duplicate_event", "event_conflict", "duplicate_business", "business_conflict")])
    return counts.withColumn("balanced", F.expr("delivered = accepted + duplicate_event + event_conflict + duplicate_business + business_conflict"))


def day_gate(declared: DataFrame, facts: DataFrame, quarantined: DataFrame, key: Sequence[str], as_of: Column) -> DataFrame:
    """Status of each declared day from what was known: no_declaration, quarantined, missing_facts, else qualified.

    declared: key, expected, known. facts and quarantined: key, known. Rows for every key of any.
    """
    d = declared.where(F.col("known") <= as_of).groupBy(*key).agg(F.max("expected").alias("expected"))
    f = facts.where(F.col("known") <= as_of).groupBy(*key).agg(F.count("*").alias("n_facts"))
    q = quarantined.where(F.col("known") <= as_of).groupBy(*key).agg(F.count("*").alias("n_quarantined"))
    all_ = d.join(f, list(key), "full").join(q, list(key), "full").fillna(0, ["n_facts", "n_quarantined"])
    status = F.when(F.col("expected").isNull(), "no_declaration").when(F.col("n_quarantined") > 0, "quarantined").when(F.col("n_facts") < F.col("expected"), "missing_facts").otherwise("qualified")
    return all_.withColumn("status", status)
