"""Joins on intervals of days by equality alone: windows and days are dealt into buckets of about a window's length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_days(*windows: DataFrame) -> int:
    """The mean length in days of windows (start, end): with buckets so wide, windows lie in two buckets on average, whatever their number."""
    total = rows = 0
    for w in windows:
        r = w.where("start <= end").agg(F.sum(F.datediff("end", "start") + 1).alias("s"), F.count("*").alias("n")).first()
        total, rows = total + (r["s"] or 0), rows + r["n"]
    return max(1, -(-total // rows)) if rows else 1


def bucket_of(day: Column, width: int) -> Column:
    return F.floor(F.unix_date(day) / width)


def in_buckets(windows: DataFrame, width: int, name: str = "_bucket") -> DataFrame:
    """Each closed window (start, end) once for every bucket that it touches; empty ones and those without a start or an end go."""
    return windows.where("start <= end").withColumn(name, F.explode(F.sequence(bucket_of(F.col("start"), width), bucket_of(F.col("end"), width))))


def overlapping(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Pairs of windows of a key that share a day: the columns of a (key, start, end, ...) beside those of b, with a's start and end as _start and _end.

    Two windows meet in each bucket that both touch and count in that where the later one starts, so a pair comes
    once. The work follows the windows and the pairs found, not the product of a key's windows.
    """
    width = bucket_days(a, b)
    left = in_buckets(a, width).withColumnsRenamed({"start": "_start", "end": "_end"})
    met = left.join(in_buckets(b, width), [*key, "_bucket"]).where((F.col("_start") <= F.col("end")) & (F.col("start") <= F.col("_end")))
    return met.where(F.col("_bucket") == bucket_of(F.greatest("_start", "start"), width)).drop("_bucket")


def covering(facts: DataFrame, windows: DataFrame, key: Sequence[str], day: str, how: str = "inner", at: str = "") -> DataFrame:
    """Facts with the windows (key, start, end, ...) of their key that hold their day, start and end included; how may be left. A fact meets the windows of one bucket of days alone. Null keys match nothing.

    at: a name under which the fact's bucket stays. Rows lie by key and bucket then, so a Window.partitionBy(*key, at, ...) over what a fact met needs no second shuffle.
    """
    width = bucket_days(windows)
    placed = in_buckets(windows, width).withColumnsRenamed({c: f"_w_{c}" for c in key})
    asked = facts.withColumn("_at", bucket_of(F.col(day), width))
    rule = (F.col("_at") == F.col("_bucket")) & (F.col(day) >= F.col("start")) & (F.col(day) <= F.col("end"))
    for c in key:
        rule = rule & (F.col(c) == F.col(f"_w_{c}"))
    met = asked.join(placed, rule, how).drop("_bucket", *[f"_w_{c}" for c in key])
    return met.withColumnRenamed("_at", at) if at else met.drop("_at")
