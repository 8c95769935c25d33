"""Point-in-time reads over versioned and effective-dated facts.

A read names a clock; only facts available by then count, and of those the highest version.
Two rows of the same highest version are an ambiguity, which is reported, never resolved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_version(df: DataFrame, key: Sequence[str], version: str = "version") -> DataFrame:
    """Rows of each key's highest version, with ambiguous: whether there are several."""
    by = Window.partitionBy(*key)
    ranked = df.withColumn("_rank", F.rank().over(by.orderBy(F.desc(version)))).where("_rank = 1").drop("_rank")
    return ranked.withColumn("ambiguous", F.count("*").over(by) > 1)


def asof_read(df: DataFrame, origin: Column, key: Sequence[str], version: str = "version", available: str = "available") -> DataFrame:
    """The highest version of each key that was available at the origin."""
    return latest_version(df.where(F.col(available) <= origin), key, version)


def asof_multi(df: DataFrame, origins: DataFrame, key: Sequence[str], origin: str = "origin", version: str = "version", available: str = "available") -> DataFrame:
    """asof_read for a whole table of origins at once.

    A key's rows become intervals of availability: a row is what a reader sees from its
    availability until a row of a higher version is available. Both ends come from windows over the
    key, so late lower versions (available after a higher one) get an empty interval; the origins
    are few and meet the intervals by range.
    """
    by = Window.partitionBy(*key).orderBy(F.desc(version)).rowsBetween(Window.unboundedPreceding, -1)
    # rank ties share a version: they must not close each other's interval
    closed = df.withColumn("_until", F.min(F.struct(F.col(available))).over(by)[available])
    same = Window.partitionBy(*key, version)
    closed = closed.withColumn("_until", F.max("_until").over(same)).withColumn("ambiguous", F.count("*").over(same) > 1)
    seen = closed.where(F.col("_until").isNull() | (F.col("_until") > F.col(available)))
    return seen.join(origins, (F.col(available) <= F.col(origin)) & (F.col("_until").isNull() | (F.col("_until") > F.col(origin)))).drop("_until")


def effective_mapping(facts: DataFrame, plans: DataFrame, on: Sequence[str], day: str, origin: Column, fact_key: Sequence[str], from_col: str = "from_day", to_col: str = "to_day", available: str = "known", version: str = "version") -> DataFrame:
    """Each fact with the plan in force on its day as far as known at the origin: highest version, with status mapped, missing or ambiguous.

    Facts meet the plans of their bucket of days (see intervals), not all versions of their key, and are ranked where they met. A fact_key names a fact, with its key and day.
    """
    from asoflow.operators.intervals import covering

    held = plans.select(*on, F.col(from_col).alias("start"), F.date_sub(to_col, 1).alias("end"), *[F.col(c).alias(f"_p_{c}") for c in plans.columns if c not in on])
    asked = facts.withColumn("_origin", origin)
    joined = covering(asked, held, on, day, "left", at="_met").drop("start", "end")
    seen = F.coalesce(F.col(f"_p_{available}") <= F.col("_origin"), F.lit(False))
    plan = [c for c in joined.columns if c.startswith("_p_")]
    joined = joined.withColumns({c: F.when(seen, F.col(c)) for c in plan}).withColumn("_seen", seen)
    by = Window.partitionBy(*on, "_met", *[c for c in fact_key if c not in on])
    best = joined.withColumn("_rank", F.rank().over(by.orderBy(F.desc("_seen"), F.desc_nulls_last(f"_p_{version}")))).where("_rank = 1")
    best = best.withColumns({"_n": F.count("*").over(by), "_k": F.row_number().over(by.orderBy(F.lit(1)))}).where("_seen or _k = 1")
    status = F.when(~F.col("_seen") | F.col(f"_p_{version}").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").otherwise("mapped")
    return best.withColumn("status", status).drop("_rank", "_n", "_k", "_seen", "_origin", "_met")


def version_chain_violations(df: DataFrame, key: Sequence[str], version: str = "version", available: str = "available") -> DataFrame:
    """Breaks of a version chain: a version that doesn't follow its predecessor by one (the first is 1), or that was available before it."""
    by = Window.partitionBy(*key).orderBy(version)
    chained = df.withColumns({"_v": F.lag(version).over(by), "_a": F.lag(available).over(by)})
    reason = F.when(F.col(version) != F.coalesce(F.col("_v") + 1, F.lit(1)), "version_gap").when(F.col(available) < F.col("_a"), "availability_regression")
    return chained.withColumn("reason", reason).where("reason is not null").drop("_v", "_a")


def ambiguous_keys(df: DataFrame, origin: Column, key: Sequence[str], version: str = "version", available: str = "available") -> DataFrame:
    """Keys whose highest version known at the origin isn't unique."""
    counts = df.where(F.col(available) <= origin).groupBy(*key, version).agg(F.count("*").alias("_n"))  # a hot key's repeats are counted, not listed
    top = counts.groupBy(*key).agg(F.max(F.struct(F.col(version).alias("v"), F.col("_n").alias("n"))).alias("_top"))
    return top.where("_top.n > 1").select(*key)


def label_join(members: DataFrame, outcomes: DataFrame, key: Sequence[str], cutoff: str, version: str = "version", available: str = "available", value: str = "units") -> DataFrame:
    """Outcome of each member as known at its cutoff. A latest version that is incomplete (null) censors the label; an older one never stands in."""
    found = members.join(outcomes, list(key), "left")
    found = found.withColumn("_known", F.when(F.col(available) <= F.col(cutoff), F.struct(F.col(version), F.col(value), F.col(available))))
    grouped = found.groupBy(*members.columns).agg(F.max("_known").alias("_k"))
    status = F.when(F.col("_k").isNull(), "not_known").when(F.col(f"_k.{value}").isNull(), "incomplete").otherwise("labelled")
    return grouped.select(*members.columns, F.col(f"_k.{value}").alias("label"), status.alias("label_status"))
