"""Which declared days qualify, from what was known at each moment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: the statuses in the order in which they are tried
STATUSES = ("no_declaration", "closure_unavailable", "source_incomplete", "location_closed", "dq_unattributed_quarantine", "dq_missing_facts", "qualified")


def unattributed(quarantined: DataFrame, parent: DataFrame, event_id: str = "event_id", fact_id: str = "fact_id") -> DataFrame:
    """Quarantined deliveries that can't be laid to one fact: their fact is unknown to the parent, or their event id belongs to another fact there. parent: event_id, fact_id."""
    facts = parent.select(F.col(fact_id).alias("_f")).distinct().withColumn("_there", F.lit(True))
    owner = parent.groupBy(F.col(event_id).alias("_e")).agg(F.min(fact_id).alias("_own"))
    joined = quarantined.join(facts, F.col(fact_id) == F.col("_f"), "left").join(owner, F.col(event_id) == F.col("_e"), "left")
    return joined.where(F.col("_there").isNull() | (F.col("_own") != F.col(fact_id))).select(*quarantined.columns)


def qualification_gate(points: DataFrame, days: DataFrame, required: DataFrame, facts: DataFrame, loose: DataFrame, grain: Sequence[str]) -> DataFrame:
    """Status of each point (grain, as_of) from what was known then, with what is missing and, for qualified ones, the totals.

    days: grain, known, source_complete, activity ('open' or 'closed'). required: grain, kind, fact_id and own (whether the
    day's totals count it; a sale that a return needs doesn't). facts: accepted ones as kind, fact_id, available, quantity, amount, rejected. loose:
    received times of quarantined deliveries that can't be laid to a fact: from the first of them on no open day qualifies.

    Returns grain, as_of, status (the first of STATUSES that holds), n_missing, first_missing (kind:fact_id), and
    observed_units, amount, rejected_units (null unless qualified). A required fact is looked up once, with its availability as a
    column, so no point is joined with all facts. Days without facts required of them qualify with zeros.
    """
    first_loose = loose.agg(F.min("received").alias("_loose"))
    known = points.join(days, list(grain), "left").crossJoin(F.broadcast(first_loose))  # one row
    own = required.join(facts, ["kind", "fact_id"], "left").select(*grain, "own", F.concat_ws(":", "kind", "fact_id").alias("_name"), "available", "quantity", "amount", "rejected")
    asked = known.where((F.col("known") <= F.col("as_of")) & F.col("source_complete") & (F.col("activity") != "closed")).select(*grain, "as_of").join(own, list(grain))
    lacks = F.col("available").isNull() | (F.col("available") > F.col("as_of"))
    counts = F.col("own") & ~lacks
    sums = asked.groupBy(*grain, "as_of").agg(
        F.count_if(lacks).alias("n_missing"), F.min(F.when(lacks, F.col("_name"))).alias("first_missing"), F.sum(F.when(counts & ~F.col("rejected"), F.col("quantity")).otherwise(0)).alias("_units"),
        F.sum(F.when(counts, F.col("amount")).otherwise(0)).alias("_amount"), F.sum(F.when(counts & F.col("rejected"), F.col("quantity")).otherwise(0)).alias("_rejected"),
    )
    out = known.join(sums, [*grain, "as_of"], "left").fillna(0, ["n_missing", "_units", "_amount", "_rejected"])
    rules = (
        F.col("known").isNull(), F.col("known") > F.col("as_of"), ~F.col("source_complete"), F.col("activity") == "closed",
        F.coalesce(F.col("_loose") <= F.col("as_of"), F.lit(False)), F.col("n_missing") > 0,
    )
    status = F.coalesce(*[F.when(rule, name) for rule, name in zip(rules, STATUSES, strict=False)], F.lit(STATUSES[-1]))
    out = out.withColumn("status", status)
    missing = F.col("status") == "dq_missing_facts"
    good = F.col("status") == "qualified"
    return out.select(
        *grain, "as_of", "status", F.when(missing, F.col("n_missing")).otherwise(0).cast("long").alias("n_missing"), F.when(missing, F.col("first_missing")).alias("first_missing"),
        F.when(good, F.col("_units")).alias("observed_units"), F.when(good, F.col("_amount")).alias("amount"), F.when(good, F.col("_rejected")).alias("rejected_units"),
    )
