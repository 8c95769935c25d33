"""Inventory ledgers: balances, days in stock, bitemporal snapshots, incidents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_balance(ledger: DataFrame, key: Sequence[str], order: str, delta: str = "delta") -> DataFrame:
    """Adds balance after each movement and before, the balance ahead of it."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ledger.withColumn("balance", F.sum(delta).over(w))
    return summed.withColumn("before", F.col("balance") - F.col(delta))


_SIGNS = {"sale": -1, "transfer_out": -1, "receipt": 1, "transfer_in": 1, "return": 1}  # fixed values: the sign that a kind of movement has


def ledger_violations(ledger: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Movements that break the rules of a ledger, each with the first rule it breaks.

    A series opens with its one opening stock, balances aren't negative, deltas suit their kind and aren't
    zero, a movement isn't available before its day, nor before the one ahead of it (clock_regression).
    """
    by = Window.partitionBy(*key).orderBy(order)
    openings = F.sum(F.when(F.col("kind") == "opening_stock", 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    checked = running_balance(ledger, key, order).withColumns({"_openings": openings, "_n": F.row_number().over(by), "_before": F.lag("day").over(by)})
    sign = F.create_map(*[F.lit(x) for pair in _SIGNS.items() for x in pair])[F.col("kind")]
    reason = (
        F.when((F.col("_n") == 1) & (F.col("kind") != "opening_stock"), "no_opening").when((F.col("kind") == "opening_stock") & (F.col("_openings") > 1), "second_opening")
        .when(F.col("delta") * sign <= 0, "wrong_sign").when(F.col("available") < F.col("day"), "known_before_day").when(F.col("day") < F.col("_before"), "clock_regression")
        .when(F.col("balance") < 0, "negative_balance")
    )
    return checked.withColumn("reason", reason).where("reason is not null").drop("_openings", "_n", "_before")


def transfer_violations(ledger: DataFrame, transfer: str = "transfer_id") -> DataFrame:
    """Transfers that aren't a pair of one movement out and one in of the same amount: transfer, reason. Rows without a transfer id don't count."""
    pairs = ledger.where(F.col(transfer).isNotNull()).groupBy(transfer).agg(
        F.count_if(F.col("kind") == "transfer_out").alias("_out"), F.count_if(F.col("kind") == "transfer_in").alias("_in"), F.sum("delta").alias("_net"), F.count("*").alias("_n"),
    )
    reason = F.when((F.col("_out") != 1) | (F.col("_in") != 1) | (F.col("_n") != 2), "not_a_pair").when(F.col("_net") != 0, "amounts_differ")
    return pairs.select(transfer, reason.alias("reason")).where("reason is not null")


def stock_days(ledger: DataFrame, days: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """For each key and day of `days`: balance at its end, whether stock was there all day, and how often it ran out (a balance going from above zero to zero or less)."""
    moved = running_balance(ledger, key, order)
    daily = moved.groupBy(*key, "day").agg(
        F.max_by("balance", order).alias("end_balance"), F.min_by("before", order).alias("_start"), F.min("balance").alias("_low"),
        F.count_if((F.col("before") > 0) & (F.col("balance") <= 0)).alias("onsets"),
    )
    w = Window.partitionBy(*key).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # days without movement carry the last balance on: union instead of a range join
    both = daily.select(*key, "day", "end_balance", "_start", "_low", "onsets", F.lit(0).alias("_asked")).unionByName(days.select(*key, "day", F.lit(1).alias("_asked")), allowMissingColumns=True)
    both = both.groupBy(*key, "day").agg(F.max("end_balance").alias("end_balance"), F.max("_start").alias("_start"), F.max("_low").alias("_low"), F.max("onsets").alias("onsets"), F.max("_asked").alias("_asked"))
    carried = both.withColumn("end_balance", F.last("end_balance", ignorenulls=True).over(w))
    all_day = F.least(F.coalesce("_start", "end_balance"), F.coalesce("_low", "end_balance")) > 0
    return carried.where("_asked = 1").select(*key, "day", "end_balance", all_day.alias("in_stock"), F.coalesce("onsets", F.lit(0)).cast("long").alias("onsets"))


def daily_snapshot(ledger: DataFrame, cutoffs: DataFrame, key: Sequence[str], order: str, cutoff: str = "cutoff") -> DataFrame:
    """Balance at each cutoff from movements that had occurred and were known by then, with their count, the last one and the latest clock. One row per key and cutoff with any.

    A movement counts from the later of its day and its availability; sums by that day run on in one window
    of the key, in which the cutoffs stand between the days. cutoffs is a short list.
    """
    since = ledger.groupBy(*key, F.greatest("day", "available").alias("_t")).agg(F.sum("delta").alias("d"), F.count("*").alias("n"), F.max(order).alias("last"), F.max("available").alias("clock"))
    asked = since.select(*key).distinct().crossJoin(F.broadcast(cutoffs.select(F.col(cutoff).alias("_t"), F.lit(1).alias("_asked"))))
    both = since.unionByName(asked, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = both.withColumns({"balance": F.sum("d").over(w), "n_movements": F.sum("n").over(w), "last_sequence": F.max("last").over(w), "clock": F.max("clock").over(w)})
    return run.where("_asked = 1 and n_movements > 0").select(*key, F.col("_t").alias(cutoff), "balance", "n_movements", "last_sequence", "clock")


def incident_labels(ledger: DataFrame, origins: DataFrame, key: Sequence[str], order: str, horizon: int, covered: Column) -> DataFrame:
    """Whether stock runs out in the days (origin, origin + horizon].

    status is already_out (no stock at the origin), no_history, not_covered (the ledger ends
    before the window), else labelled with label 1 and the first day out, or 0. The order of a key's movements is that of
    their days. Days and origins stand in one window of the key: the last balance is carried forward, the next day out back.
    """
    moved = running_balance(ledger, key, order)
    out = F.when((F.col("before") > 0) & (F.col("balance") <= 0), F.col("day"))
    daily = moved.groupBy(*key, F.col("day").alias("_t")).agg(F.max_by("balance", order).alias("_end"), F.min(out).alias("_out"))
    both = daily.unionByName(origins.select(*key, F.col("origin").alias("_t"), F.lit(1).alias("_asked")), allowMissingColumns=True)
    upto = Window.partitionBy(*key).orderBy(F.unix_date("_t")).rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*key).orderBy(F.desc(F.unix_date("_t"))).rangeBetween(Window.unboundedPreceding, -1)  # later days, not the own
    last = F.max(F.when(F.col("_end").isNotNull(), F.struct("_t", "_end"))).over(upto)["_end"]
    found = both.withColumns({"start_balance": last, "out_day": F.min("_out").over(after)}).where("_asked = 1").select(*key, F.col("_t").alias("origin"), "start_balance", "out_day")
    end = F.date_add("origin", horizon)
    status = F.when(F.col("start_balance").isNull(), "no_history").when(F.col("start_balance") <= 0, "already_out").when(end > covered, "not_covered").otherwise("labelled")
    found = found.withColumn("status", status).withColumn("label", F.when(F.col("status") == "labelled", F.coalesce(F.col("out_day") <= end, F.lit(False)).cast("long")))
    return found.withColumn("out_day", F.when(F.col("label") == 1, F.col("out_day")))
