"""Feature tables at (series, origin)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asoflow.operators.ledger import running_balance
from asoflow.operators.panel import facts_of_origins


def forecast_features(versions: DataFrame, origins: DataFrame, key: Sequence[str], days: int = 28) -> DataFrame:
    """For each origin: known days, means, lags and the next day's weekday, from the highest version that was available at the end of the origin's day. Missing days stay missing."""
    met = facts_of_origins(versions, origins, key, "day", range(days)).where("available <= date_add(origin, 1)")
    latest = met.withColumn("_r", F.row_number().over(Window.partitionBy(*key, "origin", "day").orderBy(F.desc("version")))).where("_r = 1")
    age = F.col("age")
    made = latest.groupBy(*key, "origin").agg(
        F.count("*").alias("known"), F.round(F.avg(F.when(age < 7, F.col("units"))), 6).alias("mean_7"), F.round(F.avg("units"), 6).alias(f"mean_{days}"),
        F.max(F.when(age == 0, F.col("units"))).alias("lag_1"), F.max(F.when(age == 6, F.col("units"))).alias("lag_7"),
    )
    out = origins.join(made, [*key, "origin"], "left").withColumn("known", F.coalesce("known", F.lit(0)))
    return out.withColumns({"status": F.when(F.col("known") < 7, "insufficient_history").otherwise("ready"), "weekday": F.weekday(F.date_add("origin", 1)).cast("long")})


def stockout_features(ledger: DataFrame, daily: DataFrame, origins: DataFrame, key: Sequence[str], order: str, days: int = 28, least_known: int = 7) -> DataFrame:
    """What was known of a series' stock at each origin: values, and a status with the reason it has none.

    ledger: movements with kind, delta, day and available. daily: (key, day, in_stock, onsets) of every
    day, as stock_days gives them. A movement counts for an origin if its day and its availability are not later;
    history is the `days` days up to the origin, onsets those before its own day.

    available_qty, snapshot_age_days (since the last movement), history_known_days and history_missing_days (with and without
    sales), observed_sales_mean and _std over known days, in_stock_sales_mean over those of them in stock all day,
    history_in_stock_days, history_constrained_days and history_inventory_unknown_days, historical_stockout_onsets (null
    unless all days before are known), days_of_supply_observed and _in_stock, due_within_7d_quantity and
    next_expected_delivery_days (receipts after the origin that were ordered by then, `ordered`), last_receipt_days.
    Status: insufficient_data with reason inventory_unknown or insufficient_sales_history, already_stockout, or eligible.

    Every day of the ledger and every origin is one row of the same window of the key; no origin meets the whole history.
    """
    moved = running_balance(ledger, key, order).withColumn("_t", F.greatest("day", "available"))
    span = F.unix_date("_t")
    upto = Window.partitionBy(*key).orderBy(span).rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*key).orderBy(F.desc(span)).rangeBetween(Window.unboundedPreceding, -1)
    asked = origins.select(*key, F.col("origin").alias("_t"), F.lit(1).alias("_asked"))
    known = moved.groupBy(*key, "_t").agg(
        F.max(F.struct(F.col(order).alias("o"), F.col("balance").alias("b"), F.col("day").alias("d"))).alias("_last"),
        F.max(F.when(F.col("kind") == "receipt", F.col("day"))).alias("_receipt"),
    )
    state = known.unionByName(asked, allowMissingColumns=True).withColumns({"_last": F.max("_last").over(upto), "_receipt": F.max("_receipt").over(upto)})
    state = state.where("_asked = 1").select(*key, F.col("_t").alias("origin"), F.col("_last.b").alias("available_qty"), F.col("_last.d").alias("_at"), "_receipt")

    # a day's sales enter at the later of the day and its availability and leave when the day is too old
    sales = moved.where("kind = 'sale'").groupBy(*key, "day").agg((-F.sum("delta")).alias("u"), F.max("_t").alias("known"))
    facts = sales.join(daily.select(*key, "day", "in_stock"), [*key, "day"], "left").withColumn("f", F.when(F.col("in_stock"), 1).otherwise(0))
    sums = {"n": F.lit(1), "s": F.col("u"), "q": F.col("u") * F.col("u"), "ni": F.col("f"), "si": F.col("u") * F.col("f")}

    def steps(rows: DataFrame, known_at: Column, sums: dict[str, Column], width: int, last: int = 0) -> DataFrame:
        """What enters a window of `width` days, the newest `last` days old, and leaves it, summed up to each origin."""
        enters, leaves = F.greatest(known_at, F.date_add("day", last)), F.date_add("day", width)
        both = F.array(*[F.struct(t.alias("_t"), *[(x * sign).cast("double").alias(c) for c, x in sums.items()]) for t, sign in ((enters, 1), (leaves, -1))])
        moves = rows.where(enters < leaves).select(*key, F.inline(both)).groupBy(*key, "_t").agg(*[F.sum(c).alias(c) for c in sums])
        run = moves.unionByName(asked, allowMissingColumns=True).withColumns({c: F.coalesce(F.sum(c).over(upto), F.lit(0.0)) for c in sums})
        return run.where("_asked = 1").select(*key, F.col("_t").alias("origin"), *sums)

    history = steps(facts, F.col("known"), sums, days)
    stock = steps(daily.where("in_stock is not null"), F.col("day"), {"nd": F.lit(1), "nc": F.when(F.col("in_stock"), 0).otherwise(1)}, days)
    onsets = steps(daily.where("in_stock is not null"), F.col("day"), {"np": F.lit(1), "no": F.col("onsets")}, days, 1)
    plan = ledger.where("kind = 'receipt'").groupBy(*key, F.col("day").alias("_t")).agg(F.sum("delta").alias("_due"))
    plan = plan.unionByName(asked, allowMissingColumns=True)
    week = Window.partitionBy(*key).orderBy(span).rangeBetween(1, 7)
    plan = plan.withColumns({"due_within_7d_quantity": F.coalesce(F.sum("_due").over(week), F.lit(0.0)), "_next": F.min(F.when(F.col("_due").isNotNull(), F.col("_t"))).over(after)})
    plan = plan.where("_asked = 1").select(*key, F.col("_t").alias("origin"), "due_within_7d_quantity", "_next")

    at = [*key, "origin"]
    out = state.join(history, at).join(stock, at).join(onsets, at).join(plan, at)
    mean, inside = F.try_divide("s", "n"), F.try_divide("si", "ni")
    known_days = F.col("n").cast("long")
    status = (
        F.when(F.col("available_qty").isNull(), "insufficient_data").when(F.col("available_qty") <= 0, "already_stockout")
        .when(known_days < least_known, "insufficient_data").otherwise("eligible")
    )
    return out.select(
        *at, "available_qty", F.datediff("origin", "_at").cast("long").alias("snapshot_age_days"), known_days.alias("history_known_days"), (days - known_days).alias("history_missing_days"),
        F.round(mean, 6).alias("observed_sales_mean"), F.round(F.sqrt(F.greatest(F.try_divide("q", "n") - mean * mean, F.lit(0.0))), 4).alias("observed_sales_std"), F.round(inside, 6).alias("in_stock_sales_mean"),
        F.col("ni").cast("long").alias("history_in_stock_days"), F.col("nc").cast("long").alias("history_constrained_days"), (days - F.col("nd")).cast("long").alias("history_inventory_unknown_days"),
        F.when(F.col("np") == days - 1, F.col("no")).cast("long").alias("historical_stockout_onsets"), F.round(F.try_divide(F.col("available_qty") * F.col("n"), "s"), 4).alias("days_of_supply_observed"),
        F.round(F.try_divide(F.col("available_qty") * F.col("ni"), "si"), 4).alias("days_of_supply_in_stock"), "due_within_7d_quantity", F.datediff("_next", "origin").cast("long").alias("next_expected_delivery_days"),
        F.datediff("origin", "_receipt").cast("long").alias("last_receipt_days"), status.alias("status"),
        F.when(F.col("available_qty").isNull(), "inventory_unknown").when((F.col("available_qty") > 0) & (known_days < least_known), "insufficient_sales_history").alias("reason"),
    )


def upstream(forecasts: DataFrame, group: Sequence[str], p: str, closed: Column) -> DataFrame:
    """Sum of a week's forecasts over the series of a group, in exact decimals: a closed day adds zero, and any open day without a forecast leaves the week unknown."""
    own = F.when(closed, F.lit(0)).otherwise(F.col(p)).cast("decimal(18,6)")
    sums = forecasts.groupBy(*group).agg(F.count("*").alias("n_days"), F.count_if(closed).alias("n_closed"), F.count_if(own.isNull()).alias("n_unknown"), F.sum(own).cast("double").alias("_s"))
    known = F.col("n_unknown") == 0
    return sums.withColumns({"week": F.when(known, F.col("_s")), "status": F.when(known, "ready").otherwise("insufficient")}).drop("_s")
