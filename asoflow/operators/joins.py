"""References, matches, intervals and set comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: locations whose plans a fact may meet
_LOT = 16


def require_reference(df: DataFrame, dim: DataFrame, key: str, dim_key: str, reason: str) -> DataFrame:
    """Adds reason where the key has no row in dim."""
    there = dim.select(F.col(dim_key).alias("_there")).distinct()
    return df.join(there, F.col(key) == F.col("_there"), "left").withColumn("reason", F.when(F.col("_there").isNull(), reason)).drop("_there")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias("_p")), F.col(key) == F.col("_p"), "left_anti")


def key_set_difference(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: keys in a, in b, only in a, only in b, and keys that repeat in either."""
    sides = a.select(*key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).union(b.select(*key, F.lit(0), F.lit(1)))
    counts = sides.groupBy(*key).agg(F.sum("_a").alias("na"), F.sum("_b").alias("nb"))
    return counts.agg(
        F.count_if(F.col("na") > 0).alias("n_a"), F.count_if(F.col("nb") > 0).alias("n_b"), F.count_if(F.expr("nb = 0")).alias("only_a"),
        F.count_if(F.expr("na = 0")).alias("only_b"), F.count_if(F.expr("na > 1 or nb > 1")).alias("repeated"),
    )


def multiset_difference(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose counts differ: balance is how many more a has. One shuffle of partial sums."""
    both = a.select(*columns, F.lit(1).alias("_s")).union(b.select(*columns, F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("_s").alias("balance")).where("balance <> 0")


def single_match(df: DataFrame, other: DataFrame, key: Sequence[str], agree: Sequence[str], other_name: str) -> DataFrame:
    """Exactly one row of other per row of df, whose `agree` columns are equal; reason says what is wrong. Counting comes before joining, so repeats don't multiply."""
    counted = other.groupBy(*key).agg(F.count("*").alias("_n"), *[F.min(c).alias(f"_o_{c}") for c in agree])
    joined = df.join(counted, list(key), "left")
    differs = F.lit(False)
    for c in agree:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    reason = F.when(F.col("_n").isNull(), f"{other_name}_missing").when(F.col("_n") > 1, f"{other_name}_repeated").when(differs, f"{other_name}_differs")
    return joined.withColumn("reason", reason).drop("_n", *[f"_o_{c}" for c in agree])


def plan_match(series: DataFrame, plans: DataFrame, on: str, day: str, origin: Column, fact_key: Sequence[str]) -> DataFrame:
    """The plan of the narrowest scope in force on the day and known at the origin, latest version first; ambiguous where two tie.

    A plan without a location holds for all, one of channel 'all' for every channel; any other must be
    that of the series. A location narrows more than a channel. Each fact asks once, by equality, in its bucket of days and
    its lot of about _LOT locations, to which plans of no location belong as well, so it never meets all versions of
    its key; it is ranked where it met them. A fact_key names a fact, with its key, location and day.
    """
    from asoflow.operators.intervals import covering

    lots = max(1, -(-plans.agg(F.approx_count_distinct("location").alias("n")).first()["n"] // _LOT))
    lot, all_lots = F.pmod(F.xxhash64("location"), F.lit(lots)).cast("int"), F.sequence(F.lit(0), F.lit(lots - 1))
    held = plans.select(
        F.col(on).alias("_on"), F.explode(F.when(F.col("location").isNull(), all_lots).otherwise(F.array(lot))).alias("_lot"), F.col("location").alias("_location"), F.col("channel").alias("_channel"),
        F.col("from_day").alias("start"), F.date_sub("to_day", 1).alias("end"), *[c for c in plans.columns if c not in (on, "location", "channel", *series.columns)],
    )
    asked = series.withColumns({"_origin": origin, "_on": F.col(on), "_lot": lot})
    here = (F.col("_location").isNull() | (F.col("_location") == F.col("location"))) & ((F.col("_channel") == "all") | (F.col("_channel") == F.col("channel")))
    joined = covering(asked, held, ["_on", "_lot"], day, at="_met").where(here & (F.col("known") <= F.col("_origin")))
    joined = joined.withColumn("scope_rank", F.when(F.col("_location").isNull(), 0).otherwise(2) + F.when(F.col("_channel") == "all", 0).otherwise(1))
    by = Window.partitionBy("_on", "_lot", "_met", *fact_key)
    best = joined.withColumn("_r", F.rank().over(by.orderBy(F.desc("scope_rank"), F.desc("version")))).where("_r = 1")
    return best.withColumn("ambiguous", F.count("*").over(by) > 1).drop("_r", "_on", "_lot", "_met", "_location", "_channel", "_origin", "start", "end")


def legacy_assignment(facts: DataFrame, assignments: DataFrame, key: Sequence[str], day: str, origin: Column, fact_key: Sequence[str]) -> DataFrame:
    """Each fact with the one location that its legacy store was assigned to on its day, as far as known at the origin: n_locations (distinct ones), location (null unless it is one), status assigned, missing or ambiguous.

    assignments: key, location, from_day, to_day (half-open), known. Facts meet the assignments of their bucket of days alone.
    """
    from asoflow.operators.intervals import covering

    held = assignments.select(*key, "location", "known", F.col("from_day").alias("start"), F.date_sub("to_day", 1).alias("end"))
    met = covering(facts.withColumn("_origin", origin), held, key, day, "left")
    seen = F.when(F.col("known") <= F.col("_origin"), F.col("location"))
    found = met.groupBy(*fact_key).agg(F.count_distinct(seen).alias("n_locations"), F.min(seen).alias("location"))
    status = F.when(F.col("n_locations") == 0, "missing").when(F.col("n_locations") == 1, "assigned").otherwise("ambiguous")
    return found.withColumns({"location": F.when(F.col("n_locations") == 1, F.col("location")), "status": status})


def lagged(df: DataFrame, key: Sequence[str], day: str, value: str, lag: int, name: str) -> DataFrame:
    """The value of exactly `lag` days before; a missing day stays missing (this is no row offset)."""
    past = df.select(*key, F.date_add(day, lag).alias(day), F.col(value).alias(name))
    return df.join(past, [*key, day], "left")


def window_intersection(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Common parts of two sets of closed day windows of a key; known when both are."""
    from asoflow.operators.intervals import overlapping

    met = overlapping(a.select(*key, "start", "end", F.col("known").alias("_k")), b.select(*key, "start", "end", "known"), key)
    return met.select(*key, F.greatest("_start", "start").alias("start"), F.least("_end", "end").alias("end"), F.greatest("_k", "known").alias("known"))


def episode_match(alerts: DataFrame, episodes: DataFrame, key: Sequence[str], alert_key: Sequence[str], tolerance: int) -> DataFrame:
    """Each alert with the episode of its series that covers its day (with a tolerance after the end): the one that ends first, then the smallest id."""
    from asoflow.operators.intervals import covering

    reach = episodes.select(*key, "start", F.date_add("end", tolerance).alias("end"), "episode_id")
    covered = covering(alerts.select(*dict.fromkeys([*key, *alert_key, "day"])), reach, key, "day")
    best = covered.groupBy(*alert_key).agg(F.min(F.struct("end", "episode_id")).alias("_b"))
    return best.select(*alert_key, F.col("_b.episode_id").alias("episode_id"))


def snapshot_plus_tail(snapshots: DataFrame, ledger: DataFrame, key: Sequence[str], origin: Column) -> DataFrame:
    """Last known balance up to the origin plus the movements after it, that occurred or became available since."""
    last = snapshots.where(F.col("day") <= origin).groupBy(*key).agg(F.max_by("balance", "day").alias("base"), F.max("day").alias("base_day"))
    tail = ledger.where((F.col("day") <= origin) & (F.col("available") <= origin)).join(last, list(key))
    moved = tail.groupBy(*key).agg(F.sum(F.when((F.col("day") > F.col("base_day")) | (F.col("available") > F.col("base_day")), F.col("delta"))).alias("moved"))
    return last.join(moved, list(key), "left").select(*key, (F.col("base") + F.coalesce("moved", F.lit(0.0))).alias("on_hand"))


def return_violations(claims: DataFrame, sales: DataFrame, key: Sequence[str], window_days: int) -> DataFrame:
    """Claims against their sales: reason is the first of no sale, before the sale, after the window, more than sold over all claims so far."""
    sold = sales.groupBy(*key).agg(F.sum("quantity").alias("_sold"), F.min("sold").alias("_day"))
    order = Window.partitionBy(*key).orderBy("returned", "claim_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = claims.join(sold, list(key), "left").withColumn("_all", F.sum("claimed").over(order))
    reason = (
        F.when(F.col("_sold").isNull(), "no_sale").when(F.col("returned") < F.col("_day"), "before_sale")
        .when(F.datediff("returned", "_day") > window_days, "after_window").when(F.col("_all") > F.col("_sold"), "more_than_sold")
    )
    return joined.withColumn("reason", reason).drop("_sold", "_day", "_all")


def on_day(df: DataFrame, routes: DataFrame, day: str) -> DataFrame:
    """Rows with the stock that their location is routed to on the day. routes: location, stock and a half-open interval of days; rows without a route go."""
    from asoflow.operators.intervals import covering

    held = routes.select("location", "stock", F.col("from_day").alias("start"), F.date_sub("to_day", 1).alias("end"))
    return covering(df, held, ["location"], day).drop("start", "end")


def promotion_exposure(asked: DataFrame, promotions: DataFrame, days: int) -> DataFrame:
    """Whether a promotion that is known on the day runs in the next days at the product's stock: asked (product, stock, day) with exposed. promotions: product, stock, active (a day it runs) and known."""
    reach = promotions.select("product", "stock", "known", F.explode(F.transform(F.sequence(F.lit(1), F.lit(days)), lambda k: F.date_sub(F.col("active"), k))).alias("day"))
    hits = reach.where(F.col("known") <= F.col("day")).select("product", "stock", "day").distinct().withColumn("_hit", F.lit(True))
    return asked.join(hits, ["product", "stock", "day"], "left").select("product", "stock", "day", F.coalesce("_hit", F.lit(False)).alias("exposed"))


def truth_census(days: DataFrame, predictions: DataFrame, key: Sequence[str], mature: Column) -> DataFrame:
    """Days of truth windows by what can be said of them: unknown (no outcome), immature (later than `mature`), insufficient (nothing to predict from), evaluable; with how many are predicted and high. predictions: key, units, before."""
    joined = days.join(predictions.select(*key, "units", "before"), list(key), "left")
    status = F.when(F.col("units").isNull(), "unknown").when(F.col("day") > mature, "immature").when(F.col("before").isNull(), "insufficient").otherwise("evaluable")
    return joined.groupBy(status.alias("status")).agg(F.count("*").alias("n_days"), F.count_if(F.expr("units > before")).alias("n_predicted"), F.count_if(F.expr("units > 60")).alias("n_high"))


def tags_and_overlaps(df: DataFrame, tags: str, none: str) -> DataFrame:
    """A row for each tag of a row (`none` if it has none) and one for each pair of its tags, as a+b."""
    t = F.col(tags)
    pairs = F.flatten(F.transform(t, lambda x, i: F.transform(F.slice(t, i + 2, F.size(t)), lambda y: F.concat(x, F.lit("+"), y))))
    own = F.when(F.size(t) == 0, F.array(F.lit(none))).otherwise(F.concat(t, pairs))
    return df.select(*[c for c in df.columns if c != tags], F.explode(own).alias("tag"))


def episode_metrics(episodes: DataFrame, alerts: DataFrame, key: Sequence[str], by: Sequence[str]) -> DataFrame:
    """How episodes (key, start, end, known, young) are caught by alerts (key, day), rolled up: all, those excluded as too young, detected, recall, repeated alerts, mean delay from the start and mean lead before the episode was known.

    Alerts meet the episodes of their own day: episodes are listed by day, which bounds the join by the days they hold.
    """
    days = episodes.select(*key, "start", F.explode(F.sequence("start", "end")).alias("day")).join(alerts.select(*key, "day"), [*key, "day"])
    caught = days.groupBy(*key, "start").agg(F.min("day").alias("_first"), F.count("*").alias("_k"))
    j = episodes.join(caught, [*key, "start"], "left")
    old = ~F.col("young")
    n = F.count_if(old)
    found = F.count_if(old & F.col("_first").isNotNull())
    return j.rollup(*by).agg(
        F.count("*").alias("n_all"), F.count_if(F.col("young")).alias("n_excluded"), n.alias("n_episodes"), found.alias("n_detected"), F.round(F.try_divide(found, n), 6).alias("recall"),
        F.sum(F.when(old, F.greatest(F.coalesce("_k", F.lit(0)) - 1, F.lit(0)))).alias("n_repeats"), F.round(F.avg(F.when(old, F.datediff("_first", "start"))), 6).alias("mean_delay"),
        F.round(F.avg(F.when(old, F.datediff("known", "_first"))), 6).alias("mean_lead"),
    )
