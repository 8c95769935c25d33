"""The forecast frame: 36 features of a series' target day, all as known at the origin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asoflow.functions.columns import calendar as calendar_parts
from asoflow.operators.intervals import covering
from asoflow.operators.joins import plan_match
from asoflow.operators.panel import facts_of_origins

LAGS, WINDOWS = (1, 7, 14, 28), (7, 14, 28)
HISTORY = [*(f"origin_lag_{k}_units" for k in LAGS), *(f"rolling_{s}_{w}" for w in WINDOWS for s in ("mean", "std", "count"))]
CALENDAR = ["weekday", "week_of_year", "month", "quarter", "is_weekend", "is_public_holiday", "is_easter", "is_christmas", "is_black_friday", "is_cyber_monday", "location_open", "is_category_season"]
CATEGORICAL = ["category_id", "brand", "country_code", "calendar_jurisdiction", "channel"]
PLANNED = ["planned_regular_price_minor_units", "currency", "planned_promotion_offered", "planned_promotion_type", "planned_promotion_discount_basis_points", "planned_promotion_minimum_quantity"]
#: fixed values: the columns of a frame, in order
FEATURES = [*HISTORY, *(f"target_{c}" for c in CALENDAR), *CATEGORICAL, *PLANNED]


def history_features(versions: DataFrame, origins: DataFrame, assortment: DataFrame, key: Sequence[str]) -> DataFrame:
    """Lags, rolling means, deviations and counts of the 28 days up to each origin, from the highest version available by its end; days on which the series isn't in the assortment don't count.

    Adds history_active_days, history_known_days and insufficient_history (fewer than 28 active or 7 known days). Missing days stay missing.
    """
    days = max(WINDOWS)
    met = facts_of_origins(versions, origins, key, "day", range(days)).where("available <= origin").join(assortment.select(*key, "from_day", "to_day"), list(key)).where("from_day <= day and day < to_day")
    latest = met.groupBy(*key, "origin", "age").agg(F.max_by("units", "version").alias("units"))
    age = F.col("age")
    picks = [F.max(F.when(age == k - 1, F.col("units"))).alias(f"origin_lag_{k}_units") for k in LAGS]
    for w in WINDOWS:
        own = F.when(age < w, F.col("units"))
        picks += [F.avg(own).alias(f"rolling_mean_{w}"), F.stddev_pop(own).alias(f"rolling_std_{w}"), F.count(own).alias(f"rolling_count_{w}")]
    made = latest.groupBy(*key, "origin").agg(*picks)
    active = F.greatest(F.lit(0), F.datediff(F.least(F.col("origin"), F.date_sub("to_day", 1)), F.greatest(F.date_sub("origin", days - 1), F.col("from_day"))) + 1)
    out = origins.join(assortment.select(*key, "from_day", "to_day"), list(key)).withColumn("history_active_days", active).drop("from_day", "to_day").join(made, [*key, "origin"], "left")
    out = out.fillna(0, [f"rolling_count_{w}" for w in WINDOWS]).withColumn("history_known_days", F.col(f"rolling_count_{days}"))
    return out.withColumn("insufficient_history", (F.col("history_active_days") < days) | (F.col("history_known_days") < 7))


def calendar_as_of(calendar: DataFrame, asked: DataFrame) -> DataFrame:
    """The calendar's row of each origin, target day and location: the highest version that was known at the origin. asked: origin, target, location."""
    met = asked.join(calendar.withColumnRenamed("day", "target"), ["target", "location"]).where("known <= origin")
    rest = [c for c in calendar.columns if c not in ("day", "location", "version", "known")]
    best = met.groupBy("origin", "target", "location").agg(F.max_by(F.struct(*rest), "version").alias("_b"))
    return best.select("origin", "target", "location", *[F.col(f"_b.{c}").alias(c) for c in rest])


def promotion_match(rows: DataFrame, promotions: DataFrame, fact_key: Sequence[str]) -> DataFrame:
    """The active promotion of the highest priority in force on each target at its place and channel, by its latest version known at the origin; ambiguous where two tie. Promotions: promotion_id, product, location and channel (null and 'all' for every one), from_day, to_day, version, known, status, priority, and its terms."""
    held = promotions.withColumnsRenamed({"location": "_location", "channel": "_channel", "from_day": "start"}).withColumn("end", F.date_sub("to_day", 1)).drop("to_day")
    met = covering(rows, held, ["product"], "target").where(F.col("known") <= F.col("origin"))
    met = met.where((F.col("_location").isNull() | (F.col("_location") == F.col("location"))) & ((F.col("_channel") == "all") | (F.col("_channel") == F.col("channel"))))
    terms = ["status", "priority", "promotion_type", "discount_basis_points", "minimum_quantity"]
    known = met.groupBy(*fact_key, "promotion_id").agg(F.max_by(F.struct(*terms), "version").alias("_t")).where("_t.status = 'active'")
    best = known.groupBy(*fact_key).agg(F.max(F.struct("_t.priority", "promotion_id", "_t")).alias("_b"), F.max("_t.priority").alias("_p"), F.collect_list("_t.priority").alias("_all"))  # the promotions of one day
    tied = F.size(F.filter("_all", lambda p: p == F.col("_p"))) > 1
    return best.select(*fact_key, *[F.col(f"_b._t.{c}").alias(c) for c in terms[2:]], tied.alias("ambiguous_promotion"))


def forecast_frame(targets: DataFrame, versions: DataFrame, assortment: DataFrame, catalog: DataFrame, calendar: DataFrame, seasons: DataFrame, plans: DataFrame, promotions: DataFrame, key: Sequence[str] = ("product", "location", "channel")) -> DataFrame:
    """All FEATURES of every active target: key, origin, h, target, the 36 columns, and the state of the history.

    targets: key, origin, h, target. A target is active if its day is not before the product's launch and in the series' assortment (from_day,
    to_day). catalog: product, part, launch, category_id, brand. calendar: versions by day and location, with
    country_code, calendar_jurisdiction, location_open and the flags of movable days. seasons: day, category_id,
    is_category_season. plans and promotions: versions with scopes and half-open days, on the catalog's part and the product. The
    calendar, plans and promotions are those known at the origin. Features of the history are made once for an origin, the calendar's once for a
    place; a plan is looked up by equality (plan_match). Nothing known gives null, and no promotion is 'not offered'.
    """
    rows = targets.join(assortment.select(*key, "from_day", "to_day"), list(key)).where("from_day <= target and target < to_day").drop("from_day", "to_day")
    rows = rows.join(catalog, "product").where("launch <= target").drop("launch")
    fact_key = [*key, "origin", "target"]
    history = history_features(versions, targets.select(*key, "origin").distinct(), assortment, key)
    places = calendar_as_of(calendar, rows.select("origin", "target", "location").distinct())
    priced = plan_match(rows.select(*fact_key, "part"), plans, "part", "target", F.col("origin"), fact_key)
    priced = priced.groupBy(*fact_key).agg(F.min("price_cents").alias("planned_regular_price_minor_units"), F.bool_or("ambiguous").alias("ambiguous_price"))
    promoted = promotion_match(rows.select(*fact_key), promotions, fact_key)
    out = rows.join(history, [*key, "origin"]).join(places, ["origin", "target", "location"], "left").join(priced, fact_key, "left").join(promoted, fact_key, "left")
    out = out.join(seasons.withColumnRenamed("day", "target"), ["target", "category_id"], "left")
    parts = calendar_parts(F.col("target"))
    named = {
        "target_weekday": parts["weekday"], "target_week_of_year": parts["iso_week"], "target_month": parts["month"], "target_quarter": parts["quarter"], "target_is_weekend": parts["is_weekend"],
        **{f"target_{c}": F.col(c) for c in CALENDAR[5:]}, "currency": F.when(F.col("planned_regular_price_minor_units").isNotNull(), F.lit("EUR")), "planned_promotion_offered": F.col("promotion_type").isNotNull(),
        "planned_promotion_type": F.col("promotion_type"), "planned_promotion_discount_basis_points": F.col("discount_basis_points"), "planned_promotion_minimum_quantity": F.col("minimum_quantity"),
    }
    state = ["history_active_days", "history_known_days", "insufficient_history", F.coalesce("location_open", F.lit(False)).alias("target_calendar_eligible"), F.coalesce("ambiguous_price", F.lit(False)).alias("ambiguous_price"), F.coalesce("ambiguous_promotion", F.lit(False)).alias("ambiguous_promotion")]
    made = out.withColumns(named)
    return made.select(*[c for c in key if c != "channel"], "origin", "h", "target", *FEATURES, *state)
