"""Calendar panels: reindexing, lags, rolling statistics, baselines, robust scales, islands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reindex(df: DataFrame, key: Sequence[str], first: str, last: str, day: str = "day") -> DataFrame:
    """Every key on every day of the range, with what df has there; missing days stay null."""
    days = df.select(*key).distinct().withColumn(day, F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))))
    return days.join(df, [*key, day], "left")


def over_days(key: Sequence[str], day: str, width: int) -> Window:
    """A window of calendar days up to the row's own, whatever rows are missing."""
    return Window.partitionBy(*key).orderBy(F.unix_date(F.col(day))).rangeBetween(-(width - 1), 0)


def rolling(df: DataFrame, key: Sequence[str], day: str, value: str, widths: Sequence[int]) -> DataFrame:
    """Mean, population deviation and count of known values over calendar days; all widths share a sort."""
    out = {}
    for w in widths:
        span = over_days(key, day, w)
        out |= {f"mean_{w}": F.avg(value).over(span), f"std_{w}": F.stddev_pop(value).over(span), f"n_{w}": F.count(value).over(span)}
    return df.withColumns(out)


def facts_of_origins(df: DataFrame, origins: DataFrame, key: Sequence[str], day: str, ages: Sequence[int]) -> DataFrame:
    """Each origin with the facts of the days that are so many days old at it, and their age. The days are listed and joined on equality, so an origin never meets its series' whole history."""
    asked = origins.withColumn("age", F.explode(F.array(*[F.lit(a) for a in ages]))).withColumn(day, F.expr("date_sub(origin, age)"))
    return asked.join(df, [*key, day])


def origin_lags(df: DataFrame, origins: DataFrame, key: Sequence[str], day: str, value: str, lags: Sequence[int]) -> DataFrame:
    """Value on origin + 1 - lag, for each origin and lag."""
    met = facts_of_origins(df, origins, key, day, [k - 1 for k in lags])
    picks = [F.max(F.when(F.col("age") == k - 1, F.col(value))).alias(f"lag_{k}") for k in lags]
    return origins.join(met.groupBy(*origins.columns).agg(*picks), origins.columns, "left")


def empirical_baselines(df: DataFrame, origins: DataFrame, key: Sequence[str], day: str, value: str) -> DataFrame:
    """last_observed, moving_average (28 days), median_7 and the last value on the same weekday (seasonal), from facts up to each origin."""
    met, age = facts_of_origins(df, origins, key, day, range(28)), F.col("age")
    return met.groupBy(*origins.columns).agg(
        F.max_by(value, day).alias("last_observed"), F.avg(value).alias("moving_average"), F.median(F.when(age < 7, F.col(value))).alias("median_7"),
        F.max_by(F.when(age % 7 == 6, F.col(value)), F.when(age % 7 == 6, F.col(day))).alias("seasonal"), F.count(value).alias("known"),
    )


def robust_scale(df: DataFrame, group: Sequence[str], residual: str, min_rows: int = 7) -> DataFrame:
    """max(1, 1.4826 MAD) of each group, null with fewer rows: exact medians in two passes, by ranks, so no task holds a group."""
    from asoflow.operators.metrics import quantiles

    middle = quantiles(df, group, residual, {"_m": 0.5}).drop("n")
    apart = df.join(middle, list(group)).select(*group, F.abs(F.col(residual) - F.col("_m")).alias("_d"))
    spread = df.select(*group).distinct().join(quantiles(apart, group, "_d", {"_mad": 0.5}), list(group), "left").fillna(0, ["n"])
    return spread.select(*group, "n", F.when(F.col("n") >= min_rows, F.greatest(F.lit(1.0), F.col("_mad") * 1.4826)).alias("scale"))


def islands(df: DataFrame, key: Sequence[str], day: str, known: str) -> DataFrame:
    """Maximal runs of consecutive days: start, end, days, and when the whole run was known."""
    w = Window.partitionBy(*key).orderBy(day)
    grouped = df.withColumn("_g", F.date_sub(F.col(day), F.row_number().over(w)))
    return grouped.groupBy(*key, "_g").agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count("*").alias("n_days"), F.max(known).alias("known")).drop("_g")


def count_residual(observed: Column, expected: Column, span: Window, min_known: int) -> Column:
    """(sum of observed - expected) / max(1, root of the sum of expected) over the days of a window where both are known."""
    both = observed.isNotNull() & expected.isNotNull()
    gap = F.sum(F.when(both, observed - expected)).over(span)
    base = F.sum(F.when(both, expected)).over(span)
    return F.when(F.count(F.when(both, 1)).over(span) >= min_known, gap / F.greatest(F.lit(1.0), F.sqrt(base)))


def horizons(origins: DataFrame, n: int = 14) -> DataFrame:
    """Each origin with its targets, all under the origin's own cutoff."""
    return origins.withColumn("h", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long")))).withColumn("target", F.expr("date_add(origin, cast(h as int))"))


def membership(df: DataFrame, day: str, train_end: str, tune_end: str, test_end: str, purge: int) -> DataFrame:
    """Role of each row by its day, none in the purge before a boundary."""
    d = F.col(day)

    def before(text: str) -> Column:
        return d <= F.date_sub(F.lit(text).cast("date"), purge)

    role = (
        F.when(before(train_end), "train").when(d <= F.lit(train_end).cast("date"), "purged").when(before(tune_end), "tune")
        .when(d <= F.lit(tune_end).cast("date"), "purged").when(d <= F.lit(test_end).cast("date"), "test").otherwise("outside")
    )
    return df.withColumn("role", role)


def window_tensor(df: DataFrame, origins: DataFrame, key: Sequence[str], day: str, value: str, days: int) -> DataFrame:
    """For each origin the values of its last days, oldest first, each with a flag that it is missing (then 0), in one array."""
    asked = origins.withColumn(day, F.explode(F.sequence(F.date_sub("origin", days - 1), F.col("origin"))))
    rows = asked.join(df, [*key, day], "left").groupBy(*key, "origin").agg(F.sort_array(F.collect_list(F.struct(day, value))).alias("_h"))  # so many days each
    return rows.select(*key, "origin", F.flatten(F.transform("_h", lambda x: F.array(F.coalesce(x[value], F.lit(0.0)), F.when(x[value].isNull(), 1.0).otherwise(0.0)))).alias("tensor"))


def truth_windows(df: DataFrame, key: Sequence[str], day: str, least: int) -> DataFrame:
    """Runs of at least so many days of a series, with their peak and kind: spillover if the product has a run at another place on any of its days, else paired if another channel of the place has, else alone.

    key: product, location, channel. Runs are compared by their days: no run meets all others of its product.
    """
    product, location, channel = key
    w = Window.partitionBy(*key).orderBy(day)
    runs = df.withColumn("_g", F.date_sub(F.col(day), F.row_number().over(w))).groupBy(*key, "_g").agg(F.min(day).alias("start"), F.max(day).alias("end"), F.max("known").alias("known"), F.count("*").alias("n_days"), F.max("units").alias("peak"))
    runs = runs.where(F.col("n_days") >= least).drop("_g")
    days = runs.select(*key, "start", F.explode(F.sequence("start", "end")).alias(day))
    places = days.groupBy(product, day).agg((F.count_distinct(location) > 1).alias("_spills"))
    channels = days.groupBy(product, location, day).agg((F.count_distinct(channel) > 1).alias("_paired"))
    flags = days.join(places, [product, day]).join(channels, [product, location, day]).groupBy(*key, "start").agg(F.bool_or("_spills").alias("_spills"), F.bool_or("_paired").alias("_paired"))
    kind = F.when(F.col("_spills"), "spillover").when(F.col("_paired"), "paired").otherwise("alone")
    return runs.join(flags, [*key, "start"]).withColumn("kind", kind).drop("_spills", "_paired")
