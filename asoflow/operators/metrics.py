"""Metrics that are complete or null, order statistics, classification scores, gates and resampling."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asoflow.sources.scratch import written

_BUCKETS = 64


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal keys, where nulls are equal; one row if there are no keys."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    rule = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, rule).drop(*[f"_r_{k}" for k in keys])


def running_sums(cells: DataFrame, group: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    """cells (one row for each distinct value of a group) with, for each of sums, upto_ and total_: its sum over the values up to the row's own, and over the group.

    The values of a group are cut at its approximate quantiles into buckets; a window sorts a bucket, and only the
    buckets' sums meet per group. Which cuts are taken doesn't change the result, as long as they are taken once.
    """
    shares = [k / _BUCKETS for k in range(1, _BUCKETS)]
    cells = written(cells)  # read three times
    cuts = written(cells.groupBy(*group).agg(F.percentile_approx(value, shares, 1000).alias("_cuts")))  # a short list for each group; approximate, so another run may cut elsewhere, and both readers below need the same
    placed = _joined(cells, cuts, group).withColumn("_b", F.size(F.filter("_cuts", lambda x: x < F.col(value)))).drop("_cuts")
    whole = Window.partitionBy(*group)
    held = placed.groupBy(*group, "_b").agg(*[F.sum(s).alias(f"_s_{s}") for s in sums])
    upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = held.select(*group, "_b", *[(F.sum(f"_s_{s}").over(upto) - F.col(f"_s_{s}")).alias(f"_skip_{s}") for s in sums], *[F.sum(f"_s_{s}").over(whole).alias(f"total_{s}") for s in sums])
    inside = Window.partitionBy(*group, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = _joined(placed, held, [*group, "_b"]).withColumns({f"upto_{s}": F.col(f"_skip_{s}") + F.sum(s).over(inside) for s in sums})
    return out.drop("_b", *[f"_skip_{s}" for s in sums])


def cumulative(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """The distinct values of each group (nulls don't count) with n, their rows, upto, the rows up to the value, and total. Equal values are one row before anything is sorted."""
    cells = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    return running_sums(cells, group, value, ["n"]).withColumnsRenamed({"upto_n": "upto", "total_n": "total"})


def order_statistic(df: DataFrame, group: Sequence[str], value: str, rank: Callable[[Column], Column]) -> DataFrame:
    """The rank(n)-th smallest value of each group of n, null if there is none, and n."""
    found = cumulative(df, group, value)
    reached = F.when((rank(F.col("total")) >= 1) & (F.col("upto") >= rank(F.col("total"))), F.col(value))
    return found.groupBy(*group).agg(F.max("total").alias("n"), F.min(reached).alias("statistic"))


def quantiles(df: DataFrame, group: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Each group's n and its quantiles (name -> share), linear between two neighbours, by exact ranks; nulls don't count, and a group without values has no row."""
    found = cumulative(df, group, value)
    picks = []
    for name, q in wanted.items():
        place = F.lit(q) * (F.col("total") - 1)
        low, high = (F.min(F.when(F.col("upto") >= f(place) + 1, F.col(value))) for f in (F.floor, F.ceil))
        part = F.max(place - F.floor(place))
        picks.append((low + (high - low) * part).alias(name))
    return found.groupBy(*group).agg(F.max("total").alias("n"), *picks)


def ranked_down(df: DataFrame, group: Sequence[str], score: str, tie: str) -> DataFrame:
    """Adds rank, the place of each row of its group by falling score and then rising tie, and n; rows without a score go. A window holds the rows of one score."""
    found = cumulative(df, group, score).select(*group, score, (F.col("total") - F.col("upto")).alias("_above"), F.col("total").alias("n"))
    place = F.row_number().over(Window.partitionBy(*group, score).orderBy(tie))
    return _joined(df, found, [*group, score]).withColumn("rank", F.col("_above") + place).drop("_above")


def capacity_threshold(df: DataFrame, group: Sequence[str], score: str, share: float) -> DataFrame:
    """The score that at most floor(n * share) rows of a group exceed."""
    return order_statistic(df, group, score, lambda n: n - F.floor(n * share)).select(*group, F.col("statistic").alias("threshold"), "n")


def capacity_cuts(df: DataFrame, group: Sequence[str], score: str, alerts: float, high: float, least_rows: int) -> DataFrame:
    """Two cuts of each group by exact ranks: n, allowed_alerts and allowed_high (floor(n * share)), threshold and high_threshold, the scores that at most so many rows exceed; both null with fewer than least_rows. Without a group it is the census over all rows. Rows without a score don't count."""
    found = cumulative(df, group, score)
    allowed = {name: F.floor(F.round(F.col("total") * share, 9)) for name, share in (("alerts", alerts), ("high", high))}
    cut = {name: F.min(F.when(F.col("upto") >= F.col("total") - a, F.col(score))) for name, a in allowed.items()}
    out = found.groupBy(*group).agg(F.max("total").alias("n"), *[F.max(a).cast("long").alias(f"allowed_{k}") for k, a in allowed.items()], cut["alerts"].alias("threshold"), cut["high"].alias("high_threshold"))
    enough = F.col("n") >= least_rows
    return out.withColumns({c: F.when(enough, F.col(c)) for c in ("threshold", "high_threshold")})


def observation_report(df: DataFrame, group: Sequence[str], alert: str, high: str, truth: str, score: str) -> DataFrame:
    """Precision, recall, false alerts per 1000 clean rows, precision of high severity and average precision of each group, a row each: metric, value, unit, numerator, denominator, n_total, n_evaluable, coverage, status and the reason why it isn't evaluable.

    alert, high and truth are booleans; rows whose truth is null are requested, but not evaluable. Numerators are null for the average precision.
    """
    seen = F.col(truth).isNotNull()
    hits = {"alerts": F.col(alert), "positives": F.col(truth), "caught": F.col(alert) & F.col(truth), "severe": F.col(high), "severe_caught": F.col(high) & F.col(truth)}
    sums = df.groupBy(*group).agg(F.count("*").alias("n_total"), F.count_if(seen).alias("n_evaluable"), *[F.count_if(seen & x).alias(c) for c, x in hits.items()])
    judged = df.where(seen).select(*group, F.col(score).alias("_s"), F.col(truth).cast("long").alias("_y"))
    precise = average_precision(judged, group, "_s", "_y").select(*group, F.col("average_precision").alias("_ap"))
    sums = sums.join(precise, list(group), "left") if group else sums.crossJoin(precise)  # one row each
    c = {name: F.col(name).cast("long") for name in ("n_total", "n_evaluable", *hits)}
    clean = c["n_evaluable"] - c["positives"]
    none = F.lit(None).cast("long")
    wanted = (
        ("precision", c["caught"], c["alerts"], 1, "ratio", "no_positive_predictions"), ("recall", c["caught"], c["positives"], 1, "ratio", "no_truth_positives"),
        ("false_alerts_per_1000", c["alerts"] - c["caught"], clean, 1000, "alerts_per_1000_clean_observations", "no_evaluable_clean_observations"),
        ("high_severity_precision", c["severe_caught"], c["severe"], 1, "ratio", "no_high_severity_predictions"),
    )
    rows = [
        F.struct(F.lit(name).alias("metric"), F.round(F.try_divide(a * times, b), 6).alias("value"), F.lit(unit).alias("unit"), a.alias("numerator"), b.alias("denominator"), F.when(b == 0, reason).alias("reason"))
        for name, a, b, times, unit, reason in wanted
    ]
    rows.append(F.struct(F.lit("average_precision").alias("metric"), F.col("_ap").alias("value"), F.lit("ratio").alias("unit"), none.alias("numerator"), none.alias("denominator"), F.when(F.col("_ap").isNull(), "both_truth_classes_required").alias("reason")))
    out = sums.select(*group, "n_total", "n_evaluable", F.round(F.try_divide("n_evaluable", "n_total"), 6).alias("coverage"), F.inline(F.array(*rows)))
    return out.withColumn("status", F.when(F.col("reason").isNull(), "evaluable").otherwise("not_evaluable"))


def point_sums(y: str = "y", p: str = "p") -> list[Column]:
    """Sufficient statistics of forecasts p against outcomes y; only rows with an outcome count, and sums merge over any partitioning."""
    there = F.col(y).isNotNull()
    both = there & F.col(p).isNotNull()
    e = F.when(both, F.col(p) - F.col(y))
    return [
        F.count_if(there).alias("n"), F.count_if(both).alias("n_predicted"), F.sum(F.abs(e)).alias("s_abs"), F.sum(e * e).alias("s_sq"), F.sum(e).alias("s_e"),
        F.sum(F.when(both, F.col(y))).alias("s_y"), F.sum(F.when(both & (F.col(y) == 0), F.col(p))).alias("s_zero"),
        F.count_if(both & (F.col(p) > F.col(y))).alias("n_over"), F.count_if(both & (F.col(p) < F.col(y))).alias("n_under"),
        F.sum(F.when(both & (F.col(y) > 0), F.abs(e) / F.col(y))).alias("s_ape"), F.count_if(both & (F.col(y) > 0)).alias("n_positive"),
    ]


SUMS = ("n", "n_predicted", "s_abs", "s_sq", "s_e", "s_y", "s_zero", "n_over", "n_under", "s_ape", "n_positive")


def point_metrics(sums: DataFrame, digits: int = 6) -> DataFrame:
    """Metrics from the sums: null unless every row with an outcome has a forecast, ratios null at a zero denominator."""
    full = (F.col("n") > 0) & (F.col("n") == F.col("n_predicted"))

    def m(x: Column) -> Column:
        return F.round(F.when(full, x), digits)

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) != 0, F.col(a) / F.col(b))

    return sums.withColumns(
        {
            "mae": m(ratio("s_abs", "n")), "mse": m(ratio("s_sq", "n")), "rmse": m(F.sqrt(ratio("s_sq", "n"))), "bias": m(ratio("s_e", "n")), "normalized_bias": m(ratio("s_e", "s_y")),
            "wape": m(ratio("s_abs", "s_y")), "zero_excess": m(F.coalesce("s_zero", F.lit(0.0))), "mape": m(ratio("s_ape", "n_positive")), "prediction_coverage": F.round(ratio("n_predicted", "n"), digits),
        }
    ).drop("s_abs", "s_sq", "s_e", "s_y", "s_zero", "s_ape")


def merged(sums: DataFrame, group: Sequence[str]) -> DataFrame:
    """Sums of cells added up to coarser groups."""
    return sums.groupBy(*group).agg(*[F.sum(c).alias(c) for c in SUMS])


def by_dimensions(cells: DataFrame, dimensions: Sequence[str], required: DataFrame | None = None) -> DataFrame:
    """Margins of cell sums for all rows and for each dimension, as (dimension, value): cells are summed once, then added up. Required groups without rows are kept, with zero counts."""
    tags = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in dimensions])
    out = merged(cells.select(*SUMS, F.inline(tags)), ["dimension", "value"])
    if required is not None:
        out = required.join(out, ["dimension", "value"], "left").fillna(0, ["n", "n_predicted"])
    return out


def interval_metrics(df: DataFrame, group: Sequence[str], y: str, low: str, high: str, coverage: float) -> DataFrame:
    from asoflow.functions.columns import interval_score

    there = F.col(y).isNotNull()
    both = there & F.col(low).isNotNull() & F.col(high).isNotNull()
    full = F.count_if(there) == F.count_if(both)
    inside = ((F.col(y) >= F.col(low)) & (F.col(y) <= F.col(high))).cast("int")
    return df.groupBy(*group).agg(
        F.count_if(there).alias("n"), F.round(F.when(full, F.avg(F.when(both, inside))), 6).alias("coverage"), F.round(F.when(full, F.avg(F.when(both, F.col(high) - F.col(low)))), 6).alias("mean_width"),
        F.round(F.when(full, F.avg(F.when(both, interval_score(F.col(y), F.col(low), F.col(high), coverage)))), 6).alias("mean_score"),
    )


def residual_quantile(df: DataFrame, group: Sequence[str], residual: Column, coverage: float, min_rows: int) -> DataFrame:
    """Split-conformal quantile: the ceil((n + 1) * coverage)-th smallest residual of each group; not ready with fewer rows or an unattainable rank."""
    rank = lambda n: F.ceil(F.round((n + 1) * coverage, 9))
    picked = order_statistic(df.select(*group, residual.alias("_r")), group, "_r", rank)
    ready = (F.col("n") >= min_rows) & (rank(F.col("n")) <= F.col("n"))
    return picked.select(*group, "n", F.when(ready, F.col("statistic")).alias("quantile"), F.when(ready, "ready").otherwise("not_ready").alias("status"))


def _fallback(groups: DataFrame, levels: Sequence[Sequence[str]], found: Sequence[DataFrame], ready: Column, columns: Sequence[str]) -> DataFrame:
    """For each group of the finest level, the columns of the first level that is ready, and which it is; nulls if none is."""
    out, picks = groups, []
    for k, (level, stats) in enumerate(zip(levels, found, strict=True)):
        stats = stats.withColumn(f"_l{k}", F.when(ready, F.struct(*columns, F.lit(k).alias("level")))).select(*level, f"_l{k}")
        if level:
            other = stats.select(*[F.col(c).alias(f"_r_{c}") for c in level], f"_l{k}")
            out = out.join(other, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in level]), "left").drop(*[f"_r_{c}" for c in level])
        else:
            out = out.crossJoin(F.broadcast(stats))  # one row
        picks.append(F.col(f"_l{k}"))
    return out.withColumn("_f", F.coalesce(*picks)).select(*groups.columns, *[F.col(f"_f.{c}").alias(c) for c in columns], "_f.level")


def endpoint_shift(df: DataFrame, levels: Sequence[Sequence[str]], y: str, low: str, high: str, tail: float, min_rows: int) -> DataFrame:
    """How far the ends of forecast bands are to be shifted, for each group of the finest level.

    lower_shift is the floor((n + 1) * tail)-th smallest y - low, upper_shift the
    ceil((n + 1) * (1 - tail))-th smallest y - high of the finest pool, from the levels in order (the last
    may be all rows), that has min_rows rows, all with a band, and both ranks. Where no pool has, the shifts and level are null.
    """
    rows = df.where(F.col(y).isNotNull()).withColumns({"_lo": F.col(y) - F.col(low), "_hi": F.col(y) - F.col(high)})
    first, last = lambda n: F.floor(F.round((n + 1) * tail, 9)), lambda n: F.ceil(F.round((n + 1) * (1 - tail), 9))
    found = []
    for level in levels:
        sizes = rows.groupBy(*level).agg(F.count("*").alias("rows"), F.count_if(F.col("_lo").isNull() | F.col("_hi").isNull()).alias("without"))
        a = order_statistic(rows, level, "_lo", first).select(*level, F.col("statistic").alias("lower_shift"))
        b = order_statistic(rows, level, "_hi", last).select(*level, F.col("statistic").alias("upper_shift"))
        found.append(_joined(_joined(sizes, a, level), b, level))
    n = F.col("rows")
    ready = (n >= min_rows) & (F.col("without") == 0) & (first(n) >= 1) & (last(n) <= n)
    return _fallback(rows.select(*levels[0]).distinct(), levels, found, ready, ["lower_shift", "upper_shift", "rows"])


def shortest_band(df: DataFrame, group: Sequence[str], residual: str, coverage: float) -> DataFrame:
    """The shortest window of sorted residuals that holds ceil((n + 1) * coverage) of them (all, if that is more): n, low, high; ties to the lowest.

    For each distinct residual as lower end the upper end is the value at a later rank; values are found by
    slices of ranks, a few thousand to a group, so that no task holds a group.
    """
    cells = cumulative(df, group, residual).withColumns({"_first": F.col("upto") - F.col("n") + 1, "_slice": F.ceil(F.col("total") / 4096)})
    need = F.least(F.col("total"), F.ceil(F.round((F.col("total") + 1) * coverage, 9)))
    lows = cells.withColumn("_end", F.col("_first") + need - 1).where(F.col("_end") <= F.col("total"))
    lows = lows.select(*group, "total", F.col(residual).alias("low"), "_end", F.floor(F.col("_end") / F.col("_slice")).alias("_at"))
    spans = F.sequence(F.floor(F.col("_first") / F.col("_slice")), F.floor(F.col("upto") / F.col("_slice")))
    highs = cells.select(*group, F.col(residual).alias("high"), "_first", "upto", F.explode(spans).alias("_at"))
    met = _joined(lows, highs, [*group, "_at"]).where((F.col("_first") <= F.col("_end")) & (F.col("_end") <= F.col("upto")))
    width = F.round(F.col("high") - F.col("low"), 9)
    best = met.groupBy(*group).agg(F.max("total").alias("n"), F.min(F.struct(width.alias("w"), "low", "high")).alias("_b"))
    return best.select(*group, "n", F.col("_b.low").alias("low"), F.col("_b.high").alias("high"))


def signed_band(df: DataFrame, levels: Sequence[Sequence[str]], y: str, p: str, coverage: float, min_rows: int) -> DataFrame:
    """The shortest band of signed residuals, scaled by the root of the forecast (0.5 at least), of the finest pool with min_rows rows: low, high and level for each group of the finest level."""
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    rows = rows.withColumn("_r", F.round((F.col(y) - F.col(p)) / F.greatest(F.lit(0.5), F.sqrt(F.greatest(F.col(p), F.lit(0.0)))), 6))
    found = [shortest_band(rows, level, "_r", coverage) for level in levels]
    return _fallback(rows.select(*levels[0]).distinct(), levels, found, F.col("n") >= min_rows, ["low", "high", "n"])


def confusion(predicted: Column, y: Column, false_alarm: float = 1.0, miss: float = 5.0) -> list[Column]:
    tp, fp, fn = (F.count_if(predicted & (y == 1)), F.count_if(predicted & (y == 0)), F.count_if(~predicted & (y == 1)))
    return [
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.count_if(~predicted & (y == 0)).alias("tn"), F.round(F.try_divide(tp, tp + fp), 6).alias("precision"),
        F.round(F.try_divide(tp, tp + fn), 6).alias("recall"), (fp * false_alarm + fn * miss).alias("cost"),
    ]


def average_precision(df: DataFrame, group: Sequence[str], p: str, y: str, digits: int = 6) -> DataFrame:
    """Sum of recall steps times precision over distinct scores, ties taken together; null unless both classes are there. No window spans a group's scores."""
    ties = df.groupBy(*group, p).agg(F.sum(y).alias("_t"), F.count("*").alias("_n"))
    steps = running_sums(ties, group, p, ["_t", "_n"])
    above = {c: F.col(f"total_{c}") - F.col(f"upto_{c}") + F.col(c) for c in ("_t", "_n")}
    sums = steps.groupBy(*group).agg(F.sum("_t").alias("n_positive"), F.sum("_n").alias("n"), F.sum(F.col("_t") * above["_t"] / above["_n"]).alias("_s"))
    both = (F.col("n_positive") > 0) & (F.col("n_positive") < F.col("n"))
    return sums.select(*group, "n", "n_positive", F.round(F.when(both, F.col("_s") / F.col("n_positive")), digits).alias("average_precision"))


def roc_auc(df: DataFrame, group: Sequence[str], p: str, y: str) -> DataFrame:
    """Exact rank statistic: ties count half. Works on distinct scores, not on pairs; no window spans a group's scores."""
    ties = df.groupBy(*group, p).agg(F.sum(y).alias("_t"), F.sum(1 - F.col(y)).alias("_f"))
    steps = running_sums(ties, group, p, ["_f"])
    sums = steps.groupBy(*group).agg(F.sum("_t").alias("n_positive"), F.sum("_f").alias("n_negative"), F.sum(F.col("_t") * (F.col("upto__f") - F.col("_f") / 2)).alias("_s"))
    return sums.select(*group, "n_positive", "n_negative", F.round(F.try_divide(F.col("_s"), F.col("n_positive") * F.col("n_negative")), 6).alias("roc_auc"))


def brier(df: DataFrame, group: Sequence[str], p: str, y: str) -> DataFrame:
    rate = F.avg(y)
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.round(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))), 6).alias("brier"), F.round(rate, 6).alias("prevalence"), F.round(rate * (1 - rate), 6).alias("constant_brier"))


def reliability(df: DataFrame, group: Sequence[str], p: str, y: str, bins: int = 5, digits: int = 6) -> DataFrame:
    """Bins of equal width: rows, mean probability, rate, and gap, the bin's part of the expected calibration error."""
    from asoflow.functions.columns import reliability_bin

    own = df.groupBy(*group, reliability_bin(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("_p"), F.avg(F.col(y).cast("double")).alias("_y"))
    total = F.sum("n").over(Window.partitionBy(*group))
    return own.select(*group, "bin", "n", F.round("_p", 6).alias("mean_p"), F.round("_y", 6).alias("rate"), F.round(F.abs(F.col("_p") - F.col("_y")) * F.col("n") / total, digits).alias("gap"))


def top_k_per_origin(df: DataFrame, group: Sequence[str], score: str, tie: str, share: float) -> DataFrame:
    """The first ceil(n * share) rows of each group by falling score, then tie, with their rank."""
    ranked = ranked_down(df, group, score, tie)
    return ranked.where(F.col("rank") <= F.ceil(F.round(F.col("n") * share, 9))).drop("n")


def poisson_steps(most: int = 11) -> list[float]:
    """Bounds of a uniform draw at which a Poisson(1) number goes up by one."""
    steps, total, term = [], 0.0, 0.36787944117144233
    for k in range(1, most + 1):
        total += term
        steps.append(total)
        term /= k
    return steps


def cluster_bootstrap(cells: DataFrame, cluster: Sequence[str], numerator: str, denominator: str, replicates: int, coverage: float = 0.95, min_clusters: int = 10, seed: int = 42) -> DataFrame:
    """Interval of a ratio of sums when whole clusters are drawn with replacement.

    Each cluster's multiplicity in a replicate is a Poisson(1) draw of its own hash, which is
    what drawing with replacement tends to with many clusters: no replicate has to number the clusters, and the sums of all replicates
    are one aggregation with map-side partial sums. One row: estimate, low, high, clusters, valid replicates; the interval is
    null with too few clusters or any replicate without a denominator.
    """
    sums = cells.groupBy(*cluster).agg(F.sum(numerator).alias("_a"), F.sum(denominator).alias("_b"))
    whole = sums.agg(F.sum("_a").alias("a"), F.sum("_b").alias("b"), F.count("*").alias("clusters"))
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in cluster], F.col("rep").cast("string"), F.lit(str(seed)))
    u = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / float(1 << 32)
    times = reduce(lambda x, y: x + y, [F.when(u >= t, 1).otherwise(0) for t in poisson_steps()])
    drawn = sums.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_m", times)
    reps = drawn.groupBy("rep").agg(F.sum(F.col("_a") * F.col("_m")).alias("a"), F.sum(F.col("_b") * F.col("_m")).alias("b")).withColumn("ratio", F.try_divide("a", "b"))
    tail = (1 - coverage) / 2
    limits = reps.agg(F.percentile("ratio", tail).alias("low"), F.percentile("ratio", 1 - tail).alias("high"), F.count("ratio").alias("valid"))
    ok = (F.col("clusters") >= min_clusters) & (F.col("valid") == replicates)
    return whole.crossJoin(limits).select(F.round(F.try_divide("a", "b"), 6).alias("estimate"), F.round(F.when(ok, F.col("low")), 6).alias("low"), F.round(F.when(ok, F.col("high")), 6).alias("high"), "clusters", "valid")


def shrunk_offsets(df: DataFrame, parent: Sequence[str], child: Sequence[str], residual: str, target: str, alpha: float) -> DataFrame:
    """Mean residual of each child group drawn towards its parent's, with weight n / (n + alpha), n its distinct targets."""
    top = df.groupBy(*parent).agg(F.avg(residual).alias("_top")) if parent else df.agg(F.avg(residual).alias("_top"))
    low = df.groupBy(*parent, *child).agg(F.avg(residual).alias("_own"), F.countDistinct(target).alias("n_targets"))
    joined = low.join(top, list(parent)) if parent else low.crossJoin(F.broadcast(top))
    w = F.col("n_targets") / (F.col("n_targets") + alpha)
    return joined.select(*parent, *child, "n_targets", F.round(w * F.col("_own") + (1 - w) * F.col("_top"), 6).alias("offset"))


def best_candidate(df: DataFrame, group: Sequence[str], metric: str, name: str, baseline: str, improvement: float) -> DataFrame:
    """The candidate of the least metric (ties by name); the baseline stays unless that is better by the given share."""
    picked = df.groupBy(*group).agg(F.min(F.struct(metric, name)).alias("_best"), F.max(F.when(F.col(name) == baseline, F.col(metric))).alias("_base"))
    wins = F.col(f"_best.{metric}") <= F.col("_base") * (1 - improvement)
    return picked.select(*group, F.when(wins | F.col("_base").isNull(), F.col(f"_best.{name}")).otherwise(F.lit(baseline)).alias("chosen"), F.round(f"_best.{metric}", 6).alias("best_metric"))


def gates(df: DataFrame, failed: Sequence[tuple[Column, str]], unavailable: Sequence[tuple[Column, str]] = ()) -> DataFrame:
    """verdict passed, failed or not_ready, with all failed_reasons and not_ready_reasons; what isn't ready isn't failed. A rule that is null doesn't hold."""
    from asoflow.functions.columns import all_reasons

    out = df.withColumns({"failed_reasons": F.concat_ws(",", all_reasons(failed)), "not_ready_reasons": F.concat_ws(",", all_reasons(unavailable)) if unavailable else F.lit("")})
    return out.withColumn("verdict", F.when(F.col("not_ready_reasons") != "", "not_ready").when(F.col("failed_reasons") != "", "failed").otherwise("passed"))


def risk_gates(scores: DataFrame, required: Sequence[str], least: int = 50, least_class: int = 10, most_ece: float = 0.2) -> DataFrame:
    """Gates of a risk model over all rows and by segment (column segment; p, y): average precision above prevalence, Brier score below that of the constant rate of all rows, calibration error within its budget. A required segment that is missing or small is not ready."""
    tags = F.array(F.struct(F.lit("all").alias("_s")), F.struct(F.concat(F.lit("segment:"), "segment").alias("_s")))
    g = scores.select("p", "y", F.inline(tags)).where("_s is not null").withColumnRenamed("_s", "segment").crossJoin(F.broadcast(scores.agg(F.avg("y").alias("rate"))))  # one row
    own = g.groupBy("segment").agg(
        F.count("*").alias("n"), F.sum("y").alias("n_positive"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"), F.avg("y").alias("prevalence"),
        F.avg((F.col("rate") - F.col("y")) * (F.col("rate") - F.col("y"))).alias("constant"),
    )
    ap = average_precision(g, ["segment"], "p", "y", digits=12).select("segment", "average_precision")
    ece = reliability(g, ["segment"], "p", "y", digits=12).groupBy("segment").agg(F.sum("gap").alias("ece"))
    wanted = scores.sparkSession.createDataFrame([("all",), *[(s,) for s in required]], "segment string")
    m = wanted.join(own, "segment", "left").join(ap, "segment", "left").join(ece, "segment", "left")
    few = (F.col("n") < least) | (F.col("n_positive") < least_class) | (F.col("n") - F.col("n_positive") < least_class)
    failed = [(F.col("average_precision") <= F.col("prevalence"), "no_skill"), (F.col("brier") >= F.col("constant"), "brier"), (F.col("ece") > most_ece, "calibration")]
    out = gates(m, failed, [(F.col("n").isNull(), "required_segment_missing"), (few, "insufficient_support")])
    return out.select("segment", F.coalesce("n", F.lit(0)).alias("n"), "not_ready_reasons", "failed_reasons", "verdict")


def capacity_queue(df: DataFrame, p: str, tie: str, share: float) -> DataFrame:
    """Adds taken: whether a row is among the first ceil(n * share) of all rows by (-p, tie).

    The place in the whole is the rank inside the row's bucket of scores plus the rows of the
    buckets above: scores lie in [0, 1], are cut into 4096 buckets, and only the buckets' counts
    meet in one task.
    """
    bucketed = df.withColumn("_b", F.floor(F.col(p) * 4096))
    counts = bucketed.groupBy("_b").agg(F.count("*").alias("_c"))
    above = Window.orderBy(F.desc("_b"))
    counts = counts.select("_b", (F.sum("_c").over(above.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_c")).alias("_above"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    placed = bucketed.join(F.broadcast(counts), "_b").withColumn("_k", F.row_number().over(Window.partitionBy("_b").orderBy(F.desc(p), tie)))  # 4097 buckets at most
    return placed.withColumn("taken", F.col("_above") + F.col("_k") <= F.ceil(F.round(F.col("_n") * share, 9))).drop("_b", "_above", "_n", "_k")


def final_report(queue: DataFrame, dimensions: Sequence[str], wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """One frozen queue (taken, p, y) by dimension and value: rows, what the queue takes, recall, Brier score, and a gate against the group's constant rate. Wanted groups that are empty or of one class are not_evaluable."""
    tags = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in dimensions])
    e = F.col("p") - F.col("y")
    m = queue.select("taken", "p", "y", F.inline(tags)).groupBy("dimension", "value").agg(
        F.count("*").alias("n"), F.count_if(F.col("taken")).alias("n_taken"), F.count_if(F.col("taken") & (F.col("y") == 1)).alias("tp"), F.sum("y").alias("_y"), F.avg(e * e).alias("_b"), F.avg("y").alias("_r"),
    )
    asked = queue.sparkSession.createDataFrame(list(wanted), "dimension string, value string")
    gate = F.when(F.col("n").isNull() | (F.col("_y") == 0) | (F.col("_y") == F.col("n")), "not_evaluable").when(F.col("_b") >= F.col("_r") * (1 - F.col("_r")), "failed").otherwise("passed")
    out = asked.join(m, ["dimension", "value"], "left")
    return out.select("dimension", "value", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_taken", "tp")], F.round(F.try_divide("tp", "_y"), 6).alias("recall"), F.round("_b", 6).alias("brier"), gate.alias("gate"))
