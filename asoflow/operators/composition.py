"""Functional composition: for each head a method with a fitted correction, guarded on two chronological blocks, beside a frozen reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asoflow.operators.metrics import quantiles

HEADS = ("median", "mean")


def _tried(raw: Column, ratio: Column, offset: Column) -> Column:
    return F.greatest(F.lit(0.0), raw * ratio + offset)


def fitted_corrections(first: DataFrame, group: Sequence[str]) -> DataFrame:
    """What the first block says of each method: group, method, place, head, mode, ratio, offset. Mode 0 leaves a forecast alone; mode 1 adds the median residual (median head) or takes
    the ratio of sums, which the caller clips (mean head; the mean outcome where all forecasts are 0).

    first: group, method, place (order of methods), y, raw.
    """
    keys = [*group, "method", "place"]
    shift = quantiles(first.withColumn("_r", F.col("y") - F.col("raw")), keys, "_r", {"shift": 0.5}).drop("n")
    sums = first.groupBy(*keys).agg(F.sum("y").alias("_y"), F.sum("raw").alias("_p"), F.avg("y").alias("_m")).join(shift, keys)
    one, zero = F.lit(1.0), F.lit(0.0)
    scale = F.when(F.col("_p") == 0, one).otherwise(F.try_divide("_y", "_p"))
    options = [
        F.struct(F.lit(head).alias("head"), F.lit(mode).alias("mode"), ratio.alias("ratio"), offset.alias("offset"))
        for head, mode, ratio, offset in (("median", 0, one, zero), ("mean", 0, one, zero), ("median", 1, one, F.col("shift")), ("mean", 1, scale, F.when(F.col("_p") == 0, F.col("_m")).otherwise(zero)))
    ]
    return sums.select(*keys, F.inline(F.array(*options)))


def guarded_selection(rows: DataFrame, group: Sequence[str], baselines: Sequence[str], least_rows: int = 100, clip: tuple[float, float] = (0.8, 1.25), regression: float = 0.02, most_bias: float = 0.05) -> DataFrame:
    """The choice of each group and head: baseline, selected, mode, ratio, offset, reason.

    rows: group, block (1 or 2, one after the other in time), method, place, y, raw; every method on the same rows. The
    baseline is the uncorrected one of `baselines` that costs least in the second block (absolute error for the median, squared for the mean). A
    method, plain or corrected, may take its place if it costs no more in both blocks (for the median up to `regression` more), and for the mean if
    its bias stays within most_bias in both; among those the cheapest in the second block wins, plain before corrected, and a median that isn't
    cheaper than the baseline there is not taken. Groups with fewer rows in either block keep the baseline.

    All methods, corrections, heads and blocks are rows of one aggregation; nothing is fitted in a loop.
    """
    fits = fitted_corrections(rows.where("block = 1"), group)
    fits = fits.withColumn("ratio", F.when((F.col("head") == "mean") & (F.col("mode") == 1) & (F.col("offset") == 0), F.least(F.greatest("ratio", F.lit(clip[0])), F.lit(clip[1]))).otherwise(F.col("ratio")))
    error = _tried(F.col("raw"), F.col("ratio"), F.col("offset")) - F.col("y")
    cost = F.when(F.col("head") == "median", F.abs(error)).otherwise(error * error)
    keys = [*group, "head", "method", "place", "mode", "ratio", "offset"]
    blocks = rows.join(fits, [*group, "method", "place"]).groupBy(*keys, "block").agg(F.count("*").alias("n"), F.round(F.avg(cost), 9).alias("cost"), F.round(F.try_divide(F.sum(error), F.sum("y")), 9).alias("bias"))
    pick = [F.max(F.when(F.col("block") == b, F.col(c))).alias(f"{c}{b}") for b in (1, 2) for c in ("n", "cost", "bias")]
    options = blocks.groupBy(*keys).agg(*pick)
    plain = options.where(F.col("method").isin(*baselines) & (F.col("mode") == 0))
    reference = plain.groupBy(*group, "head").agg(F.min_by(F.struct("method", "cost1", "cost2", "n1", "n2"), F.struct("cost2", "place")).alias("_b"))
    known = options.join(reference, [*group, "head"])
    slack = F.when(F.col("head") == "median", 1 + regression).otherwise(1.0)
    fits_in = [F.col(f"cost{b}") <= F.col(f"_b.cost{b}") * slack for b in (1, 2)]
    unbiased = [F.coalesce(F.abs(f"bias{b}") <= most_bias, F.lit(False)) for b in (1, 2)]
    allowed = fits_in[0] & fits_in[1] & ((F.col("head") == "median") | (unbiased[0] & unbiased[1]))
    choice = known.groupBy(*group, "head").agg(F.first("_b").alias("_b"), F.min_by(F.when(allowed, F.struct("method", "mode", "ratio", "offset", "cost2")), F.when(allowed, F.struct("cost2", "mode", "place"))).alias("_c"))
    few = F.coalesce(F.least("_b.n1", "_b.n2") < least_rows, F.lit(True))
    keeps = few | F.col("_c").isNull() | ((F.col("head") == "median") & (F.col("_c.cost2") >= F.col("_b.cost2")))
    taken = {c: F.when(keeps, other).otherwise(F.col(f"_c.{c}")) for c, other in (("method", F.col("_b.method")), ("mode", F.lit(0)), ("ratio", F.lit(1.0)), ("offset", F.lit(0.0)))}
    same = keeps | ((F.col("_c.method") == F.col("_b.method")) & (F.col("_c.mode") == 0))
    reason = F.when(few, "sparse_fallback").when(same, "baseline_retained").otherwise("guarded_selection")
    return choice.select(*group, "head", F.col("_b.method").alias("baseline"), taken["method"].alias("selected"), taken["mode"].alias("mode"), taken["ratio"].alias("ratio"), taken["offset"].alias("offset"), reason.alias("reason"))


def composed(rows: DataFrame, choice: DataFrame, group: Sequence[str], key: Sequence[str]) -> DataFrame:
    """The forecast of each key from its group's frozen choice: mean, median, and the reference's mean and median. rows: key with one row for each method (method, raw)."""
    met = rows.join(choice, list(group))
    values = []
    for head in HEADS:
        own = F.col("head") == head
        values.append(F.max(F.when(own & (F.col("method") == F.col("selected")), _tried(F.col("raw"), F.col("ratio"), F.col("offset")))).alias(head))
        values.append(F.max(F.when(own & (F.col("method") == F.col("baseline")), F.greatest(F.lit(0.0), F.col("raw")))).alias(f"reference_{head}"))
    return met.groupBy(*group, *[k for k in key if k not in group]).agg(F.first("y").alias("y"), *values)


def weight_grid(bins: DataFrame, group: Sequence[str], weights: Sequence[float], least_rows: int = 100, most_bias: float = 0.05) -> DataFrame:
    """A weight for each group's offset, by closed forms over bins of equal forecasts: group, weight, mse, bias, feasible, chosen.

    bins: group, block (1 or 2), base (forecast), offset (the block's own), n, sy, syy (sums of the outcome and its square). A weight is feasible if both
    blocks have least_rows, neither costs more than weight 0 and both biases are within most_bias; the cheapest feasible one in the second block
    is chosen, ties to the smaller weight, none where none is feasible. mse and bias are those of the second block.
    """
    grid = F.array(*[F.lit(float(w)) for w in weights])
    moved = bins.withColumn("weight", F.explode(grid)).withColumn("_v", F.greatest(F.lit(0.0), F.col("base") + F.col("weight") * F.col("offset")))
    sums = moved.groupBy(*group, "weight", "block").agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum(F.col("_v") * F.col("n")).alias("sp"), F.sum(F.col("syy") - 2 * F.col("_v") * F.col("sy") + F.col("_v") * F.col("_v") * F.col("n")).alias("sse"))
    each = sums.select(*group, "weight", "block", "n", F.round(F.col("sse") / F.col("n"), 6).alias("mse"), F.round(F.try_divide(F.col("sp") - F.col("sy"), F.col("sy")), 9).alias("bias"), ((F.col("sy") == 0) & (F.col("sp") == 0)).alias("idle"))
    none = each.where("weight = 0").select(*group, "block", F.col("mse").alias("_base"))
    joined = each.join(none, [*group, "block"])
    ok = (F.col("n") >= least_rows) & (F.col("mse") <= F.col("_base")) & F.coalesce(F.abs("bias") <= most_bias, F.col("idle"))
    both = joined.groupBy(*group, "weight").agg(F.max(F.when(F.col("block") == 2, F.col("mse"))).alias("mse"), F.max(F.when(F.col("block") == 2, F.col("bias"))).alias("bias"), (F.count_if(ok) == 2).alias("feasible"))
    best = both.where("feasible").groupBy(*group).agg(F.min_by("weight", F.struct("mse", "weight")).alias("_w"))
    return both.join(best, list(group), "left").withColumn("chosen", F.coalesce(F.col("weight") == F.col("_w"), F.lit(False))).drop("_w")
