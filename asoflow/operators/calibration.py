"""Ridge logistic fits of many candidates at once, joint conditional calibration, and selection over the fits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MOST_VALUES = 32  # of a category or location


@dataclass(frozen=True)
class Candidate:
    """Columns whose weights are drawn to zero by C (as 0.5 * w.w + C * loss), beside a free intercept."""

    name: str
    C: float
    columns: tuple[str, ...]


def ridge_logistic(df: DataFrame, label: str, candidates: Sequence[Candidate], steps: int = 60, tolerance: float = 1e-9) -> list[np.ndarray]:
    """Intercept and weights of each candidate, by Newton steps.

    A step is one pass for all candidates: every task sums each one's gradient, Gram matrix and loss over its rows, and a groupBy adds the
    tasks' sums up. What reaches the driver is a Gram matrix a candidate. A step that raises the loss is halved.
    """
    names = list(dict.fromkeys(c for k in candidates for c in k.columns))
    data = df.select(F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(names)]).persist()
    picks = [np.array([names.index(c) for c in k.columns], int) for k in candidates]
    weights = [np.zeros(len(k.columns) + 1) for k in candidates]

    def passed(at: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [np.zeros((len(w) + 1, len(w) + 1)) for w in at]
            for batch in batches:
                y = batch.column(0).to_numpy()
                x = np.stack([batch.column(k + 1).to_numpy() for k in range(len(names))], axis=1) if names else np.zeros((len(y), 0))
                for own, w, pick in zip(held, at, picks, strict=True):
                    z = np.concatenate([np.ones((len(y), 1)), x[:, pick]], axis=1)
                    m = z @ w
                    p = np.where(m >= 0, 1 / (1 + np.exp(-np.abs(m))), np.exp(-np.abs(m)) / (1 + np.exp(-np.abs(m))))
                    own[0, 0] += np.logaddexp(0, m).sum() - y @ m
                    own[0, 1:] += z.T @ (y - p)
                    own[1:, 1:] += (z * (p * (1 - p))[:, None]).T @ z
            for k, own in enumerate(held):
                flat = own.reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), k)), pa.array(np.arange(len(flat))), pa.array(flat)], ["k", "cell", "s"])

        out = [np.zeros((len(w) + 1) ** 2) for w in at]
        for r in data.mapInArrow(run, "k long, cell long, s double").groupBy("k", "cell").agg(F.sum("s").alias("s")).collect():
            out[r["k"]][r["cell"]] = r["s"]
        found = []
        for flat, w, c in zip(out, at, candidates, strict=True):
            own = flat.reshape(len(w) + 1, -1)
            free = np.concatenate([[0.0], np.full(len(w) - 1, 1 / c.C)])
            found.append((own[0, 0] + 0.5 * float(free @ w**2), own[0, 1:] - free * w, own[1:, 1:] + np.diag(free)))
        return found

    now, move, done = passed(weights), [np.zeros_like(w) for w in weights], [False] * len(weights)
    fresh = [True] * len(weights)
    for _ in range(steps):
        for k, (_, gradient, hessian) in enumerate(now):
            if fresh[k]:
                done[k] = bool(np.abs(gradient).max() <= tolerance * max(1.0, np.abs(np.diag(hessian)).max()))
                move[k] = np.zeros_like(gradient) if done[k] else np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        if all(done):
            break
        tried = [w + m for w, m in zip(weights, move, strict=True)]
        after = passed(tried)
        for k in range(len(weights)):
            fresh[k] = after[k][0] <= now[k][0] + 1e-9 * abs(now[k][0])
            if fresh[k]:
                weights[k], now[k] = tried[k], after[k]
            else:
                move[k] = move[k] / 2
    data.unpersist()
    return weights


@dataclass(frozen=True)
class Conditional:
    """A sigmoid of slope * raw plus offsets of category, location and constraint, fitted jointly."""

    slope: float
    intercept: float
    categories: dict[str, float]
    locations: dict[str, float]
    constrained: float

    def margin(self, raw: str, category: str, location: str, constrained: str) -> Column:
        """Values that the fit didn't see have no offset."""
        offsets = [_looked_up(F.col(c).cast("string"), known) for c, known in ((category, self.categories), (location, self.locations))]
        return F.col(raw) * self.slope + self.intercept + offsets[0] + offsets[1] + F.coalesce(F.col(constrained).cast("double"), F.lit(0.0)) * self.constrained

    def predict(self, df: DataFrame, raw: str, category: str, location: str, constrained: str, name: str = "p") -> DataFrame:
        from asoflow.functions.columns import stable_sigmoid

        return df.withColumn(name, stable_sigmoid(self.margin(raw, category, location, constrained)))


def _looked_up(key: Column, known: dict[str, float]) -> Column:
    return F.coalesce(*[F.when(key == name, F.lit(value)) for name, value in sorted(known.items())], F.lit(0.0))


def fit_conditional(df: DataFrame, label: str, raws: dict[str, str], category: str, location: str, constrained: str, grid: Sequence[float] = (0.01, 0.1, 1.0, 10.0), least_per_class: int = 10) -> tuple[dict[tuple[str, float], Conditional], dict[tuple[str, float], str]]:
    """Calibrators of every base model (name -> column of its raw score) and every C of the grid, fitted in the same passes, and the rejected ones with the reason.

    A calibrator is a ridge logistic fit on the raw score, an indicator of each category and each location and the constraint. Its
    slope must be above zero, so that it keeps the order of scores within a group. There must be least_per_class rows
    of both classes, and at most 32 categories and 32 locations: they make the model's size.
    """
    counts = {int(r[label]): r["count"] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if min(counts.get(0, 0), counts.get(1, 0)) < least_per_class:
        raise ValueError("too few rows of a class to calibrate")
    values = [sorted(r["v"] for r in df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("v")).distinct().limit(_MOST_VALUES + 1).collect()) for c in (category, location)]
    if max(map(len, values)) > _MOST_VALUES:
        raise ValueError("too many categories or locations")
    coded = df.where(F.col(label).isNotNull()).withColumns(
        {f"_c{k}": F.coalesce((F.col(category).cast("string") == v).cast("double"), F.lit(0.0)) for k, v in enumerate(values[0])}
        | {f"_l{k}": F.coalesce((F.col(location).cast("string") == v).cast("double"), F.lit(0.0)) for k, v in enumerate(values[1])}
        | {"_free": F.coalesce(F.col(constrained).cast("double"), F.lit(0.0))}
    )
    tags = [*(f"_c{k}" for k in range(len(values[0]))), *(f"_l{k}" for k in range(len(values[1]))), "_free"]
    candidates = [Candidate(name, c, (raw, *tags)) for name, raw in raws.items() for c in grid]
    fitted, rejected = {}, {}
    for candidate, w in zip(candidates, ridge_logistic(coded, label, candidates), strict=True):
        key = (candidate.name, candidate.C)
        if w[1] <= 0:
            rejected[key] = "nonpositive_raw_score_slope"
            continue
        n = len(values[0])
        fitted[key] = Conditional(float(w[1]), float(w[0]), dict(zip(values[0], w[2 : 2 + n].tolist(), strict=True)), dict(zip(values[1], w[2 + n : -1].tolist(), strict=True)), float(w[-1]))
    return fitted, rejected


def select_candidate(df: DataFrame, label: str, raws: dict[str, str], fitted: dict[tuple[str, float], Conditional], category: str, location: str, constrained: str, prevalence: float, least_rows: int = 30) -> DataFrame:
    """Every fitted candidate over the same rows, best first: name, C, failing, brier, average_precision, place.

    A segment (each category and each location with least_rows rows) fails unless the candidate's Brier score is below that of the training
    prevalence and both classes are there. Order: fewest failing segments, Brier score, average precision (falling), name, C. All
    candidates are scored in one plan.
    """
    from asoflow.functions.columns import stable_sigmoid
    from asoflow.operators.metrics import average_precision

    tried = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(c).alias("C"), stable_sigmoid(m.margin(raws[name], category, location, constrained)).alias("p")) for (name, c), m in fitted.items()])
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), F.col(category).cast("string").alias("cat"), F.col(location).cast("string").alias("loc"), F.inline(tried))
    segments = F.array(F.struct(F.lit("category").alias("dimension"), F.col("cat").alias("value")), F.struct(F.lit("location").alias("dimension"), F.col("loc").alias("value")))
    error, base = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y")), (F.lit(prevalence) - F.col("y")) * (F.lit(prevalence) - F.col("y"))
    cells = rows.select("name", "C", "y", "p", F.inline(segments)).where("value is not null").groupBy("name", "C", "dimension", "value").agg(F.count("*").alias("n"), F.sum("y").alias("k"), F.avg(error).alias("b"), F.avg(base).alias("b0"))
    failing = cells.where(F.col("n") >= least_rows).groupBy("name", "C").agg(F.count_if((F.col("b") >= F.col("b0")) | (F.col("k") == 0) | (F.col("k") == F.col("n"))).alias("failing"))
    whole = rows.groupBy("name", "C").agg(F.avg(error).alias("brier"))
    precise = average_precision(rows, ["name", "C"], "p", "y").select("name", "C", "average_precision")
    out = whole.join(failing, ["name", "C"], "left").join(precise, ["name", "C"], "left").withColumn("failing", F.coalesce("failing", F.lit(0)))
    order = Window.orderBy("failing", "brier", F.col("average_precision").desc_nulls_last(), "name", "C")  # as many rows as candidates
    return out.select("name", "C", "failing", "brier", "average_precision", F.row_number().over(order).alias("place"))
