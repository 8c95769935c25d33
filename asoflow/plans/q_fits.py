"""Models that Spark fits itself: boosted histograms, joint calibration, selection over fits, exact bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from asoflow.operators import boosting, calibration, resampling
from asoflow.operators import models as ML
from asoflow.plans.q_metrics import _errors
from asoflow.plans.q_models import _BEFORE, FEATURES, _frame
from asoflow.plans.registry import query
from asoflow.sources.adapters import SERIES, table
from asoflow.sources.scratch import written


@query("ml02_histogram_booster")
def _(spark, d):
    """Boosted mean and median of a day's units, fitted to the days before 2000 and scored on all later ones beside the moving average of the days before."""
    from asoflow.operators.joins import lagged

    rows = lagged(_frame(spark, d), SERIES, "day", "mean_28", 1, "average").withColumn("average", F.coalesce("average", F.col("mean_28"))).drop("mean_28").withColumnRenamed("average", "mean_28")
    rows = written(rows)  # every pass of both fits reads it
    train, later = rows.where(_BEFORE), rows.where(f"not {_BEFORE}")
    mean, median = (boosting.fit_booster(train, FEATURES, "units", head, rounds=20, depth=4, leaves=15, bins=32) for head in ("mean", "median"))
    p = median.predict(mean.predict(later, "p_mean"), "p_median").withColumn("p_average", F.col("mean_28"))
    errors = [F.avg(F.abs(F.col(n) - F.col("units"))).alias(f"mae_{n[2:]}") for n in ("p_mean", "p_median", "p_average")]
    return p.groupBy("product").agg(F.count("*").alias("n"), *errors, F.count_if(F.expr("p_mean < 0 or p_median < 0")).alias("n_negative"))


def _raw_scores(spark, d):
    """Documents with the raw scores of two base models, fitted to a third of them, and the other two thirds by role."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.ln("n_chars").alias("a"), F.length(F.regexp_replace("text", "[^A-Z]", "")).cast("double").alias("b"), (F.col("n_chars") < 300).alias("short"))
    rows = docs.join(table(spark, d, "labels"), "doc_id").withColumns({"y": F.col("quality"), "area": F.concat(F.lit("g"), (F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % 4).cast("string"))})
    rows = written(rows)  # every pass of the fits reads these numbers, not the texts
    train = rows.where("doc_id % 3 = 0")
    for name, kind in (("linear", "logistic"), ("boosted", "boosted")):
        model = ML.fit_risk(train, ["a", "b"], "y", kind, **({"maxIter": 5} if kind == "boosted" else {}))
        rows = ML.risk_scores(model, rows, ["a", "b"]).withColumnRenamed("raw", f"raw_{name}").drop("p")
    return rows, train.agg(F.avg("y")).first()[0]


_LEAST = 3  # rows of a class: the smallest tables have five
_RAWS = {"linear": "raw_linear", "boosted": "raw_boosted"}


@query("ml05_joint_calibration")
def _(spark, d):
    """Slope, intercept and all offsets of each base model at C = 1, fitted jointly."""
    rows, _ = _raw_scores(spark, d)
    fitted, rejected = calibration.fit_conditional(rows.where("doc_id % 3 = 1"), "y", _RAWS, "lang", "area", "short", grid=(1.0,), least_per_class=_LEAST)
    out = []
    for (name, _), m in fitted.items():
        out += [(name, "slope", m.slope), (name, "intercept", m.intercept), (name, "constrained", m.constrained)]
        out += [(name, f"category {k}", v) for k, v in m.categories.items()] + [(name, f"location {k}", v) for k, v in m.locations.items()]
    out += [(name, reason, 0.0) for (name, _), reason in rejected.items()]
    return spark.createDataFrame(out, "model string, term string, weight double")


@query("ml09_fitted_selection")
def _(spark, d):
    """Two base models times four C, calibrated on one third of the documents and ordered on another."""
    rows, prevalence = _raw_scores(spark, d)
    fitted, _ = calibration.fit_conditional(rows.where("doc_id % 3 = 1"), "y", _RAWS, "lang", "area", "short", least_per_class=_LEAST)
    return calibration.select_candidate(rows.where("doc_id % 3 = 2"), "y", _RAWS, fitted, "lang", "area", "short", prevalence)


@query("ag23_exact_bootstrap")
def _(spark, d):
    """Blocks of 28 days of a series drawn with replacement, 500 times, exactly as many as there are."""
    e = _errors(spark, d).withColumns({"block": F.floor(F.datediff("target", F.lit("1998-01-01").cast("date")) / 28), "a": F.abs("e")})
    return resampling.exact_cluster_bootstrap(e, ["block", *SERIES], "a", "y", 500)
