"""Models fitted and scored on Spark: trees, logistic risk with calibration, isolation forests, importance."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assembled(df: DataFrame, features: Sequence[str], out: str = "_x") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def fit_regressor(train: DataFrame, features: Sequence[str], label: str, kind: str = "forest", seed: int = 42, **settings):
    """One model for all horizons (the horizon is a feature): 'forest' for means, 'boosted' for means, 'boosted_median' for medians."""
    common = {"featuresCol": "_x", "labelCol": label, "predictionCol": "_p", "seed": seed}
    if kind == "forest":
        model = RandomForestRegressor(**common, **({"numTrees": 64, "maxDepth": 12} | settings))
    else:
        loss = "absolute" if kind == "boosted_median" else "squared"
        model = GBTRegressor(**common, lossType=loss, **({"maxIter": 100, "stepSize": 0.1} | settings))
    return model.fit(assembled(train.where(F.col(label).isNotNull()), features))


def predict(model, df: DataFrame, features: Sequence[str], name: str = "p") -> DataFrame:
    """Forecasts, never below zero."""
    return model.transform(assembled(df, features)).withColumn(name, F.greatest(F.col("_p"), F.lit(0.0))).drop("_x", "_p")


def fit_risk(train: DataFrame, features: Sequence[str], label: str, kind: str = "logistic", **settings):
    """A classifier of a 0/1 label; both classes must be there."""
    if train.select(label).distinct().count() < 2:
        raise ValueError("training needs both classes")
    if kind == "logistic":
        model = LogisticRegression(featuresCol="_x", labelCol=label, **({"regParam": 0.01} | settings))
    else:
        model = GBTClassifier(featuresCol="_x", labelCol=label, **({"maxIter": 40, "maxDepth": 4, "seed": 42} | settings))
    return model.fit(assembled(train.withColumn(label, F.col(label).cast("double")), features))


def risk_scores(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds raw (log odds) and p."""
    scored = model.transform(assembled(df, features))
    p = vector_to_array("probability")[1]
    clipped = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return scored.withColumns({"p": p, "raw": F.ln(clipped / (1 - clipped))}).drop("_x", "probability", "rawPrediction", "prediction")


def calibrate(scored: DataFrame, label: str, least_per_class: int = 10) -> tuple[float, float]:
    """Slope and intercept of a sigmoid on the raw score; the slope must be above zero."""
    counts = {r[label]: r["count"] for r in scored.groupBy(label).count().collect()}
    if min(counts.get(0, 0), counts.get(1, 0)) < least_per_class:
        raise ValueError("too few rows of a class to calibrate")
    model = LogisticRegression(featuresCol="_x", labelCol=label, maxIter=100).fit(assembled(scored.withColumn(label, F.col(label).cast("double")), ["raw"]))
    slope, intercept = float(model.coefficients[0]), float(model.intercept)
    if slope <= 0:
        raise ValueError("the calibrated slope isn't positive")
    return slope, intercept


def calibrate_by(scored: DataFrame, label: str, segment: str, least_per_class: int = 10) -> tuple[float, float, dict[str, float]]:
    """calibrate, and an offset for each segment that has enough rows of both classes: a logistic fit of the label on a
    constant beside the calibrated margin, by Newton steps on sums that Spark takes; the segments are few."""
    slope, intercept = calibrate(scored, label, least_per_class)
    y, margin = F.col(label).cast("double"), F.col("raw") * slope + intercept
    counts = scored.groupBy(segment).agg(F.sum(y).alias("k"), F.count("*").alias("n")).collect()
    offsets = {r[segment]: 0.0 for r in counts if min(r["k"], r["n"] - r["k"]) >= least_per_class}
    for _ in range(6):
        p = 1 / (1 + F.exp(-(margin + offset_column(segment, offsets))))
        for r in scored.groupBy(segment).agg(F.sum(y - p).alias("g"), F.sum(p * (1 - p)).alias("h")).collect():
            if r[segment] in offsets:
                offsets[r[segment]] += r["g"] / (r["h"] + 1.0)  # drawn towards none, as by a unit prior
    return slope, intercept, offsets


def offset_column(segment: str, offsets: dict[str, float]) -> Column:
    """Each row's offset, 0 where its segment has none."""
    return F.coalesce(*[F.when(F.col(segment) == name, F.lit(value)) for name, value in sorted(offsets.items())], F.lit(0.0))


def calibrated(raw: Column, slope: float, intercept: float, offset: Column | None = None) -> Column:
    from asoflow.functions.columns import stable_sigmoid

    margin = raw * slope + intercept
    return stable_sigmoid(margin if offset is None else margin + offset)


def node_table(nodes: Sequence[tuple]) -> pd.DataFrame:
    """Nodes of trees (tree, node, feature or None, threshold, left, right, value); a row goes left where its feature is at most the threshold. Numbers of a tree's nodes follow one another from 0, the root."""
    return pd.DataFrame(list(nodes), columns=["tree", "node", "feature", "threshold", "left", "right", "value"])


def exported_nodes(model, features: Sequence[str]) -> pd.DataFrame:
    """The trees of an MLlib forest as a node table, a model's size."""
    rows: list[list] = []

    def walk(tree: int, node, numbers: list[int]) -> int:
        at, own = numbers[0], len(rows)
        numbers[0] += 1
        rows.append([tree, at, None, 0.0, -1, -1, float(node.prediction())])
        if node.getClass().getSimpleName() == "InternalNode":
            rows[own][2:4] = [features[node.split().featureIndex()], float(node.split().threshold())]
            rows[own][4] = walk(tree, node.leftChild(), numbers)
            rows[own][5] = walk(tree, node.rightChild(), numbers)
        return at

    for k, tree in enumerate(model.trees):
        walk(k, tree._call_java("rootNode"), [0])
    return node_table(rows)


def portable_scores(df: DataFrame, nodes: pd.DataFrame, features: Sequence[str], intercept: float = 0.0, mean: bool = False, name: str = "p") -> DataFrame:
    """Adds the intercept plus the sum (or the mean) of all trees' leaves, not below zero: a pandas UDF over batches, to which the node table travels once, walks all trees at once."""
    nodes = nodes.sort_values(["tree", "node"])
    roots = np.flatnonzero(nodes["node"].to_numpy() == 0)
    base = np.repeat(roots, np.diff(np.append(roots, len(nodes))))
    inner = nodes["feature"].notna().to_numpy()
    feature = np.array([list(features).index(f) if ok else 0 for f, ok in zip(nodes["feature"], inner, strict=True)])
    threshold, value = nodes["threshold"].to_numpy(float), nodes["value"].to_numpy(float)
    left, right = base + nodes["left"].to_numpy(int), base + nodes["right"].to_numpy(int)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            columns = (columns,) if isinstance(columns, pd.Series) else columns  # one feature comes alone
            x = np.stack([c.to_numpy(float) for c in columns], axis=1)
            at = np.tile(roots, (len(x), 1))
            while inner[at].any():
                goes = np.take_along_axis(x, feature[at], axis=1) <= threshold[at]
                at = np.where(inner[at], np.where(goes, left[at], right[at]), at)
            leaves = value[at]
            yield pd.Series(np.maximum(0.0, intercept + (leaves.mean(axis=1) if mean else leaves.sum(axis=1))))

    return df.withColumn(name, score(*[F.col(f).cast("double") for f in features]))


def isolation_forest(df: DataFrame, group: Sequence[str], features: Sequence[str], trees: int = 32, sample: int = 256, least: int = 64, seed: int = 7) -> DataFrame:
    """Trees as rows: group, tree, node, feature, threshold, left, right, depth, size.

    Each tree's rows are drawn by hash before any grouping: the `sample` smallest of a hash that depends on the tree, taken from a
    thinned set, so a task grows one tree from at most `sample` rows whatever the group's size.
    """
    kinds = dict(df.dtypes)
    counts = df.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    rows = df.select(*group, *features).join(counts, list(group)).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    u = F.pmod(F.xxhash64(*features, "tree", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    rows = rows.withColumn("_u", u).where(F.col("_u") < 3.0 * sample / F.col("_n"))
    w = Window.partitionBy(*group, "tree").orderBy("_u", *features)
    rows = rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= sample)

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed + int(key[-1]))
        x, out = pdf[list(features)].to_numpy(float), []
        limit = int(np.ceil(np.log2(max(2, len(x)))))

        def build(at: np.ndarray, depth: int) -> int:
            node = len(out)
            out.append([node, -1, 0.0, -1, -1, depth, len(at)])
            spread = x[at].max(axis=0) - x[at].min(axis=0)
            if depth < limit and len(at) > 1 and (spread > 0).any():
                f = int(rng.choice(np.flatnonzero(spread > 0)))
                t = float(rng.uniform(x[at, f].min(), x[at, f].max()))
                goes = x[at, f] <= t
                if 0 < goes.sum() < len(at):
                    left, right = build(at[goes], depth + 1), build(at[~goes], depth + 1)
                    out[node][1:5] = [f, t, left, right]
            return node

        build(np.arange(len(x)), 0)
        nodes = pd.DataFrame(out, columns=["node", "feature", "threshold", "left", "right", "depth", "size"])
        for name, value in zip([*group, "tree"], key, strict=True):
            nodes[name] = value
        return nodes

    schema = ", ".join(f"`{g}` {kinds[g]}" for g in group) + ", tree int, node int, feature int, threshold double, `left` int, `right` int, depth int, size int"
    found = rows.groupBy(*group, "tree").applyInPandas(lambda key, pdf: grow(key, pdf)[[*group, "tree", "node", "feature", "threshold", "left", "right", "depth", "size"]], schema)
    return found


def isolation_scores(df: DataFrame, forest: DataFrame, group: Sequence[str], features: Sequence[str], sample: int = 256) -> DataFrame:
    """Adds score to the rows of groups that have a forest, by walking all trees at once.

    Rows are dealt into pieces of about 50,000, each of which meets its group's trees, a few
    hundred nodes each, in one task; a group of any size so spreads over many.
    """
    kinds = dict(df.dtypes)
    pieces = max(1, df.count() // 50_000)
    dealt = df.withColumn("_piece", F.pmod(F.xxhash64(*df.columns), F.lit(pieces)))
    spread = forest.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))))

    def c(n: float) -> float:
        return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def walk(rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or trees.empty:
            return pd.DataFrame(columns=[*kinds, "score"])
        trees = trees.sort_values(["tree", "node"])
        feature, threshold, left, right, depth, size = (trees[k].to_numpy() for k in ("feature", "threshold", "left", "right", "depth", "size"))
        starts = np.flatnonzero(trees["node"].to_numpy() == 0)
        base = np.repeat(starts, np.diff(np.append(starts, len(trees))))
        rest = depth + np.array([c(n) for n in size])
        x = rows[list(features)].to_numpy(float)
        at = np.tile(starts, (len(x), 1))
        while (inner := feature[at] >= 0).any():
            goes = np.take_along_axis(x, np.maximum(feature[at], 0), axis=1) <= threshold[at]
            at = np.where(inner, base[at] + np.where(goes, left[at], right[at]), at)
        return rows[list(kinds)].assign(score=2.0 ** (-rest[at].mean(axis=1) / c(min(sample, int(size[starts].max())))))

    keys = [*group, "_piece"]
    return dealt.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(walk, ", ".join(f"`{k}` {v}" for k, v in kinds.items()) + ", score double")


def permutation_importance(df: DataFrame, score, groups: dict[str, Sequence[str]], label: str, key: Sequence[str], rounds: int = 5) -> DataFrame:
    """Rise of the Brier score and drop of the average precision when a group of features is shuffled among rows: feature, brier, brier_rise, average_precision, precision_drop, rounds.

    A shuffle is a join of two row numbers: each row takes the features of the row that has its number in another hash order. Numbers are dealt within hash buckets of about 50,000 rows (64 buckets at least), so no task numbers the whole.
    score: a function that adds p to a DataFrame.
    """
    from asoflow.operators.metrics import average_precision, brier

    def value(rows: DataFrame) -> tuple[float, float]:
        scored = score(rows).select("p", label).persist()
        found = brier(scored, [], "p", label).first()["brier"], average_precision(scored, [], "p", label).first()["average_precision"]
        scored.unpersist()
        return found[0], float("nan") if found[1] is None else found[1]

    base, out = value(df), []
    buckets = max(64, df.count() // 50_000)
    for name, columns in groups.items():
        found = []
        for r in range(rounds):
            bucket = F.pmod(F.xxhash64(*key, F.lit(r)), F.lit(buckets))
            own = df.withColumn("_b", bucket)
            own = own.withColumn("_k", F.row_number().over(Window.partitionBy("_b").orderBy(*key)))
            other = own.select("_b", *columns, F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(*key, F.lit(100 + r)), *key)).alias("_k"))
            found.append(value(own.drop(*columns).join(other, ["_b", "_k"]).drop("_b", "_k")))
        mean = np.mean(found, axis=0)
        out.append((name, base[0], float(mean[0]) - base[0], base[1], base[1] - float(mean[1]), rounds))
    return df.sparkSession.createDataFrame(out, "feature string, brier double, brier_rise double, average_precision double, precision_drop double, rounds int")
