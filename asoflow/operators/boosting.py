"""Histogram boosting: binned features, gradient histograms summed over the cluster, mean and median heads."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asoflow.sources.scratch import dropped, written

_REFRESH = 10  # rounds after which the rows' predictions are written


@dataclass
class _Tree:
    """Nodes in order; a row goes left where its bin is at most cut. Leaves have feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, at, at + 1
        for column, start in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            column.extend([start, start])
        return at, at + 1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        while (inner := feature[at] >= 0).any():
            goes = bins[np.arange(len(bins)), np.maximum(feature[at], 0)] <= cut[at]
            at = np.where(inner, np.where(goes, left[at], right[at]), at)
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


@dataclass
class Booster:
    """A fitted model: the start value and the trees as a node table, for portable_scores."""

    start: float
    nodes: pd.DataFrame
    features: Sequence[str]

    def predict(self, df: DataFrame, name: str = "p") -> DataFrame:
        """Forecasts, never below zero."""
        from asoflow.operators.models import portable_scores

        return portable_scores(df, self.nodes, self.features, intercept=self.start, name=name)


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Cuts of each feature at its approximate quantiles: a short list for each, merged from the partitions' sketches."""
    shares = [k / bins for k in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 10_000).alias(f) for f in features]).first()
    return [np.unique(np.array(row[f] or [], float)) for f in features]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def fit_booster(train: DataFrame, features: Sequence[str], label: str, head: str = "mean", rounds: int = 100, rate: float = 0.1, leaves: int = 31, depth: int = 6, least_rows: int = 20, bins: int = 64) -> Booster:
    """Boosted trees of the label's mean (squared loss) or median (absolute loss).

    Features are binned once (at most 255 bins; nulls go with the smallest). A round grows one tree, a level at a time:
    every task sums rows and gradients by leaf, feature and bin, one groupBy adds the tasks' sums up, and the leaves of the level are split
    where the gain is largest, best gains first, while there are fewer than `leaves`. What reaches the driver is the
    histogram of a level, whatever the number of rows. Leaf values are the mean of the residuals, or for the median head their
    median, from merged quantile sketches (exact to a rank of 1 / 10,000). Predictions are rewritten every few rounds, so a pass walks few
    trees. Rows without a label don't train; too few rows give a model without splits.
    """
    if head not in ("mean", "median") or not 2 <= bins <= 255:
        raise ValueError("a head is mean or median, and there are 2 to 255 bins")
    median, width = head == "median", len(features)
    known = train.where(F.col(label).isNotNull()).select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("_y"))
    start = known.agg((F.percentile_approx("_y", 0.5, 10_000) if median else F.avg("_y")).alias("s")).first()["s"]
    if start is None:
        raise ValueError("no row to learn from")
    edges = bin_edges(known, features, bins)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [np.searchsorted(e, np.nan_to_num(batch.column(k).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf), "left") for k, e in enumerate(edges)]
            packed = np.stack(columns, axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in packed], pa.binary()), batch.column(width), pa.array(np.full(len(batch), float(start)))], ["bins", "y", "f"])

    rows = written(known.mapInArrow(pack, "bins binary, y double, f double"))
    trees: list[_Tree] = []
    done = 0  # trees that the rows' f holds

    def residuals(batch: pa.RecordBatch, upto: list[_Tree]) -> tuple[np.ndarray, np.ndarray]:
        x = _matrix(batch.column(0), width)
        now = batch.column(2).to_numpy().copy()
        for t in upto:
            now += t.scores(x)
        return x, batch.column(1).to_numpy() - now

    def histogram(tree: _Tree, upto: list[_Tree], open_: list[int]) -> pd.DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size = len(open_) * width * 256
            counts, sums = np.zeros(size), np.zeros(size)
            place = np.full(len(tree.feature), -1)
            place[open_] = np.arange(len(open_))
            for batch in batches:
                if not len(batch):
                    continue
                x, r = residuals(batch, upto)
                at = place[tree.leaves(x)]
                x, r, at = x[at >= 0], r[at >= 0], at[at >= 0]
                g = np.sign(r) if median else r
                for f in range(width):
                    cell = (at * width + f) * 256 + x[:, f]
                    counts += np.bincount(cell, minlength=size)
                    sums += np.bincount(cell, g, size)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), pa.array(sums[some])], ["cell", "n", "g"])

        return rows.mapInArrow(run, "cell long, n double, g double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).toPandas()

    def leaf_values(tree: _Tree, upto: list[_Tree]) -> dict[int, float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    x, r = residuals(batch, upto)
                    yield pa.RecordBatch.from_arrays([pa.array(tree.leaves(x)), pa.array(r)], ["leaf", "r"])

        value = F.percentile_approx("r", 0.5, 10_000) if median else F.avg("r")
        return {r["leaf"]: r["v"] for r in rows.mapInArrow(run, "leaf long, r double").groupBy("leaf").agg(value.alias("v")).collect()}  # a row for each leaf

    for _ in range(rounds):
        tree, open_, n_leaves, means = _Tree(), [0], 1, {}
        for _ in range(depth):
            found = histogram(tree, trees[done:], open_)
            n, g = (np.zeros((len(open_), width, 256)) for _ in range(2))
            n.reshape(-1)[found["cell"]], g.reshape(-1)[found["cell"]] = found["n"], found["g"]
            means |= {node: g[k, 0].sum() / max(1.0, n[k, 0].sum()) for k, node in enumerate(open_)}
            best = sorted(((*_best_cut(n[k], g[k], least_rows), node) for k, node in enumerate(open_)), key=lambda b: -b[0])
            open_ = []
            for gain, f, cut, sides, node in best:
                if gain > 1e-9 and n_leaves < leaves:
                    open_ += (children := tree.split(node, f, cut))
                    means |= dict(zip(children, sides, strict=True))
                    n_leaves += 1
            if not open_ or n_leaves == leaves:
                break
        if len(tree.feature) == 1:
            break
        values = leaf_values(tree, trees[done:]) if median else means
        tree.value = [rate * values.get(k, 0.0) if f < 0 else 0.0 for k, f in enumerate(tree.feature)]
        trees.append(tree)
        if len(trees) - done == _REFRESH:
            held = trees[done:]

            def add(batches: Iterator[pa.RecordBatch], held: list[_Tree] = held) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if len(batch):
                        now = batch.column(1).to_numpy() - residuals(batch, held)[1]
                        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(now)], ["bins", "y", "f"])

            before, rows, done = rows, written(rows.mapInArrow(add, "bins binary, y double, f double")), len(trees)
            dropped([before])
    dropped([rows])
    table = [
        (k, node, features[t.feature[node]] if t.feature[node] >= 0 else None, float(edges[t.feature[node]][t.cut[node]]) if t.feature[node] >= 0 else 0.0, t.left[node], t.right[node], t.value[node])
        for k, t in enumerate(trees) for node in range(len(t.feature))
    ]
    return Booster(float(start), pd.DataFrame(table, columns=["tree", "node", "feature", "threshold", "left", "right", "value"]), list(features))


def _best_cut(n: np.ndarray, g: np.ndarray, least_rows: int) -> tuple[float, int, int, tuple[float, float]]:
    """Gain, feature and last bin of the left side of a leaf's best split, and the mean gradients of both sides; the first of equal gains."""
    nl, gl = n.cumsum(axis=1)[:, :-1], g.cumsum(axis=1)[:, :-1]
    nr, gr = n.sum(axis=1, keepdims=True) - nl, g.sum(axis=1, keepdims=True) - gl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl**2 / nl + gr**2 / nr - g[0].sum() ** 2 / max(1.0, n[0].sum())
    gain = np.where((nl >= least_rows) & (nr >= least_rows), np.nan_to_num(gain, nan=-1.0), -1.0)
    f, cut = np.unravel_index(np.argmax(np.round(gain, 9)), gain.shape)
    sides = tuple(float(a[f, cut] / max(1.0, b[f, cut])) for a, b in ((gl, nl), (gr, nr)))
    return float(gain[f, cut]), int(f), int(cut), sides
