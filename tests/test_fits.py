"""Fits on Spark against plain numpy programs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from asoflow.operators import boosting, calibration, metrics, resampling


def plain_booster(x, y, median, rounds, rate, leaves, depth, least_rows, bins):
    """The same booster on arrays: one tree a round, level by level, best gains first."""
    mid = lambda v: np.sort(v)[-(-len(v) // 2) - 1]
    edges = [np.unique([np.sort(c)[max(0, int(np.ceil(len(c) * k / bins)) - 1)] for k in range(1, bins)]) for c in x.T]
    b = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    f = np.full(len(y), mid(y) if median else y.mean())
    for _ in range(rounds):
        r = y - f
        g = np.sign(r) if median else r
        leaf, open_, n_leaves, count = np.zeros(len(y), int), [0], 1, 1
        for _ in range(depth):
            best = []
            for node in open_:
                at = leaf == node
                found = (-1.0, 0, 0)
                for k in range(b.shape[1]):
                    for cut in range(int(b[:, k].max()) + 1):
                        left = at & (b[:, k] <= cut)
                        right = at & ~left
                        if min(left.sum(), right.sum()) >= least_rows:
                            gain = g[left].sum() ** 2 / left.sum() + g[right].sum() ** 2 / right.sum() - g[at].sum() ** 2 / at.sum()
                            if round(gain, 9) > round(found[0], 9):
                                found = (gain, k, cut)
                best.append((*found, node))
            open_ = []
            for gain, k, cut, node in sorted(best, key=lambda v: -v[0]):
                if gain > 1e-9 and n_leaves < leaves:
                    at = leaf == node
                    leaf[at] = np.where(b[at, k] <= cut, count, count + 1)
                    open_ += [count, count + 1]
                    count, n_leaves = count + 2, n_leaves + 1
            if not open_ or n_leaves == leaves:
                break
        if count == 1:
            break
        for node in np.unique(leaf):
            at = leaf == node
            f[at] += rate * (mid(r[at]) if median else r[at].mean())
    return np.maximum(f, 0)


@pytest.mark.parametrize("head", ["mean", "median"])
def test_booster_equals_a_plain_one(spark, head):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(600, 3)), 2)
    y = np.round(10 + 4 * (x[:, 0] > 0.3) + 3 * x[:, 1] * (x[:, 2] > 0) + rng.exponential(1, 600), 3)
    df = spark.createDataFrame([(k, *map(float, row), float(v)) for k, (row, v) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, y double").repartition(3)
    settings = {"rounds": 12, "rate": 0.3, "leaves": 6, "depth": 3, "least_rows": 15, "bins": 16}
    model = boosting.fit_booster(df, ["a", "b", "c"], "y", head, **settings)
    got = np.array([r["p"] for r in model.predict(df).orderBy("id").collect()])
    assert np.allclose(got, plain_booster(x, y, head == "median", **settings), atol=1e-8)
    loss = (lambda p: np.abs(y - p).mean()) if head == "median" else (lambda p: ((y - p) ** 2).mean())
    assert loss(got) < 0.7 * loss(np.full(600, np.median(y) if head == "median" else y.mean()))


def test_booster_takes_nulls_ties_and_few_rows(spark):
    df = spark.createDataFrame([(None, 1.0), (2.0, 1.0), (2.0, 1.0), (3.0, None)], "a double, y double")
    model = boosting.fit_booster(df, ["a"], "y", rounds=3)
    assert {r["p"] for r in model.predict(df.fillna(0.0, ["a"])).collect()} == {1.0}
    with pytest.raises(ValueError):
        boosting.fit_booster(df.limit(0), ["a"], "y")


def plain_logistic(x, y, c):
    z = np.column_stack([np.ones(len(x)), x])
    w, free = np.zeros(z.shape[1]), np.r_[0.0, np.full(x.shape[1], 1 / c)]
    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(free), z.T @ (y - p) - free * w)
        w = w + step
        if np.abs(step).max() < 1e-13:
            break
    return w


def calibration_rows(spark):
    rng = np.random.default_rng(7)
    n = 900
    raw, other = rng.normal(size=n), rng.normal(size=n)
    cat, loc, free = rng.integers(0, 3, n), rng.integers(0, 4, n), rng.random(n) < 0.3
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * raw + 0.5 * (cat == 1) - 0.7 * (loc == 2) + 0.4 * free)))).astype(int)
    df = spark.createDataFrame([(float(raw[k]), float(-raw[k] + 0.1 * other[k]), f"c{cat[k]}", f"l{loc[k]}", bool(free[k]), int(y[k])) for k in range(n)], "raw double, wrong double, cat string, loc string, free boolean, y int")
    x = np.column_stack([raw, *[cat == k for k in range(3)], *[loc == k for k in range(4)], free]).astype(float)
    return df.repartition(3), x, y


def test_joint_calibration_equals_a_plain_fit(spark):
    df, x, y = calibration_rows(spark)
    fitted, rejected = calibration.fit_conditional(df, "y", {"good": "raw", "bad": "wrong"}, "cat", "loc", "free")
    assert {k[0] for k in fitted} == {"good"} and set(rejected) == {("bad", c) for c in (0.01, 0.1, 1.0, 10.0)}
    for (_, c), m in fitted.items():
        w = plain_logistic(x, y, c)
        got = [m.intercept, m.slope, *m.categories.values(), *m.locations.values(), m.constrained]
        assert np.abs(np.array(got) - w).max() < 1e-6
        p = [r["p"] for r in m.predict(df, "raw", "cat", "loc", "free").select("p").collect()]
        assert min(p) > 0 and max(p) < 1
    with pytest.raises(ValueError):
        calibration.fit_conditional(df.where("y = 1"), "y", {"good": "raw"}, "cat", "loc", "free")


def test_selection_orders_fits(spark):
    df, x, y = calibration_rows(spark)
    fitted, _ = calibration.fit_conditional(df, "y", {"good": "raw"}, "cat", "loc", "free")
    rows = calibration.select_candidate(df, "y", {"good": "raw"}, fitted, "cat", "loc", "free", float(y.mean())).orderBy("place").collect()
    assert [r["place"] for r in rows] == [1, 2, 3, 4] and [(r["failing"], r["brier"]) for r in rows] == sorted((r["failing"], r["brier"]) for r in rows)
    for r in rows:
        w = plain_logistic(x, y, r["C"])
        p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
        assert r["brier"] == pytest.approx(((p - y) ** 2).mean(), abs=1e-9)
        order = np.argsort(-p, kind="stable")
        assert r["average_precision"] == pytest.approx((y[order] * np.cumsum(y[order]) / np.arange(1, len(y) + 1)).sum() / y.sum(), abs=1e-4)


def test_bootstrap_draws_as_many_clusters_as_there_are(spark, monkeypatch):
    monkeypatch.setattr(resampling, "_BUCKET", 4)  # two levels
    rng = np.random.default_rng(1)
    a, b = rng.gamma(2, 1, 1500), rng.gamma(3, 2, 1500)
    df = spark.createDataFrame([(k, float(a[k]), float(b[k])) for k in range(1500)], "k long, a double, b double")
    reps = resampling.bootstrap_replicates(df.withColumn("one", F.lit(1.0)), ["k"], ["a", "b", "one"], 300).collect()
    assert len(reps) == 300 and {(r["draws"], r["one"]) for r in reps} == {(1500, 1500.0)}
    plain = [a[i].sum() / b[i].sum() for i in rng.integers(0, 1500, (3000, 1500))]
    got = [r["a"] / r["b"] for r in reps]
    assert np.mean(got) == pytest.approx(np.mean(plain), rel=0.005) and np.std(got) == pytest.approx(np.std(plain), rel=0.2)
    again = resampling.bootstrap_replicates(df.withColumn("one", F.lit(1.0)).repartition(7), ["k"], ["a", "b", "one"], 300).collect()
    assert sorted((r["rep"], round(r["a"], 6)) for r in reps) == sorted((r["rep"], round(r["a"], 6)) for r in again)
    row = resampling.exact_cluster_bootstrap(df, ["k"], "a", "b", 100).first()
    assert row["low"] < row["estimate"] < row["high"] and row["least_draws"] == row["most_draws"] == row["clusters"] == 1500
    assert resampling.exact_cluster_bootstrap(df.limit(5), ["k"], "a", "b", 20).first()["low"] is None


def test_one_draw_each_is_uniform(spark):
    """Multiplicities of a cluster over replicates have mean 1 and the variance of a multinomial."""
    df = spark.range(40).select(F.col("id").alias("k"), *[(F.col("id") == k).cast("double").alias(f"m{k}") for k in range(4)])
    reps = resampling.bootstrap_replicates(df, ["k"], [f"m{k}" for k in range(4)], 1000).collect()
    m = np.array([[r[f"m{k}"] for k in range(4)] for r in reps])
    assert np.abs(m.mean(axis=0) - 1).max() < 0.12 and np.abs(m.var(axis=0) - 39 / 40).max() < 0.2


def test_ranks_without_a_window_over_a_group(spark):
    rng = np.random.default_rng(3)
    p, y, g = np.round(rng.random(5000), 2), rng.integers(0, 2, 5000), rng.integers(0, 2, 5000)
    df = spark.createDataFrame([(int(g[k]), float(p[k]), int(y[k])) for k in range(5000)], "g int, p double, y long")
    for r in metrics.roc_auc(df, ["g"], "p", "y").collect():
        own = g == r["g"]
        up, down = p[own & (y == 1)], p[own & (y == 0)]
        assert r["roc_auc"] == pytest.approx(((up[:, None] > down).sum() + 0.5 * (up[:, None] == down).sum()) / len(up) / len(down), abs=1e-6)
