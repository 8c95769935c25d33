"""Interval joins against plain loops, and their time on one hot series."""

import datetime
import random
import time

from pyspark.sql import functions as F

from asoflow.operators import joins as J
from asoflow.operators import versions as V


def day(k):
    return datetime.date(2000, 1, 1) + datetime.timedelta(days=k)


def windows(rng, n, longest, keys="ab"):
    out = []
    for k in range(n):
        lo = rng.randrange(0, 200)
        out.append((rng.choice(keys), day(lo), day(lo + rng.choice((0, 1, 3, longest)) - (1 if rng.random() < 0.05 else 0)), day(lo + rng.randrange(5)), k))
    return out


def test_overlaps_and_episodes_by_loops(spark):
    rng = random.Random(2)
    a, b = windows(rng, 120, 40), windows(rng, 150, 90) + [("a", None, day(3), day(1), 999), (None, day(1), day(3), day(1), 998)]
    schema = "key string, start date, end date, known date, episode_id long"
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    got = sorted(map(tuple, J.window_intersection(da, db, ["key"]).collect()))
    valid = [w for w in b if w[0] and w[1] and w[1] <= w[2]]
    want = sorted((x[0], max(x[1], y[1]), min(x[2], y[2]), max(x[3], y[3])) for x in a if x[1] <= x[2] for y in valid if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    assert got == want and len(want) > 500
    alerts = [(rng.choice("abc"), day(rng.randrange(-5, 320)), k) for k in range(300)]
    found = {r["id"]: r["episode_id"] for r in J.episode_match(spark.createDataFrame(alerts, "key string, day date, id long"), db, ["key"], ["id"], 3).collect()}
    tolerant = datetime.timedelta(days=3)
    want = {}
    for key, at, k in alerts:
        hits = [(w[2], w[4]) for w in b if w[0] == key and w[1] and w[1] <= at <= w[2] + tolerant]
        if hits:
            want[k] = min(hits)[1]
    assert found == want
    assert J.window_intersection(da.limit(0), db, ["key"]).count() == 0


def test_many_windows_of_one_series_take_linear_time(spark):
    def seconds(n):
        w = spark.range(n).select(F.lit("one").alias("key"), F.date_add(F.lit(day(0)), (F.col("id") * 2).cast("int")).alias("start"), F.date_add(F.lit(day(0)), (F.col("id") * 2 + 2).cast("int")).alias("end"), F.lit(day(0)).alias("known"))
        began = time.perf_counter()
        assert J.window_intersection(w, w, ["key"]).count() == 3 * n - 2
        return time.perf_counter() - began

    seconds(100)
    assert seconds(10_000) < 20 and seconds(100_000) < 60


def test_mapping_and_scopes_by_loops(spark):
    rng = random.Random(5)
    plans = []
    for _ in range(250):
        lo = rng.randrange(0, 100)
        plans.append((rng.choice([1, 2, None]), rng.choice([None, "north", "south"]), rng.choice(["all", "web", "shop"]), day(lo), day(lo + rng.choice((0, 1, 10, 60))), day(lo + rng.randrange(-5, 5)), rng.randrange(1, 6), rng.randrange(1000)))
    facts = [(k, rng.choice([1, 2, 3, None]), rng.choice(["north", "south", "west"]), rng.choice(["web", "shop", "all"]), day(rng.randrange(0, 170))) for k in range(300)]
    dp = spark.createDataFrame(plans, "part long, location string, channel string, from_day date, to_day date, known date, version long, price long")
    df = spark.createDataFrame(facts, "id long, part long, location string, channel string, day date")

    def in_force(p, part, at, origin):
        return part is not None and p[0] == part and p[3] <= at < p[4] and p[5] <= origin

    origin = datetime.timedelta(days=1)
    got = {}
    for r in J.plan_match(df, dp, "part", "day", F.date_sub("day", 1), ["id"]).collect():
        got.setdefault(r["id"], []).append((r["scope_rank"], r["version"], r["price"], r["ambiguous"]))
    want = {}
    for k, part, loc, chan, at in facts:
        hits = [(2 * (p[1] is not None) + (p[2] != "all"), p[6], p[7]) for p in plans if in_force(p, part, at, at - origin) and p[1] in (None, loc) and p[2] in ("all", chan)]
        top = [h for h in hits if h[:2] == max(x[:2] for x in hits)]
        if top:
            want[k] = sorted((*h, len(top) > 1) for h in top)
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 50

    got = {}
    for r in V.effective_mapping(df, dp.drop("location", "channel"), ["part"], "day", F.date_sub("day", 1), ["id"]).collect():
        got.setdefault(r["id"], []).append((r["_p_price"], r["status"]))
    for k, part, _, _, at in facts:
        hits = [(p[6], p[7]) for p in plans if in_force(p, part, at, at - origin)]
        top = [h[1] for h in hits if h[0] == max(hits)[0]]
        assert sorted(got.pop(k), key=str) == sorted([(x, "ambiguous" if len(top) > 1 else "mapped") for x in top] or [(None, "missing")], key=str)
    assert not got
