"""Two worlds of the same tables compared by a tree of digests: products, weeks, days, rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asoflow.operators.joins import multiset_difference
from asoflow.sources.scratch import written

_LEVELS = (["key"], ["key", "week"], ["key", "week", "day"])
_MARKS = ["n", "d1", "d2"]


def digest_tree(rows: DataFrame, key: str, day: str) -> DataFrame:
    """Leaves of a table's digest tree: key, week (its Monday), day, n (rows), d1, d2 (sums of two hashes of whole rows).

    Sums don't depend on the order of rows and count repeated ones; a level above is the sum of the one below.
    """
    whole = [F.col(c) for c in sorted(rows.columns)]
    nulls = F.concat_ws(",", *[F.when(c.isNull(), F.lit(str(k))) for k, c in enumerate(whole)])  # hashes skip nulls
    hashes = [F.xxhash64(F.lit(seed), nulls, *whole).cast("decimal(38,0)") for seed in (1, 2)]
    named = rows.select(F.col(key).cast("string").alias("key"), F.trunc(day, "week").alias("week"), F.to_date(day).alias("day"), *[h.alias(f"d{k + 1}") for k, h in enumerate(hashes)])
    return named.groupBy("key", "week", "day").agg(F.count("*").alias("n"), F.sum("d1").alias("d1"), F.sum("d2").alias("d2"))


def _level(tree: DataFrame, keys: Sequence[str]) -> DataFrame:
    return tree.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in _MARKS])


def differing_days(a: DataFrame, b: DataFrame) -> DataFrame:
    """key and day of the leaves that differ between two trees. The trees are compared from the keys down: weeks are looked at only for keys that differ, days only for weeks that do."""
    found = None
    for keys in _LEVELS:
        sides = []
        for tree, mark in ((a, "a"), (b, "b")):
            kept = tree if found is None else tree.join(found, found.columns, "left_semi")
            sides.append(_level(kept, keys).select(*keys, *[F.col(m).alias(f"{m}_{mark}") for m in _MARKS]))
        same = [F.col(f"{m}_a").eqNullSafe(F.col(f"{m}_b")) for m in _MARKS]
        found = sides[0].join(sides[1], list(keys), "full").where(~(same[0] & same[1] & same[2])).select(*keys)
    return found.select("key", "day")


def world_differences(a: Mapping[str, DataFrame], b: Mapping[str, DataFrame], keyed: Mapping[str, tuple[str, str]]) -> DataFrame:
    """How two worlds' tables differ as multisets: table, key, adds (rows that b has more), removes, first_day (null if nothing differs).

    keyed: each table's key column and day column. Every key of either world is there. Only rows of days whose digests differ are
    compared one by one; rows that repeat count as often as they do. Rows without a key or a day are not compared: they are in no day.
    """
    out = None
    for name, (key, day) in keyed.items():
        pair = [w[name].where(F.col(key).isNotNull() & F.col(day).isNotNull()) for w in (a, b)]
        trees = [written(digest_tree(rows, key, day)) for rows in pair]
        days = written(differing_days(*trees))
        columns = sorted(pair[0].columns)
        rows = [r.select(*columns, F.col(key).cast("string").alias("_k"), F.to_date(day).alias("_d")).join(days.select(F.col("key").alias("_k"), F.col("day").alias("_d")), ["_k", "_d"], "left_semi") for r in pair]
        changed = multiset_difference(rows[1], rows[0], ["_k", "_d", *columns])
        sums = changed.groupBy(F.col("_k").alias("key")).agg(F.sum(F.greatest("balance", F.lit(0))).alias("adds"), F.sum(F.greatest(-F.col("balance"), F.lit(0))).alias("removes"), F.min("_d").alias("first_day"))
        keys = trees[0].select("key").union(trees[1].select("key")).distinct()
        own = keys.join(sums, "key", "left").select(F.lit(name).alias("table"), "key", F.coalesce("adds", F.lit(0)).cast("long").alias("adds"), F.coalesce("removes", F.lit(0)).cast("long").alias("removes"), "first_day")
        out = own if out is None else out.union(own)
    return out
