import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from asoflow.llm.substrings import without_repeats


def plain(rows, window):
    """Every window of every row looked up among those of all rows."""
    least = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        goes = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                goes.update(range(k, k + window))
        out.append((i, len(w), len(goes), b" ".join(x for k, x in enumerate(w) if k not in goes).decode()))
    return Counter(out)


def found(spark, rows, window, parts=5, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("tag", "removed", "first", "size", "n_words", "ids", "bucket")}).repartition(parts)
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in without_repeats(df, window, **more).collect())


@pytest.mark.parametrize("window", [2, 5, 50])
def test_equals_plain_lookup(spark, window):
    rng = random.Random(window)
    vocabulary = [f"w{k}" for k in range(9)] + ["Über", "日本", "W1", "x" * 400]
    passages = [rng.choices(vocabulary, k=rng.randrange(window, 3 * window)) for _ in range(6)]
    rows = []
    for k in range(120):
        w = []
        for _ in range(rng.randrange(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.6 else rng.choices(vocabulary, k=rng.randrange(1, 2 * window))
        rows.append((rng.choice([k, k, k, k - (1 << 62), 7]), rng.choice([" ", "\n", "\t \x0b"]).join(w)))
    rows += [rows[3], rows[3], (None, rows[5][1]), (None, None), (500, None), (501, ""), (502, " \n"), (503, " "), (rows[9][0], rows[10][1]), (900, rows[11][1]), (901, rows[11][1])]
    want = plain(rows, window)
    assert found(spark, rows, window) == want and any(r[2] for r in want)
    assert found(spark, rows, window, parts=1) == want
    assert found(spark, rows, window, most_bits=17) == want


def test_a_hot_passage_and_a_long_text(spark):
    hot = [f"h{k}" for k in range(60)]
    rows = [(k, " ".join([f"a{k}", *hot, f"b{k}"])) for k in range(3000)]  # the grams of the passage are estimated often
    rows += [(5000, " ".join(["same"] * 100_000)), (5001, " ".join(["same"] * 60)), (5002, "x" * 300_000 + " end")]
    got = found(spark, rows, 50)
    assert got == plain(rows, 50)


def test_sketch_that_is_full_loses_nothing(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(str(rng.randrange(10**6)) for _ in range(400))) for k in range(300)]
    rows += [(1000 + k, " ".join([*rows[k][1].split()[100:180], "tail"])) for k in range(20)]
    assert found(spark, rows, 50, most_bits=17) == plain(rows, 50)


def test_empty(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
