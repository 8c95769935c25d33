"""The pipeline on the smallest tables: each stage against a plain rule over its own input."""

import re
import struct
from collections import Counter
from hashlib import sha256
from zlib import crc32

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import brute_jaccard

from asoflow.llm.mixing import mix

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import sentencepiece

    from asoflow.llm.sentencepiece_bpe import default_model

    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert docs.dtypes == before.dtypes
        kept.append((name, before, docs))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {name: Counter(r["doc_id"] for r in after.select("doc_id").collect()) for name, _, after in kept}

    good = [k for k, q in labels.items() if q == 1]
    assert sum(k in ids["quality"] for k in good) >= 0.97 * len(good)
    assert set(ids["language"]) == {k for k in ids["quality"] if re.search(r"[^\W\d_]", texts[k] or "")}

    order = sorted(ids["language"])
    classes = brute_jaccard([texts[k] for k in order], 5, 80)
    assert set(ids["near_duplicates"]) == {order[c] for _, c in classes.values()}

    assert set(ids["mixing"]) <= set(ids["near_duplicates"]) and max(ids["mixing"].values()) <= 3
    words = {k: len((texts[k] or "").split()) for k in ids["near_duplicates"]}
    assert abs(sum(words[k] * n for k, n in ids["mixing"].items()) - sum(words.values())) <= 0.1 * sum(words.values())  # a document per source

    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    assert ids["tokens"] == ids["mixing"]
    for r in docs.limit(40).collect():
        want = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["ids"] == want and r["ids_sha256"] == sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()


def texts_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_treat_repeated_and_null_ids_row_by_row(spark):
    """Each stage decides on a row by the row itself: ids may repeat, with equal or other texts, or be missing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    row = {r["doc_id"]: r for r in docs.collect()}

    def made(*rows):
        return docs.union(spark.createDataFrame([{**row[k].asDict(), "doc_id": i, "text": t} for i, k, t in rows], docs.schema))

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stage["quality"](spark, docs, SF).collect()}
    # the id that repeats is held out, so that its rows don't train
    clean, junk = min(k for k, q in labels.items() if q == 1 and k in kept and crc32(str(k).encode()) % 5 == 0), min(k for k, q in labels.items() if q == 0 and k in row and k not in kept)
    got = texts_of(stage["quality"](spark, made((None, clean, row[clean]["text"]), (None, junk, row[junk]["text"]), (clean, junk, row[junk]["text"]), (clean, clean, row[clean]["text"])), SF))
    assert (got[None, row[clean]["text"]], got[clean, row[clean]["text"]]) == (1, 2)
    assert got[None, row[junk]["text"]] == got[clean, row[junk]["text"]] == 0

    other = min(k for k in row if row[k]["lang"] and row[k]["lang"] != row[clean]["lang"])
    got = texts_of(stage["language"](spark, made((None, clean, row[clean]["text"]), (None, clean, "123 !!"), (clean, clean, "123 !!"), (clean, other, row[other]["text"])), SF))
    assert (got[None, row[clean]["text"]], got[clean, row[clean]["text"]], got[clean, row[other]["text"]]) == (1, 1, 1)
    assert got[None, "123 !!"] == got[clean, "123 !!"] == 0

    fresh = " ".join(f"fresh{k}" for k in range(40))
    few = docs.where(f"doc_id = {clean}")
    few = few.union(made((clean, clean, row[clean]["text"]), (None, clean, row[clean]["text"]), (None, clean, fresh), (None, clean, fresh), (clean, clean, fresh + " end")).exceptAll(docs))
    assert texts_of(stage["near_duplicates"](spark, few, SF)) == {(clean, row[clean]["text"]): 1, (clean, fresh + " end"): 1}

    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "d e", "s"), (None, "f g", "s"), (None, "f g", "t"), (2, "h", None), (3, "", "s")]
    some = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = Counter()
    for r in mix(some, carry=some.columns).collect():
        want[tuple(r["row"])] += r["copies"]
    assert set(want) == set(rows) and want[3, "", "s"] == 0
    assert Counter(map(tuple, stage["mixing"](spark, some, SF).collect())) == +want
    even = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (1, "a b", "t"), (1, "a b", "t")], some.schema)
    sums = {r["source"]: (r["target"], r["taken"]) for r in mix(even, carry=even.columns).groupBy("row.source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    assert all(abs(taken - target) <= 2 for target, taken in sums.values())  # repeated rows are rounded one by one: a source misses its target by one of them at most
    assert stage["mixing"](spark, even, SF).count() <= 3 * even.count()

    tokens = stage["tokens"](spark, some, SF).collect()
    assert Counter(r["doc_id"] for r in tokens) == Counter(r[0] for r in rows)


def test_near_duplicates_builds_no_hash_table_of_a_growing_side(spark):
    docs = spark.createDataFrame([(i, f"one two three four five six seven {i % 3}") for i in range(9)], "doc_id long, text string")
    plan = corpus_pipeline.near_duplicates(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert any("LeftSemi" in x for x in joins) and not [x for x in joins if "LeftSemi" in x and "Broadcast" in x]
    assert sum("BroadcastHashJoin" in x for x in joins) <= 2  # the hot classes of join_classes, fewer than a thousand
