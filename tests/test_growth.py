"""What must not grow with the tables: batches of a replay, what is read twice, and rules that SQL and query share."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from asoflow.plans import q_sinks

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("parts", [16, 40])
def test_batches_of_a_replay_do_not_grow_with_partitions(spark, monkeypatch, parts):
    monkeypatch.setattr(q_sinks, "_parts", lambda spark, d: parts)
    root = q_sinks._replayed(spark, SF)
    assert len(list(Path(root.removeprefix("file://")).glob("good/batch=*"))) == 4
    good = spark.read.parquet(f"{root}/good")
    assert good.count() == good.select("event_id").distinct().count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_running_sums_take_approximate_cuts_once(spark):
    from asoflow.operators.metrics import running_sums

    cells = spark.range(5_000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
    out = running_sums(cells, ["g"], "v", ["n"])
    assert "percentile_approx" not in out._jdf.queryExecution().optimizedPlan().toString()  # else each reader cuts for itself
    assert out.where("upto_n <> floor(v / 3) + 1").count() == 0 and out.count() == 5_000


def test_scoped_search_matches_sql_in_double_precision(spark, tmp_path):
    """Vectors whose cosine in single precision rounds to another sixth place."""
    import numpy as np
    from oracle import compare, connect

    from asoflow.plans import registry

    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=64))], i % 10) for i in range(1_500)]
    _tables(spark, tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    name = "tx08_scoped_search"
    mine = {tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).select("query_id", "id", "rank", "score").collect()}
    theirs = connect(str(tmp_path)).execute(f"select query_id, id, rank, score from ({registry.oracle_sql()[name]})").fetchall()
    assert mine == set(theirs) and len(mine) == len(theirs)
    assert compare(spark, connect(str(tmp_path)), str(tmp_path), registry.queries()[name], registry.oracle_sql()[name]) is None


def test_hash_embedding_matches_sql_on_null_and_empty_texts(spark, tmp_path):
    from oracle import compare, connect

    from asoflow.plans import registry

    docs = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "1L as n_chars")
    _tables(spark, tmp_path, documents=docs)
    name = "tx06_hash_embedding"
    assert compare(spark, connect(str(tmp_path)), str(tmp_path), registry.queries()[name], registry.oracle_sql()[name]) is None


def test_rounded_numbers_of_a_digest_keep_the_sign_of_zero(spark, tmp_path):
    """Texts with a number between -0.0000005 and 0, one in four million: SQL rounds it to -0.0, which prints and hashes unlike 0.0."""
    from oracle import connect

    from asoflow.plans import registry

    docs = spark.createDataFrame([(1, "text number 808443"), (2, "a b")], "doc_id long, text string")
    turns = spark.createDataFrame([(1, 0, "text 4419276"), (1, 1, "a b")], "conv_id long, turn int, text string")
    _tables(spark, tmp_path, documents=docs, conversations=turns)
    for name, key, value in (("tx06_hash_embedding", "doc_id", "v"), ("tx07_embedding_cache", "turn", "raw")):
        mine = {r[0]: str(r[1]) for r in registry.queries()[name](spark, str(tmp_path)).select(key, value).collect()}
        theirs = connect(str(tmp_path)).execute(f"select {key}, {value} from ({registry.oracle_sql()[name]})").fetchall()
        assert mine == {k: str(v) for k, v in theirs} and any("-0.0," in v for v in mine.values())


def _tables(spark, root, **tables):
    """The smallest tables with some in place of them."""
    for path in Path(SF).glob("*.parquet"):
        if path.stem not in tables:
            (root / path.name).symlink_to(path)
    for name, df in tables.items():
        df.write.parquet(str(root / f"{name}.parquet"))


def test_search_holds_scores_of_a_stripe_and_deliveries_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from asoflow.operators import text as T
    from asoflow.sources import events as E

    matrix, cosines = T._block_math()
    with pytest.raises(ValueError, match="one length"):  # as an array, not an object for each number
        matrix(pa.chunked_array([pa.array([[1.0, 2.0], [3.0]])]))
    x = np.arange(1.0, 7.0).reshape(2, 3)
    assert (matrix(pa.chunked_array([pa.array(x.tolist())])) == x).all()
    assert cosines(x, x).tolist() == [[1.0, 0.974632], [0.974632, 1.0]]

    monkeypatch.setattr(E, "_ROWS", 50)
    rows = spark.range(2_000).select(F.col("id").alias("event_id"), F.concat(F.lit("b"), "id").alias("body"))
    E.deliver_once(rows.where("event_id < 900"), str(tmp_path / "out"))
    E.deliver_once(rows, str(tmp_path / "out"))
    assert len([p for p in (tmp_path / "out").glob("part-*")]) > 8 + 18  # a task for each 50 rows, not one for what fits 64 MB
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("event_id").distinct().count() == 2_000
    for bad in (rows.withColumn("body", F.lit("x")), spark.createDataFrame([(5000, "p"), (5000, "q")], rows.schema)):
        with pytest.raises(ValueError, match="another body"):
            E.deliver_once(bad, str(tmp_path / "out"))


def test_near_duplicates_send_shingles_once(spark, monkeypatch):
    """Shingles are exploded once to count and choose them, and once more only for the chosen."""
    from asoflow.operators import text as T

    plans, written = [], T.written
    monkeypatch.setattr(T, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or written(df))
    words = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, words), (2, words + " more"), (3, words), (4, " ".join(f"v{k}" for k in range(30)))], "doc_id long, text string")
    found = {tuple(r) for r in T.near_duplicates(docs, "doc_id", "text").collect()}
    assert found == {(1, 1, 1), (2, 2, 1), (3, 1, 1), (4, 4, 4)}
    assert max(p.count("Generate explode") for p in plans[:3]) == 2


def test_near_duplicates_write_shingles_of_possible_partners_only(spark, monkeypatch):
    """Of a set without a partner only the halves of its first shingles are written. What is left equals all pairs compared one by one, around the threshold, in sets of many sizes."""
    import random

    from asoflow.operators import text as T

    rng, texts = random.Random(5), []
    for _ in range(40):
        words = [f"w{rng.randrange(10_000)}" for _ in range(rng.randrange(12, 90))]
        for _ in range(6):
            texts.append(list(words))
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [f"v{rng.randrange(10_000)}" for _ in range(rng.randrange(3))]
    texts += [[f"u{k}x{j}" for j in range(100)] for k in range(300)]
    sets = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} if len(t) >= 12 else None for t in texts]
    best = list(range(len(sets)))
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 18 * len(sets[a] & sets[b]) >= 8 * (len(sets[a]) + len(sets[b]))]
    assert any(18 * len(sets[a] & sets[b]) == 8 * (len(sets[a]) + len(sets[b])) for a, b in pairs)
    for _ in sets:
        for a, b in pairs:
            best[a] = best[b] = min(best[a], best[b])

    tables, written = [], T.written
    monkeypatch.setattr(T, "written", lambda df: tables.append(written(df)) or tables[-1])
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {r["id"]: r["component_id"] for r in T.near_duplicates(docs, "doc_id", "text").collect()}
    assert found == {k: best[k] for k, x in enumerate(sets) if x} and len(pairs) > 100
    whole = [t for t in tables if "array<bigint>" in dict(t.dtypes).values()]
    assert whole and max(t.agg(F.max("class")).first()[0] if "class" in t.columns else len(texts) for t in whole) < 240
    assert sum(t.count() for t in whole) < 240


def test_near_duplicates_of_very_long_texts(spark):
    """More shingles than a ten-thousandth of an int."""
    from asoflow.operators import text as T

    words = [f"w{k}" for k in range(220_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-5]))], "doc_id long, text string")
    assert {tuple(r) for r in T.near_duplicates(docs, "doc_id", "text").collect()} == {(1, 1, 1), (2, 2, 1)}


def test_available_at_deals_lines_by_their_number(spark, monkeypatch):
    from asoflow.plans import q_scans, registry

    monkeypatch.setattr(q_scans, "_TASK_ROWS", 1_000)
    tasks = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 1_000)
    plan = registry.queries()["prj06_available_at"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {tasks}), REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan


@pytest.mark.parametrize(("name", "most"), [("ag08_endpoint_shift", 0), ("ml14_fitted_composition", 0)])
def test_forecasts_that_are_read_often_are_made_once(spark, name, most):
    from asoflow.plans import registry

    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_shipdate") <= most


def test_boosters_read_a_written_frame(spark, monkeypatch):
    """A pass of a fit reads the rows of a series and day, not the lines and the joins again."""
    from asoflow.operators import boosting
    from asoflow.plans import q_models, registry

    seen, fit = [], boosting.fit_booster

    def shorter(train, *args, **settings):
        seen.append(train._jdf.queryExecution().optimizedPlan().toString())
        return fit(train, *args, **(settings | {"rounds": 1}))

    monkeypatch.setattr(boosting, "fit_booster", shorter)
    registry.queries()["ml02_histogram_booster"](spark, SF)
    seen.append(q_models._frame(spark, SF)._jdf.queryExecution().optimizedPlan().toString())
    assert len(seen) == 3 and not any("l_shipdate" in p or "Join" in p for p in seen)


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS")


def test_facts_are_ranked_where_they_met_plans(spark):
    """A fact travels once, whatever scopes it asks for, and what it met isn't shuffled again; lots of locations change no result."""
    from asoflow.operators import joins as J
    from asoflow.operators import versions as V

    held = spark.range(40).selectExpr("id % 2 as part", "if(id > 36, null, concat('l', id)) as location", "if(id % 3 = 0, 'all', 'web') as channel", "date'2000-01-01' as from_day", "date'2000-02-01' as to_day", "date'1999-12-01' as known", "1L as version", "id as price")
    facts = spark.range(80).selectExpr("id", "id % 2 as part", "concat('l', id % 40) as location", "if(id < 40, 'web', 'shop') as channel", "date'2000-01-10' as day")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        matched = J.plan_match(facts, held, "part", "day", F.col("day"), ["id"])
        mapped = V.effective_mapping(facts, held.drop("location", "channel"), ["part"], "day", F.col("day"), ["id"])
        assert _shuffles(matched) == 2 and _shuffles(mapped) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plans, want = held.collect(), set()
    for f in facts.collect():
        met = [(2 * (p.location is not None) + (p.channel != "all"), p.price) for p in plans if p.part == f.part and p.location in (None, f.location) and p.channel in ("all", f.channel)]
        want |= {(f.id, *m) for m in met if m[0] == max(met)[0]}
    assert {(r.id, r.scope_rank, r.price) for r in matched.collect()} == want and len(want) > 60
    assert mapped.count() == 80 * 20


def test_plans_are_dealt_by_parts_and_lines_keep_their_place_beside_suppliers(spark, monkeypatch):
    from asoflow.sources import adapters

    monkeypatch.setattr(adapters, "_TASK_PARTS", 50, raising=False)
    tasks = -(-spark.read.parquet(f"{SF}/part.parquet").count() // 50)
    assert tasks > 1 and f", {tasks}), REPARTITION_BY_NUM" in adapters.plans(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_suppkey" not in adapters.lines(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_fits_on_documents_read_texts_once(spark):
    from asoflow.plans import q_fits, q_models

    for rows in (q_models._risk(spark, SF), q_fits._raw_scores(spark, SF)[0]):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_replace" not in plan and "Join" not in plan


def test_feature_frame_reads_lines_once(spark):
    from asoflow.plans import registry

    assert "l_shipdate" not in registry.queries()["ds07_feature_frame"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
