"""Hand-built rows: bounds, ties, missing values, late facts, streams against their batch twins."""

import datetime as dt
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from asoflow.functions import columns as C
from asoflow.operators import history as H
from asoflow.operators import joins as J
from asoflow.operators import ledger as L
from asoflow.operators import metrics as M
from asoflow.operators import panel as P
from asoflow.operators import replay as R
from asoflow.operators import text as T
from asoflow.operators import versions as V
from asoflow.sources import events as E
from asoflow.sources import tables as S
from asoflow.streaming.replay import classified_sink, history_sink, replay_stream


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_asof_bounds_and_ties(spark):
    rows = [("a", 1, day(0), 5.0), ("a", 2, day(3), 7.0), ("b", 1, day(0), 1.0), ("b", 1, day(1), 2.0), ("c", 1, day(9), 4.0)]
    df = spark.createDataFrame(rows, "k string, version long, available date, units double")
    got = {(r["k"], r["units"], r["ambiguous"]) for r in V.asof_read(df, F.lit(day(2)), ["k"]).collect()}
    assert got == {("a", 5.0, False), ("b", 1.0, True), ("b", 2.0, True)}
    assert {r["units"] for r in V.asof_read(df, F.lit(day(3)), ["k"]).where("k = 'a'").collect()} == {7.0}


def test_asof_multi_is_asof_read_for_each_origin(spark):
    rows = [(k, v, day((k * 7 + v * (5 if k % 2 else -2) + 20) % 30), float(v)) for k in range(12) for v in range(1, 4)]
    df = spark.createDataFrame(rows, "k long, version long, available date, units double")
    origins = spark.createDataFrame([(day(n),) for n in range(0, 31, 3)], "origin date")
    many = {(r["origin"], r["k"], r["version"]) for r in V.asof_multi(df, origins, ["k"]).collect()}
    each = {(o["origin"], r["k"], r["version"]) for o in origins.collect() for r in V.asof_read(df, F.lit(o["origin"]), ["k"]).collect()}
    assert many == each


def test_incident_bounds(spark):
    ledger = [("p", day(0), 1, "opening_stock", 5.0), ("p", day(7), 2, "sale", -5.0), ("p", day(8), 3, "receipt", 4.0), ("p", day(20), 4, "sale", -1.0)]
    df = spark.createDataFrame([(*r, r[1]) for r in ledger], "k string, day date, sequence long, kind string, delta double, available date")
    origins = spark.createDataFrame([("p", day(n)) for n in (0, -1, 7, 8, 30)] + [("q", day(0))], "k string, origin date")
    got = {(r["k"], r["origin"]): (r["status"], r["label"]) for r in L.incident_labels(df, origins, ["k"], "sequence", 7, F.lit(day(20))).collect()}
    assert got == {
        ("p", day(0)): ("labelled", 1), ("p", day(-1)): ("no_history", None), ("p", day(7)): ("already_out", None), ("p", day(8)): ("labelled", 0),
        ("p", day(30)): ("not_covered", None), ("q", day(0)): ("no_history", None),
    }


def test_lag_does_not_shift_over_gaps(spark):
    df = spark.createDataFrame([("s", day(0), 1.0), ("s", day(6), 2.0), ("s", day(7), 3.0)], "k string, day date, units double")
    got = {r["day"]: r["lag7"] for r in J.lagged(df, ["k"], "day", "units", 7, "lag7").collect()}
    assert got == {day(0): None, day(6): None, day(7): 1.0}


def test_scale_floor_and_ratio_nulls(spark):
    df = spark.createDataFrame([("s", 2.0)] * 9, "k string, r double")
    assert P.robust_scale(df, ["k"], "r").first()["scale"] == 1.0
    sums = spark.createDataFrame([(0.0, 1.0), (0.0, None)], "y double, p double").agg(*M.point_sums())
    assert M.point_metrics(sums).first()["mae"] is None
    full = spark.createDataFrame([(0.0, 1.0)], "y double, p double").agg(*M.point_sums())
    assert (M.point_metrics(full).first()["mae"], M.point_metrics(full).first()["wape"]) == (1.0, None)


def test_conformal_rank(spark):
    df = spark.createDataFrame([(float(k),) for k in range(1, 20)], "r double").withColumn("g", F.lit("g"))
    assert M.residual_quantile(df, ["g"], F.col("r"), 0.9, 5).first()["quantile"] == 18.0
    assert M.residual_quantile(df.limit(5), ["g"], F.col("r"), 0.9, 5).first()["status"] == "not_ready"


def test_partition_invariance(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("k"), (F.col("id") * 3 % 11).alias("v"))
    assert S.content_digest(df).first() == S.content_digest(df.repartition(9)).first()
    assert S.content_digest(df).first() != S.content_digest(df.union(df.limit(1))).first()


def test_publish_once(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") * 2).alias("v"))
    assert S.publish_once(df, str(tmp_path), "t", ["id"])[1] is True
    assert S.publish_once(df.repartition(3), str(tmp_path), "t", ["id"])[1] is False
    with pytest.raises(ValueError):
        S.publish_once(df.limit(3), str(tmp_path), "t", ["id"])


def test_roles_and_schema_drift(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "final")], "id long, role string")
    S.write_roles(df, str(tmp_path / "r"))
    assert {tuple(r) for r in S.read_roles(spark, str(tmp_path / "r"), "id long, role string").collect()} == {(1, "train"), (2, "final")}
    df.write.parquet(str(tmp_path / "p"))
    other = S.TableSpec("t", spark.createDataFrame([], "id int, role string").schema, ("id",))
    with pytest.raises(ValueError):
        S.read_table(spark, str(tmp_path / "p"), other)


def test_events_are_delivered_once(spark, tmp_path):
    path = str(tmp_path / "sink")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "event_id long, body string")
    assert E.deliver_once(first, path).count() == 2
    assert E.deliver_once(first.union(spark.createDataFrame([(3, "c")], first.schema)), path).where("event_id = 3").count() >= 0
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError):
        E.deliver_once(spark.createDataFrame([(1, "other")], first.schema), path)


def test_strict_json(spark):
    rows = [('{"k": 1}',), ('{"k": 1, "x": 2}',), ("{",), ('{"k": 1, "k": 2}',)]
    got = [r["problem"] for r in E.decode_json(spark.createDataFrame(rows, "t string"), "t", "k long").collect()]
    assert got == [None, "unknown_field", "malformed", "duplicate_key"]


def test_uuid5(spark):
    import uuid

    got = spark.range(20).select(C.uuid5(uuid.NAMESPACE_DNS.hex, F.col("id").cast("string")).alias("u")).collect()
    assert [r["u"] for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, str(k))) for k in range(20)]


def test_text_pieces_and_blocks(spark):
    for text in ("", "a b c", "é" * 50, "line one\nline two\n\nline three " * 5):
        parts = T.bounded_pieces(text, 20)
        assert all(0 < len(p.encode()) <= 20 for p in parts)
        assert "".join("".join(parts).split()) == "".join(text.split())
    md = "# A\n\npara\nmore\n\n## B\n```\n# no heading\n```\n---\n<!-- x -->\nend\n# C\nlast"
    blocks = T.markdown_blocks(spark.createDataFrame([(1, md)], "id long, t string"), "id", "t").orderBy("block").collect()
    assert [(r["kind"], r["path"], r["text"]) for r in blocks] == [("text", "A", "para\nmore"), ("code", "A > B", "```\n# no heading\n```"), ("text", "A > B", "end"), ("text", "C", "last")]


NAMES = ("partition", "offset", "kind", "event_id", "event_time", "complete_through", "value")
RECORDS = [
    (0, 0, "delivery", 1, "2024-01-01T10:00:00", None, 1.0), (0, 1, "delivery", 2, "2024-01-01T09:00:00", None, 2.0), (0, 1, "delivery", 2, "2024-01-01T09:00:00", None, 2.0),
    (0, 2, "delivery", 1, "2024-01-01T10:00:00", None, 1.0), (0, 3, "delivery", 1, "2024-01-01T10:00:00", None, 9.0), (0, 4, "progress", None, None, "2024-01-02T00:00:00", None),
    (0, 4, "delivery", 5, "2024-01-02T00:00:00", None, 3.0), (0, 9, "delivery", 6, "2024-01-03T00:00:00", None, 3.0), (1, 0, "delivery", 7, "2024-01-03T00:00:00", None, 3.0),
    (0, 5, "progress", None, None, "2024-01-02T00:00:00", None), (1, 7, "progress", None, None, "2024-01-09T00:00:00", None), (1, 1, "delivery", 2, "2024-01-14T00:00:00", None, 2.0),
]


def replayed(spark, root, parts, parent=None, fail=None):
    """Runs the stream over parts, a file and batch each; the batch numbered `fail` is lost after its effects."""
    (root / "in").mkdir(exist_ok=True)
    for k, part in enumerate(parts):
        (root / "in" / f"{k}.json").write_text("".join(json.dumps(dict(zip(NAMES, r, strict=True))) + "\n" for r in part))
        os.utime(root / "in" / f"{k}.json", (1_700_000_000 + k * 60,) * 2)  # files are taken by age
    schema = "partition int, offset long, kind string, event_id long, event_time timestamp, complete_through timestamp, value double"
    lost = {fail}

    def run():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(root / "in"))
        sink = classified_sink(str(root / "good"), str(root / "bad"), parent)

        def write(batch, number):
            sink(batch, number)
            batch.where("kind = 'progress'").write.mode("overwrite").parquet(str(root / f"told/batch={number}"))
            if number in lost:
                lost.discard(number)
                raise RuntimeError("lost")

        replay_stream(source).writeStream.foreachBatch(write).option("checkpointLocation", str(root / "c")).trigger(availableNow=True).start().awaitTermination(120)

    try:
        run()
    except Exception:
        assert fail is not None
        run()
    return spark.read.parquet(str(root / "good")), spark.read.parquet(str(root / "bad")), spark.read.parquet(str(root / "told"))


@pytest.mark.parametrize("fail", [None, 0, 1])
def test_replay_stream(spark, tmp_path, fail):
    good, bad, told = replayed(spark, tmp_path, (RECORDS[:4], RECORDS[4:]), fail=fail)
    kept = sorted((r["partition"], r["offset"], r["timing"]) for r in good.collect())
    assert kept == [(0, 0, "on_time"), (0, 1, "out_of_order"), (0, 4, "late"), (1, 0, "on_time")]
    lost = sorted((r["partition"], r["offset"], r["status"]) for r in bad.collect())
    # the copy at (1, 1) comes many days after its event, from another partition
    assert lost == [(0, 1, "redelivery"), (0, 2, "duplicate_event"), (0, 3, "event_conflict"), (0, 9, "gap"), (1, 1, "duplicate_event")]
    marks = sorted((r["partition"], r["offset"], r["transport"]) for r in told.collect())
    assert marks == [(0, 4, "progress"), (0, 5, "frontier_not_advanced"), (1, 7, "position_mismatch")]


def test_replay_against_a_parent(spark, tmp_path):
    parent = spark.createDataFrame([(1, 1.0), (2, 5.0), (5, 3.0)], "event_id long, value double")
    good, bad, _ = replayed(spark, tmp_path, (RECORDS[:4], RECORDS[4:]), parent)
    assert sorted(r["event_id"] for r in good.collect()) == [1, 5]
    assert sorted((r["partition"], r["offset"], r["status"]) for r in bad.collect()) == [
        (0, 1, "payload_conflict"), (0, 1, "redelivery"), (0, 2, "duplicate_event"), (0, 3, "payload_conflict"), (0, 9, "gap"), (1, 0, "foreign_event"), (1, 1, "payload_conflict"),
    ]


OBSERVED = "partition int, offset long, event_id string, row_id string, observation_id string, version long, grain string, units double, available date"


def test_observation_history(spark, tmp_path):
    def made(*rows):
        return spark.createDataFrame(rows, OBSERVED)

    first = made((0, 0, "e1", "r1", "o1", 1, "g1", 1.0, day(1)), (0, 1, "e2", "r2", "o1", 2, "g1", 2.0, day(3)), (1, 0, "e3", "r3", "o2", 1, "g2", None, day(1)))
    none = first.limit(0)
    assert H.observation_violations(first, none).count() == 0
    assert H.observation_violations(first, first).count() == 0  # the same records again are receipts
    cases = {
        (1, 2, "e4", "r4", "o3", 1, "g3", 1.0, day(1)): {"offset_gap"}, (1, 0, "e3", "r3", "o2", 1, "g2", 5.0, day(1)): {"receipt_mismatch", "event_collision", "version_collision"},
        (1, 1, "e1", "r4", "o3", 1, "g3", 1.0, day(1)): {"event_collision"}, (1, 1, "e4", "r1", "o3", 2, "g3", 1.0, day(1)): {"row_collision"}, (1, 1, "e4", "r4", "o3", 1, "g1", 1.0, day(1)): {"grain_collision"},
        (1, 1, "e4", "r4", "o1", 3, "g9", 1.0, day(4)): {"grain_changed"}, (1, 1, "e4", "r4", "o1", 3, "g1", 1.0, day(2)): {"availability_regression"}, (1, 1, "e4", "r4", "o1", 3, "g1", 1.0, day(3)): set(),
    }
    for row, want in cases.items():
        assert {r["reason"] for r in H.observation_violations(made(row), first).collect()} == want, row
    write = history_sink(str(tmp_path / "h"), str(tmp_path / "b"))
    write(first, 0)
    write(first, 0)  # tried again
    with pytest.raises(ValueError):
        write(made((1, 1, "e1", "r4", "o3", 1, "g3", 1.0, day(1))), 1)
    assert spark.read.parquet(str(tmp_path / "h")).count() == 3 and spark.read.parquet(str(tmp_path / "b")).first()["reason"] == "event_collision"
    write(made((1, 1, "e4", "r4", "o1", 3, "g1", 4.0, day(5))), 1)
    H.captured(spark.read.parquet(str(tmp_path / "h")).drop("batch"), str(tmp_path / "cap"))
    back = H.restored(spark, str(tmp_path / "cap"))
    assert {(r["grain"], r["version"], r["units"]) for r in H.history_as_of(back, F.lit(day(4))).collect()} == {("g1", 2, 2.0), ("g2", 1, None)}
    assert H.quantity_total(H.history_as_of(back, F.lit(day(4)))).first()["status"] == "unknown_quantity"
    assert H.quantity_total(H.history_as_of(back, F.lit(day(9))).where("grain = 'g1'")).first()["total"] == 4.0
    back.where("offset = 0").write.mode("overwrite").parquet(str(tmp_path / "cap/rows2"))
    (tmp_path / "cap/rows").rename(tmp_path / "cap/old")
    (tmp_path / "cap/rows2").rename(tmp_path / "cap/rows")
    with pytest.raises(ValueError):
        H.restored(spark, str(tmp_path / "cap"))


def test_classify_deliveries(spark):
    rows = [(0, 1, "g", "x", 1.0), (1, 1, "g", "x", 1.0), (2, 1, "g", "y", 2.0), (3, 2, "g", "z", 1.0), (4, 3, "g", "w", 5.0), (5, 4, "h", "v", 5.0)]
    df = spark.createDataFrame(rows, "offset long, event_id long, grain string, body string, value double")
    got = {r["offset"]: r["status"] for r in R.classify_deliveries(df).collect()}
    assert got == {0: "accepted", 1: "duplicate_event", 2: "event_conflict", 3: "duplicate_business", 4: "business_conflict", 5: "accepted"}
    assert R.accounting(R.classify_deliveries(df)).first()["balanced"] is True


def test_cosine_search_in_blocks(spark, monkeypatch):
    rows = [(k, k % 4, [float((k * a) % 7 - 3), float(k % 5), 1.0]) for k, a in zip(range(90), [3, 5, 2] * 30, strict=True)]
    chunks = spark.createDataFrame(rows, "id long, document long, v array<double>")
    queries = chunks.where("id % 3 = 0").selectExpr("id as query_id", "v")

    def found():
        return sorted(map(tuple, T.cosine_search(chunks, queries, 5, 2).select("query_id", "id", "document", "score", "rank").collect()))

    want = []
    for q, _, x in rows[::3]:
        held, rank = {}, 0
        for score, k, d in sorted((-round(float(np.dot(x, v) / np.linalg.norm(x) / np.linalg.norm(v)), 6), k, d) for k, d, v in rows if k != q):
            held[d] = held.get(d, 0) + 1
            if held[d] <= 2 and rank < 5:
                rank += 1
                want.append((q, k, d, -score, rank))
    assert found() == sorted(want)
    monkeypatch.setattr(T, "_QUERIES", 7)
    monkeypatch.setattr(T, "_VECTORS", 20)
    assert found() == sorted(want)


def test_cosine_search_takes_any_number_of_queries(spark):
    chunks = spark.createDataFrame([(k, k, [1.0, k / 3]) for k in range(3)], "id long, document long, v array<double>")
    queries = spark.range(100, 10_101).selectExpr("id as query_id", "array(1.0d, 0.5d) as v")
    assert T.cosine_search(chunks, queries, 1, 1).count() == 10_001


def test_diversify_skips_what_does_not_fit(spark):
    rows = [(1, 10, "r1", "d1", 0.9, 50), (1, 11, "r1", "d1", 0.8, 80), (1, 12, "r2", "d1", 0.7, 30), (1, 13, "r2", "d2", 0.6, 100), (1, 14, "r2", "d2", 0.5, 10), (1, 15, "r3", "d3", -0.1, 1)]
    hits = spark.createDataFrame(rows, "query_id long, id long, repository string, document string, score double, size int")
    got = [tuple(r)[1:] for r in T.diversify(hits, 0.0, 100, "size", 5, 2).orderBy("used").collect()]
    assert got == [(10, 0, 50), (12, 0, 80), (14, 2, 90)]  # 13 doesn't fit and is skipped, 11 is the third of its document


def test_near_duplicates_are_classes_and_components(spark):
    base = [f"w{k}" for k in range(60)]
    texts = {1: base, 2: base, 3: [*base[:30], "x", *base[31:]], 4: [*base[:30], "x", *base[31:50], "y", *base[51:]], 5: [f"v{k}" for k in range(60)], 6: base[:11], 7: ["Straße", *base[1:]], 8: ["STRASSE", *base[1:]]}
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()] + [(9, None), (10, "")], "id long, t string")
    got = {r["id"]: (r["class_id"], r["component_id"]) for r in T.near_duplicates(df, "id", "t").collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (4, 1), 5: (5, 5), 7: (7, 1), 8: (7, 1)}
    many = spark.createDataFrame([(k, " ".join([*base, f"end{k}"])) for k in range(300)], "id long, t string")
    assert {r["component_id"] for r in T.near_duplicates(many, "id", "t").collect()} == {0}
    assert T.near_duplicates(df.limit(0), "id", "t").count() == 0


def test_chunks(spark):
    md = "# A\n\npara\n\npara\n\n# B\n\npara\n\n" + "long words here " * 20
    rows = T.chunk_table(spark.createDataFrame([(1, md)], "id long, t string"), "id", "t", 100).orderBy("chunk_index").collect()
    assert [(r["path"], r["text"], len(r["occurrences"])) for r in rows[:2]] == [("A", "para", 2), ("B", "para", 1)]
    assert all(len(r["text"].encode()) <= 100 for r in rows) and [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert [r["tokens"] for r in rows] == [-(-len(r["text"].encode()) // 4) for r in rows]
    spark.udtf.register("chunk_text", T.chunk_text)
    got = spark.sql("select piece, text from chunk_text('one two three', 8)").collect()
    assert [tuple(r) for r in got] == list(enumerate(T.bounded_pieces("one two three", 8)))


def test_order_statistics_by_buckets(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g in ("a", "b", None) for v in np.round(rng.exponential(5, 700), 1)] + [("c", 1.0)] * 500 + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for rank in (1, 7, 350, 500):
        got = {r["g"]: r["statistic"] for r in M.order_statistic(df, ["g"], "v", lambda n, rank=rank: F.lit(rank)).collect()}
        want = {g: sorted(v for h, v in rows if h == g and v is not None)[rank - 1] for g in ("a", "b", None, "c")}
        assert got == want
    assert M.order_statistic(df, [], "v", lambda n: n).first()["statistic"] == max(v for _, v in rows if v is not None)
    band = {r["g"]: (r["n"], round(r["high"] - r["low"], 6)) for r in M.shortest_band(df, ["g"], "v", 0.8).collect()}
    for g in ("a", None):
        v = sorted(x for h, x in rows if h == g)
        need = int(np.ceil((len(v) + 1) * 0.8))
        assert band[g] == (len(v), round(min(v[k + need - 1] - v[k] for k in range(len(v) - need + 1)), 6))


def test_endpoint_shift_falls_back_and_may_be_missing(spark):
    rows = [("p", "l", float(k), 10.0, 20.0) for k in range(99)] + [("p", "m", 1.0, 10.0, 20.0)] * 5
    df = spark.createDataFrame(rows, "product string, location string, y double, low double, high double")
    levels = [["product", "location"], ["product"], []]
    got = {r["location"]: (r["lower_shift"], r["upper_shift"], r["level"]) for r in M.endpoint_shift(df, levels, "y", "low", "high", 0.05, 50).collect()}
    assert got["l"] == (4.0 - 10, 94.0 - 20, 0)  # floor(5) = 5th of y - low, ceil(95) = 95th of y - high
    assert got["m"][2] == 1
    assert {r["level"] for r in M.endpoint_shift(df, levels, "y", "low", "high", 0.05, 5000).collect()} == {None}
    gap = df.union(spark.createDataFrame([("p", "l", 1.0, None, None)], df.schema))
    assert {r["level"] for r in M.endpoint_shift(gap, levels, "y", "low", "high", 0.05, 50).collect()} == {None}


def test_plan_of_another_place_does_not_win(spark):
    lines = spark.createDataFrame([(1, "p", "EU", "web", day(5)), (2, "p", "US", "shop", day(5)), (3, "p", "US", "web", day(5))], "id long, part string, location string, channel string, day date")
    plans = [("p", None, "all", day(0), day(9), 1, day(0), 1), ("p", "EU", "all", day(0), day(9), 1, day(0), 2), ("p", None, "web", day(0), day(9), 1, day(0), 3), ("p", "EU", "shop", day(0), day(9), 1, day(0), 4)]
    df = spark.createDataFrame(plans, "part string, location string, channel string, from_day date, to_day date, version long, known date, price long")
    got = {r["id"]: r["price"] for r in J.plan_match(lines, df, "part", "day", F.lit(day(5)), ["id"]).collect()}
    assert got == {1: 2, 2: 1, 3: 3}
