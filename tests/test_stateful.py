"""Stateful processors on hand-built streams, batch by batch."""

import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from asoflow.operators.qualification import qualification_gate
from asoflow.operators.worlds import world_differences
from asoflow.streaming.stateful import buffered_replay, checked_history, fail_stop_sink, rocks_state

RECORD = "`partition` int, `offset` long, kind string, event_id long, event_time timestamp, complete_through timestamp, value double"


def at(hour):
    return datetime.datetime(2024, 1, 1, hour)


def delivery(offset, event, hour, value=1.0, partition=0):
    return (partition, offset, "delivery", event, at(hour), None, value)


def progress(offset, hour, partition=0):
    return (partition, offset, "progress", None, None, at(hour), None)


def test_deliveries_wait_in_state_for_a_missing_offset(spark, tmp_path):
    batches = [
        [delivery(1, 11, 5), delivery(2, 10, 6), progress(1, 6), delivery(0, 20, 1, partition=1)],
        [delivery(4, 13, 3), delivery(2, 10, 6)],
        [delivery(0, 10, 4), progress(0, 2), progress(9, 23)],
        [delivery(3, 10, 8, 7.0), delivery(0, 10, 4), progress(2, 9), progress(5, 6)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, RECORD).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
        with rocks_state(spark, bounded=True):
            stream = buffered_replay(spark.readStream.schema(RECORD).parquet(str(tmp_path / "in")), patience_ms=1)
            stream.writeStream.foreachBatch(lambda b, n, k=k: b.withColumn("run", F.lit(k)).write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    alarms = [(r["run"], r["offset"], r["value"]) for r in rows if r["kind"] == "gap"]
    assert (1, 0, 3.0) in alarms  # the missing offset and how many wait
    got = sorted((r["run"], r["partition"], r["offset"], r["kind"], r["event_id"], r["status"], r["timing"]) for r in rows if r["kind"] != "gap")
    want = [
        (0, 1, 0, "delivery", 20, "accepted", "on_time"), (1, 0, 2, "delivery", 10, "redelivery", None),
        (2, 0, 0, "progress", None, "progress", None), (2, 0, 0, "delivery", 10, "accepted", "on_time"), (2, 0, 1, "progress", None, "progress", None), (2, 0, 1, "delivery", 11, "accepted", "late"),
        (2, 0, 2, "delivery", 10, "duplicate_event", "late"), (3, 0, 3, "delivery", 10, "event_conflict", "on_time"), (3, 0, 4, "delivery", 13, "accepted", "late"), (3, 0, 0, "delivery", 10, "redelivery", None),
        (3, 0, 2, "progress", None, "position_mismatch", None), (3, 0, 5, "progress", None, "frontier_not_advanced", None),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)


OBSERVED = "`partition` int, `offset` long, event_id string, row_id string, observation_id string, version long, grain string, units double, available date"


def observed(offset, version=1, day=1, partition=0, **changes):
    row = {"event": f"e{partition}-{offset}", "row": f"r{version}", "observation": "o", "grain": "g"} | changes
    return (partition, offset, row["event"], row["row"], row["observation"], version, row["grain"], 1.0, datetime.date(2024, 1, day))


@pytest.mark.parametrize(
    ("bad", "reason"),
    [
        (observed(2, 1, 2), "version_collision"), (observed(2, 3, 3, row="r1"), "row_collision"), (observed(2, 3, 3, grain="other"), "grain_changed"), (observed(2, 1, 1, observation="o2", row="x"), "grain_collision"),
        (observed(2, 3, 1), "availability_regression"), (observed(2, 3, 3, event="e0-0"), "event_collision"), (observed(1, 3, 3), "receipt_mismatch"), (observed(5, 3, 3), "offset_gap"),
    ],
)
def test_history_stops_at_its_first_fault(spark, tmp_path, bad, reason):
    def run(rows):
        spark.createDataFrame(rows, OBSERVED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with rocks_state(spark, bounded=True):
            stream = checked_history(spark.readStream.schema(OBSERVED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), buckets=2)
            stream.writeStream.foreachBatch(fail_stop_sink(str(tmp_path / "good"), str(tmp_path / "bad"))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    run([observed(0), observed(1, 2, 2)])
    run([observed(0), observed(0, 1, partition=1)])  # delivered again, and the same fact in another partition
    with pytest.raises(Exception, match="HistoryStopped"):
        run([bad])
    good, faults = spark.read.parquet(str(tmp_path / "good")), spark.read.parquet(str(tmp_path / "bad"))
    assert sorted((r["partition"], r["offset"]) for r in good.collect()) == [(0, 0), (0, 1), (1, 0)]
    assert reason in {r["reason"] for r in faults.collect()}


def test_worlds_differ_row_by_row(spark):
    schema = "key string, day date, x long"
    d = [datetime.date(2024, 1, k) for k in range(1, 29)]
    a = [("p", d[0], 1), ("p", d[0], 1), ("p", d[20], 2), ("q", d[3], None), ("r", d[5], 5), (None, d[1], 1)]
    b = [("p", d[0], 1), ("p", d[20], 2), ("p", d[20], 3), ("q", d[3], None), ("s", d[9], 1)]
    got = {r["key"]: (r["adds"], r["removes"], r["first_day"]) for r in world_differences({"t": spark.createDataFrame(a, schema)}, {"t": spark.createDataFrame(b, schema)}, {"t": ("key", "day")}).collect()}
    assert got == {"p": (1, 1, d[0]), "q": (0, 0, None), "r": (0, 1, d[5]), "s": (1, 0, d[9])}


def test_day_gate_tries_statuses_in_order(spark):
    day = datetime.date
    names = ["none", "late", "incomplete", "closed", "missing", "good", "idle"]
    points = spark.createDataFrame([(n, day(2024, 1, 9)) for n in names], "n string, as_of date")
    days = spark.createDataFrame([("late", day(2024, 1, 10), True, "open"), ("incomplete", day(2024, 1, 1), False, "closed"), ("closed", day(2024, 1, 1), True, "closed"), *((n, day(2024, 1, 1), True, "open") for n in ("missing", "good", "idle"))], "n string, known date, source_complete boolean, activity string")
    required = spark.createDataFrame([("missing", "sale", "1", True), ("missing", "sale", "2", True), ("good", "return", "3", True), ("good", "sale", "1", False), ("good", "return", "4", True), ("closed", "sale", "9", True)], "n string, kind string, fact_id string, own boolean")
    facts = spark.createDataFrame([("sale", "1", day(2024, 1, 2), 4, 10.0, False), ("sale", "2", day(2024, 1, 20), 1, 1.0, False), ("return", "3", day(2024, 1, 9), 2, 5.0, False), ("return", "4", day(2024, 1, 3), 7, 6.0, True)], "kind string, fact_id string, available date, quantity long, amount double, rejected boolean")
    none = spark.createDataFrame([], "received date")
    got = {r["n"]: (r["status"], r["n_missing"], r["first_missing"], r["observed_units"], r["amount"], r["rejected_units"]) for r in qualification_gate(points, days, required, facts, none, ["n"]).collect()}
    empty = (0, None, None, None, None)
    assert got == {
        "none": ("no_declaration", *empty), "late": ("closure_unavailable", *empty), "incomplete": ("source_incomplete", *empty), "closed": ("location_closed", *empty),
        "missing": ("dq_missing_facts", 1, "sale:2", None, None, None), "good": ("qualified", 0, None, 2, 11.0, 7), "idle": ("qualified", 0, None, 0, 0.0, 0),
    }
    loose = spark.createDataFrame([(day(2024, 1, 9),), (day(2024, 1, 30),)], "received date")
    got = {r["n"]: r["status"] for r in qualification_gate(points, days, required, facts, loose, ["n"]).collect()}
    assert [got[n] for n in names[3:]] == ["location_closed", *["dq_unattributed_quarantine"] * 3]


class _Map:
    """A map state that counts its calls."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def getMapState(self, name, *schemas):
        return self

    def containsKey(self, key):
        self.calls += 1
        return key in self.rows

    def getValue(self, key):
        self.calls += 1
        return self.rows[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.rows[key] = value

    def removeKey(self, key):
        self.calls += 1
        self.rows.pop(key, None)


@pytest.mark.parametrize("held", [5_000, 200_000])
def test_state_is_read_and_written_by_slots_not_by_entries(monkeypatch, held):
    from asoflow.streaming import stateful as S

    monkeypatch.setattr(S, "_HELD", held)
    for kind in (S._Slots, S._Blocks):
        state = _Map()
        slots = kind(state, "x")
        for batch in range(4):
            for n in range(batch, 12_000, 4):
                assert n not in slots and slots.get(n) is None
                slots.put(n, [n, None, 0.1])
            slots.flush()
        assert all(slots.get(n) == [n, None, 0.1] for n in range(12_000))
        assert held == 5_000 or state.calls < 1_000  # three calls an entry before
        assert all(len(json.loads(v) or ()) <= S._SLOT for (v,) in state.rows.values())
        for n in range(0, 12_000, 7):
            assert slots.pop(n) == [n, None, 0.1]
        slots.flush()
        assert 7 not in slots and slots.get(8) == [8, None, 0.1]
