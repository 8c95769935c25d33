"""Stateful processors: a replay that waits for missing offsets, and the rules of a versioned history, each key against its own past."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession, bounded: bool = False) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which stateful processors need. bounded: they run no batch without data, so a run over what is there (availableNow) ends although timers may wait."""
    wanted = {_PROVIDER: _ROCKS} | ({_NO_DATA: "false"} if bounded else {})
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


# --- state in slots ---------------------------------------------------------------------------

_SLOT = 2_000  # entries of a slot
_HELD = 200_000  # entries in memory, read or written since the last flush


class _Slots:
    """A map state whose entries lie many to a slot, so that a batch reads and writes a slot once and not each entry.

    A slot is named by the leading digits of its entries' digests; one that grows beyond _SLOT entries hands them to sixteen
    slots of one digit more. So slots stay small and a batch costs what it brings, however many entries there are.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str) -> None:
        self.state = handle.getMapState(name, "slot string", "entries string")
        self.held: dict[str, dict | None] = {}  # None: handed on
        self.changed: set[str] = set()
        self.n_held = 0

    def _slot(self, name: str) -> str:
        digest, slot = hashlib.md5(name.encode(), usedforsecurity=False).hexdigest(), "s"
        while self._entries(slot) is None:
            slot = "s" + digest[: len(slot)]
        return slot

    def _entries(self, slot: str) -> dict | None:
        if slot not in self.held:
            if self.n_held >= _HELD:
                self.flush()
            self.held[slot] = json.loads(self.state.getValue((slot,))[0]) if self.state.containsKey((slot,)) else {}
            self.n_held += len(self.held[slot] or ())
        return self.held[slot]

    def __contains__(self, name) -> bool:
        return str(name) in self._entries(self._slot(str(name)))

    def get(self, name):
        return self._entries(self._slot(str(name))).get(str(name))

    def put(self, name, value) -> None:
        slot = self._slot(str(name))
        entries = self._entries(slot)
        entries[str(name)] = value
        self.n_held += 1
        self.changed.add(slot)
        if len(entries) > _SLOT:
            self._hand_on(slot, entries)

    def _hand_on(self, slot: str, entries: dict) -> None:
        self.held[slot] = None
        for name, value in entries.items():
            self.put(name, value)

    def pop(self, name):
        slot = self._slot(str(name))
        value = self._entries(slot).pop(str(name))
        self.changed.add(slot)
        return value

    def flush(self) -> None:
        """Write what changed; to be called before another key's rows are handled."""
        for slot in self.changed:
            entries = self.held[slot]
            if entries == {}:
                self.state.removeKey((slot,))
            else:
                self.state.updateValue((slot,), (json.dumps(entries),))
        self.held.clear()
        self.changed.clear()
        self.n_held = 0


class _Blocks(_Slots):
    """Slots of entries named by whole numbers, a thousand that follow one another in each: what is read in order lies together."""

    def _slot(self, name: str) -> str:
        return str(int(name) // 1_000)

    def _hand_on(self, slot: str, entries: dict) -> None:
        pass


# --- replay ----------------------------------------------------------------------------------

_REPLAYED = "`partition` int, `offset` long, kind string, event_id long, value double, status string, timing string, watermark timestamp"


class _GapBuffer(StatefulProcessor):
    """One capture partition: its place, the deliveries and progress records beyond a gap, and the events that were seen."""

    def __init__(self, patience_ms: int) -> None:
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, waiting long, watermark long, latest long, alarm long")
        self.ahead = _Blocks(handle, "ahead")
        self.told = handle.getListState("told", "offset long, through long")
        self.events = _Slots(handle, "events")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, waiting, mark, latest, alarm = self.place.get() or (0, 0, None, None, None)
        progress = sorted(tuple(x) for x in self.told.get())
        had = len(progress)
        out: list[tuple] = []
        for frame in rows:  # an Arrow batch at a time
            fresh: dict[int, tuple] = {}
            for kind, offset, event, moment, through, value in frame[["kind", "offset", "event_id", "at", "through", "value"]].itertuples(index=False):
                offset = int(offset)
                if kind == "progress":
                    if offset < at:
                        out.append((offset, kind, None, None, "position_mismatch", None, mark))
                    else:
                        progress.append((offset, int(through)))
                elif offset < at or offset in fresh or (waiting and offset in self.ahead):
                    out.append((offset, kind, int(event), _number(value), "redelivery", None, mark))
                else:
                    fresh[offset] = (int(event), int(moment), _number(value))
            progress.sort()
            while True:
                while progress and progress[0][0] == at:
                    through = progress.pop(0)[1]
                    moves = mark is None or through > mark
                    mark = through if moves else mark
                    out.append((at, "progress", None, None, "progress" if moves else "frontier_not_advanced", None, mark))
                delivery = fresh.pop(at, None)
                if delivery is None and waiting and at in self.ahead:
                    delivery = self.ahead.pop(at)
                    waiting -= 1
                if delivery is None:
                    break
                event, moment, value = delivery
                seen = event in self.events
                status = "accepted" if not seen else "duplicate_event" if self.events.get(event) == value else "event_conflict"
                if not seen:
                    self.events.put(event, value)
                timing = "late" if mark is not None and moment <= mark else "out_of_order" if latest is not None and moment < latest else "on_time"
                latest = moment if latest is None else max(latest, moment)
                out.append((at, "delivery", event, value, status, timing, mark))
                at += 1
            for offset, delivery in fresh.items():
                self.ahead.put(offset, delivery)
                waiting += 1
            if out:
                yield self._frame(key, out)
                out = []
        self.ahead.flush()
        self.events.flush()
        if progress or had:
            self.told.put(progress) if progress else self.told.clear()
        if waiting and alarm is None:
            alarm = timerValues.getCurrentProcessingTimeInMs() + self.patience_ms
            self.handle.registerTimer(alarm)
        elif not waiting and alarm is not None:
            self.handle.deleteTimer(alarm)
            alarm = None
        self.place.update((at, waiting, mark, latest, alarm))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Tells that the next offset is still missing. What waits goes on waiting, so nothing is lost."""
        at, waiting, mark, latest, _ = self.place.get()
        alarm = timerValues.getCurrentProcessingTimeInMs() + self.patience_ms if waiting else None
        if waiting:
            self.handle.registerTimer(alarm)
            yield self._frame(key, [(at, "gap", None, float(waiting), "missing", None, mark)])
        self.place.update((at, waiting, mark, latest, alarm))

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(key: tuple, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["offset", "kind", "event_id", "value", "status", "timing", "watermark"])
        frame["watermark"] = pd.to_datetime(frame["watermark"].astype("Int64"), unit="us")
        frame.insert(0, "partition", key[0])
        return frame.astype({"event_id": "Int64"})


def _number(value) -> float | None:
    return None if value is None or math.isnan(value) else float(value)


def buffered_replay(records: DataFrame, patience_ms: int = 3_600_000) -> DataFrame:
    """Deliveries and progress records in the order of their offsets, in whatever order they arrive.

    records (a stream): partition int, offset long, kind ('delivery' or 'progress'), event_id long, event_time,
    complete_through (progress only), value. A progress record stands at the offset of the delivery that follows it.
    What lies beyond a missing offset waits in state, per partition, and comes out once the gap is filled; where that
    takes longer than patience_ms a row of kind 'gap' tells the missing offset and how many wait (value).

    status of a delivery: accepted, duplicate_event or event_conflict (its event was accepted before, with
    the same value or another), redelivery (its offset was passed or waits already); its timing is late at or before the
    watermark, else out_of_order before an earlier delivery's time. status of a progress record: progress,
    frontier_not_advanced, or position_mismatch if deliveries have passed it. Seen events live in state by their id, so a batch
    costs what it brings, however long the stream has run. Start the stream inside rocks_state.
    """
    rows = records.select("partition", "offset", "kind", "event_id", F.unix_micros("event_time").alias("at"), F.unix_micros("complete_through").alias("through"), "value")
    return rows.groupBy("partition").transformWithStateInPandas(_GapBuffer(patience_ms), _REPLAYED, "Append", "ProcessingTime")


# --- versioned observations --------------------------------------------------------------------

_RECORD = "`partition` int, `offset` long, event_id string, row_id string, observation_id string, version long, grain string, units double, available date"
_CHECKED = f"{_RECORD}, reason string"
_NAMES = [x.split()[0].strip("`") for x in _RECORD.split(", ")]


class _HistoryRules(StatefulProcessor):
    """Keys of some bucket: what each was bound to first, and when each version of an observation is available."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = _Slots(handle, "first")
        self.next = _Slots(handle, "next")
        self.versions = _Slots(handle, "versions")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["partition", "offset"], kind="stable")  # a bucket's part of one batch
        out = []
        for row in frame.itertuples(index=False):
            record = tuple(getattr(row, c) for c in _NAMES)
            faults = []
            if row.rule == "offset":
                due = self.next.get(int(row.partition)) or 0
                if row.offset > due:
                    faults.append("offset_gap")
                if row.offset >= due:
                    self.next.put(int(row.partition), int(row.offset) + 1)
            else:
                name = f"{row.rule}|{row.name}"
                bound = self.first.get(name)
                if bound is None:
                    self.first.put(name, row.bound)
                    if row.rule == "receipt_mismatch":
                        out.append((*record, None))  # the record itself goes on once
                elif bound != row.bound:
                    faults.append(row.rule)
                if row.rule == "grain_changed":
                    faults += self._chain(row)
            out += [(*record, reason) for reason in faults]
        for state in (self.first, self.next, self.versions):
            state.flush()
        if out:
            yield pd.DataFrame(out, columns=[*_NAMES, "reason"])

    def _chain(self, row) -> list[str]:
        """Of two versions that follow one another, the later isn't available before the earlier."""
        version, day = int(row.version), int(row.day)
        own = f"{row.name}|{version}"
        if own in self.versions:
            return []
        self.versions.put(own, day)
        before, after = (self.versions.get(f"{row.name}|{version + step}") for step in (-1, 1))
        return ["availability_regression"] if (before is not None and day < before) or (after is not None and after < day) else []

    def close(self) -> None:
        pass


def checked_history(records: DataFrame, buckets: int = 0) -> DataFrame:
    """A stream of records with the rules of a history checked against all batches before: each record once with null reason, and a row for each rule that one breaks.

    records: partition, offset, event_id, row_id, observation_id, version, grain, units, available. The rules are
    those of observation_violations. A record is sent to the buckets of its event id, row id, grain, observation and
    place; each of these keys keeps a digest of what it was bound to in state, so a batch meets only the past
    of its own keys. buckets (0: four for each shuffle partition) stays the same for a stream's life. Start the
    stream inside rocks_state.
    """
    buckets = buckets or 4 * int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fact = ("row_id", "observation_id", "version", "grain", "units", "available")
    body = F.sha2(F.to_json(F.struct("event_id", *fact)), 256)
    same = F.sha2(F.to_json(F.struct(*fact)), 256)

    def rule(reason: str, name, bound):
        return F.struct(F.lit(reason).alias("rule"), name.cast("string").alias("name"), bound.cast("string").alias("bound"))

    rules = F.array(
        rule("offset", F.col("partition"), F.lit("")), rule("receipt_mismatch", F.concat_ws("|", "partition", "offset"), body), rule("event_collision", F.col("event_id"), body),
        rule("version_collision", F.concat_ws("|", "observation_id", "version"), same), rule("row_collision", F.col("row_id"), F.col("version")),
        rule("grain_collision", F.col("grain"), F.col("observation_id")), rule("grain_changed", F.col("observation_id"), F.col("grain")),
    )
    spread = records.select(*_NAMES, F.unix_date("available").cast("long").alias("day"), F.inline(rules))
    # an observation's versions and its grain are in one bucket, a partition's offsets in another
    spread = spread.withColumn("bucket", F.pmod(F.xxhash64("rule", "name"), F.lit(buckets)).cast("int"))
    return spread.groupBy("bucket").transformWithStateInPandas(_HistoryRules(), _CHECKED, "Append", "None")


class HistoryStopped(ValueError):
    """A batch breaks the rules of the history: nothing of it was added."""


def fail_stop_sink(path: str, rejected_path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch for checked_history: a batch without faults is added whole, else nothing of it, and its faults are written and raised.

    The stream then stops with the state of the batch before, and a restart meets the same batch again. A batch that is tried again overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            faults = batch.where("reason is not null").select("partition", "offset", "reason").distinct()
            if not faults.isEmpty():
                faults.write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")
                raise HistoryStopped(f"batch {number} breaks the rules of the history")
            batch.drop("reason").write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    return write
