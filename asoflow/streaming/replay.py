"""Streams: replay with explicit progress, exactly-once sinks, versioned observations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from asoflow.operators.history import observation_violations

_OUT = "`partition` int, `offset` long, kind string, event_id long, event_time timestamp, value double, transport string, timing string, watermark timestamp"
_STATE = "next_offset long, watermark timestamp, latest timestamp"


def replay_stream(records: DataFrame) -> DataFrame:
    """Deliveries and progress records of a stream with transport and timing, per capture partition.

    records: partition int, offset long, kind ('delivery' or 'progress'), event_id long, event_time,
    complete_through (progress only), value. A progress record stands at the offset of the delivery that follows it.

    transport of a delivery: accepted if offsets follow one another, redelivery at an offset that was
    passed, gap beyond the next one (it and all later ones of the batch wait for the missing one). Of a
    progress record: progress, position_mismatch if it doesn't stand at the next offset, or
    frontier_not_advanced unless it moves the watermark forward; only the first counts. The latest
    event time isn't a watermark. A fact at or before the watermark is late, but kept; before an
    earlier accepted fact's time it is out_of_order.

    State per partition is its place and two clocks, whatever the stream's length; which events were
    seen is the accepted table's to say (see classified_sink). A partition's batch is sorted and worked on in columns.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (0, None, None)
        start, clock, latest = int(held[0]), *(pd.Timestamp(x) if x is not None and not pd.isna(x) else pd.NaT for x in held[1:])
        rows = pd.concat(list(frames))
        rows["_second"] = rows["kind"].ne("progress")  # progress stands ahead of the delivery at its offset
        rows = rows.sort_values(["offset", "_second"], kind="stable").reset_index(drop=True)
        told = rows["kind"].eq("progress").to_numpy()
        offset = rows["offset"].to_numpy(np.int64)
        fresh = ~told & (offset >= start) & ~pd.Series(np.where(told, -1 - np.arange(len(rows)), offset)).duplicated().to_numpy()
        place = start + np.cumsum(fresh) - fresh  # the offset that is due at each row
        gap = np.flatnonzero(fresh & (offset > place))
        stop = gap[0] if len(gap) else len(rows)  # nothing is accepted from the first gap on
        seen = fresh & (np.arange(len(rows)) < stop)
        transport = np.where(seen, "accepted", np.where(fresh, "gap", "redelivery")).astype(object)
        through = pd.to_datetime(rows["complete_through"]).where(told)
        sits = told & (offset == place) & (np.arange(len(rows)) <= stop)
        before = through.where(sits).cummax().ffill().shift()
        before = before.where(before.notna(), clock) if pd.isna(clock) else before.clip(lower=clock).fillna(clock)
        moves = sits & (before.isna() | (through > before)).to_numpy()
        transport[told] = np.where(moves, "progress", np.where(sits, "frontier_not_advanced", "position_mismatch"))[told]
        marks = through.where(moves).cummax().ffill()
        marks = marks.fillna(clock) if not pd.isna(clock) else marks
        at = pd.to_datetime(rows["event_time"])
        ahead = at.where(seen).cummax().ffill().shift()
        ahead = ahead.clip(lower=latest).fillna(latest) if not pd.isna(latest) else ahead
        timing = np.where(at <= marks, "late", np.where(at < ahead, "out_of_order", "on_time")).astype(object)
        timing[~seen] = None
        last = at.where(seen).max()
        clocks = [None if pd.isna(x) else x for x in (marks.iloc[-1], last if pd.isna(latest) else latest if pd.isna(last) else max(last, latest))]
        state.update((start + int(seen.sum()), *clocks))
        out = rows[["partition", "offset", "kind", "event_id", "event_time", "value"]].assign(transport=transport, timing=timing, watermark=marks)
        yield out.astype({"event_id": "Int64"})

    return records.groupBy("partition").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table in a folder, empty where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as problem:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], schema)


_GOOD = "`partition` int, `offset` long, event_id long, event_time timestamp, value double, timing string"


def classified_sink(accepted_path: str, rejected_path: str, parent: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch: accepted facts to one table, the rest with its reason and a fingerprint instead of the payload to another.

    An event counts once, by its first delivery of all batches: another one with the same value is a
    duplicate_event, with another value an event_conflict. With a parent (event_id, value) an event that it doesn't have is
    foreign_event, one with another value payload_conflict. All batches before are read from the accepted
    table, so nothing is forgotten; a batch that is tried again overwrites its own folder and doesn't see it.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.where("kind = 'delivery'").persist()
        reason = F.when(F.col("transport") != "accepted", F.col("transport"))
        if parent is not None:
            own = parent.select("event_id", F.col("value").alias("_own"), F.lit(True).alias("_there"))
            batch_ = batch.join(own, "event_id", "left")
            reason = F.coalesce(reason, F.when(F.col("_there").isNull(), "foreign_event").when(~F.col("_own").eqNullSafe(F.col("value")), "payload_conflict"))
        else:
            batch_ = batch
        rows = batch_.withColumn("_reason", reason)
        before = _table(spark, accepted_path, f"{_GOOD}, batch int").where(F.col("batch") < number).select("event_id", F.col("value").alias("_was"), F.lit(True).alias("_old"))
        fresh = Window.partitionBy("event_id", F.col("_reason").isNull()).orderBy("partition", "offset")
        rows = rows.join(before, "event_id", "left").withColumns({"_k": F.row_number().over(fresh), "_first": F.first("value").over(fresh)})
        known = F.when(F.col("_old"), F.col("_was")).otherwise(F.col("_first"))
        again = F.when(F.col("_old") | (F.col("_k") > 1), F.when(F.col("value").eqNullSafe(known), "duplicate_event").otherwise("event_conflict"))
        rows = rows.withColumn("status", F.coalesce("_reason", again, F.lit("accepted"))).persist()
        good = rows.where("status = 'accepted'").select("partition", "offset", "event_id", "event_time", "value", "timing")
        good.write.mode("overwrite").parquet(f"{accepted_path}/batch={number}")
        bad = rows.where("status <> 'accepted'").selectExpr("partition", "offset", "event_id", "status", "sha2(concat_ws('|', event_id, value), 256) as body_sha256")
        bad.write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")
        rows.unpersist()
        batch.unpersist()

    return write


def history_sink(path: str, rejected_path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch for versioned observations: a batch is added whole if it keeps all rules together with what is there, else it isn't added, and its faults are written and raised (fail-stop)."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        schema = ", ".join(f"`{c}` {t}" for c, t in batch.dtypes)
        before = _table(batch.sparkSession, path, f"{schema}, batch int").where(F.col("batch") < number).drop("batch")
        faults = observation_violations(batch, before).persist()
        try:
            if not faults.isEmpty():
                faults.write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")
                raise ValueError(f"batch {number} breaks the rules of the history")
            batch.join(before.select("partition", "offset"), ["partition", "offset"], "left_anti").dropDuplicates(["partition", "offset"]).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            faults.unpersist()
            batch.unpersist()

    return write


def daily_totals(facts: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Sums by day of a stream of facts, final once the event-time watermark has passed; it bounds the state and decides nothing else."""
    return facts.withWatermark("event_time", lateness).groupBy(F.window("event_time", "1 day")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
