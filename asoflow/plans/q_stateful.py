"""Streams whose state decides: replay with waiting deliveries, and a history that stops at its first fault."""

from __future__ import annotations

from pyspark.sql import functions as F

from asoflow.plans.q_sinks import _DEALT, _OBSERVED, _observed, _records
from asoflow.plans.registry import query
from asoflow.plans.views import sql
from asoflow.sources.scratch import scratch
from asoflow.streaming.replay import _table
from asoflow.streaming.stateful import buffered_replay, checked_history, fail_stop_sink, rocks_state

_SCHEMA = "`partition` int, `offset` long, kind string, event_id long, event_time timestamp, complete_through timestamp, value double"
_CHUNKS = 4  # that the capture is dealt over at random


@query("ud04_stateful_processor", sql(f"""with {_DEALT}, t as (select part, place, case when part = 3 and day(day) % 2 = 0 then through - interval 1 day else through end as through from told),
    w as (select *, max(through) over (partition by part order by place rows between unbounded preceding and 1 preceding) as before from t),
    x as (select d.*, (select max(t.through) from t where t.part = d.part and t.place <= d.place) as watermark from dealt d),
    y as (select *, max(moment) over (partition by part order by place rows between unbounded preceding and 1 preceding) as ahead, row_number() over (partition by event_id order by place) as k, first_value(value) over (partition by event_id order by place) as own from x)
    select cast(part as integer) as "partition", cast(place as bigint) as "offset", 'delivery' as kind, event_id, case when k = 1 then 'accepted' when value = own then 'duplicate_event' else 'event_conflict' end as status, case when moment <= watermark then 'late' when moment < ahead then 'out_of_order' else 'on_time' end as timing, watermark from y
    union all select cast(part as integer), cast(place as bigint), 'progress', null, case when before is null or through > before then 'progress' else 'frontier_not_advanced' end, null, greatest(through, before) from w
    union all select cast(part as integer), 0, 'progress', null, 'position_mismatch', null, max(through) from w group by part""", "capture"))
def _(spark, d):
    """The capture arrives in batches of random offsets, with its progress records ahead of all; deliveries beyond a gap wait in state. At last each partition is told a progress at offset 0, which was passed. Equals the batch twin by offset."""
    root, schema = scratch(spark), _SCHEMA
    rows = _records(spark, d)
    chunk = F.when((F.col("kind") == "progress") | (F.col("offset") < 5), 0).otherwise(F.pmod(F.xxhash64("partition", "offset"), F.lit(_CHUNKS)))
    rows = rows.withColumn("chunk", chunk)
    past = rows.where("kind = 'progress' and offset = 0").withColumn("chunk", F.lit(_CHUNKS).cast("long"))
    rows.union(past).write.partitionBy("chunk").json(f"{root}/in")
    for k in range(_CHUNKS + 1):  # each run is a stream of its own that goes on from the state of the one before
        with rocks_state(spark, bounded=True):
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).json(f"{root}/in/chunk={{{','.join(map(str, range(k + 1)))}}}")
            stream = buffered_replay(source).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        stream.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("partition", "offset", "kind", "event_id", "status", "timing", "watermark")


_SLICES = 5  # batches of equal shares of every partition's offsets


@query("sm05_stream_history", sql(f"""with {_OBSERVED}, n as (select part, count(*) as n from od group by 1), s as (select od.part, place, n, place * {_SLICES} // n as slice from od join n using (part)), f as (select part, n * 7 // 10 as place, (n * 7 // 10) * {_SLICES} // n as slice from n where part = 0)
    select 'added' as reason, null::integer as "partition", null::bigint as "offset", count(*) as n_rows from s where slice < (select slice from f) union all select 'event_collision', cast(part as integer), cast(place as bigint), null from f""", "demand_versions"))
def _(spark, d):
    """Five batches of clean records but for one planted fault: in the fourth a record comes with the event id of the first. The stream adds three batches, stops, reports the fault, and meets it again when it is started anew."""
    root = scratch(spark)
    rows = _observed(spark, d).select("partition", "offset", F.substring("observation_id", 3, 1000).alias("grain"), "observation_id", "version", "units", "available", (F.conv(F.substring(F.md5(F.substring("observation_id", 3, 1000).cast("binary")), 1, 6), 16, 10).cast("long") % 227).alias("h"))
    rows = rows.withColumn("available", F.when((F.col("h") == 0) & (F.col("version") == 2), F.date_add("available", 5)).otherwise(F.col("available")))
    counts = rows.groupBy("partition").agg(F.count("*").alias("n"))
    rows = rows.join(counts, "partition").withColumn("slice", F.expr(f"offset * {_SLICES} div n"))
    event = F.when((F.col("partition") == 0) & (F.col("offset") == F.expr("n * 7 div 10")), F.lit("0|0")).otherwise(F.concat_ws("|", "partition", "offset"))
    rows = rows.select("partition", "offset", event.alias("event_id"), F.concat_ws("|", "observation_id", "version").alias("row_id"), "observation_id", "version", "grain", F.col("units").cast("double").alias("units"), "available", "slice")
    rows.repartition("slice").write.partitionBy("slice").parquet(f"{root}/in")
    schema = rows.drop("slice").schema
    for k in [*range(_SLICES), _SLICES - 1]:
        with rocks_state(spark, bounded=True):
            source = spark.readStream.schema(schema).parquet(f"{root}/in/slice={{{','.join(map(str, range(k + 1)))}}}")
            stream = checked_history(source).writeStream.foreachBatch(fail_stop_sink(f"{root}/good", f"{root}/bad")).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        try:
            stream.awaitTermination()
        except Exception as problem:
            if "HistoryStopped" not in str(problem):
                raise
    good = _table(spark, f"{root}/good", f"{', '.join(f'`{n}` {t}' for n, t in rows.drop('slice').dtypes)}, batch int")
    none = [F.lit(None).cast("int").alias("partition"), F.lit(None).cast("long").alias("offset")]
    faults = spark.read.parquet(f"{root}/bad").select("reason", "partition", "offset", F.lit(None).cast("long").alias("n_rows")).distinct()
    return good.agg(F.count("*").alias("n_rows")).select(F.lit("added").alias("reason"), *none, "n_rows").union(faults)
