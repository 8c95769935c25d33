"""Round trips through sinks and streams: what is written over the whole table is read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from asoflow.operators.history import captured, history_as_of, observation_violations, quantity_total, restored
from asoflow.plans.registry import query
from asoflow.plans.views import sql
from asoflow.sources import events as E
from asoflow.sources import tables as S
from asoflow.sources.adapters import SERIES, capture, demand_versions, series_day, table
from asoflow.sources.scratch import scratch
from asoflow.streaming.replay import classified_sink, replay_stream


@query("src07_write_table", sql("select product, location, channel, day, units from series_day", "series_day"))
def _(spark, d):
    path = scratch(spark)
    S.write_table(series_day(spark, d), path, ["product", "day"], rows_per_file=20_000)
    return spark.read.parquet(path)


@query("src08_publish_once", "select true as first_written, false as second_written, count(*) as n_rows from orders")
def _(spark, d):
    root, orders = scratch(spark), table(spark, d, "orders")
    path, first = S.publish_once(orders, root, "orders", ["o_orderkey"])
    again = S.publish_once(orders.repartition(3), root, "orders", ["o_orderkey"])[1]
    return spark.read.parquet(f"{path}/rows").agg(F.lit(first).alias("first_written"), F.lit(again).alias("second_written"), F.count("*").alias("n_rows"))


@query("src09_role_files", "select o_orderkey, o_totalprice, case when o_orderdate < timestamp '1999-01-01' then 'train' else 'final' end as role from orders")
def _(spark, d):
    path = scratch(spark)
    role = F.when(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp"), "train").otherwise("final")
    S.write_roles(table(spark, d, "orders").select("o_orderkey", "o_totalprice", role.alias("role")), path)
    return S.read_roles(spark, path, "o_orderkey long, o_totalprice double, role string")


@query("src11_event_sink", "select count(*) as n_delivered, count(distinct event_id) as n_ids from events")
def _(spark, d):
    path = scratch(spark)
    rows = table(spark, d, "events").select("event_id", F.concat_ws("|", "event_type", F.col("value").cast("string")).alias("body"))
    E.deliver_once(rows.where("event_id % 3 > 0"), path)
    E.deliver_once(rows, path)  # what was delivered isn't delivered again
    return spark.read.parquet(path).agg(F.count("*").alias("n_delivered"), F.countDistinct("event_id").alias("n_ids"))


#: partitions of the capture: one for 20,000 events, 16 at least
_PARTS = "(select greatest(16, count(*) // 20000) from events)"
#: the capture dealt over partitions by event, with event times that may be late, and a progress record ahead of a partition's first delivery of each day
_DEALT = f"""dealt as (select event_id % {_PARTS} as part, row_number() over (partition by event_id % {_PARTS} order by "offset") - 1 as place, event_id, ts - to_hours(cast(event_id % 3 * 20 as integer)) as moment, day, value from capture),
    told as (select part, day, min(place) as place, cast(day - 1 as timestamp) as through from dealt group by all)"""


#: batches of a replay
_BATCHES = 4


def _parts(spark, d):
    return max(16, table(spark, d, "events").count() // 20_000)


def _dealt(spark, d):
    part = (F.col("event_id") % _parts(spark, d)).cast("int")
    place = F.row_number().over(Window.partitionBy(part).orderBy("offset")).cast("long") - 1
    at = F.col("ts") - F.make_dt_interval(F.lit(0), (F.col("event_id") % 3 * 20).cast("int"))
    return capture(spark, d).select(part.alias("partition"), place.alias("offset"), "event_id", at.alias("event_time"), "day", "value")


_RECORD = "`partition` int, `offset` long, kind string, event_id long, event_time timestamp, complete_through timestamp, value double"


def _records(spark, d):
    """Deliveries and progress records; every second one of partition 3 doesn't move the frontier."""
    rows = _dealt(spark, d)
    nights = rows.groupBy("partition", "day").agg(F.min("offset").alias("offset"))
    through = F.when((F.col("partition") == 3) & (F.dayofmonth("day") % 2 == 0), F.date_sub("day", 2)).otherwise(F.date_sub("day", 1)).cast("timestamp")
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (("event_id", "long"), ("event_time", "timestamp"), ("complete_through", "timestamp"), ("value", "double"))}
    deliveries = rows.select("partition", "offset", F.lit("delivery").alias("kind"), "event_id", "event_time", none["complete_through"], "value")
    return deliveries.union(nights.select("partition", "offset", F.lit("progress"), none["event_id"], none["event_time"], through, none["value"]))


def _replayed(spark, d, parent=None, fail=False):
    """Runs the stream over the capture in four batches, a quarter of its partitions to each: the accepted table is read again in every batch, so their number mustn't grow with the table. With fail, the first batch is lost after its effects and tried again."""
    root, parts = scratch(spark), _parts(spark, d)
    _records(spark, d).repartition(parts, "partition").sortWithinPartitions("partition", "offset").write.partitionBy("partition").json(f"{root}/in")
    state = {"fail": fail}

    def run():
        source = spark.readStream.schema(_RECORD).option("maxFilesPerTrigger", -(-parts // _BATCHES)).json(f"{root}/in")
        sink = classified_sink(f"{root}/good", f"{root}/bad", parent)

        def write(batch, number):
            batch = batch.persist()
            sink(batch, number)
            batch.where("kind = 'progress'").select("partition", "offset", "transport", "watermark").write.mode("overwrite").parquet(f"{root}/told/batch={number}")
            batch.unpersist()
            if state.pop("fail", False):
                raise RuntimeError("lost after the effects, before the commit")

        return replay_stream(source).writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()

    try:
        run().awaitTermination()
    except Exception:
        if not fail:
            raise
        run().awaitTermination()
    return root


@query("sm01_replay_stream", sql("""select event_id, min_by(value, "offset") as value from capture group by 1""", "capture"))
def _(spark, d):
    return spark.read.parquet(f"{_replayed(spark, d)}/good").select("event_id", "value")


@query("sm02_canonical_parent", sql("""with p as (select event_id, value from events where event_id % 11 <> 0), c as (select c.*, p.event_id as there, p.value as own from capture c left join p using (event_id)), r as (select *, case when there is null then 'foreign_event' when own <> value then 'payload_conflict' end as reason from c),
    s as (select *, row_number() over (partition by event_id, reason is null order by "offset") as k from r) select coalesce(reason, case when k > 1 then 'duplicate_event' else 'accepted' end) as status, count(*) as n, count(distinct event_id) as n_events from s group by 1""", "capture"))
def _(spark, d):
    """The stream joined with its canonical parent, a static table: what it doesn't have or has otherwise is rejected."""
    root = _replayed(spark, d, table(spark, d, "events").where("event_id % 11 <> 0").select("event_id", "value"))
    good = spark.read.parquet(f"{root}/good").select(F.lit("accepted").alias("status"), "event_id")
    return good.union(spark.read.parquet(f"{root}/bad").select("status", "event_id")).groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_events"))


@query("sm03_progress_watermark", sql(f"""with {_DEALT}, x as (select part, place, case when part = 3 and day(day) % 2 = 0 then through - interval 1 day else through end as through from told), w as (select *, max(through) over (partition by part order by place rows between unbounded preceding and 1 preceding) as before from x)
    select cast(part as integer) as "partition", count(case when before is null or through > before then 1 end) as n_progress, count(case when through <= before then 1 end) as n_not_advanced, max(through) as watermark from w group by 1""", "capture"))
def _(spark, d):
    told = spark.read.parquet(f"{_replayed(spark, d)}/told")
    return told.groupBy("partition").agg(F.count_if(F.expr("transport = 'progress'")).alias("n_progress"), F.count_if(F.expr("transport = 'frontier_not_advanced'")).alias("n_not_advanced"), F.max("watermark").alias("watermark"))


@query("sm04_late_labelling", sql(f"""with {_DEALT}, x as (select d.*, (select max(case when t.part = 3 and day(t.day) % 2 = 0 then t.through - interval 1 day else t.through end) from told t where t.part = d.part and t.place <= d.place) as watermark from dealt d), y as (select *, max(moment) over (partition by part order by place rows between unbounded preceding and 1 preceding) as ahead, row_number() over (partition by event_id order by place) as k from x)
    select event_id, case when moment <= watermark then 'late' when moment < ahead then 'out_of_order' else 'on_time' end as timing from y where k = 1""", "capture"))
def _(spark, d):
    return spark.read.parquet(f"{_replayed(spark, d)}/good").select("event_id", "timing")


@query("sm07_process_then_acknowledge", sql("""select count(distinct event_id) as n_accepted, count(distinct event_id) as n_events, count(*) as n_delivered from capture""", "capture"))
def _(spark, d):
    """The first batch is lost between its effects and its commit, and tried again: nothing is there twice."""
    root = _replayed(spark, d, fail=True)
    good, bad = spark.read.parquet(f"{root}/good"), spark.read.parquet(f"{root}/bad")
    return good.agg(F.count("*").alias("n_accepted"), F.countDistinct("event_id").alias("n_events")).crossJoin(good.select("offset").union(bad.select("offset")).agg(F.count("*").alias("n_delivered")))  # one row each


@query("src10_event_capture", sql(f"""with {_DEALT} select cast(part as integer) as "partition", count(*) as n_deliveries, max(place) as last_offset, (select count(*) from told t where t.part = d.part) as n_progress, 0 as n_gaps, cast(sum(value) as decimal(18, 4))::double as total from dealt d group by all""", "capture"))
def _(spark, d):
    """The capture as JSON lines, read as a stream of envelopes and checked for offsets that don't follow one another."""
    root = scratch(spark)
    rows = _records(spark, d)
    body = F.when(F.col("kind") == "delivery", F.to_json(F.struct("event_id", "value")))
    envelope = rows.select("kind", F.concat_ws("-", "kind", "partition", "offset").alias("record_id"), F.coalesce("event_time", "complete_through").alias("received_at"), F.lit("events").alias("topic"), "partition", "offset", body.alias("body_utf8"), "complete_through", (F.col("offset") - 1).alias("after_offset"), F.lit("all").alias("scope"))
    envelope.write.json(f"{root}/in")
    stream = E.read_event_capture(spark, f"{root}/in")
    stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    out = E.decode_json(spark.read.parquet(f"{root}/out"), "body_utf8", "event_id long, value double")
    due = F.lag("offset").over(Window.partitionBy("partition").orderBy("offset"))
    steps = out.where("kind = 'delivery'").withColumn("_gap", F.coalesce(F.col("offset") != due + 1, F.col("offset") != 0).cast("int"))
    told = out.where("kind = 'progress'").groupBy("partition").agg(F.count("*").alias("n_progress"))
    sums = steps.groupBy("partition").agg(F.count("*").alias("n_deliveries"), F.max("offset").alias("last_offset"), F.sum("_gap").cast("int").alias("n_gaps"), F.sum("body.value").cast("decimal(18,4)").cast("double").alias("total"))
    return sums.join(told, "partition").select("partition", "n_deliveries", "last_offset", "n_progress", "n_gaps", "total")


#: versions of demand as records of eight partitions, with faults at some of them
_OBSERVED = """ob as (select *, product || '|' || location || '|' || channel || '|' || cast(day as varchar) as grain from demand_versions), oc as (select ob.*, ('0x' || substr(md5(grain), 1, 6))::bigint as h from ob),
    od as (select h % 8 as part, row_number() over (partition by h % 8 order by grain, version) - 1 as place, grain, version, units, available, h from oc),
    orec as (select part, place, case when h % 199 = 0 then 'e|shared' else 'e|' || grain || '|' || version end as event_id, case when h % 211 = 0 and version = 2 then 'r|' || grain || '|1' else 'r|' || grain || '|' || version end as row_id, 'o|' || grain as observation_id, version, case when h % 223 = 0 and version = 2 then grain || '|x' else grain end as grain, units, case when h % 227 = 0 and version = 2 then available - 5 else available end as available from od)"""


def _observed(spark, d):
    v = demand_versions(spark, d).withColumn("_g", F.concat_ws("|", *SERIES, F.col("day").cast("string")))
    v = v.withColumn("h", F.conv(F.substring(F.md5(F.col("_g").cast("binary")), 1, 6), 16, 10).cast("long"))
    v = v.withColumn("partition", (F.col("h") % 8).cast("int"))
    v = v.withColumn("offset", F.row_number().over(Window.partitionBy("partition").orderBy("_g", "version")).cast("long") - 1)
    second, version = F.col("version") == 2, F.col("version").cast("string")
    return v.select(
        "partition", "offset", F.when(F.col("h") % 199 == 0, "e|shared").otherwise(F.concat_ws("|", F.lit("e"), "_g", version)).alias("event_id"),
        F.concat_ws("|", F.lit("r"), "_g", F.when((F.col("h") % 211 == 0) & second, "1").otherwise(version)).alias("row_id"), F.concat_ws("|", F.lit("o"), "_g").alias("observation_id"), "version",
        F.when((F.col("h") % 223 == 0) & second, F.concat("_g", F.lit("|x"))).otherwise(F.col("_g")).alias("grain"), "units", F.when((F.col("h") % 227 == 0) & second, F.date_sub("available", 5)).otherwise(F.col("available")).alias("available"),
    )


@query("sm05_observation_history", sql(f"""with {_OBSERVED}, f as (select *, first_value(place || '|' || part) over (partition by event_id order by part, place) as fe, first_value(version) over (partition by row_id order by part, place) as fr, first_value(grain) over (partition by observation_id order by part, place) as fg, lag(version) over (partition by observation_id order by version, part, place) as pv, lag(available) over (partition by observation_id order by version, part, place) as pa from orec)
    select reason, count(*) as n from (select 'event_collision' as reason from f where fe <> place || '|' || part union all select 'row_collision' from f where fr <> version union all select 'grain_changed' from f where fg <> grain union all select 'availability_regression' from f where version = pv + 1 and available < pa) group by 1""", "demand_versions"))
def _(spark, d):
    rows = _observed(spark, d)
    return observation_violations(rows, rows.limit(0)).groupBy("reason").agg(F.count("*").alias("n"))


@query("sm06_capture_as_of", sql(f"""with {_OBSERVED}, s as (select split_part(grain, '|', 2) as location, grain, max(version) as version, max_by(case when h % 5000 = 3 then null else units end, version) as units from od where available <= date '1999-06-30' group by all)
    select location, count(*) as n, case when count(*) = count(units) then sum(units) end as total, case when count(*) = count(units) then 'known' else 'unknown_quantity' end as status from s group by 1""", "demand_versions"))
def _(spark, d):
    """A history is captured with its boundaries, restored and read as of a day; a total with an unknown quantity is unknown."""
    path = scratch(spark)
    rows = _observed(spark, d).withColumn("grain", F.substring("observation_id", 3, 1000))
    h = F.conv(F.substring(F.md5(F.col("grain").cast("binary")), 1, 6), 16, 10).cast("long")
    history = rows.withColumn("units", F.when(h % 5000 != 3, F.col("units")))
    history = history.withColumn("available", F.when((h % 227 == 0) & (F.col("version") == 2), F.date_add("available", 5)).otherwise(F.col("available")))
    captured(history, path)
    seen = history_as_of(restored(spark, path), F.lit("1999-06-30").cast("date"))
    return quantity_total(seen.withColumn("location", F.split("grain", r"\|")[1]), ["location"])
