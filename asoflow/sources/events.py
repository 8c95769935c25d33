"""Event envelopes: reading captures, decoding bodies, wrapping results, idempotent delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPTURE_SCHEMA = "kind string, record_id string, received_at timestamp, topic string, partition int, `offset` long, body_utf8 string, complete_through timestamp, after_offset long, scope string"


_ROWS = 200_000  # deliveries of one task


def read_event_capture(spark: SparkSession, path: str) -> DataFrame:
    """A stream of delivery and progress records from a folder of JSON lines."""
    return spark.readStream.schema(CAPTURE_SCHEMA).json(path)


def decode_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Adds body (typed) and problem: malformed text, repeated or unknown keys; null if none."""
    known = [c.split()[0].strip("`") for c in schema.split(",")]
    text = F.col(column)
    keys = F.json_object_keys(text)
    written = F.size(F.regexp_extract_all(text, F.lit(r'"([^"\\]|\\.)*"\s*:'), F.lit(0)))
    problem = F.when(keys.isNull(), "malformed").when(F.size(F.array_except(keys, F.array(*map(F.lit, known)))) > 0, "unknown_field").when((written > F.size(F.array_distinct(keys))) & ~text.contains(":{"), "duplicate_key")
    return df.withColumns({"problem": problem, "body": F.from_json(text, schema)})


def result_events(df: DataFrame, kind: str, key: list[str], version: list[str]) -> DataFrame:
    """Envelopes of result rows: partition key from the series, event id from series and version, both decided by the content."""
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
    full = F.concat_ws("|", F.lit(kind), name, *[F.col(c).cast("string") for c in version])
    return df.withColumns({"partition_key": F.sha2(name, 256), "event_id": F.sha2(full, 256), "kind": F.lit(kind)})


def deliver_once(batch: DataFrame, delivered_path: str, id_col: str = "event_id", body_col: str = "body") -> DataFrame:
    """Append the events that aren't delivered yet, for foreachBatch; the same id with another body is an error. Returns what was new."""
    spark = batch.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-batch.count() // _ROWS))
    batch = batch.withColumn("body_sha256", F.sha2(F.col(body_col), 256)).repartition(parts, id_col).persist()  # checks and write go by id
    try:
        there = spark.read.parquet(delivered_path).select(F.col(id_col), F.col("body_sha256").alias("was"))
    except Exception as problem:  # noqa: BLE001  nothing was delivered so far
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        there = spark.createDataFrame([], f"`{id_col}` {dict(batch.dtypes)[id_col]}, was string")
    joined = batch.join(there, id_col, "left")
    bodies = joined.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("body_sha256").alias("lo"), F.max("body_sha256").alias("hi"), F.max("was").alias("was"))
    clash = bodies.where("lo <> hi or was <> lo or was <> hi")
    if not clash.isEmpty():
        batch.unpersist()
        raise ValueError("an event id came with another body")
    new = joined.where("was is null").drop("was").dropDuplicates([id_col])
    new.write.mode("append").parquet(delivered_path)
    batch.unpersist()
    return new
