"""Declared tables: reading with an exact schema, checks of partitions, grain, nulls and content, and publishing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSpec:
    """A table's declared schema, key and the column whose day is its partition."""

    name: str
    schema: T.StructType
    grain: tuple[str, ...]
    partition_field: str | None = None


def read_table(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """Read Parquet under the declared schema; a file of another schema is an error, decimals wider than 38 digits too."""
    found = spark.read.parquet(path).schema
    have = [(f.name, f.dataType) for f in found.fields]
    want = [(f.name, f.dataType) for f in spec.schema.fields]
    if have != want:
        raise ValueError(f"{spec.name}: schema drift, found {have}, declared {want}")
    return spark.read.schema(spec.schema).parquet(path)


def partition_day_violations(df: DataFrame, time_col: str, day_col: str) -> DataFrame:
    """Rows whose partition day isn't the day of their time (a null time belongs to 'unknown')."""
    day = F.coalesce(F.to_date(time_col).cast("string"), F.lit("unknown"))
    return df.where(day != F.col(day_col).cast("string")).withColumn("expected_day", day)


def canonical_cell(column: Column, kind: str) -> Column:
    """Text of a value that doesn't depend on how it was stored: decimals without trailing zeros, UTC times to the microsecond, ISO dates."""
    if kind.startswith("decimal"):
        return F.regexp_replace(F.regexp_replace(column.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if kind == "timestamp" or kind == "timestamp_ntz":
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return column.cast("string")


def record_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row's cells in the order of their names; null differs from any text."""
    kinds = dict(df.dtypes)
    cells = [F.coalesce(F.concat(F.lit("="), canonical_cell(F.col(c), kinds[c])), F.lit("~")) for c in sorted(columns or df.columns)]
    return F.concat_ws("\x1f", *cells)


def content_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """An order-free digest that keeps duplicates: row count and sums of two quarters of each row's SHA-256, one row. Sums merge on the map side, nothing is sorted."""
    h = F.sha2(record_text(df, columns), 256)
    halves = [F.conv(F.substring(h, at, 12), 16, 10).cast("decimal(38,0)") for at in (1, 13)]
    return df.agg(F.count("*").alias("n_rows"), F.sum(halves[0]).cast("string").alias("digest_a"), F.sum(halves[1]).cast("string").alias("digest_b"))


def field_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """First day, last day and count of values of each temporal column, in one pass."""
    sums = df.agg(*[f(F.to_date(c)).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count))])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"lo_{c}").alias("first_day"), F.col(f"hi_{c}").alias("last_day"), F.col(f"n_{c}").alias("n_values")) for c in columns])))


def grain_violations(df: DataFrame, grain: list[str]) -> DataFrame:
    """Keys that are null or repeat: the grain, how many rows, and the reason."""
    empty = F.lit(False)
    for c in grain:
        empty = empty | F.col(c).isNull()
    counts = df.groupBy(*grain).agg(F.count("*").alias("n_rows"))
    return counts.withColumn("reason", F.when(empty, "null_key").when(F.col("n_rows") > 1, "duplicate_key")).where("reason is not null")


def null_violations(df: DataFrame, required: list[str]) -> DataFrame:
    """How many rows leave each required column null or an empty text."""
    kinds = dict(df.dtypes)
    bad = [F.col(c).isNull() | (F.col(c) == "" if kinds[c] == "string" else F.lit(False)) for c in required]
    counts = df.agg(*[F.count_if(b).alias(c) for b, c in zip(bad, required, strict=True)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_missing")) for c in required])))


def write_table(df: DataFrame, path: str, key: list[str], rows_per_file: int = 1_000_000) -> None:
    """zstd Parquet in the order of the key, with files of bounded length; refuses to overwrite."""
    ordered = df.repartitionByRange(*key).sortWithinPartitions(*key)
    ordered.write.mode("errorifexists").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def publish_once(df: DataFrame, root: str, name: str, key: list[str]) -> tuple[str, bool]:
    """Publish under the content's digest: the path, and whether it was written now. The same content again is a no-op; the name with other content is a conflict."""
    spark = df.sparkSession
    mark = content_digest(df).first()
    digest = F.sha2(F.lit(f"{mark['n_rows']}:{mark['digest_a']}:{mark['digest_b']}"), 256)
    path = f"{root.rstrip('/')}/{name}"
    own = spark.range(1).select(digest.alias("d")).first()["d"]
    try:
        there = spark.read.text(f"{path}/digest").first()[0]
    except Exception as problem:  # noqa: BLE001  Spark says that a path is missing in several ways
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        write_table(df, f"{path}/rows", key)
        spark.range(1).select(F.lit(own)).coalesce(1).write.text(f"{path}/digest")
        return path, True
    if there != own:
        raise ValueError(f"{name} is published with other content")
    return path, False


def write_roles(df: DataFrame, path: str, role: str = "role") -> None:
    """One folder of JSON lines per role."""
    df.write.mode("errorifexists").partitionBy(role).json(path)


def read_roles(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
