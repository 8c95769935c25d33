"""Folders and tables where all executors can see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder under the one in spark.checkpoint.dir, or that of setCheckpointDir. Where both are unset, a local temporary folder on a local master (tests, one machine); on a cluster an error, since executors would write where no other one can read."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.gettempdir()
    return f"{root.rstrip('/')}/asoflow-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written to such a folder and read back: later steps start from the files, so a lost executor costs a reread."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(tables: list[DataFrame]) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
