"""Intermediate tables in the folder that all executors share, and joins with classes of equal rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[str] = []  # paths of this driver's intermediate tables, oldest first


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a new local folder on a local master (tests, one machine); on a cluster an error, since executors would write where no other one can read."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="asoflow-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write df once and read it back: later steps start from the files, so a lost executor
    costs a reread instead of the whole lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/asoflow-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many intermediate tables there are so far, for release."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int, but_last: int = 0) -> None:
    """Delete the intermediate tables written since then, but for the last ones. Nothing that is still to run may read them."""
    upto = len(_WRITTEN) - but_last
    for path in _WRITTEN[since:upto]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    del _WRITTEN[since:upto]


def sorted_merge(df: DataFrame) -> DataFrame:
    """df as a side of joins whose sides both grow with the input: they are shuffled and merged at any size, so the driver never builds a hash table of
    a side that happens to be small now (4 MB of its heap at least, and copies, for each such join of a plan)."""
    return df.hint("merge")


_HOT = 1000


def join_classes(rows: DataFrame, classes: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Each row with its class (one per keys; size: how many rows it has).

    Classes that hold more than a thousandth of all rows are fewer than a thousand whatever the input, so
    they are broadcast; their rows never meet in one task. The others are joined by a shuffle.
    """
    total = classes.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = F.col(size) * _HOT > F.lit(total)
    big, small = classes.where(hot), classes.where(~hot)
    spread = rows.join(F.broadcast(big), list(keys))  # fewer than _HOT classes
    rest = rows.join(F.broadcast(big.select(*keys)), list(keys), "left_anti").join(sorted_merge(small), list(keys))
    return spread.unionByName(rest)
