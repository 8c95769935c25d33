"""Quarantine and enrichment: one plan, one reason column, two outputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asoflow.functions.columns import first_reason, normalized_code
from asoflow.sources.tables import record_text


def curate(df: DataFrame, rules: Sequence[tuple[Column, str]], codes: Mapping[str, bool] | None = None, clocks: Sequence[str] = ()) -> DataFrame:
    """Rows with codes normalised (upper case where the flag says so), the record's digest, availability (the latest of its clocks), and reason: the first rule it breaks, null if accepted."""
    clean = df.withColumns({c: normalized_code(F.col(c), upper) for c, upper in (codes or {}).items()})
    available = F.greatest(*clocks) if len(clocks) > 1 else F.col(clocks[0]) if clocks else F.lit(None).cast("timestamp")
    return clean.withColumns({"reason": first_reason(rules), "source_record_sha256": F.sha2(record_text(df), 256), "curated_available_at": available})


def split(curated: DataFrame, name: str, grain: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and quarantined ones as text with their grain and reason."""
    bad = curated.where("reason is not null").select(
        F.lit(name).alias("source_table"), F.to_json(F.array(*[F.col(g).cast("string") for g in grain])).alias("grain"), "source_record_sha256", "reason",
        F.to_json(F.struct(*[c for c in curated.columns if c != "reason"])).alias("row_json"),
    )
    return curated.where("reason is null").drop("reason"), bad


def profile(curated: DataFrame, name: str) -> DataFrame:
    """Rows by reason, with whether the table is ready: nothing in quarantine."""
    counts = curated.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n_rows"))
    bad = counts.where("reason <> 'accepted'").agg((F.coalesce(F.sum("n_rows"), F.lit(0)) == 0).alias("ready"))
    return counts.withColumn("source_table", F.lit(name)).crossJoin(bad)  # one row
