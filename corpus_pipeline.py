"""A corpus pipeline of five stages: quality, language, near-duplicates, mixing, tokens.

Each stage decides on a row by the row itself and carries it whole, in a struct, so that
columns of any name pass through untouched, and repeated or null ids are neither joined nor lost. An
empty table gives an empty one, with the columns that the stage's result has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asoflow.llm.jaccard import jaccard_components
from asoflow.llm.langid import UNKNOWN, fit, identify
from asoflow.llm.mixing import mixed_documents
from asoflow.llm.quality import quality_scores
from asoflow.llm.sentencepiece_bpe import default_model, encode_decode
from asoflow.llm.store import release, sorted_merge, stored, written

#: Two stages learn models and one draws: SQL can't express them.
ORACLE_SQL: str | None = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose predicted quality is 1, each by its own text.

    A null text is judged as the empty one; very long ones whole. Equal texts are judged alike. Rows with
    a null id are judged, but never train. Without labels all scores are 0.5, and all rows stay.
    """
    scored = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=docs.columns)
    return scored.where("predicted = 1").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told, each by its own text; the learned language takes the place of a missing one.

    Null texts and texts without a letter go; where no row has a language to learn from, all go. Equal texts get equal languages.
    """
    told = identify(docs, fit(docs), carry=docs.columns).where(F.col("lang_pred") != UNKNOWN)
    row = F.col("row")
    return told.select(*[(F.coalesce(row[c], F.col("lang_pred")) if c == "lang" else row[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates (shingles of five words, similarity of 0.8 or more): the one with the smallest id, one with a null id only if there is no other.

    Every row is a node of its own, so repeated and null ids are compared like all others; of rows that tie, the first
    written stays. Null texts and texts without words are no one's duplicates: all of them stay.
    """
    rows = stored(docs.select(F.monotonically_increasing_id().alias("n"), F.struct(*docs.columns).alias("row")))  # written, so the numbers stay
    found = jaccard_components(rows.select("n", "row.text"), words=5, percent=80, id_col="n").select("n", "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")
    first = rows.select("n", "row.doc_id").join(sorted_merge(found), "n").groupBy("component_id").agg(F.min(order)["n"].alias("n"))
    return rows.join(sorted_merge(first.select("n")), "n", "left_semi").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it. Null texts and texts without words are never taken; a null source is a source of its own; every row is rounded for itself, so equal rows may get different numbers of copies."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and digests of every row. A null text is encoded as the empty one, very long ones whole; equal texts get equal ids."""
    return encode_decode(docs, default_model(), with_ids=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mixing", mixing), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's output is written to the shared folder and reread. The tables that a stage wrote on the way are deleted once its output is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        mark = written()
        docs = stored(stage(spark, docs, sf_dir))
        release(spark, mark, but_last=1)
    return STAGES[-1][1](spark, docs, sf_dir)
