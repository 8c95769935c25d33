"""Quality classifier as a sparse rule ensemble.

Statistics of every whole text are taken once. A forest of shallow trees is fitted to labelled
rows; every path from a root to a node is a conjunctive rule over the statistics. A lasso
logistic regression on the rules keeps few of them, and those are compiled into one Spark
column expression, which scores all rows inside the JVM.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asoflow.llm.store import stored

_GROUPS = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "stop": ".?", "comma": ",;:", "bang": "!", "bar": "|", "sign": "#$%&*@^~=+<>{}[]\\/_", "quote": "'\"()-", "line": "\n", "space": " \t\r"}
_OF_BYTE = np.zeros((256, len(_GROUPS)))
for _k, _chars in enumerate(_GROUPS.values()):
    _OF_BYTE[[ord(c) for c in _chars], _k] = 1
STATISTICS = ("log_bytes", "log_words", "word_bytes", *(f"{g}_share" for g in _GROUPS), "high_share", "distinct_words", "top_word", "distinct_lines", "line_words", "stop_per_line")


def _statistics(text: str) -> list[float]:
    """The STATISTICS of one text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    count = np.bincount(raw, minlength=256)
    n = max(1, len(raw))
    groups = count @ _OF_BYTE
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    w, k = max(1, len(words)), max(1, len(lines))
    seen: dict[str, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    solid = n - groups[-1] - groups[-2]
    return [
        math.log1p(len(raw)), math.log1p(len(words)), solid / w, *(groups / n), float(count[128:].sum()) / n,
        len(seen) / w, max(seen.values(), default=0) / w, len(set(lines)) / k, w / k, float(groups[2]) / k,
    ]


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """id_col and the STATISTICS (double) of each whole text; null counts as empty. The columns that carry names follow in a struct `row`."""
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string"), *([F.struct(*carry).alias("row")] if carry else []))
    kept = ["row"] if carry else []
    types = [T.StructField(id_col, texts.schema[0].dataType), *(T.StructField(s, T.DoubleType()) for s in STATISTICS)]
    types += [T.StructField("row", texts.schema["row"].dataType)] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([_statistics(x.as_py() or "") for x in batch.column(1)]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, k]) for k in range(len(STATISTICS))), *batch.columns[2:]], [id_col, *STATISTICS, *kept])

    return texts.mapInArrow(run, T.StructType(types))


Rule = tuple[tuple[str, str, float], ...]  # (statistic, '<=' or '>', threshold), all of which must hold


def tree_rules(model, names: tuple[str, ...]) -> list[Rule]:
    """The paths from the roots of a forest's trees to all their nodes."""
    found: dict[Rule, None] = {}

    def walk(node, path: Rule) -> None:
        if path:
            # on the way down a later bound on the same statistic is the tighter one
            found[tuple(sorted({(s, o): (s, o, t) for s, o, t in path}.values()))] = None
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            name, at = names[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), (*path, (name, "<=", at)))
            walk(node.rightChild(), (*path, (name, ">", at)))

    for tree in model.trees:
        walk(tree._call_java("rootNode"), ())
    return list(found)


def rule_column(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [F.col(s) <= F.lit(t) if o == "<=" else F.col(s) > F.lit(t) for s, o, t in rule])


def rule_table(labelled: DataFrame, rules: list[Rule]) -> DataFrame:
    """label and x, which rules hold (1 or 0), made by the workers: hundreds of column expressions would be planned and compiled on the driver."""
    tests = [[(STATISTICS.index(s), o, t) for s, o, t in rule] for rule in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [column.to_numpy(zero_copy_only=False) for column in batch.columns[: len(STATISTICS)]]
            holds = np.ones((len(batch), len(tests)))
            for k, rule in enumerate(tests):
                for s, o, t in rule:
                    holds[:, k] *= values[s] <= t if o == "<=" else values[s] > t
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(tests))
            yield pa.RecordBatch.from_arrays([batch.column(len(STATISTICS)), pa.ListArray.from_arrays(ends, pa.array(holds.ravel()))], ["label", "x"])

    return labelled.select(*STATISTICS, "label").mapInArrow(run, "label double, x array<double>")


class RuleEnsemble:
    """Weighted rules and an intercept."""

    def __init__(self, rules: list[tuple[float, Rule]], intercept: float) -> None:
        self.rules, self.intercept = rules, intercept

    @classmethod
    def fit(cls, labelled: DataFrame, trees: int = 40, depth: int = 3, lasso: float = 0.002) -> RuleEnsemble:
        """labelled: the STATISTICS and label (0 or 1), a bounded table."""
        labelled = labelled.select(*STATISTICS, F.col("label").cast("double")).coalesce(2).persist()  # written and small by its bound
        counts = {int(r["label"]): r["count"] for r in labelled.groupBy("label").count().collect()}
        if len(counts) < 2:  # nothing to tell apart
            labelled.unpersist()
            return cls([], {1: 6.0, 0: -6.0}[next(iter(counts))] if counts else 0.0)
        vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(labelled)
        forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, subsamplingRate=0.7, seed=7).fit(vectors)
        rules = tree_rules(forest, STATISTICS)
        del forest, vectors  # the driver needs only the rules from here on
        gc.collect()
        if not rules:
            labelled.unpersist()
            return cls([], math.log(counts[1] / counts[0]))
        table = rule_table(labelled, rules).select("label", array_to_vector("x").alias("x"))
        model = LogisticRegression(featuresCol="x", labelCol="label", regParam=lasso, elasticNetParam=1.0, standardization=False, maxIter=100).fit(table)
        labelled.unpersist()
        weights = model.coefficients.toArray()
        return cls([(float(w), r) for w, r in zip(weights, rules, strict=True) if abs(w) > 1e-6], float(model.intercept))

    def column(self) -> Column:
        """The probability of label 1 as a column over the STATISTICS."""
        margin = reduce(lambda a, b: a + b, [F.when(rule_column(r), w).otherwise(0.0) for w, r in self.rules], F.lit(self.intercept))
        return 1 / (1 + F.exp(-margin))


def held_out(id_col: str) -> Column:
    """Whether a row is kept from all learning: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def quality_scores(docs: DataFrame, labels: DataFrame, most_labelled: int = 12_000, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Quality of every whole text, learnt from labels (id_col, quality 0 or 1).

    Returns one row per input row: id_col, held_out, score (0 to 1, the probability of label
    1), predicted (1 if score >= cut, else 0). Only labelled rows that aren't held out train, at
    most most_labelled of them, chosen by a hash of the id; of several labels of one id the
    lowest counts, null and other labels don't; of several rows of one id the one of the smallest statistics trains.
    Only the text's statistics are inputs of a score.
    A null text is scored as the empty one, a null id as held out. If no or just one label is
    there to learn from, all scores are equal (0.5 or near that label); an empty table of documents gives an
    empty one. Repeated rows get equal scores. Other columns aren't read
    unless carry names them: these come back in a struct `row`.
    """
    seen = stored(text_statistics(docs, id_col, text_col, carry))
    marked = labels.where("quality in (0, 1)").select(F.col(id_col).alias("_id"), "quality").groupBy("_id").agg(F.min("quality").alias("label"))
    marked = marked.where(~held_out("_id")).orderBy(F.xxhash64("_id"), "_id").limit(most_labelled)
    found = seen.join(F.broadcast(marked), seen[id_col] == marked["_id"])  # at most most_labelled ids
    found = found.groupBy("_id").agg(F.min(F.struct(*STATISTICS)).alias("_s"), F.min("label").alias("label"))
    score = RuleEnsemble.fit(stored(found.select("_s.*", "label"))).column()  # written: fitting reads no documents
    out = seen.select(id_col, F.coalesce(held_out(id_col), F.lit(True)).alias("held_out"), score.alias("score"), *(["row"] if carry else []))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
