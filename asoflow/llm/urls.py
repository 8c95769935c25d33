"""URL filters: fixed rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from pathlib import Path

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path) of the rules; fixed values.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Where the labelled urls of the classifier lie: lines of label (1 to block) and url.
LABELLED_URLS = Path(__file__).with_name("labelled_urls.csv")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """verdict and rule of the longest rule that fits, as a struct; null if none does."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))).otherwise(found)
    return found


def char_grams(text: Column, sizes: Sequence[int]) -> Column:
    """All character n-grams of these sizes, with marks for the ends. The text is cut into characters once, so the work is linear in its length; a text shorter than a size gives itself."""
    chars = F.regexp_extract_all(F.concat(F.lit("\x02"), text, F.lit("\x03")), F.lit("(?s)."), F.lit(0))

    def of_size(c: Column, n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(c) - n + 1, F.lit(1)))
        return F.transform(places, lambda i: F.array_join(F.slice(c, i, F.lit(n)), ""))

    # as the variable of an outer function the characters are cut out once, not once for each n-gram
    return F.flatten(F.transform(F.array(chars), lambda c: F.concat(*[of_size(c, n) for n in sizes])))


class UrlClassifier:
    """Logistic regression on hashed n-grams of host and path; the label is 1 to block."""

    def __init__(self, model: PipelineModel, sizes: Sequence[int]) -> None:
        self.model, self.sizes = model, sizes

    @staticmethod
    def grams(urls: DataFrame, sizes: Sequence[int]) -> DataFrame:
        return urls.withColumns({"_host_grams": char_grams(F.col("host"), sizes), "_path_grams": char_grams(F.col("path"), sizes)})

    @classmethod
    def fit(cls, labelled: DataFrame, sizes: Sequence[int] = (2, 3, 4), features: int = 1 << 13, ridge: float = 1e-3) -> UrlClassifier:
        """labelled: host, path and label (1 to block), a small table."""
        stages = [
            HashingTF(inputCol="_host_grams", outputCol="_h", numFeatures=features, binary=True),
            HashingTF(inputCol="_path_grams", outputCol="_p", numFeatures=features, binary=True),
            VectorAssembler(inputCols=["_h", "_p"], outputCol="_x"),
            LogisticRegression(featuresCol="_x", labelCol="label", predictionCol="_block", probabilityCol="_prob", rawPredictionCol="_raw", regParam=ridge, maxIter=50),
        ]
        return cls(Pipeline(stages=stages).fit(cls.grams(labelled, sizes)), sizes)

    def score(self, urls: DataFrame) -> DataFrame:
        """urls with block_score, the probability that the url is to be blocked."""
        from pyspark.ml.functions import vector_to_array

        scored = self.model.transform(self.grams(urls, self.sizes)).withColumn("block_score", vector_to_array("_prob")[1])
        return scored.drop("_host_grams", "_path_grams", "_h", "_p", "_x", "_block", "_prob", "_raw")


def labelled_urls(spark: SparkSession, path: str | Path = LABELLED_URLS) -> DataFrame:
    """A small file of label,url lines as host, path and label. The driver reads it: it goes to the workers as rows."""
    with open(path, encoding="utf-8", newline="") as lines:
        rows = [(url, float(label)) for label, url in csv.reader(lines)]
    return spark.createDataFrame(rows, "url string, label double").select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label")


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """Host, path and verdict of every url.

    Returns one row per input row: id_col, host, path, rule (host and path of the longest rule
    that fits the host or a domain above it and starts the path; else null), verdict (that
    rule's, else the classifier's: block from a probability of 0.5), block_score.

    labelled (host, path, label 1 to block), a small table, trains the classifier; without it
    labelled_urls() does, whose urls are invented. Where one verdict has no labelled url there is nothing to learn: every
    score is then that of the other (0.5 if there are none at all). Urls that are null or hold no :// have empty host and path and are judged
    as such. Repeated rows are judged alike, an empty table gives an empty one. Other columns are not read, whatever their names.
    """
    if labelled is None:
        labelled = labelled_urls(pages.sparkSession)
    labelled = labelled.select("host", "path", F.col("label").cast("double")).coalesce(1).persist()
    url = F.col(url_col)
    seen = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    sides = [r[0] for r in labelled.select("label").distinct().collect()]
    if len(sides) == 2:
        seen = UrlClassifier.fit(labelled).score(seen)
    else:
        seen = seen.withColumn("block_score", F.lit(float(sides[0]) if sides else 0.5))
    labelled.unpersist()
    seen = seen.withColumn("_r", matched_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("_r.verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return seen.select(id_col, "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "block_score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
