"""Language identification with a string kernel.

The kernel of two texts counts the character n-grams of one to three characters (blended
spectrum) that are present in both, over the root of the product of their own counts. Landmark
texts give the Nyström map; one-versus-rest kernel ridge regression on it gives the weights. A
batch of texts is scored by sparse matrix products: presence of n-grams times landmarks times weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asoflow.llm.quality import held_out
from asoflow.llm.store import stored

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_ORDERS = 3


class Grams:
    """Distinct n-grams of texts as numbers, over an alphabet; all other characters count as one."""

    def __init__(self, alphabet: str) -> None:
        self.size = len(alphabet) + 1
        self.index = np.zeros(0x110000, np.int32)
        self.index[[ord(c) for c in alphabet]] = np.arange(1, self.size)
        self.starts = np.cumsum([0, *(self.size**k for k in range(1, _ORDERS))])
        self.total = int(self.starts[-1] + self.size**_ORDERS)
        self.last = np.zeros(self.total, np.int32)  # where an n-gram was seen last; never needs clearing

    def of(self, text: str) -> np.ndarray:
        at = self.index[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        found, code = [], at
        for k in range(_ORDERS):
            if k:
                code = code[:-1] * self.size + at[k:]
            if not len(code):
                break
            codes = code + self.starts[k]
            place = np.arange(len(codes), dtype=np.int32)
            self.last[codes] = place
            found.append(codes[self.last[codes] == place])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


class Model:
    """Learned languages, the alphabet, the n-grams of the landmarks and each one's weights."""

    def __init__(self, languages: list[str], alphabet: str, codes: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
        self.languages, self.alphabet, self.codes, self.weights, self.bias = languages, alphabet, codes, weights, bias


_COLUMNS = 1 << 15  # n-grams of one block of the landmarks' kernel


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int, landmarks: int) -> DataFrame:
    """Learning texts: at most `most` ids, as many of each language (of the `most` most frequent ones), by hash of the id; among them the landmarks.

    A bound on the hash that follows from the language's count leaves a few more than wanted of each, so
    ranking them is small work whatever the table's size. Of rows that repeat an id the smallest text learns.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("_lang").isNotNull() & F.col("text").isNotNull() & ~held_out("_id"))
    counts = rows.groupBy("_lang").agg(F.approx_count_distinct("_id", 0.02).alias("_n"))
    counts = stored(counts.orderBy(F.desc("_n"), "_lang").limit(most))
    languages = max(1, counts.count())
    each = max(1, most // languages)
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    near = rows.join(F.broadcast(counts), "_lang").where(place * F.col("_n") < (each * 1.2 + 30) * (1 << 30))  # at most `most` languages
    near = near.groupBy("_lang", "_id").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(place, "_id"))
    kept = near.withColumn("_k", rank).where(F.col("_k") <= each)
    return stored(kept.select(F.col("_lang").alias("lang"), "text", (F.col("_k") <= max(1, landmarks // languages)).alias("landmark")))


def fit(docs: DataFrame, most: int = 4000, landmarks: int = 240, alphabet: int = 160, ridge: float = 1.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learn from the texts of at most `most` ids that aren't held out; None if there is none with a language, as in an empty table. The driver gets numbers of the landmarks and one kernel row per sampled text, all bounded by the parameters and the texts' alphabets. Other columns are not read."""
    sample = _sample(docs, id_col, text_col, lang_col, most, landmarks)

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(set((x.as_py() or "").lower())) for x in batch.column(0)], pa.list_(pa.string()))], ["c"])

    marks = sample.where("landmark").select("text")
    common = marks.mapInArrow(letters, "c array<string>").select(F.explode("c").alias("c")).groupBy("c").count().orderBy(F.desc("count"), "c").limit(alphabet).collect()
    if not common:
        return None
    chars = "".join(r["c"] for r in common)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(chars)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.sort(grams.of(x.as_py() or "")).tolist() for x in batch.column(0)], pa.list_(pa.int64()))], ["g"])

    found = marks.mapInArrow(codes, "g array<long>").toArrow().column("g").combine_chunks()
    ends = np.concatenate(([0], np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False)))) if len(found) else np.zeros(1, int)
    flat = found.flatten().to_numpy(zero_copy_only=False)
    of_mark = [flat[lo:hi].astype(np.int64) for lo, hi in zip(ends, ends[1:], strict=False) if hi > lo]
    del found, flat
    if not of_mark:
        return None
    of_mark.sort(key=lambda x: (len(x), x.tolist()))
    vocabulary = np.unique(np.concatenate(of_mark))
    places = [np.searchsorted(vocabulary, x).astype(np.int32) for x in of_mark]  # sparse: it travels with the tasks

    def presence_of() -> np.ndarray:
        presence = np.zeros((len(places), len(vocabulary)), np.float32)
        for k, x in enumerate(places):
            presence[k, x] = 1 / np.sqrt(len(x))
        return presence

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, presence = Grams(chars), presence_of()
        at = np.full(grams.total, -1, np.int32)
        at[vocabulary] = np.arange(len(vocabulary))
        for batch in batches:
            rows = []
            for x in batch.column(1):
                own = grams.of(x.as_py() or "")
                shared = at[own]
                rows.append((presence[:, shared[shared >= 0]].sum(axis=1) / np.sqrt(max(1, len(own)))).astype(float).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["lang", "k"])

    rows = sorted(tuple(r) for r in sample.select("lang", "text").mapInArrow(kernels, "lang string, k array<double>").collect())
    languages = sorted({lang for lang, _ in rows})
    kernel = np.array([k for _, k in rows])
    target = np.array([[1.0 if lang == x else -1.0 for x in languages] for lang, _ in rows])
    alike = np.zeros((len(places), len(places)))
    for lo in range(0, len(vocabulary), _COLUMNS):  # a block of n-grams at a time, so the driver never holds the whole matrix
        block = np.zeros((len(places), min(_COLUMNS, len(vocabulary) - lo)), np.float32)
        for k, x in enumerate(places):
            block[k, x[np.searchsorted(x, lo) : np.searchsorted(x, lo + _COLUMNS)] - lo] = 1 / np.sqrt(len(x))
        alike += block @ block.T
    values, vectors = np.linalg.eigh(alike)
    kept = values > 1e-6 * values.max()
    into = vectors[:, kept] / np.sqrt(values[kept])  # the Nyström map of a kernel row
    mapped = np.hstack([kernel @ into, np.ones((len(rows), 1))])
    penalty = ridge * np.eye(mapped.shape[1])
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(mapped.T @ mapped + penalty, mapped.T @ target)
    of_landmark, weights = into @ solved[:-1], np.zeros((len(vocabulary), len(languages)))
    for k, x in enumerate(places):
        weights[x] += of_landmark[k] / np.sqrt(len(x))
    return Model(languages, chars, vocabulary, weights, solved[-1])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Language of every whole text: id_col, held_out, lang_pred, score (0 to 1: how far the one-versus-rest regression of the language is towards yes).

    A null text or one without a letter is `und` with score 0, as all are without a model. A
    tie goes to the first language in order. Rows repeat as input rows do; a null id counts as held out.
    An empty table gives an empty one. Other columns are not read, whatever their names. The columns that carry names come back with each row, in a struct `row`.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"), *([F.struct(*carry).alias("row")] if carry else []))
    kept = ["row"] if carry else []
    types = [T.StructField(id_col, rows.schema[0].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    types += [T.StructField("row", rows.schema["row"].dataType)] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(model.alphabet)
        at = np.full(grams.total, -1, np.int32)
        at[model.codes] = np.arange(len(model.codes))
        for batch in batches:
            tags, scores = [], []
            for lo in range(0, len(batch), 256):
                part = batch.column(1).slice(lo, 256)
                known, sizes, norms, lettered = [], [], [], []
                for x in part:
                    text = x.as_py() or ""
                    own = grams.of(text)
                    shared = at[own]
                    known.append(shared[shared >= 0])
                    sizes.append(len(known[-1]))
                    norms.append(np.sqrt(max(1, len(own))))
                    lettered.append(_LETTER.search(text) is not None)
                ends = np.cumsum(sizes)
                sums = np.vstack([np.zeros((1, len(model.languages))), np.cumsum(model.weights[np.concatenate(known)], axis=0)])
                raw = (sums[ends] - sums[ends - sizes]) / np.array(norms)[:, None] + model.bias
                best = raw.argmax(axis=1)
                value = np.clip((raw[np.arange(len(best)), best] + 1) / 2, 0, 1)
                tags += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
                scores += [float(v) if ok else 0.0 for v, ok in zip(value, lettered, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tags, pa.string()), pa.array(scores, pa.float64()), *batch.columns[2:]], [id_col, "lang_pred", "score", *kept])

    if model is None:
        out = rows.select(id_col, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), *kept)
    else:
        out = rows.mapInArrow(run, T.StructType(types))
    return out.select(id_col, F.coalesce(held_out(id_col), F.lit(True)).alias("held_out"), "lang_pred", "score", *kept)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
