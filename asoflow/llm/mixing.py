"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations alone.

Every document of a source should be copied target / size-of-source times. The whole part of that
number is certain; the fraction is a probability. Probabilities meet in pairs: mass,
weighted by the documents' sizes, moves at random from one side to the other until one of them
is 0 or 1, which keeps the words of both together exactly. All documents of a source have the same
fraction at first; so in a leaf, a small group of a
source's documents, each document in turn, from the largest, meets all smaller ones as one side, a pair
of a document and a lump: expectations and words stay as in any pair, and what is left open is small.
Each leaf leaves one fraction at most, mostly of its smallest document; these go up a reduction
tree, a level of which is one groupBy, in which documents meet one by one, until one fraction of
each source is left, which a last draw rounds. So a source's words miss its target by the size of
that one document at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asoflow.llm.store import stored

_FAN_IN = 64
_PARTS = 256  # of the rows of one key that are numbered apart
_WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> F.Column:
    """Words of a column, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORDS)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """source, source_size, target for rows of source and size.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes;
    a target stops at most times its source's size and the excess goes to the others by weight
    until none is above. That is a water level: with the sources by limit / weight, the level is
    what the first k stopped ones leave over the weights of the rest, for the least k that fits.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))  # as large as the list of sources
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    limits = sums.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = limits.withColumn("level", level).withColumn("k", F.row_number().over(order))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("k", "level"))
    level = F.coalesce(F.min(fits).over(whole)["level"], F.lit(float("inf")))
    return leveled.select("source", "source_size", F.least(F.col("limit"), level * F.col("weight")).alias("target"))


def _draw(*parts: F.Column) -> F.Column:
    """A number in [0, 1) that the given values decide."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def _closed(p: F.Column) -> F.Column:
    return F.when(p < 1e-9, 0.0).when(p > 1 - 1e-9, 1.0).otherwise(p)


def _settle(state: F.Column, doc: F.Column) -> F.Column:
    """One step of a leaf, largest document first: the document meets all smaller ones of the leaf, which still share one fraction.

    It takes from all of them alike what it lacks to 1, or gives them all it has, with such odds
    that all expectations stay; so what is open at the end is the smallest document. If they
    can't take or give so much, they become 0 or 1 instead and it stays open.
    """
    p, rest, size = state["p"], state["rest"] - doc["size"], doc["size"]
    up = F.least((1 - p) * size, p * rest)
    down = F.least(p * size, (1 - p) * rest)
    rises = _draw(doc["key"], F.lit(17)) * (up + down) < down
    own = _closed(p + F.when(rises, up).otherwise(-down) / size)
    others = _closed(p + F.when(rises, -up).otherwise(down) / rest)
    fixed, last = (p == 0) | (p == 1), rest < 0.5
    mine = doc.withField("p", F.when(fixed | last, p).otherwise(own))
    opens = ~fixed & (last | ((own > 0) & (own < 1)))
    return F.struct(
        F.when(fixed | last, p).otherwise(others).alias("p"), rest.alias("rest"), F.when(opens, mine).otherwise(state["open"]).alias("open"),
        F.when(opens, state["done"]).otherwise(F.concat(state["done"], F.array(mine))).alias("done"),
    )


def _meet(state: F.Column, new: F.Column) -> F.Column:
    """One step of the pivotal method: the open fraction meets the next one.

    With words wa = a.size * a.p and wb likewise, either all of b's or all of a's mass that fits
    moves over: after up, a is 1 or b is 0; after down, a is 0 or b is 1. The odds are such that
    the expected words of both stay.
    """
    open_, done = state["open"], state["done"]
    up = F.least((1 - open_["p"]) * open_["size"], new["p"] * new["size"])
    down = F.least(open_["p"] * open_["size"], (1 - new["p"]) * new["size"])
    shift = F.when(_draw(open_["key"], new["key"], F.lit(11)) * (up + down) < down, up).otherwise(-down)

    a = open_.withField("p", _closed(open_["p"] + shift / open_["size"]))
    b = new.withField("p", _closed(new["p"] - shift / new["size"]))
    a_open = (a["p"] > 0) & (a["p"] < 1)
    return F.when(open_.isNull(), F.struct(new.alias("open"), done.alias("done"))).otherwise(
        F.struct(F.when(a_open, a).otherwise(b).alias("open"), F.concat(done, F.array(F.when(a_open, b).otherwise(a))).alias("done"))
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds place: 0, 1, 2 ... among rows of one key, in parts, so that many equal rows don't meet in one task."""
    parts = rows.withColumn("part", F.pmod(F.xxhash64("n"), F.lit(_PARTS)))
    counts = parts.groupBy("key", "part").agg(F.count("*").alias("c"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    skips = counts.withColumn("skip", F.coalesce(F.sum("c").over(before), F.lit(0))).where("skip > 0").drop("c")  # repeated keys alone
    inside = F.row_number().over(Window.partitionBy("key", "part").orderBy("n")) - 1
    placed = parts.withColumn("place", inside).join(skips, ["key", "part"], "left")
    return placed.withColumn("place", F.col("place") + F.coalesce("skip", F.lit(0))).drop("part", "skip")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """How many words, copies counted, a mix takes of each document.

    Returns id_col, size (words [^\\x20\\x09-\\x0D]+, null 0), source_size, target (of its source),
    copies, taken (copies times size), one row per input row. copies never exceeds most, rounded up. Rows
    without words are taken 0 times, very long texts are counted whole; a null source is a source of its own, the last. Every row
    is rounded for itself, those with a null or repeated id too, so equal rows may get different copies. The draws are hashes of
    id, source, text and, among equal rows, of a number from 0 on, so a rerun agrees; ties in size are ordered by them.
    Other columns are not read unless carry names them: these come back in a
    struct `row`, so a row never has to be found again by its id. An empty table gives an empty one.
    """
    carried = [F.struct(*carry).alias("row")] if carry else []
    sized = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), F.xxhash64(F.col(text_col)).alias("print"), F.monotonically_increasing_id().alias("n"), *carried))  # written, so the numbers stay
    targets = stored(source_targets(sized, weights, most).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    rows = sized.join(F.broadcast(targets) if _few(targets) else targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rows = rows.withColumn("whole", F.floor(F.col("rate") + 1e-12).cast("long")).withColumn("p", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    fractions = rows.where("size > 0 and p > 1e-9").select("n", "source", "p", "size", F.xxhash64("id", "source", "size", "print").alias("key"))
    fractions = _numbered(fractions).select("source", F.struct(F.col("size").cast("double").alias("size"), F.xxhash64("key", "place").alias("key"), "n", "p").alias("doc"))
    settled, level = None, 0
    while True:
        counts = fractions.groupBy("source").agg(F.count("*").alias("n"))
        counts = counts.select(F.col("source").alias("s"), F.ceil(F.col("n") / _FAN_IN).alias("groups"))
        dealt = fractions.join(F.broadcast(counts) if _few(targets) else counts, F.col("source").eqNullSafe(F.col("s")))
        dealt = dealt.withColumn("g", F.pmod(F.xxhash64(F.col("doc.key"), F.lit(level)), F.col("groups")))
        none = F.lit(None).cast(fractions.schema["doc"].dataType)
        start = [none.alias("open"), F.array().cast(f"array<{fractions.select('doc').dtypes[0][1]}>").alias("done")]
        met = dealt.groupBy("source", "g").agg(F.sort_array(F.collect_list("doc"), asc=False).alias("docs"))
        if level == 0:  # all documents of a source have the same fraction yet
            weight = F.aggregate("docs", F.lit(0.0), lambda a, x: a + x["size"])
            folded = F.aggregate("docs", F.struct(F.col("docs")[0]["p"].alias("p"), weight.alias("rest"), *start), _settle)
        else:
            folded = F.aggregate("docs", F.struct(*start), _meet)
        met = stored(met.select("source", folded.alias("state")).select("source", F.struct("state.open", "state.done").alias("state")))
        done = met.select("source", F.explode("state.done").alias("doc"))
        settled = done if settled is None else settled.union(done)
        fractions = met.select("source", F.col("state.open").alias("doc")).where("doc is not null")
        if fractions.groupBy("source").count().where("count > 1").isEmpty():
            break
        level += 1
    last = fractions.select("source", "doc", F.when(_draw(F.col("doc.key"), F.lit(13)) < F.col("doc.p"), 1).otherwise(0).alias("extra"))
    settled = settled.select("source", "doc", F.col("doc.p").cast("int").alias("extra")).union(last)
    out = rows.join(settled.where("extra > 0").select("doc.n", "extra"), "n", "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("p") > 1e-9, F.coalesce("extra", F.lit(0))).otherwise(0)).otherwise(0).cast("long")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["row"] if carry else []))


def _few(targets: DataFrame) -> bool:
    """Whether the list of sources is short enough to broadcast."""
    return targets.count() <= 100_000


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """The mix itself: each row as many times as it is taken, with the columns of docs. Rows without words go; repeated and null ids are allowed."""
    taken = mix(docs, weights, most, carry=docs.columns).where("copies > 0")
    return taken.select("row", F.explode(F.expr("sequence(1L, copies)"))).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
