"""Balanced label propagation of documents over shards, in DataFrame operations alone.

Documents with equal texts are linked. Labels are shards: they start at random, and in each
round every document looks at the bytes of its neighbours by shard and asks to move where it has
most of them, among the shards with room. Requests into a shard are granted in the order of a
running sum up to its quota (its fair share of all bytes less the linked bytes it holds), so a
group larger than a shard fills one after another. At last, documents without links move from
shards above the fair share to those below, in passes over ever smaller documents, until the
sizes are even; linked documents are moved so only after those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asoflow.llm.store import join_classes, stored

_BUCKET_ROWS = 4_000


def _running(df: DataFrame, keys: list[str], value: str, ties: list[str], buckets: int) -> DataFrame:
    """Adds start: the sum of value over the rows before this one, per keys, in the order of a hash bucket and ties within it. The work is by bucket; only the buckets' sums meet in one task per key."""
    df = df.withColumn("bucket", F.pmod(F.xxhash64(*ties), F.lit(buckets)))
    sums = df.groupBy(*keys, "bucket").agg(F.sum(value).alias("held"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("skip", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held")
    inside = Window.partitionBy(*keys, "bucket").orderBy(*ties).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(sums, [*keys, "bucket"])
    return joined.withColumn("start", F.col("skip") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("bucket", "skip")


def _loads(df: DataFrame, shards: int) -> list[int]:
    """Bytes by shard: one number for each, whatever the input."""
    held = {r["shard"]: r["b"] for r in df.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    return [int(held.get(s) or 0) for s in range(shards)]


def _pick(values: list[float], at: str) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col(at) + 1).cast("int"))


def _propagate(linked: DataFrame, shards: int, fair: float, turn: int, buckets: int) -> DataFrame | None:
    """One round; None if no one asks to move."""
    room = [max(0.0, fair - b) for b in _loads(linked, shards)]
    held = linked.groupBy("gid", "shard").agg(F.sum("size").alias("b"))
    rank = F.struct(F.col("b").alias("b"), F.xxhash64("gid", "shard").alias("tie"), F.col("shard").alias("to"))
    best = held.where(_pick(room, "shard") > 0).groupBy("gid").agg(F.max(rank).alias("best"))
    asks = held.join(best, "gid").where(rank < F.col("best")).select("gid", "shard", F.col("best.to").alias("to"), "b")
    asks = _running(asks, ["to"], "b", ["gid", "shard"], buckets)
    grants = stored(asks.withColumn("part", (_pick(room, "to") - F.col("start")) / F.col("b")).where("part > 0").select("gid", "shard", "to", "part"))
    if grants.isEmpty():
        return None
    draw = F.pmod(F.xxhash64("row", "n", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
    # parts of groups above a thousandth of all bytes are fewer than a thousand: their rows stay where they are
    keys = ["gid", "shard"]
    hot = held.where(F.col("b") * 1000 > fair * shards).select(*keys).join(grants, keys, "left")
    moved = linked.join(F.broadcast(hot), keys).unionByName(linked.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(grants, keys, "left"))
    return stored(moved.select("id", "gid", "size", "crc", "row", "n", F.when((F.col("to").isNotNull()) & (draw < F.col("part")), F.col("to")).otherwise(F.col("shard")).alias("shard")))


def _even_out(rows: DataFrame, shards: int, fair: float, buckets: int, passes: int) -> DataFrame:
    """Moves documents from shards above the fair share to those below. The first pass takes any document; later ones only such as are small against what is still uneven."""
    for k in range(passes):
        loads = _loads(rows, shards)
        over, under = [max(0.0, b - fair) for b in loads], [max(0.0, fair - b) for b in loads]
        if max(over) < 1:
            break
        small = F.col("size") <= (max(over) / 4 if k else float("inf"))
        queue = rows.where((_pick(over, "shard") > 0) & small).withColumn("linked", F.col("gid").isNotNull())
        queue = _running(queue, ["shard", "linked"], "size", ["row", "n"], buckets)
        free = {r["shard"]: r["b"] for r in queue.where("not linked").groupBy("shard").agg(F.sum("size").alias("b")).collect()}
        first = F.when(F.col("linked"), _pick([free.get(s) or 0 for s in range(shards)], "shard")).otherwise(0.0)
        queue = queue.withColumn("start", first + F.col("start") + F.col("size") / 2)
        goes = F.col("start") < _pick(over, "shard")
        # where the leaving bytes of all shards are laid one after another, and so are the gaps
        base = [sum(over[:s]) for s in range(shards)]
        at = _pick(base, "shard") + F.col("start")
        to, gap = F.lit(None).cast("int"), 0.0
        for s in range(shards):
            to = F.coalesce(to, F.when((at >= gap) & (at < gap + under[s]), s)) if under[s] else to
            gap += under[s]
        queue = queue.where(goes).select("n", F.coalesce(to, F.col("shard")).alias("to"))
        kept = rows.join(queue, "n", "left").select("id", "gid", "size", "crc", "row", "n", F.coalesce("to", "shard").alias("shard"))
        rows = stored(kept)
    return rows


def shard(docs: DataFrame, shards: int = 8, rounds: int = 5, passes: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts documents into so many shards of nearly equal bytes, equal texts together where they fit.

    Returns one row per input row: id_col, size (UTF-8 bytes of the text, null none, plus 1),
    text_crc32 (unsigned; null text: 0), group_id (a digest of the text if other rows have it
    too, else null), law ('bytes'), shard, slot (0, 1, 2 ... within the shard), grown_shard
    (null: this law has none).

    Null texts are linked with nothing; empty texts are equal texts. Repeated rows count and move
    each for itself. A null id is allowed. Groups larger than a shard are spread over as few as the quotas allow.
    Other columns are not read; an empty table gives an empty one.
    """
    text = F.col(text_col)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    digest = F.sha2(text.cast("binary"), 256)
    rows = docs.select(F.col(id_col).alias("id"), size.alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("crc"), digest.alias("digest"))
    rows = stored(rows.withColumns({"row": F.xxhash64("id", "digest"), "n": F.monotonically_increasing_id()}))  # written, so the numbers stay
    classes = stored(rows.where("digest is not null").groupBy("digest").agg(F.count("*").alias("m")))
    named = join_classes(rows.where("digest is not null"), classes, ["digest"], "m").withColumn("gid", F.when(F.col("m") > 1, F.col("digest"))).drop("m")
    rows = named.unionByName(rows.where("digest is null"), allowMissingColumns=True).withColumn("shard", F.pmod(F.xxhash64("row", F.lit(17)), F.lit(shards)).cast("int"))
    rows = stored(rows.select("id", "gid", "size", "crc", "row", "n", "shard"))
    total = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    fair, buckets = (total["b"] or 0) / shards, max(16, total["n"] // (_BUCKET_ROWS * shards))
    linked, alone = rows.where("gid is not null"), rows.where("gid is null")
    for turn in range(rounds):
        after = _propagate(linked, shards, fair, turn, buckets)
        if after is None:
            break
        linked = after
    rows = _even_out(linked.unionByName(alone), shards, fair, buckets, passes)
    rows = _running(rows.withColumn("one", F.lit(1).cast("long")), ["shard"], "one", ["row", "n"], buckets)
    return rows.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("gid").alias("group_id"),
        F.lit("bytes").alias("law"), "shard", F.col("start").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
