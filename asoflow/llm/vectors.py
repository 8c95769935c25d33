"""Embeddings: near-duplicates by random hyperplanes, and nearest neighbours by one-bit codes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asoflow.llm.graph import connected_components
from asoflow.llm.store import join_classes, stored


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all lists equally long, as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector of the rows that take part: no nulls, all finite, not zero. Floats stay floats, all else is double; cosines are taken in double."""
    v = F.col("v")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    narrow = isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if narrow else "array<double>").alias("v"))
    return kept.where(F.col("id").isNotNull() & v.isNotNull() & good)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of the lists: the length, which rows have it, and their matrix."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        yield int(size), at, matrix(column.take(pa.array(at)))


def _marked(rows: DataFrame) -> DataFrame:
    """Adds mark, a digest of the unit form: equal marks have equal cosines with all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [b""] * len(batch)
            for _, at, x in _by_length(batch.column(1)):
                unit = _unit(x) + 0.0  # no negative zeros
                for place, row in zip(at, unit, strict=True):
                    marks[place] = hashlib.blake2b(row.tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.binary())], ["id", "v", "mark"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("mark", T.BinaryType())]))


# --- near-duplicates -------------------------------------------------------------------------

_CELL = 1024  # vectors of one block of a bucket
_BUCKET = 128  # unrelated vectors of a bucket, on average


def tables_for(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits per code and number of tables: a bucket holds about _BUCKET unrelated vectors, and a pair right at the threshold meets in some table with the given probability."""
    bits = min(31, max(4, math.ceil(math.log2(max(2, n / _BUCKET)))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def most_differing(bits: int, threshold: float, miss: float) -> int:
    """So many of all sign bits differ at most, but for the given probability, in a pair at the threshold (Hoeffding's bound)."""
    return min(bits, math.floor(bits * math.acos(threshold) / math.pi + math.sqrt(bits * math.log(1 / miss) / 2)))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position linked with each of n, over pairs a < b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


_CELL_KEY = ("key", "i", "j")


def _in_cells(batches: Iterator[pa.RecordBatch], work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """work on each whole run of equal (key, i, j); a run may spread over several batches."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in _CELL_KEY])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
        if waiting and any(waiting[-1].column(k)[len(waiting[-1]) - 1].as_py() != int(x) for k, x in zip(_CELL_KEY, keys[:, 0], strict=True)):
            yield work(_joined(waiting))
            waiting = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            waiting.append(batch.slice(lo, hi - lo))
            if hi < len(batch):
                yield work(_joined(waiting))
                waiting = []
    if waiting:
        yield work(_joined(waiting))


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


_CARRIED = 256  # sign bits beside a code, whatever the number of tables


def embedding_near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.9995, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links of vectors whose cosine, in double precision, is at least threshold, and their components.

    Vectors of equal unit form are one node with a multiplicity. Every node gets a sign code from
    random hyperplanes in each of several tables; nodes that share a code meet. Buckets are cut
    into blocks, and each pair of blocks is one piece of work (a cell), so a hot bucket spreads over many tasks.
    Codes travel first, with a fixed number of sign bits: a cell keeps the nodes that have a partner whose bits are near
    enough and that, by these bits, it meets in no earlier table. Only for those the vectors and the bits of all tables are fetched; a pair
    counts in the first table that it shares, and the cosine is taken. A cell returns one row per node, never its pairs.

    Returns one row per input row: id_col, n_links (other vectors linked directly),
    component_id (smallest id reachable, itself included), kept (id_col = component_id). Every
    link is verified; a pair right at the threshold is missed with probability 1 - recall at
    most, closer pairs less. Vectors that are null, zero or hold null, NaN or infinite
    components link with nothing; vectors of different lengths don't link. Equal rows that repeat an
    id count once; rows that repeat an id with other vectors are one node of the graph, whose
    n_links adds up those of its vectors. A null id has no component and no kept. An empty
    table gives an empty one; other columns are not read.
    """
    marked = stored(_marked(usable(vectors, id_col, vector_col)))
    members = stored(marked.select("mark", "id").distinct())  # a hot mark is spread by its ids
    sizes = members.groupBy("mark").agg(F.count("*").alias("m"), F.min("id").alias("lead"))
    forms = marked.groupBy("mark").agg(F.first("v").alias("v"))  # equal marks: any will do
    nodes = stored(sizes.join(forms, "mark").withColumn("node", F.monotonically_increasing_id()))  # written, so the numbers stay
    n = nodes.count()
    miss = (1 - recall) / 2
    bits, tables = tables_for(n, threshold, 1 - miss)
    total = bits * tables

    carried = min(total, _CARRIED)  # sign bits that travel with every code
    near_enough = most_differing(carried, threshold, miss)

    def bits_of(column: pa.Array, count: int) -> np.ndarray:
        packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
        return np.unpackbits(packed, axis=1, count=count, bitorder="little")

    def codes_of(signs: np.ndarray, upto: int) -> np.ndarray:
        """The codes of the first tables."""
        return (signs[:, : upto * bits].reshape(len(signs), upto, bits) * (1 << np.arange(bits))).sum(axis=2, dtype=np.int64)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, x in _by_length(batch.column(1)):
                planes = np.random.default_rng(20240 + size).standard_normal((size, total))
                signs = _unit(x) @ planes > 0
                keys = np.arange(tables, dtype=np.int64) << 40 | size % 512 << 31 | codes_of(signs, tables)
                packed = np.packbits(signs, axis=1, bitorder="little")
                head = np.packbits(signs[:, :carried], axis=1, bitorder="little")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * tables), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[at]), lists, *(pa.array([row.tobytes() for row in p], pa.binary()) for p in (head, packed))], ["node", "keys", "head", "signs"])

    coded = stored(nodes.select("node", "v").mapInArrow(code, "node long, keys array<long>, head binary, signs binary"))
    places = coded.select("node", F.explode("keys").alias("key"), "head")
    held = places.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    met = places.join(held, "key").withColumn("blocks", F.ceil(F.col("held") / _CELL).cast("int")).withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    met = met.select("node", "key", "head", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = met.select("node", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "head")
    cells = cells.repartition(*_CELL_KEY).sortWithinPartitions(*_CELL_KEY, "node")

    def pairs_in(batch: pa.RecordBatch, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of a cell that are near by the carried bits and share no code of an earlier table: of those tables whose bits are carried, or with whole of all."""
        heads = bits_of(batch.column("head"), carried)
        block, key = batch.column("block").to_numpy(), batch.column("key")[0].as_py()
        crossing = batch.column("i")[0].as_py() != batch.column("j")[0].as_py()
        table = key >> 40
        spun = heads.astype(np.float32) * 2 - 1
        earlier = codes_of(bits_of(batch.column("signs"), total), table) if whole else codes_of(heads, min(table, carried // bits))
        for lo in range(0, len(heads), 512):
            near = spun[lo : lo + 512] @ spun.T >= carried - 2 * near_enough
            near &= np.arange(len(heads)) > np.arange(lo, lo + len(near))[:, None]
            if crossing:
                near &= block != block[lo : lo + len(near), None]
            x, y = np.nonzero(near)
            for part in range(0, len(x), 1 << 18):
                a, b = x[part : part + (1 << 18)] + lo, y[part : part + (1 << 18)]
                fresh = ~(earlier[a] == earlier[b]).any(axis=1) if earlier.shape[1] else np.ones(len(a), bool)
                yield a[fresh], b[fresh]

    def sift(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The rows of a cell that have a partner to verify."""
        wanted = np.zeros(len(batch), bool)
        for a, b in pairs_in(batch, False):
            wanted[a] = wanted[b] = True
        return batch.select(["node", *_CELL_KEY, "block", "head"]).filter(pa.array(wanted))

    schema = "node long, key long, i int, j int, block int, head binary"
    wanted = cells.mapInArrow(lambda batches: _in_cells(batches, sift), schema)
    full = nodes.select("node", "v", "m", "lead").join(coded.select("node", "signs"), "node")
    work = wanted.join(full, "node").repartition(*_CELL_KEY).sortWithinPartitions(*_CELL_KEY, "node")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Verified links of a cell, by node."""
        node, weight = batch.column("node").to_numpy(), batch.column("m").to_numpy()
        lead = batch.column("lead").to_numpy()
        unit, size = _ragged(batch.column("v"))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in pairs_in(batch, True):
            close = (unit[a] * unit[b]).sum(axis=1) >= threshold
            close &= size[a] == size[b]
            left.append(a[close])
            right.append(b[close])
        x, y = np.concatenate(left), np.concatenate(right)
        links = np.bincount(x, weight[y], len(node)) + np.bincount(y, weight[x], len(node))
        root = _roots(len(node), x, y)
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(lead[some]), pa.array(lead[root[some]])], ["node", "links", "a", "b"])

    found = stored(work.mapInArrow(lambda batches: _in_cells(batches, verify), "node long, links long, a long, b long"))
    several = members.groupBy("id").agg(F.count("*").alias("k")).where("k > 1")  # ids with several vectors tie their nodes
    ties = members.join(several, "id").join(nodes.select("mark", "lead"), "mark").select(F.col("id").alias("a"), F.col("lead").alias("b"))
    parts = connected_components(found.select("a", "b").union(ties))
    links = found.groupBy("node").agg(F.sum("links").alias("n"))
    classes = nodes.select("mark", "node", "m", "lead").join(links, "node", "left").join(parts.withColumnRenamed("id", "lead"), "lead", "left")
    classes = classes.select("mark", "m", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "lead").alias("c"))
    own = join_classes(members, classes, ["mark"], "m").groupBy("id").agg(F.sum("n").alias("n"), F.min("c").alias("c"))
    ids = vectors.select(F.col(id_col).cast("long").alias("id"))
    out = ids.join(own, "id", "left").withColumn("component_id", F.coalesce("c", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of lists that may differ in length, padded by zeros, and the lengths."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), int(size.max())))
    for width, at, x in _by_length(column):
        out[at, :width] = _unit(x)
    return out, size


# --- nearest neighbours ----------------------------------------------------------------------

_QUERIES = 512  # queries of one block
_CODES = 32_768  # vectors of one block
_CHUNK = 4_096  # codes unpacked at once
_FIRST = 32  # vectors of the best estimates, compared exactly to begin with


def _rotation(size: int, bits: int) -> np.ndarray:
    """Random rotations side by side, enough for so many bits (a whole number of 64-bit words), scaled so that lengths stay."""
    wide = -(-size // 64) * 64
    rng, turns = np.random.default_rng(77 + size), max(1, -(-bits // wide))
    parts = []
    for _ in range(turns):
        q, r = np.linalg.qr(rng.standard_normal((wide, wide)))
        parts.append((q * np.sign(np.diag(r)))[:size])
    return np.hstack(parts) / math.sqrt(turns)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the row of y, in double precision, the same for equal rows wherever they stand."""
    x, y = (z / np.abs(z).max(axis=1, keepdims=True) for z in (x, y))
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


class _Estimates:
    """Estimated cosines of the queries of a block with the codes of another, and the codes' error bounds."""

    def __init__(self, queries: pa.Table, codes: pa.Table, bits: int, bound: float) -> None:
        self.ask_ids, self.ids = queries.column("id").to_numpy(), codes.column("id").to_numpy()
        x = matrix(queries.column("v").combine_chunks())
        turn = _rotation(x.shape[1], bits)
        wide = turn.shape[1]
        spun = (_unit(x) @ turn).astype(np.float32).T
        packed = np.frombuffer(b"".join(codes.column("bits").to_pylist()), np.uint8).reshape(len(self.ids), -1)
        fit = codes.column("fit").to_numpy()
        self.guess = np.empty((len(self.ids), len(self.ask_ids)), np.float32)
        for lo in range(0, len(self.ids), _CHUNK):
            signs = np.unpackbits(packed[lo : lo + _CHUNK], axis=1, bitorder="little").astype(np.float32) * 2 - 1
            self.guess[lo : lo + _CHUNK] = signs @ spun / (math.sqrt(wide) * fit[lo : lo + _CHUNK, None])
        self.error = (bound * np.sqrt(np.maximum(0, 1 - fit**2)) / (fit * math.sqrt(max(1, wide - 1)))).astype(np.float32)
        place = {int(q): n for n, q in enumerate(self.ask_ids)}
        for row, own in enumerate(self.ids):  # a query is no candidate of its own
            if (at := place.get(int(own))) is not None:
                self.guess[row, at] = -np.inf


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, bound: float = 2.5, bits: int = 512, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k candidates of largest cosine for each query, by randomly rotated one-bit codes.

    The index is built once and written: a vector's code is the packed signs of its rotated
    unit vector (several rotations where the vector is shorter than `bits`), with the dot product of
    the vector and its code as correction scalar. Queries and codes, not vectors, meet in blocks:

    1. each block's best estimates; the best of all blocks are compared exactly, which gives each query's
       k-th best so far;
    2. all candidates whose estimate plus `bound` standard deviations of its error reaches that.
       Only for these the vectors are fetched and compared exactly.

    vectors and queries: id_col and vector_col. Returns query_id, rank (from 1), vec_id, score
    (exact cosine of the original vectors), nearest first, ties to the smaller id; the query's own
    id is no candidate; all candidates, if fewer. Null, zero or partly null or non-finite
    vectors take no part, nor do candidates of another length. Of vectors with equal unit form only the
    k + 1 smallest ids are indexed: by the rule for ties no other can be among the k nearest. Rows that
    repeat an id with another vector each count as candidates; a query id that repeats asks with its
    smallest vector. An empty table gives an empty one; other columns are not read.
    """
    columns = [id_col, vector_col]
    marked = stored(_marked(usable(vectors.select(*columns), id_col, vector_col)))
    crowded = marked.groupBy("mark").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("mark")
    rank = F.row_number().over(Window.partitionBy("mark").orderBy("id"))
    ends = marked.join(crowded, "mark", "left_semi").dropDuplicates(["mark", "id"]).withColumn("_k", rank).where(F.col("_k") <= k + 1)
    pool = stored(marked.join(crowded, "mark", "left_anti").select("id", "v").union(ends.select("id", "v")))
    asked = stored(usable(queries.select(*columns), id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")))
    code_blocks, query_blocks = max(1, -(-pool.count() // _CODES)), max(1, -(-asked.count() // _QUERIES))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, x in _by_length(batch.column(1)):
                spun = _unit(x) @ _rotation(size, bits)
                packed = [row.tobytes() for row in np.packbits(spun > 0, axis=1, bitorder="little")]
                fit = np.abs(spun).sum(axis=1) / math.sqrt(spun.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[at]), pa.array(np.full(len(at), size, np.int32)), pa.array(packed, pa.binary()), pa.array(fit)], ["id", "size", "bits", "fit"])

    codes = stored(pool.mapInArrow(index, "id long, size int, bits binary, fit double"))
    kinds = dict(asked.dtypes)
    side = codes.select(
        F.pmod(F.xxhash64("id"), F.lit(code_blocks)).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"),
        F.lit(False).alias("asks"), "size", "id", F.lit(None).cast(kinds["v"]).alias("v"), F.lit(None).cast("double").alias("least"), "bits", "fit",
    )

    def cells(questions: DataFrame) -> DataFrame:
        """questions (id, v, least) and the codes, by cell."""
        other = questions.select(
            F.explode(F.sequence(F.lit(0), F.lit(code_blocks - 1))).alias("c"), F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("q"),
            F.lit(True).alias("asks"), F.size("v").alias("size"), "id", "v", "least", F.lit(None).cast("binary").alias("bits"), F.lit(None).cast("double").alias("fit"),
        )
        return side.unionByName(other).groupBy("c", "q", "size")

    def sides(table: pa.Table) -> tuple[pa.Table, pa.Table] | None:
        asks = table.column("asks").to_numpy()
        one, two = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        return (one, two) if len(one) and len(two) else None

    def pairs(query: list[np.ndarray], vec: list[np.ndarray], guess: list[np.ndarray]) -> pa.Table:
        joined = [np.concatenate(x) if x else np.zeros(0) for x in (query, vec, guess)]
        return pa.table([pa.array(joined[0].astype(np.int64)), pa.array(joined[1].astype(np.int64)), pa.array(joined[2].astype(np.float32))], names=["query_id", "vec_id", "guess"])

    first = max(_FIRST, 4 * k)

    def best(key: tuple, table: pa.Table) -> pa.Table:
        query, vec, guess = [], [], []
        if found := sides(table):
            e = _Estimates(*found, bits, bound)
            top = np.argpartition(e.guess, -first, axis=0)[-first:] if len(e.ids) > first else np.repeat(np.arange(len(e.ids))[:, None], len(e.ask_ids), axis=1)
            value = np.take_along_axis(e.guess, top, axis=0)
            ok = np.isfinite(value)
            query.append(np.broadcast_to(e.ask_ids, top.shape)[ok])
            vec.append(e.ids[top][ok])
            guess.append(value[ok])
        return pairs(query, vec, guess)

    def reach(key: tuple, table: pa.Table) -> pa.Table:
        query, vec, guess = [], [], []
        if found := sides(table):
            e = _Estimates(*found, bits, bound)
            least = found[0].column("least").to_numpy(zero_copy_only=False).astype(np.float32) - np.float32(1e-5)
            for lo in range(0, len(e.ids), _CHUNK):
                part = e.guess[lo : lo + _CHUNK]
                row, at = np.nonzero((part + e.error[lo : lo + _CHUNK, None] >= least) & np.isfinite(part))
                query.append(e.ask_ids[at])
                vec.append(e.ids[row + lo])
                guess.append(part[row, at])
        return pairs(query, vec, guess)

    def exact(found: DataFrame) -> DataFrame:
        """The cosine of each pair, from the original vectors."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score = np.zeros(len(batch))
                for _, at, x in _by_length(batch.column("a")):
                    score[at] = _cosines(x, matrix(batch.column("b").take(pa.array(at))))
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(score)], ["query_id", "vec_id", "score"])

        met = found.join(pool.select(F.col("id").alias("vec_id"), F.col("v").alias("b")), "vec_id")
        met = met.join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("a")), "query_id").where(F.size("a") == F.size("b"))
        return met.select("query_id", "vec_id", "a", "b").mapInArrow(run, "query_id long, vec_id long, score double")

    schema = "query_id long, vec_id long, guess float"
    per_query = Window.partitionBy("query_id")
    start = cells(asked.withColumn("least", F.lit(None).cast("double"))).applyInArrow(best, schema)
    start = start.withColumn("_k", F.row_number().over(per_query.orderBy(F.desc("guess"), "vec_id"))).where(F.col("_k") <= first)
    start = stored(exact(start.select("query_id", "vec_id").distinct()))
    order = per_query.orderBy(F.desc("score"), "vec_id")
    least = start.withColumn("_k", F.row_number().over(order)).where(F.col("_k") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    bounded = asked.join(least, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    more = exact(cells(bounded).applyInArrow(reach, schema).select("query_id", "vec_id").distinct())
    ranked = start.union(more).distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


_USABLE = """u as (select vec_id, embedding::double[] as v from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    s as (select vec_id, v, sqrt(list_dot_product(v, v)) as l from u)"""
SQL = {
    "op1_embedding_near_dedup": f"""with recursive {_USABLE}, p as (select a.vec_id as a, b.vec_id as b from s a join s b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_dot_product(a.v, b.v) / (a.l * b.l) >= 0.95),
    r as (select vec_id, vec_id as c from embeddings union select p.b, r.c from r join p on p.a = r.vec_id), m as (select vec_id, min(c) as component_id from r group by 1), n as (select a, count(*) as n from p group by 1)
    select e.vec_id, coalesce(n.n, 0) as n_links, component_id, e.vec_id = component_id as kept from embeddings e join m on m.vec_id = e.vec_id left join n on n.a = e.vec_id""",
    "op7_nearest_neighbours": f"""with {_USABLE}, c as (select q.vec_id as query_id, s.vec_id, list_dot_product(q.v, s.v) / (q.l * s.l) as score from s q join s on q.vec_id % 50 = 0 and s.vec_id <> q.vec_id and len(q.v) = len(s.v))
    select query_id, cast(rank as integer) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from c) where rank <= 5""",
}


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where("vec_id % 50 = 0"))
