"""Removal of repeated passages: a count-min prefilter, then exact grouping of what may be repeated.

A window is a run of so many words of one document. A word goes if a window that covers it also
starts in a document with a smaller id.

1. Each window is represented by one of its grams, shorter runs of words: the one with the least
   print. So equal windows have equal grams, and a window occurs at most as often as its gram is chosen.
   Chosen grams are a tenth of the words.
2. Every task counts its chosen grams in a count-min sketch of two rows; the sketches are added
   up block by block over the cluster. The estimate of a gram never is too small, so a window whose gram is
   estimated once is unique, and no repeated window is lost.
3. The other windows are grouped exactly by their 128-bit prints. Windows of one gram go to one bucket,
   as runs of neighbours; those of grams that are estimated often are dealt by their own prints.
   Each task first settles what it can by itself and sends one document's copy of a window, so a
   passage that many documents share never meets in one task.
4. The removed runs go back to their documents, which drop the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asoflow.llm.shingles import U, _mix, chunks, text_buffers, word_prints

_BASE = 0xD1342543DE82EF95  # odd
_TABLES = [_mix(np.arange(lo, lo + 256, dtype=U) * U(0x9E3779B97F4A7C15)) for lo in (20_001, 30_001)]
_BLOCK = 16  # bits of a cell's place within a block of the sketch
_OFTEN = 256  # grams estimated that often are dealt by window
_HELD = 1 << 20  # windows or grams that a task holds before it settles and sends them


def _runs(prints: np.ndarray, size: int) -> np.ndarray:
    """A print of every run of so many neighbours, by doubling."""
    n = len(prints) - size + 1
    if n < 1:
        return prints[:0]
    total, have, width, part = np.zeros(n, U), 0, 1, prints
    while True:
        if size & width:
            total = total * U(pow(_BASE, width, 1 << 64)) + part[have : have + n]
            have += width
        if have == size:
            return _mix(total)
        part = part[:-width] * U(pow(_BASE, width, 1 << 64)) + part[width:]
        width *= 2


def _chosen(prints: np.ndarray, before: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the windows of some rows start, the gram's place that each chooses, and the prints of all grams."""
    ends = np.maximum(before[1:] - window + 1, before[:-1])
    edge = np.zeros(len(prints) + 1, np.int64)
    np.add.at(edge, before[:-1], 1)
    np.add.at(edge, ends, -1)
    starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    grams = _runs(prints, gram)
    if not len(starts):
        return starts, starts, grams
    least = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).argmin(axis=1)[starts] + starts
    return starts, least, grams


def _cells(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    """Where two rows of 2^(bits - 1) cells each count a gram."""
    return [(_mix(grams + U(seed)) >> U(65 - bits)).astype(np.int64) + (row << (bits - 1)) for row, seed in enumerate((0x51ED270B7A1F, 0x2545F4914F6C))]


def _sketch(docs: DataFrame, window: int, gram: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit maps over the cells: counted twice or more, and _OFTEN or more. Their size is 2^bits, whatever the input."""

    def counted(grams: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cells, times = np.unique(np.concatenate([c for g in grams for c in _cells(g, bits)]), return_counts=True)
        blocks, at = np.unique(cells >> _BLOCK, return_index=True)
        inner, times = (cells & ((1 << _BLOCK) - 1)).astype("<u2"), np.minimum(times, _OFTEN)
        once = times == 1
        rows = []
        for lo, hi in zip(at, [*at[1:], len(cells)], strict=True):
            single = once[lo:hi]
            rows.append((inner[lo:hi][single].tobytes(), inner[lo:hi][~single].tobytes(), times[lo:hi][~single].astype("<u2").tobytes()))
        for lo in range(0, len(rows), 1024):
            some = rows[lo : lo + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(blocks[lo : lo + 1024], pa.int32()), *(pa.array([r[k] for r in some], pa.binary()) for k in range(3))], ["block", "once", "more", "times"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, at = text_buffers(batch.column(0))
            for lo, hi in chunks(at):
                prints, before = word_prints(data, at[lo : hi + 1], _TABLES[0], None)
                _, least, grams = _chosen(prints, before, window, gram)
                held.append(grams[np.unique(least)])
                size += len(held[-1])
                if size > _HELD:
                    yield from counted(held)
                    held, size = [], 0
        if size:
            yield from counted(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, once, more, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = sums.setdefault(block, np.zeros(1 << _BLOCK, np.uint16))
                for cells, by in ((once, 1), (more, np.frombuffer(times, "<u2"))):
                    cells = np.frombuffer(cells, "<u2")
                    x[cells] = np.minimum(x[cells] + by, _OFTEN)  # a cell occurs once in each
        for block, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([np.packbits(x >= least, bitorder="little").tobytes()], pa.binary()) for least in (2, _OFTEN))], ["block", "twice", "often"])

    spark = docs.sparkSession
    parts = docs.select("text").mapInArrow(count, "block int, once binary, more binary, times binary")
    merged = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").mapInArrow(add, "block int, twice binary, often binary")
    maps = [np.zeros(max(1, (1 << bits) >> 3), np.uint8) for _ in range(2)]
    step = (1 << _BLOCK) >> 3
    for row in merged.toLocalIterator(prefetchPartitions=False):
        for one, found in zip(maps, (row["twice"], row["often"]), strict=True):
            one[row["block"] * step : (row["block"] + 1) * step] = np.frombuffer(found, np.uint8)[: len(one)]
    return maps[0], maps[1]


def _has(bitmap: np.ndarray, cells: list[np.ndarray]) -> np.ndarray:
    out = None
    for c in cells:
        bit = (bitmap[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
        out = bit if out is None else out & bit
    return out


def _split(ids: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows are those of a smallest id among equal ones, and which are to go."""
    order = np.lexsort((ids, h2, h1))
    a, b = h1[order], h2[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    first = ids[order][new][np.cumsum(new) - 1]
    goes = np.zeros(len(ids), bool)
    goes[order] = ids[order] > first
    return ~goes, goes


def _spans(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs in sorted arrays: the last one counts up by one, the others stay."""
    if not len(keys[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate(([True], keys[-1][1:] != keys[-1][:-1] + 1))
    for k in keys[:-1]:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return at, np.diff(np.concatenate((at, [len(new)])))


def _lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))


_SENT = "bucket int, goes boolean, ids array<long>, tags array<long>, first array<int>, size array<int>, h1 array<long>, h2 array<long>"


def _removed(docs: DataFrame, window: int, gram: int, bits: int, total: int) -> DataFrame:
    """doc_id, tag, first, size: runs of windows that go."""
    spark = docs.sparkSession
    maps = spark.sparkContext.broadcast(_sketch(docs, window, gram, bits))
    buckets = max(1024, total >> 26)
    names = [x.split()[0] for x in _SENT.split(", ")]

    def sent(bucket: np.ndarray, goes: bool, ids: np.ndarray, tags: np.ndarray, pos: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((pos, tags, ids, bucket))
        bucket, ids, tags, pos, h1, h2 = (x[order] for x in (bucket, ids, tags, pos, h1, h2))
        again = np.zeros(len(ids), bool)  # equal rows of one document
        again[1:] = (bucket[1:] == bucket[:-1]) & (ids[1:] == ids[:-1]) & (tags[1:] == tags[:-1]) & (pos[1:] == pos[:-1])
        bucket, ids, tags, pos, h1, h2 = (x[~again] for x in (bucket, ids, tags, pos, h1, h2))
        at, size = _spans(bucket, ids, tags, pos)
        own, lo = np.unique(bucket[at], return_index=True)
        ends = np.concatenate((lo, [len(at)]))
        if goes:
            h1, h2, inner = h1[:0], h2[:0], np.zeros(len(ends), np.int64)
        else:
            inner = np.concatenate((at, [len(bucket)]))[ends]
        lists = [_lists(x, ends, k) for x, k in ((ids[at], pa.int64()), (tags[at], pa.int64()), (pos[at], pa.int32()), (size, pa.int32()))]
        lists += [_lists(x.view(np.int64), inner, pa.int64()) for x in (h1, h2)]
        whole = pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([goes] * len(own), pa.bool_()), *lists], names)
        for k in range(0, len(own), 1024):
            yield whole.slice(k, 1024)

    def settle(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        bucket, ids, tags, pos, h1, h2 = (np.concatenate(x) for x in zip(*parts, strict=True))
        stays, goes = _split(ids, h1, h2)
        yield from sent(*[x[stays] for x in (bucket,)], False, *(x[stays] for x in (ids, tags, pos, h1, h2)))
        if goes.any():
            spread = (_mix(tags[goes].view(U)) % U(buckets)).astype(np.int64)
            yield from sent(spread, True, *(x[goes] for x in (ids, tags, pos, h1, h2)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, often = maps.value
        held, size = [], 0
        for batch in batches:
            ids, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, at = text_buffers(batch.column(2))
            for lo, hi in chunks(at):
                prints, before = word_prints(data, at[lo : hi + 1], _TABLES[0], None)
                starts, least, grams = _chosen(prints, before, window, gram)
                if not len(starts):
                    continue
                chosen = grams[least]
                cells = _cells(chosen, bits)
                found = _has(twice, cells)
                if not found.any():
                    continue
                starts, chosen, cells = starts[found], chosen[found], [c[found] for c in cells]
                second, _ = word_prints(data, at[lo : hi + 1], _TABLES[1], None, 11)
                h1, h2 = _runs(prints, window)[starts], _runs(second, window)[starts]
                bucket = (np.where(_has(often, cells), h2, _mix(chosen)) % U(buckets)).astype(np.int64)
                row = np.searchsorted(before, starts, "right") - 1
                held.append((bucket, ids[lo + row], tags[lo + row], starts - before[row], h1, h2))
                size += len(starts)
                if size > _HELD:
                    yield from settle(held)
                    held, size = [], 0
        if size:
            yield from settle(held)

    def spans(ids: np.ndarray, tags: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((pos, tags, ids))
        ids, tags, pos = ids[order], tags[order], pos[order]
        at, size = _spans(ids, tags, pos)
        return pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(tags[at], pa.int64()), pa.array(pos[at], pa.int32()), pa.array(size, pa.int32())], ["doc_id", "tag", "first", "size"])

    def grouped(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        """All windows of one bucket."""
        ids, tags, first, size, h1, h2 = (np.concatenate(x) for x in zip(*parts, strict=True))
        within = np.arange(len(h1)) - np.repeat(np.cumsum(size) - size, size)
        ids, tags, pos = np.repeat(ids, size), np.repeat(tags, size), np.repeat(first, size) + within
        goes = _split(ids, h1, h2)[1]
        if goes.any():
            yield spans(ids[goes], tags[goes], pos[goes])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets in order, one at a time."""
        now, held = None, []
        for batch in batches:
            bucket, goes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ends = [np.concatenate(([0], np.cumsum(batch.column(k).value_lengths().to_numpy(zero_copy_only=False)))) for k in range(2, 8)]
            flat = [batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in range(2, 8)]
            for i, b in enumerate(bucket):
                row = tuple(x[e[i] : e[i + 1]] for x, e in zip(flat, ends, strict=True))
                if goes[i]:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in row[:4]], ["doc_id", "tag", "first", "size"])
                    continue
                if b != now and held:
                    yield from grouped(held)
                    held = []
                now = b
                held.append(row)
        if held:
            yield from grouped(held)

    dealt = docs.where("doc_id is not null").select("doc_id", "tag", "text").mapInArrow(find, _SENT)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 27)
    return dealt.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(group, "doc_id long, tag long, first int, size int")


def without_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", most_bits: int = 30) -> DataFrame:
    """Each document without the words that a window covers which also starts in a document with a smaller id.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Returns one row per input row: id_col, n_words,
    n_removed, removed (array of first word and number of windows that go from there on, in no order), kept_text (kept words
    joined by one space).

    Windows are judged on the input, not on what is left, and all of them, in texts of any length.
    Null and empty texts have no words. Texts with fewer words than a window keep all. Of equal texts
    the one with the smallest id keeps its words; rows that share an id don't take from each other, repeated
    rows get equal results. A row with a null id keeps all its words and takes none from others. Other columns are
    not read, whatever their names; an empty table gives an empty one.

    The sketch has a bit for each eight bytes of text (rounded up to a power of two), at most 2^most_bits; above that
    it lets more windows through to the exact grouping, and the result is the same.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tag"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(most_bits, max(_BLOCK + 1, (total >> 3).bit_length()))
    gram = max(1, min(window - 1, window * 16 // 25)) if window > 1 else 1
    found = _removed(rows, window, gram, bits, total)
    gone = found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "size")).alias("removed"))  # at most one for each word of a document

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed = batch.column(2)
            ends = np.concatenate(([0], np.cumsum(removed.fill_null([]).value_lengths().to_numpy(zero_copy_only=False)))) if len(batch) else [0]
            flat = removed.flatten()
            first, size = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            counts, lost, texts, held, lo = [], [], [], 0, 0
            for i, text in enumerate(batch.column(1)):
                words = (text.as_py() or "").encode().split()  # at the bytes 0x20 and 0x09 to 0x0D
                n = len(words)
                if ends[i + 1] > ends[i]:
                    change = np.zeros(n + 1, np.int32)
                    np.add.at(change, first[ends[i] : ends[i + 1]], 1)
                    np.add.at(change, first[ends[i] : ends[i + 1]] + size[ends[i] : ends[i + 1]] + window - 1, -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                counts.append(n)
                lost.append(n - len(words))
                texts.append(b" ".join(words).decode())
                held += len(texts[-1])
                if held > 1 << 24 or i == len(batch) - 1:
                    part = batch.slice(lo, i + 1 - lo)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), part.column(2), pa.array(texts, pa.string())], names)
                    counts, lost, texts, held, lo = [], [], [], 0, i + 1

    names = ["doc_id", "n_words", "n_removed", "removed", "kept_text"]
    schema = "doc_id long, n_words long, n_removed long, removed array<struct<first: int, size: int>>, kept_text string"
    joined = rows.join(gone, ["doc_id", "tag"], "left").select("doc_id", "text", "removed")
    return joined.mapInArrow(cut, schema).withColumnRenamed("doc_id", id_col)


SQL = {
    "op11_substring_dedup": r"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
    p as (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50), x as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from p),
    s as (select h, min(doc_id) as least from x group by h), g as (select doc_id, list(i) as r from x join s using (h) where doc_id > least group by 1),
    c as (select distinct doc_id, unnest(range(i, i + 50)) as i from (select doc_id, unnest(r) as i from g)), l as (select doc_id, list(i) as r from c group by 1),
    q as (select d.doc_id, w, coalesce(len(r), 0) as n, case when r is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: not list_contains(r, z[2])), lambda z: z[1]) end as k from d left join l using (doc_id))
    select doc_id, cast(len(w) as bigint) as n_words, cast(n as bigint) as n_removed, sha256(coalesce(array_to_string(k, ' '), '')) as kept_sha256 from q""",
}


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
