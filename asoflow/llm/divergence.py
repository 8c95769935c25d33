"""How far the sources of a language diverge, by hash-consed segment trees over term ids.

A language keeps the terms that enough of its documents hold, and gives each of them an id: a block
of about _LEAVES terms that occur about as often, and a place in it. In each block every source of the language
has a segment tree over the places, whose leaves are its counts. Trees are hash-consed from the leaves
up: a node is the pair of its children, and equal subtrees, of any source at any place, are one node. Two
trees are compared from the roots down at the same time, level by level: a pair of nodes that
has been met already for two sources is priced once, however often it occurs. The prices of the
blocks' roots are summed by a groupBy.

Where a language has many sources, they are taken in tiles of _TILE: one task row is a block of terms and
two tiles, so its size is bounded. All numbers are integers.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asoflow.llm.store import stored

#: bytes of terms, with A-Z as a-z; all others are spaces
_TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_HELD = 400_000
_LEAVES = 2048
_TILE = 64
_FRONT = 1 << 20  # node pairs that are held at once
_UNIT = 1_000_000_000


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it); null columns count as ''. Terms are runs of letters A-Z, lower-cased, and of characters beyond ASCII.

    A task counts by group what it reads and hands on its sums once it holds _HELD terms.
    """

    def sums(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, rows) in held.items():
            for some in itertools.batched(n, 1 << 16):
                columns = [[lang] * len(some), [source] * len(some), [t.decode() for t in some]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), *(pa.array([x[t] for t in some], pa.int64()) for x in (n, rows))], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().translate(_TERM_BYTES).split()
                n, rows = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                n.update(words)
                rows.update(set(words))
                size += len(n)
                if size > _HELD:
                    yield from sums(held)
                    held, size = {}, 0
        yield from sums(held)

    columns = [F.coalesce(F.col(c), F.lit("")) for c in (lang_col, source_col)]
    counted = docs.select(*columns, F.col(text_col).cast("string")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms: Column, extra: int) -> Column:
    """1 + floor(_UNIT * (count + extra) / (total + extra * terms)), a thousand at a time, so that nothing overflows below 9 * 10^15."""
    rest, out, whole = count + extra, F.lit(1).cast("long"), total + extra * terms
    for unit in (1_000_000, 1_000, 1):
        step = rest * 1000
        out, rest = out + F.floor(_div(step, whole)) * unit, step % whole
    return out


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _shares(count: np.ndarray, total: np.ndarray, terms: int, extra: int) -> np.ndarray:
    rest, out, whole = count + extra, np.ones(len(count), np.int64), total + extra * terms
    for unit in (1_000_000, 1_000, 1):
        out += rest * 1000 // whole * unit
        rest = rest * 1000 % whole
    return out


def _trees(counts: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Hash-consed trees over the rows of a matrix: leaf values, (left, right) of each node by level, root of each row."""
    values, ids = np.unique(counts, return_inverse=True)
    ids, levels, known = ids.reshape(counts.shape), [], len(values)
    while ids.shape[1] > 1:
        nodes, found = np.unique(ids[:, 0::2] * known + ids[:, 1::2], return_inverse=True)
        levels.append((nodes // known, nodes % known))
        ids, known = found.reshape(len(ids), -1), len(nodes)
    return values, levels, ids[:, 0]


def _priced(trees: tuple, totals: np.ndarray, one: np.ndarray, two: np.ndarray, terms: int, extra: int) -> np.ndarray:
    """Sum of the differences of shares over all leaves, for pairs of rows one[k], two[k]."""
    values, levels, roots = trees
    pair, x, y, ways = np.arange(len(one)), roots[one], roots[two], []
    for left, right in reversed(levels):  # down: each pair of nodes once
        below = int(max(left.max(), right.max())) + 1
        code = np.concatenate([(pair * below + side[x]) * below + side[y] for side in (left, right)])
        distinct, way = np.unique(code, return_inverse=True)
        ways.append((way[: len(x)], way[len(x) :]))
        pair, x, y = distinct // below // below, distinct // below % below, distinct % below
    a, b = values[x], values[y]
    price = np.abs(_shares(a, totals[one[pair]], terms, extra) - _shares(b, totals[two[pair]], terms, extra))
    price[a < 0] = 0  # places past the block's last term
    for left, right in reversed(ways):  # up: what a pair costs is what its children cost
        price = price[left] + price[right]
    return price


def _pair_sums(cells: DataFrame, groups: DataFrame, blocks: DataFrame, extra: int) -> DataFrame:
    """lang, g, h, value for all g < h of a language that has terms."""
    tiles = groups.groupBy("lang", (F.col("g") / _TILE).cast("long").alias("tile")).agg(F.sort_array(F.collect_list(F.struct("g", "total"))).alias("groups"))  # _TILE at most
    held = cells.join(groups.select("lang", "source", "g"), ["lang", "source"]).groupBy("lang", "block", (F.col("g") / _TILE).cast("long").alias("tile")).agg(F.collect_list(F.struct("g", "place", "n")).alias("cells"))  # _TILE blocks at most
    one, two = (tiles.select("lang", F.col("tile").alias(f"tile{k}"), F.col("groups").alias(f"groups{k}")) for k in "12")
    units = blocks.join(one.join(two, "lang").where("tile1 <= tile2"), "lang")
    for k in "12":
        units = units.join(held.select("lang", "block", F.col("tile").alias(f"tile{k}"), F.col("cells").alias(f"cells{k}")), ["lang", "block", f"tile{k}"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                same = row["tile1"] == row["tile2"]
                groups_ = row["groups1"] + ([] if same else row["groups2"])
                g = np.array([x["g"] for x in groups_], np.int64)
                totals = np.array([x["total"] for x in groups_], np.int64)
                width = 1 << (row["m"] - 1).bit_length()
                counts = np.zeros((len(g), width), np.int64)
                counts[:, row["m"] :] = -1
                found = (row["cells1"] or []) + ([] if same else row["cells2"] or [])
                if found:
                    at, place, n = (np.array([x[c] for x in found], np.int64) for c in ("g", "place", "n"))
                    counts[np.searchsorted(g, at), place] = n
                trees = _trees(counts)
                a, b = np.triu_indices(len(g), 1)
                if not same:
                    apart = (a < len(row["groups1"])) & (b >= len(row["groups1"]))
                    a, b = a[apart], b[apart]
                step = max(1, _FRONT // width)
                for lo in range(0, len(a), step):
                    x, y = a[lo : lo + step], b[lo : lo + step]
                    value = _priced(trees, totals, x, y, row["terms"], extra)
                    yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(x), pa.string()), pa.array(g[x]), pa.array(g[y]), pa.array(value)], ["lang", "g", "h", "value"])

    small = units.select("lang", "m", "terms", "tile1", "tile2", "groups1", "groups2", "cells1", "cells2")
    return small.mapInArrow(run, "lang string, g long, h long, value long").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least_docs: int = 30, extra: int = 5, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """For each group, a source of a language, how far it is from the others and which terms it holds too often.

    A language's kept terms are those in least_docs of its documents. A share is
    p = 1 + floor(10^9 * (count + extra) / (N + extra * V)) with N the kept occurrences of the group (or the language) and V
    the number of kept terms. Returns lang, source, part, item, value, rank: for part 'pair' every other source of the
    language as item, its value the sum over all kept terms of the difference of shares; for part 'term' the top kept terms that the group holds
    and whose share is above the language's, by that difference. rank counts from 1, value descending,
    item ascending by its bytes.

    Null texts, languages and sources count as ''; empty texts have no terms, and their group is there all the
    same (all values 0 where a language keeps no term). Texts of any length are read whole, repeated rows
    count each, other columns are not read, whatever their names. An empty table gives an empty one.
    """
    groups = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source")).distinct()
    counts = stored(term_counts(docs, text_col, lang_col, source_col))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = kept.withColumn("class", F.length(F.bin("all")))
    sizes = kept.groupBy("lang", "class").agg(F.ceil(F.count("*") / _LEAVES).alias("parts"))
    kept = kept.join(sizes, ["lang", "class"]).withColumn("block", F.concat_ws("-", "class", F.pmod(F.xxhash64("term"), F.col("parts"))))
    kept = stored(kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1).select("lang", "term", "all", "block", "place"))
    vocab = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("whole"))
    cells = stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all", "block", "place"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(vocab, "lang", "left").select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "terms", "whole")))
    groups = stored(groups.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1))  # as long as a language's list of sources

    blocks = kept.groupBy("lang", "block").agg(F.count("*").alias("m")).join(vocab.select("lang", "terms"), "lang")
    sums = stored(_pair_sums(cells, groups, blocks, extra))
    both = sums.union(sums.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value"))
    others = groups.select("lang", F.col("g").alias("h"), F.col("source").alias("item"))
    pairs = groups.select("lang", "source", "g").join(others, "lang").where("g <> h").join(both, ["lang", "g", "h"], "left")
    order = [F.col("value").desc(), F.col("item")]
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))

    found = cells.join(groups, ["lang", "source"])
    value = _share(F.col("n"), F.col("total"), F.col("terms"), extra) - _share(F.col("all"), F.col("whole"), F.col("terms"), extra)
    found = found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"), "n").where("n > 0 and value > 0").drop("n")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top)
    return pairs.unionByName(found)


SQL = {
    "op13_source_divergence": r"""with d as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
    g as (select distinct coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
    k as (select lang, term, count(*) as a from d group by all having count(distinct row) >= 30), v as (select lang, count(*) as v, sum(a) as a from k group by 1),
    c as (select lang, source, term, count(*) as n from d join k using (lang, term) group by all), t as (select lang, source, sum(n) as n from c group by all),
    p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (coalesce(t.n, 0) + 5 * v.v) as p, 1 + (1000000000::hugeint * (k.a + 5)) // (v.a + 5 * v.v) as q
        from g join k using (lang) join v using (lang) left join t on t.lang = g.lang and t.source = g.source left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
    s as (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
    r as (select x.lang, x.source, 'pair' as part, y.source as item, coalesce(s.value, 0) as value from g x join g y on x.lang = y.lang and x.source <> y.source left join s on s.lang = x.lang and s.source = x.source and s.item = y.source
        union all select lang, source, 'term', term, p - q from p where n > 0 and p > q)
    select lang, source, part, item, cast(value as bigint) as value, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from r qualify part = 'pair' or rank <= 50""",
}


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))
