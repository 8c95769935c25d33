"""N-gram Jaccard join as a blocked sparse matrix product.

Documents are the rows and word n-grams the columns of an incidence matrix M; the overlaps
of all pairs are M times its transpose. The product is taken in blocks of columns, and after
each block the pairs (or whole rows) whose overlap can no longer reach the bound that follows
from their sizes are discarded:

1. Block of each row's first columns in fingerprint order. A row with a partner shares at
   least a known count of them; rows that share fewer leave.
2. All columns, for the rows left: columns with one row leave, and with them rows whose
   remaining columns can't reach the bound for any partner's size.
3. Block of each row's rarest columns: the product as a join on the column and on a band of
   sizes, whose groupBy accumulates each pair's overlap count and the places of the last shared column in
   both rows. A pair is discarded if its count and all that is left behind those places can't reach the bound. To keep
   it linear for groups of near copies, first every row meets the row that leads
   its column, and only these pairs are multiplied; linked rows become one component, and then only rows of
   different components meet. The links inside a component can't change it.
4. Block of the columns behind those places, for the pairs left: its counts are added to what the pair has,
   and the sum is held against the bound.

Equal sets are one row of the matrix throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asoflow.llm.graph import connected_components
from asoflow.llm.shingles import digest, lists_of, shingle_sets
from asoflow.llm.store import join_classes, sorted_merge, stored

#: Bits of the fixed-size map of document ids that spares most texts a shuffle.
_MAP_WORDS = 1 << 17
_BAND = 1.03


def _first_columns(n: int, percent: int) -> int:
    """Among so many of n columns, the first in a common order, a row shares a tenth of n at least with any partner: all but those that the bound lets it miss."""
    return min(n, n - -(-percent * n // 100) + max(1, n // 10))


def _prints(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, whole: bool) -> DataFrame:
    """Per document: size and digests of its set, and all its columns or the upper halves of its first ones (which may take two columns for one, never one for two)."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
        return pa.RecordBatch.from_arrays([*numbers, lists_of([r[4] for r in rows])], ["doc", "n", "d1", "d2", "cols"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc, x in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), words), strict=True):
                cols = x if whole else (x[: _first_columns(len(x), percent)] >> np.uint64(32)).astype(np.uint32)
                rows.append((doc, len(x), *digest(x), cols))
                held += len(cols)
                if held > 1 << 19:
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, f"doc long, n long, d1 long, d2 long, cols array<{'long' if whole else 'int'}>")


def _band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / float(np.log(_BAND))).cast("int")


def _within(percent: int) -> Column:
    """Whether the count so far and what is left behind the last shared columns can reach the bound of the sizes."""
    left = F.least(F.col("sa") - F.col("ka"), F.col("sb") - F.col("kb")) - 1
    return (100 + percent) * (F.col("met") + left) >= percent * (F.col("na") + F.col("nb"))


def _multiplied(pairs: DataFrame, ordered: DataFrame) -> DataFrame:
    """The block of the rarest columns for given pairs (a, b): met, ka, kb as the join gives them for all, beside the sizes and the columns of both."""
    one, two = (ordered.select(F.col("doc").alias(k), F.col("n").alias(f"n{k}"), F.col("shared").alias(f"s{k}"), F.col("width").alias(f"w{k}"), F.col("cols").alias(f"c{k}")) for k in "ab")
    block = F.array_intersect(F.slice("ca", F.lit(1), F.col("wa")), F.slice("cb", F.lit(1), F.col("wb")))
    both = pairs.select("a", "b").join(sorted_merge(one), "a").join(sorted_merge(two), "b").withColumn("common", block).where(F.size("common") > 0)
    last = F.element_at("common", -1)  # in the order of a's columns, which is everyone's
    return both.withColumns({"met": F.size("common").cast("long")} | {f"k{k}": (F.array_position(f"c{k}", last) - 1).cast("long") for k in "ab"}).drop("common")


def _links(counted: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose overlap reaches the bound: what they have so far plus the block behind the last shared columns. counted: a, b, na, nb, sa, sb, met, ka, kb and the columns ca, cb of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, at), (y, by) = ((c.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))))) for c in (batch.column("ca"), batch.column("cb")))
            more = [len(np.intersect1d(x[at[i] : at[i + 1]], y[by[i] : by[i + 1]], assume_unique=True)) for i in range(len(batch))]
            common = batch.column("met").to_numpy() + np.array(more, np.int64)
            kept = (100 + percent) * common >= percent * (batch.column("na").to_numpy() + batch.column("nb").to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(kept))

    rest = [F.slice(F.col(f"c{k}"), F.col(f"k{k}").cast("int") + 2, F.greatest(F.lit(0), F.size(f"c{k}") - F.col(f"k{k}").cast("int") - 1)).alias(f"c{k}") for k in "ab"]
    return counted.where(_within(percent)).select("a", "b", "na", "nb", "met", *rest).mapInArrow(run, "a long, b long")


def _candidates(docs: DataFrame, seen: DataFrame, reps: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """Steps 1 and 2: rows of the matrix that can still have a partner, with all their columns."""
    columns = seen.where("n > 0").select("doc", F.explode("cols").alias("col"))
    shared = columns.groupBy("col").agg(F.count("*").alias("times")).where("times > 1").select("col")
    need = f"greatest(1, ceil({percent} * n / 100) div 10)"
    met = columns.join(sorted_merge(shared), "col").groupBy("doc").agg(F.count("*").alias("met"))
    left = stored(met.join(sorted_merge(reps.select(F.col("rep").alias("doc"), "n")), "doc").where(f"met >= {need}").select("doc").distinct())

    # At most _MAP_WORDS rows whatever the input: a fixed bitmap of the ids that are left.
    spot = f"pmod(xxhash64(doc), {_MAP_WORDS * 64})"
    word, bit = F.expr(f"cast({spot} div 64 as int)").alias("w"), f"cast({spot} % 64 as int)"
    bits = left.select(word, F.expr(f"shiftleft(1L, {bit})").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    texts = texts.select("*", word).join(F.broadcast(bits), "w")
    texts = texts.where(f"shiftrightunsigned(bits, {bit}) & 1 = 1").select("doc", "text")
    return _prints(texts.join(sorted_merge(left), "doc", "left_semi"), "doc", "text", words, percent, True).select("doc", "n", "cols")


def _ordered(rows: DataFrame, percent: int) -> DataFrame:
    """Step 2: each row left with its shared columns from the rarest on, and how many of them (width) can be the first that it shares with a partner."""
    cells = rows.select("doc", "n", F.explode("cols").alias("col"))
    times = cells.groupBy("col").agg(F.count("*").alias("times")).where("times > 1")
    kept = cells.join(sorted_merge(times), "col").groupBy("doc", "n").agg(F.count("*").alias("shared"), (F.sum("times") / F.col("n")).alias("central"), F.sort_array(F.collect_list(F.struct("times", "col"))).alias("cols"))
    kept = kept.withColumn("at", F.expr("n - shared")).where(f"{_most(percent)} >= {_least(percent)}")
    # beyond this place a first shared column comes too late for any partner
    width = f"cast(greatest(0, least(shared, n - {_least(percent)} + 1 - (n - shared))) as int)"
    return kept.select("doc", "n", "shared", "central", F.expr(width).alias("width"), F.col("cols.col").alias("cols"))


def _most(percent: int) -> str:
    return f"(cast(floor({100 + percent} * (n - at) / {percent}) as bigint) - n)"


def _least(percent: int) -> str:
    return f"cast(ceil({percent} * n / 100) as bigint)"


def _entries(ordered: DataFrame, percent: int) -> DataFrame:
    """The entries of step 3: for each row left, its rarest columns with the sizes that a partner may have if the column is the first that they share."""
    spread = ordered.select("doc", "n", "shared", "central", F.posexplode(F.expr("slice(cols, 1, width)")).alias("k", "col")).withColumn("at", F.expr("n - shared + k"))
    return spread.withColumn("most", F.expr(_most(percent))).withColumn("least", F.expr(_least(percent))).where("most >= least")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose sets of word shingles have a Jaccard similarity of percent / 100 or more.

    A-Z are lower-cased and words are runs of other characters than space and 0x09-0x0D. A
    document's set holds its distinct shingles of so many words; with fewer words the whole
    sequence is its one shingle. Returns one row per input row: id_col, n_shingles, set_id
    (smallest id with the same set), component_id (smallest id reachable by links).

    Null and blank texts have an empty set, link with nothing and are their own component. The
    id names the document: rows that repeat an id belong to one node; rows with a null id come
    back with null set_id and component_id. An empty table gives an empty one. Extra columns are not read,
    whatever their names. No cap applies to columns, sizes or partners; near copies are never expanded into all
    pairs, so links inside a component are found as far as they decide it, not counted.
    """
    seen = stored(_prints(docs, id_col, text_col, words, percent, False))
    narrow = seen.select("doc", "n", "d1", "d2")
    reps = narrow.where("n > 0 and doc is not null").groupBy("n", "d1", "d2").agg(F.min("doc").alias("rep"), F.count("*").alias("m"))
    rows = stored(_candidates(docs, seen, reps, id_col, text_col, words, percent))
    ordered = stored(_ordered(rows, percent))
    entries = stored(_entries(ordered, percent))

    small = entries.where("most >= n").select("col", _band(F.col("n")).alias("band"), F.col("doc").alias("a"), F.col("n").alias("na"), F.col("most").alias("mosta"), F.col("central").alias("xa"), F.col("shared").alias("sa"), F.col("k").alias("ka"))
    large = entries.withColumn("most", F.least("most", "n")).withColumn("band", F.explode(F.sequence(_band(F.col("least")), _band(F.col("most")))))
    large = large.select("col", "band", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("least").alias("leastb"), F.col("most").alias("mostb"), F.col("central").alias("xb"), F.col("shared").alias("sb"), F.col("k").alias("kb"))
    fits = (F.col("a") != F.col("b")) & (F.col("na") <= F.col("mostb")) & (F.col("na") >= F.col("leastb")) & (F.col("nb") <= F.col("mosta"))

    # the row that leads a column and band on either side is the one whose columns are the most common on average
    first = None
    for side, other, key in ((small, large, "b"), (large, small, "a")):
        own = "a" if key == "b" else "b"
        lead = side.groupBy("col", "band").agg(F.max(F.struct(f"x{own}", F.bitwise_not(own).alias("tie"), *[c for c in side.columns if c not in ("col", "band", f"x{own}", f"s{own}", f"k{own}")])).alias("s")).select("col", "band", "s.*").drop("tie")
        met = other.join(sorted_merge(lead), ["col", "band"]).where(fits).groupBy("a", "b").agg(F.count("*").alias("met"), F.max(f"x{own}").alias("x"))
        pick = met.groupBy(key).agg(F.max_by(own, F.struct("met", "x", F.bitwise_not(own))).alias(own)).select("a", "b")
        first = pick if first is None else first.union(pick)
    first = first.distinct()
    links = stored(_links(_multiplied(first, ordered), percent))
    named = stored(connected_components(links))

    def label(side: DataFrame, key: str) -> DataFrame:
        found = named.select(F.col("id").alias(key), F.col("component").alias(f"c{key}"))
        return side.join(sorted_merge(found), key, "left").withColumn(f"c{key}", F.coalesce(f"c{key}", key))

    small, large = stored(label(small, "a")), stored(label(large, "b"))
    ends = small.groupBy("col", "band").agg(F.min("ca").alias("lo"), F.max("ca").alias("hi"))
    ends = ends.join(sorted_merge(large.groupBy("col", "band").agg(F.min("cb").alias("lob"), F.max("cb").alias("hib"))), ["col", "band"])
    mixed = ends.where("lo <> hi or lob <> hib or lo <> lob").select("col", "band")
    rest = small.join(sorted_merge(mixed), ["col", "band"], "left_semi").join(sorted_merge(large), ["col", "band"]).where(fits & (F.col("ca") != F.col("cb")))
    counted = rest.groupBy("a", "b", "na", "nb", "sa", "sb").agg(F.count("*").alias("met"), F.max("ka").cast("long").alias("ka"), F.max("kb").cast("long").alias("kb"))
    one, two = (ordered.select(F.col("doc").alias(k), F.col("cols").alias(f"c{k}")) for k in "ab")
    more = _links(counted.where(_within(percent)).join(sorted_merge(one), "a").join(sorted_merge(two), "b"), percent)
    final = connected_components(stored(links.select("a", "b").union(more)))

    classes = reps.join(sorted_merge(final.withColumnRenamed("id", "rep")), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    linked = join_classes(narrow.where("n > 0 and doc is not null"), stored(classes), ["n", "d1", "d2"], "m").select("doc", "n", "rep", "component")
    alone = narrow.where("n = 0 or doc is null").select("doc", "n", F.col("doc").alias("rep"), F.col("doc").alias("component"))
    return linked.union(alone).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("rep").alias("set_id"), F.col("component").alias("component_id"))


SQL = {
    "op6_ngram_jaccard_join": r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
    t as (select doc_id, case when len(w) >= 3 then list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
    c as (select s, min(doc_id) as id, len(s) as n from t where len(s) > 0 group by s), x as (select id, n, unnest(s) as g from c),
    p as (select a.id as a, b.id as b from x a join x b on a.g = b.g and a.id < b.id and 100 * b.n >= 90 * a.n and 100 * a.n >= 90 * b.n group by all having 190 * count(*) >= 90 * (any_value(a.n) + any_value(b.n))),
    e as (select a, b from p union select b, a from p), r as (select id, id as k from c union select e.b, r.k from r join e on e.a = r.id), m as (select id, min(k) as component_id from r group by 1)
    select t.doc_id, cast(len(t.s) as bigint) as n_shingles, coalesce(c.id, t.doc_id) as set_id, coalesce(m.component_id, t.doc_id) as component_id from t left join c on c.s = t.s and len(t.s) > 0 left join m on m.id = c.id""",
}


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=90)
