"""Documents: inventory, blocks, chunks, duplicates, search and its metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asoflow.operators import markdown
from asoflow.operators.markdown import bounded_pieces, chunk_table  # noqa: F401
from asoflow.sources.scratch import written


_QUERIES, _VECTORS = 1_000, 20_000  # of one block of a search
_STRIPE = 32  # queries whose scores against a block are held at once
_SHARE = 8  # a class is left if one in so many of the shingles it needs is shared among its first ones
_MAP_WORDS = 1 << 17  # of the bit map of classes left


def corpus_scan(docs: DataFrame, id_col: str, text_col: str, excluded: Sequence[tuple[Column, str]] = ()) -> DataFrame:
    """Content ids of texts with one kind of line end: how many documents each has, the first, how many different byte checksums they have, and the reason for which documents are left out (the first rule that holds, null if none)."""
    from asoflow.functions.columns import first_reason

    content = F.sha2(F.regexp_replace(text_col, "\r\n?", "\n"), 256)
    reason = first_reason(excluded) if excluded else F.lit(None).cast("string")
    return docs.groupBy(content.alias("content_id"), reason.alias("reason")).agg(F.count("*").alias("n_documents"), F.min(id_col).alias("first_id"), F.count_distinct(F.sha2(text_col, 256)).alias("n_checksums"))


def markdown_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks of Markdown with the path of headings above: id, block, kind (code or text), path, text. See markdown for what is read and left out."""
    code = F.col("kind").isin("fence", "code_block")
    return markdown.markdown_blocks(docs, id_col, text_col).withColumn("kind", F.when(code, "code").otherwise("text"))


def pieces(blocks: DataFrame, keys: Sequence[str], text_col: str, limit: int) -> DataFrame:
    """Every block's pieces with their ordinal, by bounded_pieces in batches."""
    import pandas as pd

    kinds = dict(blocks.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(*r[:-1], k, p) for r in pdf.itertuples(index=False) for k, p in enumerate(bounded_pieces(r[-1] or "", limit))]
            yield pd.DataFrame(rows, columns=[*keys, "piece", "text"])

    return blocks.select(*keys, text_col).mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", piece int, text string")


def chunk_ordinals(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines of text as chunks: id, checksum, ordinal (order of first occurrence among the document's distinct lines, from 0), occurrences (line numbers), bytes and a token estimate; blank lines go."""
    lines = docs.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("_n", "_t")).where("length(trim(_t)) > 0")
    grouped = lines.groupBy(id_col, F.sha2("_t", 256).alias("checksum")).agg(F.sort_array(F.collect_list(F.col("_n").cast("long"))).alias("occurrences"), F.max(F.octet_length("_t")).cast("long").alias("n_bytes"))
    index = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col("occurrences")[0])) - 1
    return grouped.withColumns({"ordinal": index.cast("long"), "tokens": F.ceil(F.col("n_bytes") / 4)})


def exact_duplicates(docs: DataFrame, id_col: str, text_col: str, fields: Sequence[str]) -> DataFrame:
    """Groups of equal texts: size, first id, and for each field how many values differ inside. Groups are counted, not listed."""
    groups = docs.groupBy(F.sha2(text_col, 256).alias("checksum")).agg(F.count("*").alias("n_documents"), F.min(id_col).alias("first_id"), *[F.count_distinct(f).alias(f"n_{f}") for f in fields])
    return groups.where("n_documents > 1")


def components(edges: DataFrame) -> DataFrame:
    """Smallest id reachable from every id that has an edge (a, b): id, component. Labels spread over the edges and jump to the label's label, a round is written before the next."""
    edges = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels, before = edges.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")), None
    while True:
        labels = written(labels)
        mark = labels.agg(F.sum(F.col("component").cast("decimal(38,0)")), F.count("*")).first()  # ids may be as large as hashes
        if mark == before:
            return labels
        before = mark
        own = labels.select(F.col("id").alias("b"), F.col("component").alias("_c"))
        near = edges.join(own, "b").groupBy(F.col("a").alias("id")).agg(F.min("_c").alias("_n"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("_j"))
        labels = labels.join(near, "id", "left").join(jump, "component", "left").select("id", F.least("component", "_n", "_j").alias("component"))


def _shingles(docs: DataFrame, id_col: str, text_col: str, words: int, least_words: int) -> DataFrame:
    """Per document its set of word shingles in the order of their prints (h) and the set's size n, 0 with too few words. Nothing is filtered here, since a filter would have each text taken apart twice."""
    from pyspark.ml.feature import NGram

    from asoflow.functions.columns import nfkc_casefold

    split = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(nfkc_casefold(F.coalesce(text_col, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w"))
    grams = NGram(n=words, inputCol="w", outputCol="g").transform(split)
    h = F.sort_array(F.array_distinct(F.transform("g", lambda x: F.xxhash64(x))))
    return grams.select("id", F.when(F.size("w") >= least_words, h).otherwise(F.array().cast("array<long>")).alias("h")).select("id", F.size("h").cast("long").alias("n"), "h")


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, words: int = 3, least_words: int = 12, threshold_bp: int = 8000) -> DataFrame:
    """Documents linked by a Jaccard similarity of at least threshold_bp / 10000 over word shingles: id, class_id (smallest id of the same set), component_id (smallest id reachable).

    Words are runs of letters and digits of the text after NFKC and case folding; documents with fewer than
    least_words are left out. Equal sets are one class. Two sets that are similar enough share many of their first shingles in one
    order, so only these travel, as halves, to tell which classes can have a partner; the sets of the others are never written.
    Shingles of the classes left are ordered from the rarest; two sets that are similar enough share one of the first few, whose number
    follows from the threshold. Each class first meets the class that leads such a shingle (the longest); linked classes become one
    component, and then only classes of different components meet, so a group of near copies is never expanded into all its pairs. Sets are
    fetched for pairs that the shingles met, and what is left behind them, still let be similar.
    """
    rule = (id_col, text_col, words, least_words)
    least = F.ceil(F.col("n") * threshold_bp / 10000)
    need = F.greatest(F.lit(1), F.floor(least / _SHARE))  # so many of its first shingles a class shares with any partner
    cols = F.transform(F.slice("h", F.lit(1), (F.col("n") - least + need).cast("int")), lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int"))
    sets = written(_shingles(docs, *rule).select("id", "n", F.xxhash64("h").alias("d1"), F.xxhash64(F.lit(1), "h").alias("d2"), cols.alias("cols"))).where("n > 0")
    classes = sets.groupBy("d1", "d2").agg(F.min("id").alias("class"), F.max("n").alias("n"), F.count("*").alias("m"))
    col = Window.partitionBy("x")  # a copy is no partner
    firsts = sets.select("d1", F.explode("cols").alias("x")).select("d1", (F.min("d1").over(col) != F.max("d1").over(col)).alias("shared"))
    left = firsts.where("shared").groupBy("d1").agg(F.count("*").alias("met")).join(classes, "d1").where(F.col("met") >= need * F.col("m"))

    # At most _MAP_WORDS rows whatever the input: a fixed bit map of the ids left. A class more does no harm, so it suffices.
    def spot(key: str) -> tuple[Column, Column]:
        place = F.pmod(F.xxhash64(F.col(key)), F.lit(_MAP_WORDS * 64))
        return F.floor(place / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit")

    bits = left.where(F.col("class").isNotNull()).select(*spot("class")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    texts = docs.select(id_col, text_col, *spot(id_col)).join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    rows = _shingles(texts, *rule).select(F.col("id").alias("class"), "n", "h")
    cells = rows.select("class", "n", F.explode_outer("h").alias("x")).where("x is not null")  # plain explode would filter by h, and make it twice
    met = cells.withColumn("f", F.count("*").over(Window.partitionBy("x")))  # counted where they are sent to: most occur once and go no further
    met = met.where("f > 1").groupBy("class", "n").agg(F.collect_list("f").alias("f"), F.collect_list("x").alias("x"))
    # a class has so many shingles that it may miss, less those that no one shares
    width = F.col("n") - least + 1 - (F.col("n") - F.size("x"))
    order = F.transform(F.sort_array(F.arrays_zip("f", "x")), lambda c: c["x"])
    ordered = written(met.where(width > 0).select("class", "n", width.cast("int").alias("width"), order.alias("o")))
    heads = written(ordered.select("class", "n", F.size("o").cast("long").alias("s"), F.posexplode(F.slice("o", F.lit(1), F.col("width"))).alias("k", "x")))

    def possible(meetings: DataFrame) -> DataFrame:
        """Pairs whose shared heads, and all that is left of both behind the last one, reach the threshold."""
        pairs = meetings.groupBy("a", "b", "na", "nb", "sa", "sb").agg(F.count("*").alias("met"), F.max("ka").alias("ka"), F.max("kb").alias("kb"))
        most = F.col("met") + F.least(F.col("sa") - F.col("ka"), F.col("sb") - F.col("kb")) - 1
        return pairs.where(most * (10000 + threshold_bp) >= threshold_bp * (F.col("na") + F.col("nb"))).select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        """What a pair has in common, it shares: sets are compared without the shingles of no one else."""
        full = ordered.select(F.col("class"), "n", "o")
        one, two = (full.select(F.col("class").alias(k), F.col("n").alias(f"n{k}"), F.col("o").alias(f"o{k}")) for k in "ab")
        common = F.size(F.array_intersect("oa", "ob")).cast("long")
        return pairs.join(one, "a").join(two, "b").where(common * (10000 + threshold_bp) >= threshold_bp * (F.col("na") + F.col("nb"))).select("a", "b")

    def side(table: DataFrame, k: str, *more: str) -> DataFrame:
        return table.select(F.col("class").alias(k), *[F.col(c).alias(c + k) for c in ("n", "s", "k", *more)], "x")

    fits = (F.col("na") * 10000 >= F.col("nb") * threshold_bp) & (F.col("nb") * 10000 >= F.col("na") * threshold_bp)
    # what precedes a shared shingle, it and what follows it: less than that no similar pair can have at any of its meetings
    reach = (F.least("ka", "kb") + F.least(F.col("sa") - F.col("ka"), F.col("sb") - F.col("kb"))) * (10000 + threshold_bp) >= threshold_bp * (F.col("na") + F.col("nb"))
    one, two = side(heads, "a"), side(heads, "b")
    lead = heads.groupBy("x").agg(F.max(F.struct("n", F.bitwise_not("class").alias("m"))).alias("s")).select("x", F.col("s.n").alias("nb"), F.bitwise_not("s.m").alias("b"))
    led = one.join(lead, "x").where(fits & (F.col("a") != F.col("b"))).select("a", "b").distinct()
    first = written(verified(possible(one.join(led, "a").join(two, ["b", "x"]).where(reach))))
    named = components(first)
    placed = written(heads.join(named.withColumnRenamed("id", "class"), "class", "left").withColumn("c", F.coalesce("component", "class")).drop("component"))
    mixed = placed.groupBy("x").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("x")
    one, two = (side(placed.join(mixed, "x", "left_semi"), k, "c") for k in "ab")
    rest = possible(one.join(two, "x").where(fits & reach & (F.col("ca") < F.col("cb"))))
    final = components(first.union(verified(rest)))
    out = sets.select("id", "d1", "d2").join(classes.select("d1", "d2", "class"), ["d1", "d2"]).join(final.withColumnRenamed("id", "class"), "class", "left")
    return out.select("id", F.col("class").alias("class_id"), F.coalesce("component", "class").alias("component_id"))


def _block_math() -> tuple[Callable, Callable]:
    """What a search does with a block; inner functions, so that they travel to the workers with it."""

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        """Lists of one length as the rows of a matrix, without an object for each number."""
        lists = column.combine_chunks()
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        if lists.null_count or (lengths != lengths[0]).any():
            raise ValueError("vectors of a search must have one length")
        return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)

    def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Cosines of rows with rows, rounded to six places."""
        return np.round((x @ y.T) / np.sqrt((x * x).sum(axis=1))[:, None] / np.sqrt((y * y).sum(axis=1)), 6)

    return matrix, cosines


def cosine_search(chunks: DataFrame, queries: DataFrame, k: int, per_document: int, scoped: bool = False) -> DataFrame:
    """The k best chunks of each query by exact cosine, at most per_document of one document; ties to the smaller id.

    chunks: id, document, v. queries: query_id, v; any number of both. They meet in blocks by matrix products, and a
    block returns k rows a query, which are enough: what comes after them in the block comes after as many in the
    whole. Scores are rounded to six places before they are compared.

    scoped: a query sees only what it may, before anything is ranked. Chunks then have scope (null: for everyone), status, from_day
    and to_day (half-open, null: no end), queries have scope and day: a chunk must be open to the query's scope, 'active', and
    in force on its day.
    """
    blocks, asks = max(1, -(-chunks.count() // _VECTORS)), max(1, -(-queries.count() // _QUERIES))
    document = dict(chunks.dtypes)["document"]
    v = F.col("v").cast("array<double>").alias("v")
    if scoped:
        chunks = chunks.where("status = 'active'")
        own = [F.col("scope"), F.coalesce(F.unix_date("from_day"), F.lit(-(1 << 30))).alias("since"), F.coalesce(F.unix_date("to_day"), F.lit(1 << 30)).alias("until")]
        asked = [F.col("scope"), F.unix_date("day").alias("since"), F.lit(0).alias("until")]
    else:
        own = asked = [F.lit(None).cast("string").alias("scope"), F.lit(0).alias("since"), F.lit(1).alias("until")]
    side = chunks.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(asks - 1))).alias("q"), F.lit(False).alias("ask"), "id", "document", v, *own)
    other = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("c"), F.pmod(F.xxhash64("query_id"), F.lit(asks)).cast("int").alias("q"), F.lit(True).alias("ask"), F.col("query_id").alias("id"), F.lit(None).cast(document).alias("document"), v, *asked)

    matrix, cosines = _block_math()

    def best(table: pa.Table) -> pa.Table:
        ask = table.column("ask").to_numpy()
        asked, pool = table.filter(pa.array(ask)), table.filter(pa.array(~ask))
        found: dict[str, list] = {"query_id": [], "id": [], "document": [], "score": []}
        if len(asked) and len(pool):
            x, y = (matrix(t.column("v")) for t in (asked, pool))
            ids, documents, own = pool.column("id").to_numpy(), pool.column("document").to_pylist(), asked.column("id").to_numpy()
            scores = (row for at in range(0, len(x), _STRIPE) for row in cosines(x[at : at + _STRIPE], y))  # a stripe of queries at a time
            scope, wants = (np.array(t.column("scope").to_pylist(), object) for t in (pool, asked))
            since, until, day = pool.column("since").to_numpy(), pool.column("until").to_numpy(), asked.column("since").to_numpy()
            public = np.array([s is None for s in scope])
            for q, row, want, at_day in zip(own, scores, wants, day, strict=True):
                seen = (public | (scope == want)) & (since <= at_day) & (at_day < until)
                row = np.where((ids == q) | ~seen, -np.inf, row)
                wide, picked = 8 * k, []
                while True:  # the best rows by score; more, if one document has too many of them
                    least = np.partition(row, -wide)[-wide] if wide < len(row) else -np.inf
                    at = np.flatnonzero(np.isfinite(row) & (row >= least))
                    picked, held = [], {}
                    for i in at[np.lexsort((ids[at], -row[at]))]:
                        if held.setdefault(documents[i], 0) < per_document:
                            held[documents[i]] += 1
                            picked.append(i)
                            if len(picked) == k:
                                break
                    if len(picked) == k or least == -np.inf:
                        break
                    wide *= 4
                found["query_id"] += [int(q)] * len(picked)
                found["id"] += ids[picked].tolist()
                found["document"] += [documents[i] for i in picked]
                found["score"] += row[picked].tolist()
        return pa.table({"query_id": pa.array(found["query_id"], pa.int64()), "id": pa.array(found["id"], pa.int64()), "document": pa.array(found["document"], table.schema.field("document").type), "score": pa.array(found["score"], pa.float64())})

    hits = side.unionByName(other).groupBy("c", "q").applyInArrow(best, f"query_id long, id long, document {document}, score double")
    order = (F.desc("score"), F.asc("id"))
    kept = hits.withColumn("_d", F.row_number().over(Window.partitionBy("query_id", "document").orderBy(*order))).where(F.col("_d") <= per_document)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= k).drop("_d")


def retrieval_metrics(hits: DataFrame, cases: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """One row over all cases: recall at k and mean reciprocal rank, how many citations stand, and how many cases and critical cases pass.

    hits: query_id, id, rank. cases: query_id, wanted and forbidden (groups of chunks), n_wanted (how many chunks it wants), critical.
    chunks: id, grp; a hit that isn't there is a citation that doesn't stand. A case passes if no hit is forbidden, all
    citations stand and at least one wanted chunk is found. Latency isn't data and is left out.
    """
    met = hits.where(F.col("rank") <= k).join(chunks.select("id", "grp"), "id", "left")
    joined = cases.join(met, "query_id", "left")
    good = F.col("grp").eqNullSafe(F.col("wanted"))
    each = joined.groupBy("query_id", "n_wanted", "critical").agg(
        F.count_if(good).alias("found"), F.coalesce(1 / F.min(F.when(good, F.col("rank"))), F.lit(0.0)).alias("rr"), F.count_if(F.col("grp") == F.col("forbidden")).alias("banned"),
        F.count("id").alias("cited"), F.count("grp").alias("bound"),
    )
    passed = (F.col("banned") == 0) & (F.col("cited") == F.col("bound")) & (F.col("found") > 0)
    return each.agg(
        F.count("*").alias("n_queries"), F.round(F.avg(F.try_divide("found", "n_wanted")), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.count_if(F.col("banned") == 0).alias("n_clean"),
        F.round(F.try_divide(F.sum("bound"), F.sum("cited")), 6).alias("citation_rate"), F.count_if(passed).alias("n_passed"), F.round(F.try_divide(F.count_if(passed & F.col("critical")), F.count_if(F.col("critical"))), 6).alias("critical_pass_rate"),
    )


def diversify(hits: DataFrame, least: float, budget: int, size_col: str, most: int, per_document: int) -> DataFrame:
    """The best hit of each repository first, then of each document not there yet, then the rest: in this order hits are taken as long as there are fewer than `most`, skipping those that don't fit the size budget or whose document has enough.

    hits: query_id, id, repository, document, score and the size. Returns query_id, id, tier, used (size so far). A query's hits, few by the search's k, are folded in one row.
    """
    hits = hits.where(F.col("score") >= least)
    order = (F.desc("score"), F.asc("id"))
    r = F.row_number().over(Window.partitionBy("query_id", "repository").orderBy(*order))
    d = F.row_number().over(Window.partitionBy("query_id", "document").orderBy(*order))
    there = F.max((F.col("_r") == 1).cast("int")).over(Window.partitionBy("query_id", "document")) == 1
    tiered = hits.withColumns({"_r": r, "_d": d}).withColumn("tier", F.when(F.col("_r") == 1, 0).when((F.col("_d") == 1) & ~there, 1).otherwise(2))
    row = F.struct("tier", (-F.col("score")).alias("s"), "id", F.col("document").cast("string").alias("document"), F.col(size_col).cast("long").alias("size"))
    queue = tiered.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("_q"))
    kind = "array<struct<tier:int,id:bigint,document:string,used:bigint>>"

    def take(state: Column, x: Column) -> Column:
        fits = (state["used"] + x["size"] <= budget) & (F.size(state["hits"]) < most) & (F.size(F.filter(state["hits"], lambda h: h["document"].eqNullSafe(x["document"]))) < per_document)
        hit = F.struct(x["tier"].alias("tier"), x["id"].alias("id"), x["document"].alias("document"), (state["used"] + x["size"]).alias("used"))
        return F.struct(F.when(fits, state["used"] + x["size"]).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["hits"], F.array(hit))).otherwise(state["hits"]).alias("hits"))

    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(kind).alias("hits"))
    return queue.select("query_id", F.inline(F.aggregate("_q", start, take)["hits"])).select("query_id", "id", "tier", "used")


def greedy_budget(hits: DataFrame, least: float, budget: int, size_col: str, most: int, per_document: int) -> DataFrame:
    """What diversify takes, as a grouped map over Arrow batches: a query's hits are one group, as many as its search returned (a bounded k), and are gone through in order once."""
    found = hits.where(F.col("score") >= least).select("query_id", "id", "repository", "document", "score", F.col(size_col).cast("long").alias("size"))

    def take(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (-r["score"], r["id"]))
        first_of: dict[str, set] = {"repository": set(), "document": set()}
        for r in rows:
            r["top"] = r["repository"] not in first_of["repository"]
            first_of["repository"].add(r["repository"])
        led = {r["document"] for r in rows if r["top"]}
        for r in rows:
            fresh = r["document"] not in first_of["document"]
            first_of["document"].add(r["document"])
            r["tier"] = 0 if r["top"] else 1 if fresh and r["document"] not in led else 2
        used, held, out = 0, {}, []
        for r in sorted(rows, key=lambda r: (r["tier"], -r["score"], r["id"])):
            if used + r["size"] <= budget and len(out) < most and held.get(r["document"], 0) < per_document:
                used += r["size"]
                held[r["document"]] = held.get(r["document"], 0) + 1
                out.append((r["query_id"], r["id"], r["tier"], used))
        kinds = (table.schema.field("query_id").type, table.schema.field("id").type, pa.int32(), pa.int64())
        return pa.table([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=["query_id", "id", "tier", "used"])

    types = dict(found.dtypes)
    return found.groupBy("query_id").applyInArrow(take, f"query_id {types['query_id']}, id {types['id']}, tier int, used long")


def index_violations(chunks: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """Chunks without a vector, vectors without a chunk, wrong dimensions and norms, and where both sides have a checksum those that differ (the chunk has changed since): id, reason."""
    from asoflow.functions.columns import norm

    ids, own = chunks.select("id"), vectors.select("id")
    shape = F.when(F.size("v") != dimension, "dimension").when(F.abs(norm(F.col("v")) - 1) > 1e-3, "norm")
    bad = vectors.select("id", shape.alias("reason")).where("reason is not null")
    if "checksum" in chunks.columns and "checksum" in vectors.columns:
        both = chunks.select("id", F.col("checksum").alias("_now")).join(vectors.select("id", "checksum"), "id")
        bad = bad.union(both.where(~F.col("checksum").eqNullSafe(F.col("_now"))).select("id", F.lit("checksum")))
    return bad.union(ids.join(own, "id", "left_anti").select("id", F.lit("no_vector"))).union(own.join(ids, "id", "left_anti").select("id", F.lit("no_chunk")))


def hash_numbers(text: Column, size: int) -> Column:
    """Numbers from -1 up to 1 that the text's digest decides."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.conv(F.substring(F.sha2(F.concat(i.cast("string"), F.lit(":"), text), 256), 1, 8), 16, 10).cast("double") / 2147483648.0 - 1)


def hash_embedding(text: Column, size: int = 8) -> Column:
    """A unit vector that the text's digest decides, for tests."""
    raw = hash_numbers(text, size)
    return F.transform(raw, lambda x: x / F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, y: a + y * y)))


def embedded_once(rows: DataFrame, checksum: str, text: str, embed: Callable[[Column], Column], name: str) -> DataFrame:
    """rows with the embedding of their text, made once for each distinct checksum, and n_shared, how many rows share it."""
    distinct = rows.groupBy(checksum).agg(F.count("*").alias("n_shared"), F.min(text).alias("_t"))
    return rows.drop(text).join(distinct.withColumn(name, embed(F.col("_t"))).drop("_t"), checksum)


@F.udtf(returnType="piece int, text string")
class chunk_text:  # noqa: N801  a table function of SQL
    """bounded_pieces of a text under a limit of bytes, with their ordinals."""

    def eval(self, text: str, limit: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(bounded_pieces(text or "", limit))


def within_budget(df: DataFrame, budget: int) -> DataFrame:
    """df itself if it has at most budget rows, else an error: reads at most one row more than that to tell."""
    if df.limit(budget + 1).count() > budget:
        raise ValueError(f"more than {budget} rows")
    return df
