"""Alignment of two tokenizers' tokens over the bytes of the same text.

Both libraries say which part of the text a token stands for: character offsets from tokenizers,
spans from sentencepiece. These are the coarse cuts. Where a token stands for part of a multibyte
character or for a single byte, its span is that of the whole character or empty; there the token's decoded
bytes give the cut. Byte offsets where tokens of both end cut them into groups; tokens whose byte ranges
overlap are linked.

Neither tokenizer makes a token that holds a space after another character, so a text may be cut
before each single space between other characters, and each piece (a word, mostly) is aligned once and
remembered. A text in which some piece doesn't come back as its bytes is judged as a whole.
"""

from __future__ import annotations

import hashlib
import itertools
import operator
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asoflow.llm.store import join_classes, stored

MARK = "▁"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_KEPT = 400_000  # pieces that a worker remembers: bounds its memory alone
_KEPT_LENGTH = 64
_TOGETHER = 1 << 15  # characters of pieces that are encoded as one text
_PART = 1 << 20  # characters that are aligned at once (or one text)
_FEW_PAIRS = 1_000_000
_SPAN = operator.attrgetter("id", "begin", "end")
_WORKERS: dict[str, _Aligner] = {}


def _byte_letters() -> dict[str, int]:
    """Byte of each letter that byte-level vocabularies write it as: printable bytes are themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ends(coarse: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens whose bytes make up the text: the coarse cut where the span (begin, end) is as long as the token's bytes, else what the bytes say."""
    decoded = np.cumsum(sizes)
    return np.where((coarse[:, 1] - coarse[:, 0] == sizes) & (coarse[:, 1] == decoded), coarse[:, 1], decoded)


class _Aligner:
    """Both tokenizers in one worker process, and the pieces that it has aligned."""

    def __init__(self, a_json: str, b_model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a process for each core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = _byte_letters()
        found = {}
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            found[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.a_bytes = [found.get(i, b"") for i in range(max(found) + 1)]
        self.b_bytes: list[bytes] = []
        self.cuts = True
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode())
            self.cuts &= self.b.is_control(i) or MARK not in piece.lstrip(MARK)
        self.sizes = [np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes)]
        self.names = [[str(i) for i in range(len(t))] for t in (self.a_bytes, self.b_bytes)]
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}  # what was remembered before; what is met again moves to known

    def align(self, pieces: list[str]) -> list[tuple | None]:
        """For each piece n_a, n_b, groups and the linked pairs; None where the tokens' bytes aren't those of the piece. The pieces are encoded as one text, with a space before each; where that doesn't come back as its bytes, halves of them are."""
        text = " ".join(pieces)
        raw = f" {text}".encode()
        one, two = self.a.encode(f" {text}", add_special_tokens=False), self.b.encode(text, return_type="proto").pieces
        a, two = one.ids, np.fromiter(itertools.chain.from_iterable(map(_SPAN, two)), np.int64, 3 * len(two)).reshape(-1, 3)
        b = two[:, 0].tolist()
        same = b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw
        if same:
            coarse = np.fromiter(itertools.chain.from_iterable(one.offsets), np.int64, 2 * len(a)).reshape(-1, 2)
            stops = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1)
            if len(raw) > len(text) + 1:  # where each character starts in the bytes
                letters = np.frombuffer(f" {text}".encode("utf-32-le"), "<u4")
                at = np.concatenate(([0], np.cumsum(1 + (letters >= 0x80) + (letters >= 0x800) + (letters >= 0x10000))))
                coarse, stops = at[coarse], at[stops]
            a_ids, b_ids = np.array(a, np.int64), two[:, 0]
            a_ends = _ends(coarse, self.sizes[0][a_ids])
            spans = two[:, 1:] + 1  # after the space
            spans[0, 0] = 0
            b_ends = _ends(spans, self.sizes[1][b_ids])
            if all(e[np.searchsorted(e, stops)].tolist() == stops.tolist() for e in (a_ends, b_ends)):
                return _linked([[t[i] for i in x] for t, x in zip(self.names, (a, b), strict=True)], a_ids, a_ends, b_ids, b_ends, stops)
        if len(pieces) == 1:
            return [None]
        half = len(pieces) // 2
        return self.align(pieces[:half]) + self.align(pieces[half:])

    def documents(self, texts: list[str | None]) -> Iterator[tuple | None]:
        cut = [(_CUT.split(t) if self.cuts else [t]) if t else [] for t in texts]
        if 2 * len(self.known) > _KEPT:
            self.known, self.older = {}, self.known
        known, older, plain, long, lo, held = self.known, self.older, [], [], 0, 0
        for p in set(itertools.chain.from_iterable(cut)).difference(known):
            if p in older:
                known[p] = older[p]
                continue
            if len(p) > _KEPT_LENGTH:
                long.append(p)
            if p[0].isspace() or p[-1].isspace():
                known[p] = self.align([p])[0]
            else:
                plain.append(p)
        for k, p in enumerate(plain):
            held += len(p)
            if held > _TOGETHER or k == len(plain) - 1:
                known.update(zip(plain[lo : k + 1], self.align(plain[lo : k + 1]), strict=True))
                lo, held = k + 1, 0
        for text, pieces in zip(texts, cut, strict=True):
            if not text:
                yield None
                continue
            parts = [known[p] for p in pieces]
            if None in parts and len(parts) > 1:
                parts = self.align([text])
            yield None if parts[0] is None else _joined(parts)
        for p in long:
            del known[p]


def _linked(names: list[list[str]], a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, stops: np.ndarray) -> list[tuple]:
    """names: of a's and b's ids; the pairs are bytes, eight for each. What stands between stops, which are ends of both. Between two neighbouring ends of either there is one token of both: a link; ends of both close a group."""
    ends = np.union1d(a_ends, b_ends)
    pairs = (a[np.searchsorted(a_ends, ends)] << 32 | b[np.searchsorted(b_ends, ends)]).tobytes()
    both = np.intersect1d(a_ends, b_ends, assume_unique=True)
    one, two = names
    upto = [np.concatenate(([0], np.searchsorted(e, both, "right"))).tolist() for e in (a_ends, b_ends)]
    groups = [
        f"{one[i]}|{two[k]}" if j == i + 1 and m == k + 1 else f"{','.join(one[i:j])}|{','.join(two[k:m])}"
        for i, j, k, m in zip(upto[0], upto[0][1:], upto[1], upto[1][1:], strict=False)
    ]
    cuts = [np.concatenate(([0], np.searchsorted(e, stops, "right"))).tolist() for e in (a_ends, b_ends, both, ends)]
    return [(x[1] - x[0], y[1] - y[0], ";".join(groups[g[0] : g[1]]), pairs[8 * p[0] : 8 * p[1]]) for x, y, g, p in zip(*(itertools.pairwise(c) for c in cuts), strict=True)]


def _joined(parts: list[tuple]) -> tuple:
    """n_a, n_b, n_groups, n_links, groups, distinct pairs and their times of a text from its pieces."""
    n_a, n_b, groups, pairs = zip(*parts, strict=True)
    whole = ";".join(groups)
    pairs = np.frombuffer(b"".join(pairs), np.int64)
    codes, times = np.unique(pairs, return_counts=True)
    return sum(n_a), sum(n_b), whole.count(";") + 1, len(pairs), whole, codes, times


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    lo = held = 0
    for k, text in enumerate(texts):
        held += len(text.as_py() or "")
        if held > _PART or k == len(texts) - 1:
            yield lo, k + 1
            lo, held = k + 1, 0


def aligned_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's tokens of both tokenizers, cut into groups that end at the same byte.

    a_path: a byte-level BPE file of tokenizers, which encodes a space and the text; b_path: a sentencepiece model, which encodes
    the text and adds the space itself. Special tokens' strings in a text are plain text. Returns id_col, n_a, n_b,
    n_groups, n_links, groups (ids as a1,a2|b1;a3|b2,b3), pairs (array of a, b, times: the distinct linked ids and how
    often they are linked here), one row per input row.

    Null and empty texts, and those whose tokens don't come back as the bytes of space and text, have
    no tokens: zeros, '' and no pairs. Texts of any length are aligned whole; equal texts get equal
    rows, repeated rows repeat; a null id is allowed. Other columns are not read, whatever their names; an
    empty table gives an empty one. The files are read on the driver and travel with the tasks: they are as large as the vocabularies.
    """
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        model = (f.read(), g.read())
    name = hashlib.sha1(model[0].encode() + model[1]).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two vocabularies
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"]
    fields = [pa.field("a", pa.int32()), pa.field("b", pa.int32()), pa.field("times", pa.int64())]
    none = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from asoflow.llm import alignment  # the module that the worker keeps

        tool = alignment._WORKERS.get(name)
        if tool is None:
            tool = alignment._WORKERS[name] = _Aligner(*sent.value)
        for batch in batches:
            for lo, hi in _slices(batch.column(1)):
                rows = [x or none for x in tool.documents(batch.column(1).slice(lo, hi - lo).to_pylist())]
                at = pa.array(np.concatenate(([0], np.cumsum([len(r[5]) for r in rows]))).astype(np.int32))
                codes = np.concatenate([r[5] for r in rows])
                flat = pa.StructArray.from_arrays([pa.array((codes >> 32).astype(np.int32)), pa.array((codes & 0xFFFFFFFF).astype(np.int32)), pa.array(np.concatenate([r[6] for r in rows]))], fields=fields)
                columns = [batch.column(0).slice(lo, hi - lo), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4)), pa.array([r[4] for r in rows], pa.string()), pa.ListArray.from_arrays(at, flat)]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.select(id_col).dtypes[0][1]
    schema = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<struct<a: int, b: int, times: long>>"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count (rows that hold them linked), best (the count is the highest of its a, ties included)."""
    counts = aligned.select(F.inline("pairs")).groupBy("a", "b").agg(F.count("*").alias("count"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def link_support(aligned: DataFrame, few: int = _FEW_PAIRS) -> DataFrame:
    """aligned (a written table of aligned_tokens with a row number n) with n_best and count_sum: links whose pair is the best of its a in all rows, and the sum of the counts over links.

    The table of pairs is bounded by the vocabularies; up to so many pairs it is broadcast, beyond that the pairs
    of the rows are joined by a shuffle, but for the most frequent ones.
    """
    table = stored(pair_counts(aligned))
    spread = aligned.select("n", F.inline("pairs"))
    found = spread.join(F.broadcast(table), ["a", "b"]) if table.count() <= few else join_classes(spread, table, ["a", "b"], "count")
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0))
    sums = found.groupBy("n").agg(best.alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    rows = aligned.join(sums, "n", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})


def default_models() -> tuple[str, str]:
    """Paths of the public byte-level and piece vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aligned_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_models())
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups"), 256)).otherwise("")
    rows = stored(found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs", F.monotonically_increasing_id().alias("n")))  # written, so the numbers stay
    return link_support(rows).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
