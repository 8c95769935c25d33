"""SentencePiece BPE encoding and decoding with a merge-type prefix table.

For a text, the encoding of each prefix ends in one token only: among the vocabulary tokens
that end there (found by an automaton), the one that is compatible with the last token of the
prefix before it. Two tokens are compatible if their joined text encodes to just these two.
One pass over the text stores that last token for every prefix; the ids are then read backwards.
The time is linear in the text, however long a stretch without spaces is.

No token has a space mark after another character, so a text may be cut before each space mark
that follows something else; the cut pieces (words, mostly) are encoded apart and remembered.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
_KEPT = 150_000  # cut pieces that a worker remembers twice over: bounds its memory alone
_KEPT_LENGTH = 160


def read_model(path: str) -> dict:
    """Pieces and special ids of a model file, for closures: as large as the vocabulary."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    size = m.get_piece_size()
    special = {i for i in range(size) if m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)}
    normal = [(m.id_to_piece(i), i, m.get_score(i)) for i in range(size) if i not in special]
    found = {
        "pieces": normal,
        "bytes": [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)],
        "byte_fallback": all(m.is_byte(m.piece_to_id(f"<0x{b:02X}>")) for b in range(256)),
        "bos": m.bos_id(), "eos": m.eos_id(), "unk": m.unk_id(),
        "controls": [i for i in range(size) if m.is_control(i)],
    }
    if not found["byte_fallback"] or any(MARK in p.lstrip(MARK) for p, _, _ in normal):
        raise ValueError("only BPE models with byte fallback, whose pieces have space marks in front alone, are supported")
    if m.encode("a  a ") != m.encode("a  a ") or m.decode(m.encode(" a  b ")) != " a  b ":
        raise ValueError("only models that keep white space as it is are supported")
    return found


class _Known(dict):
    """Remembers a function's values; when full, those of longest ago go."""

    def __init__(self, of: Callable, most: int = _KEPT) -> None:
        super().__init__()
        self.of, self.most, self.before = of, most, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.of(key)
        if len(key) <= _KEPT_LENGTH:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value


class PrefixTable:
    """Encoder and decoder for one model."""

    def __init__(self, model: dict) -> None:
        import ahocorasick

        self.model = model
        # a piece's merge has the order of its score; among characters it never matters
        self.order = {p: -s for p, _, s in model["pieces"] if len(p) > 1}
        ids = {p: i for p, i, _ in model["pieces"]}
        self.texts = {i: p.replace(MARK, " ") for p, i, _ in model["pieces"]} | dict.fromkeys(model["controls"], "")
        self.texts |= {model["bytes"][b]: chr(b) for b in range(128)}  # these bytes are whole characters
        self.controls = set(model["controls"])
        self.of_byte = {i: b for b, i in enumerate(model["bytes"])}
        #: ids of a token, packed; those of a character that is in no piece are of its bytes
        self.packed = _Known(lambda t: self.pack([ids[t]] if t in ids else [model["bytes"][b] for b in t.encode("utf-8", "surrogatepass")]))
        self.parts = _Known(self.part)
        self.begin, self.end = self.pack([model["bos"]]), self.pack([model["eos"]])
        self.automaton = ahocorasick.Automaton()
        for piece in {*self.order, *(c for p, _, _ in model["pieces"] for c in p)}:
            if len(piece) == 1 or self.merged(piece) == [piece]:  # a piece that no merges lead to is never a token
                # compatible tokens before it, as far as known; None stands for the start or a character that is in no piece
                self.automaton.add_word(piece, (len(piece), {None: True}, piece))
        self.automaton.make_automaton()

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def merged(self, text: str) -> list[str]:
        """Plain merging, for texts of a token or two: the best pair first, the leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                o = self.order.get(parts[i] + parts[i + 1])
                if o is not None and (best is None or o < best):
                    best, at = o, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def tokens(self, text: str) -> list[str]:
        """The tokens of a text whose spaces are marks; a character that is in no piece stands for itself."""
        last: list[str | None] = [None] * (len(text) + 1)  # the prefix table
        for end, (size, fits, piece) in self.automaton.iter(text):  # for each end the longest piece first
            if last[end + 1] is None:
                before = last[end + 1 - size]
                fit = fits.get(before)
                if fit is None:
                    fit = fits[before] = self.merged(before + piece) == [before, piece]
                if fit:
                    last[end + 1] = piece
        out, at = [], len(text)
        while at:
            token = last[at] or text[at - 1]
            out.append(token)
            at -= len(token)
        out.reverse()
        return out

    def part(self, text: str) -> bytes:
        """Ids of a cut piece as little-endian unsigned 32-bit integers."""
        packed = self.packed
        return b"".join([packed[t] for t in self.tokens(text)])

    def decoded(self, ids: list[int]) -> str:
        """Text of ids, before the mark in front is taken off: pieces with spaces for marks, runs of byte ids as UTF-8."""
        texts = self.texts
        try:
            return "".join([texts[i] for i in ids])
        except KeyError:  # there are ids of bytes or others that have no text of their own
            out, run = [], bytearray()
        for i in ids:
            if i in self.of_byte:
                run.append(self.of_byte[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(texts.get(i, " ⁇ "))
        out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def encode(self, text: str) -> bytes:
        """Ids with begin and end as little-endian unsigned 32-bit integers."""
        known = self.parts
        parts = [known[x] for x in _CUT.findall(MARK + text.replace(" ", MARK))] if text else []
        return b"".join([self.begin, *parts, self.end])

    def decode(self, ids: list[int]) -> str:
        plain = self.decoded(ids)
        return plain[1:] if plain.startswith(" ") and next((i for i in ids if i not in self.controls), None) not in self.of_byte else plain


_CUT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


_TABLES: dict[tuple, PrefixTable] = {}


def table_for(model: dict) -> PrefixTable:
    """A worker's table of a model, kept from task to task."""
    key = (len(model["pieces"]), model["pieces"][-1], model["bos"], model["eos"])
    if key not in _TABLES:
        _TABLES[key] = PrefixTable(model)
    return _TABLES[key]


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about a million bytes, so that what a task holds doesn't depend on the batch."""
    lo, held = 0, 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        held += n or 0
        if held > 1 << 20:
            yield lo, k + 1
            lo, held = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text with begin and end ids, and decode it again.

    Returns id_col, n_tokens, ids_sha256 and decoded_sha256 (lowercase hex over the ids as
    little-endian unsigned 32-bit integers and over the decoded UTF-8 text); with_ids adds ids
    (array of int) and decoded. Null counts as the empty text, whose ids are begin and end.
    Rows repeat if input rows do, equal texts get equal ids, a null id stays null; an empty table gives an empty one.
    Texts of any length are encoded whole. Other columns are not read, whatever their names. The model is read on the driver
    and travels with the tasks: its size is that of the vocabulary.
    """
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_for(model)
        for batch in batches:
            for lo, hi in _parts(batch.column(1)):
                count, ids, plain, raw, texts = [], [], [], [], []
                for text in batch.column(1).slice(lo, hi - lo):
                    packed = table.encode(text.as_py() or "")
                    numbers = np.frombuffer(packed, "<u4")
                    decoded = table.decode(numbers.tolist())
                    count.append(len(numbers))
                    ids.append(sha256(packed).hexdigest())
                    plain.append(sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                    if with_ids:
                        raw.append(numbers.astype(np.int32))
                        texts.append(decoded)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(plain, pa.string())]
                if with_ids:
                    ends = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32))
                    columns += [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(raw))), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    schema = f"`{id_col}` {docs.select(id_col).dtypes[0][1]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def decode_ids(ids: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Text of each row's ids (array of int): id_col, decoded. A null array gives null."""
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_for(model)
        for batch in batches:
            texts = [None if x.as_py() is None else table.decode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "decoded"])

    return ids.select(id_col, F.col(ids_col).cast("array<int>")).mapInArrow(run, f"`{id_col}` {ids.select(id_col).dtypes[0][1]}, decoded string")


def default_model() -> str:
    """Path of the public 32k model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
