"""Markdown as blocks with heading paths, cut into bounded pieces and chunks: each document is read once, in its own row."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: titles, case-folded, of sections that only lead elsewhere
_NAVIGATION = {"toc", "contents", "table of contents", "navigation", "spis treści", "nawigacja"}
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+|$)")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r" {0,3}(?:([-*+])|(\d{1,9})[.)])(?:[ \t]+|$)")
_QUOTE = re.compile(r" {0,3}>")
_DELIMITER = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML = re.compile(r" {0,3}</?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$)")
_DEFINITION = re.compile(r" {0,3}\[[^\]]+\]:[ \t]*\S")
_ANCHOR = re.compile(r"\[[^\[\]]*\]\(#[^()\s]*\)")
_INDENT = re.compile(r"(?: {4}|\t)")
_BETWEEN_ANCHORS = " \t\n|.,:;·•←→–—-*+0123456789)"
_SENT = 1 << 22  # characters of a batch of rows


def _kind_of(line: str, following: str) -> str:
    """The block that a line begins where no other goes on."""
    if not line.strip():
        return "gap"
    if _FENCE.match(line):
        return "fence"
    if _ATX.match(line):
        return "heading"
    if line.lstrip(" ").startswith("<!--") and not _INDENT.match(line):
        return "comment"
    if _RULE.match(line):
        return "rule"
    if _INDENT.match(line):
        return "code_block"
    if _QUOTE.match(line):
        return "blockquote"
    if item := _ITEM.match(line):
        return "bullet_list" if item[1] else "ordered_list"
    if "|" in line and "-" in following and _DELIMITER.match(following) and ("|" in following or line.strip().startswith("|")):
        return "table"
    if _HTML.match(line):
        return "html_block"
    return "reference_definition" if _DEFINITION.match(line) else "paragraph"


def _goes_on(kind: str, line: str, begins: str, after_gap: bool) -> bool:
    """Whether a line, which would begin a block of its own kind, goes on with the open one."""
    if kind in ("paragraph", "table", "html_block", "reference_definition"):
        lazy = {"paragraph", "code_block", "reference_definition", "table"} if kind == "paragraph" else {kind, "paragraph"}
        return begins in lazy if kind != "html_block" else begins != "gap"
    if kind == "code_block":
        return begins in ("code_block", "gap")
    if kind == "blockquote":
        return begins in ("blockquote", "paragraph")
    if kind in ("bullet_list", "ordered_list"):
        inner = line[:1] in (" ", "\t")
        return begins in (kind, "gap") or inner or (begins == "paragraph" and not after_gap)
    return kind == begins == "gap"


def _runs(lines: Sequence[str]) -> Iterator[tuple[str, list[str]]]:
    """Blocks in order, as kind and lines: one pass over the lines with the open block as its state."""
    kind, held, close, after_gap = "", [], "", False
    for k, line in enumerate(lines):
        if kind == "fence" and close:
            held.append(line)
            mark = _FENCE.match(line)
            if mark and mark[1][0] == close[0] and len(mark[1]) >= len(close) and not line[mark.end() :].strip():
                close = ""
            continue
        if kind == "comment" and close:
            held.append(line)
            if "-->" in line:
                close = ""
                kind = "comment" if not line.rsplit("-->", 1)[1].strip() else "html_block"
            continue
        if kind == "paragraph" and (mark := _SETEXT.match(line)):
            yield "heading", [("#" if mark[1][0] == "=" else "##") + " " + " ".join(x.strip() for x in held)]
            kind, held = "", []
            continue
        begins = _kind_of(line, lines[k + 1] if k + 1 < len(lines) else "")
        if held and _goes_on(kind, line, begins, after_gap):
            held.append(line)
        else:
            if held:
                yield from _closed(kind, held)
            kind, held = begins, [line]
            if begins == "fence":
                close = _FENCE.match(line)[1]
            elif begins == "comment":
                rest = line.split("<!--", 1)[1]
                close = "" if "-->" in rest else "-->"
                if not close and line.rsplit("-->", 1)[1].strip():
                    kind = "html_block"
        after_gap = begins == "gap"
    if held:
        yield from _closed(kind, held)


def _closed(kind: str, held: list[str]) -> Iterator[tuple[str, list[str]]]:
    """A finished block; blank lines at the end of a list or of indented code stand after it."""
    end = len(held)
    if kind in ("bullet_list", "ordered_list", "code_block"):
        while end > 1 and not held[end - 1].strip():
            end -= 1
    yield kind, held[:end]
    if end < len(held):
        yield "gap", held[end:]


def blocks_of(text: str) -> list[tuple[int, str, str | None, str, str]]:
    """Blocks of a text: number, kind, the reason for which it is omitted (null if it isn't), path of the headings above (a > b) and its lines.

    Kinds: paragraph, bullet_list, ordered_list, blockquote, fence, code_block, table, html_block and
    reference_definition. Omitted are headings (structural_heading; # and underlined ones), rules (thematic_break), comments of
    any number of lines (html_comment), paragraphs and lists of nothing but links into the document
    (anchor_navigation), and everything under a heading that names a table of contents, up to the next heading
    of its level or above (navigation_section). Numbers count all blocks and the gaps between them, from 1. A documented part of
    CommonMark: lists and quotes are not looked into.
    """
    out, headings, navigation = [], [], None
    for number, (kind, lines) in enumerate(_runs(re.sub("\r\n?", "\n", text).split("\n")), 1):
        if kind == "gap":
            continue
        body, reason = "\n".join(lines), None
        if kind == "heading":
            mark = _ATX.match(lines[0])
            title = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", lines[0][mark.end() :]).strip()
            level = len(mark[1])
            headings = [h for h in headings if h[0] < level] + [(level, title)]
            if navigation is not None and level <= navigation:
                navigation = None
            if navigation is None and title.casefold() in _NAVIGATION:
                navigation = level
            reason = "structural_heading"
        elif kind == "rule":
            reason = "thematic_break"
        elif kind == "comment":
            reason = "html_comment"
        elif kind in ("paragraph", "bullet_list", "ordered_list") and "](#" in body and not _ANCHOR.sub("", body).strip(_BETWEEN_ANCHORS):
            reason = "anchor_navigation"
        reason = "navigation_section" if navigation is not None else reason
        out.append((number, kind, reason, " > ".join(t for _, t in headings), body))
    return out


def bounded_pieces(text: str, limit: int) -> list[str]:
    """Pieces of at most limit UTF-8 bytes, cut at the last line end or else space that fits, never inside a character: one pass over the bytes."""
    raw = text.encode("utf-8").strip(b"\n")
    at, end, out = 0, len(raw), []
    while end - at > limit:
        head = at + limit
        while head > at and raw[head] & 0xC0 == 0x80:
            head -= 1
        cut = raw.rfind(b"\n", at + 1, head)
        cut = raw.rfind(b" ", at + 1, head) if cut < 0 else cut
        if cut < 0:
            cut = max(head, at + 1)
            while cut < end and raw[cut] & 0xC0 == 0x80:
                cut += 1
        if piece := raw[at:cut].strip(b"\n"):
            out.append(piece.decode())
        at = cut
        while at < end and raw[at] in b" \n":
            at += 1
    return out + ([raw[at:].decode()] if at < end else [])


def _per_document(docs: DataFrame, id_col: str, text_col: str, rows_of: Callable[[object, str], list[tuple]], columns: Sequence[tuple[str, str, pa.DataType]]) -> DataFrame:
    """Each text's rows, in its own task: id_col and columns (name, type in Spark, type in Arrow). Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, rows, held = batch.column(0), [], [], 0
            for k, text in enumerate(batch.column(1)):
                found = rows_of(ids[k].as_py(), text.as_py() or "")
                rows += found
                at += [k] * len(found)
                held += len(text.as_py() or "")
                if rows and (held > _SENT or k == len(batch) - 1):
                    arrays = [pa.array([r[c] for r in rows], kind) for c, (_, _, kind) in enumerate(columns)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.array(at))), *arrays], [id_col, *(n for n, _, _ in columns)])
                    at, rows, held = [], [], 0

    kind = docs.select(id_col).dtypes[0][1]
    return docs.where(F.col(text_col).isNotNull()).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{n} {t}" for n, t, _ in columns))


def markdown_blocks(docs: DataFrame, id_col: str, text_col: str, omitted: bool = False) -> DataFrame:
    """The blocks of every text, by blocks_of: id, block, kind, path, text; with omitted also those that are left out, and their reason. No text is shuffled."""
    columns = [("block", "long", pa.int64()), ("kind", "string", pa.string()), ("reason", "string", pa.string()), ("path", "string", pa.string()), ("text", "string", pa.string())]
    found = _per_document(docs, id_col, text_col, lambda _, text: blocks_of(text), columns)
    return found if omitted else found.where("reason is null").drop("reason")


def _chunks(name: object, text: str, limit: int) -> list[tuple]:
    found: dict[tuple, list] = {}
    for block, kind, reason, path, body in blocks_of(text):
        if reason is None:
            for piece, part in enumerate(bounded_pieces(body, limit)):
                found.setdefault((kind, path, part), []).append({"block": block, "piece": piece})
    out = []
    for index, ((kind, path, part), places) in enumerate(found.items()):
        checksum = hashlib.sha256(part.encode()).hexdigest()
        full = "\x1f".join(x for x in (None if name is None else str(name), path, kind, checksum) if x is not None)
        out.append((hashlib.sha256(full.encode()).hexdigest(), index, kind, path, part, checksum, -(-len(part.encode()) // 4), places))
    return out


def chunk_table(docs: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """Chunks of documents: the bounded pieces of their blocks, each once per document.

    id, chunk_id (of the document, heading path, kind and content), chunk_index (order of first occurrence, from
    0), kind, path, text, checksum, tokens (ceil(bytes / 4)), occurrences (block and piece of each, in order). A
    document is read, cut and deduplicated in its own row; nothing is shuffled.
    """
    places = pa.list_(pa.struct([("block", pa.int64()), ("piece", pa.int32())]))
    columns = [
        ("chunk_id", "string", pa.string()), ("chunk_index", "long", pa.int64()), ("kind", "string", pa.string()), ("path", "string", pa.string()), ("text", "string", pa.string()),
        ("checksum", "string", pa.string()), ("tokens", "long", pa.int64()), ("occurrences", "array<struct<block: long, piece: int>>", places),
    ]
    return _per_document(docs, id_col, text_col, lambda name, text: _chunks(name, text, limit), columns)
