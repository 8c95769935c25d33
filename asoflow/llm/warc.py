"""WARC derivatives: linked metadata and plain-text conversion records of response records.

Every record is a row: its header fields in order, its block, and ids that link it. A response
names its page; its metadata and conversion records refer to it, repeat its target and date
and carry digests of their own. Ids are UUIDs made from digests, so a rerun agrees and a lost
task writes the same record again.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DATE = "2024-01-01T00:00:00Z"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value: the base 32 alphabet
_NO_BREAK = re.compile(r"&(?:nbsp|#0*160(?!\d)|#[xX]0*[aA]0(?![0-9a-fA-F]));?")


def _uuid(*parts: Column) -> Column:
    h = F.sha1(F.concat_ws("\x1f", *parts).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), cut[0], F.lit("-"), cut[1], F.lit("-5"), cut[2], F.lit("-a"), cut[3], F.lit("-"), cut[4], F.lit(">"))


def sha1_base32(block: Column) -> Column:
    """sha1: and the digest in base 32, as WARC files have it: 160 bits are 32 letters of 5."""
    h = F.sha1(block.cast("binary"))
    letters = []
    for i in range(8):  # five hexadecimal digits are four letters
        value = F.conv(F.substring(h, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(_B32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(F.lit("sha1:"), *letters)


_RAW = re.compile(r"(?ai)<(script|style)\b")
_CLOSE = {name: re.compile(rf"(?ai)</{name}\s*>") for name in ("script", "style")}
_BREAKS = re.compile(r"(?ai)<(br|/?p|/?div|/?li|/?h[1-6]|/?tr|/?table|/?ul|/?ol|/?section|/?article|/?header|/?footer|/?nav|/title)\b")
_LINK, _HREF, _TITLE, _TITLE_END = (re.compile(f"(?ai){x}") for x in (r"<a\s", "href", "<title", "</title"))
_RECORDS = 1 << 20  # bytes of records that read_warc hands on at once


def _without_raw(page: str) -> str:
    """Scripts and styles that are closed become a space. A name whose end was sought once in vain isn't sought again."""
    out, at, never = [], 0, set()
    while found := _RAW.search(page, at if not out else max(at, out[-1][1])):
        at, name = found.end(), found[1].lower()
        if (end := page.find(">", at)) < 0 or len(never) == 2:
            break
        if name not in never:
            if close := _CLOSE[name].search(page, end + 1):
                out.append((found.start(), close.end()))
            else:
                never.add(name)
    return _cut(page, out, " ")


def _cut(page: str, spans: list[tuple[int, int]], by: str) -> str:
    if not spans:
        return page
    ends = [0, *(e for _, e in spans)]
    return by.join([*(page[a:b] for a, (b, _) in zip(ends, spans, strict=False)), page[ends[-1] :]])


def _without(page: str, opening: re.Pattern | str, closing: str, by: str) -> str:
    """What stands from an opening to the next closing goes; after an opening that is never closed, no other is."""
    spans, at = [], 0
    while True:
        if isinstance(opening, str):
            start = page.find(opening, at)
            after = start + len(opening)
        else:
            found = opening.search(page, at)
            start, after = (found.start(), found.end()) if found else (-1, 0)
        end = page.find(closing, after) if start >= 0 else -1
        if end < 0:
            return _cut(page, spans, by)
        at = end + len(closing)
        spans.append((start, at))


def _links(page: str) -> int:
    """Anchors with a target: each takes the last href before the next >."""
    refs, count, at = [m.start() for m in _HREF.finditer(page)], 0, 0
    end = -1
    while found := _LINK.search(page, at):
        at = found.end()
        if end < at:
            end = page.find(">", at)
            end = len(page) if end < 0 else end
        k = bisect.bisect_right(refs, end - 4) - 1
        if k >= 0 and refs[k] >= at:
            count, at = count + 1, refs[k] + 4
    return count


def _title(page: str) -> str:
    start = _TITLE.search(page)
    end = page.find(">", start.end()) if start else -1
    close = _TITLE_END.search(page, end + 1) if end >= 0 else None
    return page[end + 1 : close.start()] if close else ""


def _plain(page: str) -> str:
    text = _without(_without_raw(page), "<!--", "-->", " ")
    text = _without(_without(text, _BREAKS, ">", "\n"), "<", ">", "")
    if "&" in text:
        text = html.unescape(_NO_BREAK.sub(" ", text))
    text = re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t\r\f]+", " ", text))
    return text.strip(" \n")


def page_parts(page: Column) -> Column:
    """Struct of text, title and links of a page. Each is found in time linear in the page, whatever it holds.

    For the text, scripts, styles, comments and tags go (those that are closed), all named and numeric character
    references of HTML5 are read once, with a no-break space that one stands for as a space, and blank runs
    shrink. links counts anchors with a href. A null page is empty.
    """

    def parts(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(_plain(x), _title(x), _links(x)) for x in pages], columns=["text", "title", "links"])

    return F.pandas_udf(parts, "text string, title string, links int")(F.coalesce(page, F.lit("")))


def plain_text(page: Column) -> Column:
    """Text of a page, by page_parts."""
    return page_parts(page)["text"]


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of raw pages: record_id, page id, target_uri, date, http_headers, payload, digests. Null pages have an empty payload; null urls no target."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n"))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("target_uri"), payload.alias("payload"), http.alias("http_headers"))
    base = base.withColumn("payload_digest", sha1_base32(F.col("payload")))
    record = _uuid(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("target_uri", F.lit("")), F.col("payload_digest"))
    return base.withColumn("record_id", record).withColumn("date", F.lit(_DATE))


def derivatives(found: DataFrame) -> DataFrame:
    """For each response record a metadata and a conversion record.

    found: record_id, target_uri, date, http_headers, payload, payload_digest (more columns are
    not read). Returns page_id, warc_type, record_id, refers_to (the response's id), target_uri,
    date, content_type, block, block_digest, content_length (bytes), source_headers (of the
    response), payload_digest (of the response). Null payloads count as empty and give an empty conversion;
    null targets and dates stay null. Repeated responses give repeated records with the same ids. Pages of any length are read whole,
    in time linear in them. Columns of other names are not read, and those named like the output are replaced. An empty table gives an empty one.
    """
    found = found.withColumn("parts", page_parts(F.col("payload")))
    fields = F.to_json(
        F.struct(
            F.col("target_uri").alias("target"), F.col("record_id").alias("response"), F.col("payload_digest"),
            F.octet_length(F.coalesce("payload", F.lit(""))).alias("payload_length"),
            F.col("parts.title").alias("title"), F.col("parts.links").alias("links"),
            F.split(F.regexp_replace("http_headers", r"[\r\n]+$", ""), "\r\n").alias("http_headers"),
        )
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/json").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain").alias("content_type"), F.col("parts.text").alias("block")),
    )
    made = found.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("http_headers").alias("source_headers"), "payload_digest", F.inline(kinds))
    made = made.withColumn("block_digest", sha1_base32(F.col("block"))).withColumn("content_length", F.octet_length("block").cast("long"))
    return made.withColumn("record_id", _uuid(F.col("warc_type"), F.col("refers_to"), F.col("block_digest")))


def response_records(read: DataFrame) -> DataFrame:
    """The response records among those of read_warc, as derivatives takes them: the HTTP header is cut off at its blank line, chunks are joined and gzip is undone, and the payload is decoded by the charset that the header names (else UTF-8; what doesn't decode becomes U+FFFD).

    The record's own payload digest is kept; where it has none, that of the payload's bytes is taken. Responses without a
    header have an empty one; null blocks count as empty. page_id is null.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for block in pdf["block"]:
                head, payload = http_parts(block or b"")
                charset = re.search(r"(?im)^content-type:.*charset=[\"']?([\w.:-]+)", head)
                try:
                    text = payload.decode(charset[1] if charset else "utf-8", "replace")
                except LookupError:  # a charset that doesn't exist
                    text = payload.decode("utf-8", "replace")
                own = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
                rows.append((head, text.replace("\x00", "\ufffd"), own))
            made = pd.DataFrame(rows, columns=["http_headers", "payload", "own"])
            yield pd.concat([pdf.drop(columns="block").reset_index(drop=True), made], axis=1)

    found = read.where("warc_type = 'response'").select("record_id", "target_uri", F.col("headers")["WARC-Date"].alias("date"), F.col("headers")["WARC-Payload-Digest"].alias("told"), "block")
    kept = found.mapInPandas(run, "record_id string, target_uri string, date string, told string, http_headers string, payload string, own string")
    return kept.select(F.lit(None).cast("long").alias("page_id"), "record_id", "target_uri", "date", "http_headers", "payload", F.coalesce("told", "own").alias("payload_digest"))


def http_parts(block: bytes) -> tuple[str, bytes]:
    """Header (with its line ends) and payload of an HTTP message, chunks joined and gzip undone."""
    if not block.startswith(b"HTTP/"):
        return "", block
    head, _, payload = block.partition(b"\r\n\r\n")
    text = head.decode("latin-1") + "\r\n"
    if re.search(r"(?im)^transfer-encoding:.*chunked", text):
        parts, at = [], 0
        while line := re.compile(rb"([0-9a-fA-F]+)[^\n]*\n").match(payload, at):
            size = int(line[1], 16)
            parts.append(payload[line.end() : line.end() + size])
            at = line.end() + size + 2
            if not size:
                break
        payload = b"".join(parts)
    if re.search(r"(?im)^content-encoding:.*gzip", text):
        try:
            payload = gzip.decompress(payload)
        except (OSError, EOFError, zlib.error):  # kept as it came
            pass
    return text, payload


def response_files(found: DataFrame) -> DataFrame:
    """Responses as records for write_warc: the block is the HTTP header, a blank line and the payload."""
    block = F.concat("http_headers", F.lit("\r\n"), "payload")
    made = found.select(F.lit("response").alias("warc_type"), "record_id", F.lit(None).cast("string").alias("refers_to"), "target_uri", "date", F.lit("application/http; msgtype=response").alias("content_type"), block.alias("block"), "payload_digest")
    return made.withColumns({"block_digest": sha1_base32(F.col("block")), "content_length": F.octet_length("block").cast("long")})


def serialized(records: DataFrame) -> DataFrame:
    """Each record as the lines of a WARC file, without its last line end: column value. Header fields that are null are left out."""
    digest = [F.concat(F.lit("WARC-Payload-Digest: "), F.col("payload_digest"))] if "payload_digest" in records.columns else []
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.0"), F.concat(F.lit("WARC-Type: "), F.col("warc_type")), F.concat(F.lit("WARC-Record-ID: "), F.col("record_id")),
        F.concat(F.lit("WARC-Refers-To: "), F.col("refers_to")), F.concat(F.lit("WARC-Target-URI: "), F.col("target_uri")), F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.concat(F.lit("WARC-Block-Digest: "), F.col("block_digest")), *digest, F.concat(F.lit("Content-Type: "), F.col("content_type")), F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")),
    )
    return records.select(F.concat(head, F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n")).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """One gzip WARC file per partition."""
    serialized(records).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: warc_type, record_id, refers_to, target_uri, headers (map), block (binary). A file is one task, read in order."""

    def run(batches: Iterator) -> Iterator:
        import io

        rows, held = [], 0
        for pdf in batches:
            for content in pdf["content"]:
                stream = io.BytesIO(content)
                if content[:2] == b"\x1f\x8b":
                    stream = gzip.GzipFile(fileobj=stream)
                while line := stream.readline():
                    if not line.startswith(b"WARC/"):
                        continue
                    headers = {}
                    while (line := stream.readline()).strip():
                        name, _, value = line.decode("utf-8", "replace").partition(":")
                        headers[name.strip()] = value.strip()
                    block = stream.read(int(headers.get("Content-Length", 0)))
                    row = [headers.get(x) for x in ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI")]
                    rows.append([*row, headers, block])
                    held += len(block)
                    if held > _RECORDS:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    names = ["warc_type", "record_id", "refers_to", "target_uri", "headers", "block"]
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "warc_type string, record_id string, refers_to string, target_uri string, headers map<string,string>, block binary")


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both records of every page, with what they keep of the response."""
    made = derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return made.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "date", "source_headers", "payload_digest", "content_type", "content_length", "block_digest", "block", F.sha2(F.col("block").cast("binary"), 256).alias("block_sha256"))
