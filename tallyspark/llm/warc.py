"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response gives two records that refer to it: ``metadata`` (its HTTP status
and headers, the digests, title, links and size of the text) and ``conversion``
(its text, all visible blocks in page order). Both keep the source's record id,
target URI and date in WARC-Refers-To, WARC-Refers-To-Target-URI and
WARC-Refers-To-Date. A digest that the source states is kept as it is; others
are computed (SHA-1, base32). Record ids derive from the source's id and the
record type, so a rerun or a retried task writes the same records.

Nulls and edge cases: a null block or payload counts as empty and gives an
empty conversion. Without a blank line a block is all payload. Bodies that are
chunked (sizes of hexadecimal digits only) or compressed by gzip, deflate (with
or without a zlib head) or zstd are unpacked; if that fails they are read as they
are. A body in another encoding, such as br, has no text. Bytes that are no text
of the stated charset (UTF-8 if there is none, or none of that name, or one that
is no text encoding) become replacement characters, as do lone surrogates. A
response without record id has no derivatives
to refer to it and is left out. Repeated rows give repeated records; an empty
table gives none.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.html_text import blocks_of

SCHEMA = (
    "refers_to string, target_uri string, record_id string, warc_type string, content_type string, content_length long, "
    "block_digest string, source_block_digest string, source_payload_digest string, header string, block string"
)
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TITLE = re.compile(r"<title[^>]*>(.*?)(?:</title\s*>|$)", re.I | re.S)
LINK = re.compile(r"""<a\s(?:[^>"']|"[^"]*"|'[^']*')*?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
SIZE = re.compile(rb"[0-9A-Fa-f]+")
SURROGATE = re.compile("[\ud800-\udfff]")
PART_BYTES = 1 << 22  #: records are handed on in parts of about so many bytes, or one
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload."""
    head, blank, payload = block.partition(b"\r\n\r\n")
    if not blank or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("latin-1").split("\r\n")
    headers: list[tuple[str, str]] = []
    for line in lines:
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and headers:  # a folded header
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        elif colon:
            headers.append((name.strip(), value.strip()))
    return status, headers, payload


def body_of(headers: list[tuple[str, str]], payload: bytes) -> str:
    """The payload's text: unpacked and decoded."""
    named = {n.lower(): v.lower() for n, v in headers}
    try:
        if "chunked" in named.get("transfer-encoding", ""):
            out, at = [], 0
            while (end := payload.find(b"\r\n", at)) >= 0:
                size = payload[at:end].split(b";")[0].strip()
                if SIZE.fullmatch(size) is None:
                    raise ValueError("no chunk size")
                if not (n := int(size, 16)):
                    break
                out.append(payload[end + 2 : end + 2 + n])
                at = end + 4 + n
            payload = b"".join(out)
        packed = named.get("content-encoding", "")
        if "gzip" in packed:
            payload = gzip.decompress(payload)
        elif "deflate" in packed:
            try:
                payload = zlib.decompress(payload)
            except zlib.error:
                payload = zlib.decompress(payload, -zlib.MAX_WBITS)
        elif "zstd" in packed:
            payload = zstandard.ZstdDecompressor().decompressobj().decompress(payload)
        elif packed not in ("", "identity"):
            return ""
    except (ValueError, OSError, EOFError, zlib.error, zstandard.ZstdError):
        pass
    charset = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", named.get("content-type", ""))
    try:
        text = payload.decode(charset[1] if charset else "utf-8", "replace")
    except (LookupError, ValueError):  # UnicodeError is a ValueError
        text = payload.decode("utf-8", "replace")
    return SURROGATE.sub("\ufffd", text)


def visible_text(page: str) -> str:
    """All text of a page but scripts, styles and its head, a line for each block."""
    parsed = blocks_of(page)
    in_head = parsed.paths.below(lambda label: label == "head")
    return "\n".join(b.text for b in parsed.blocks if not in_head[b.path])


def one_line(text: str) -> str:
    return " ".join(text.split())


def header_of(fields: list[tuple[str, str | None]]) -> str:
    return "WARC/1.1\r\n" + "".join(f"{n}: {one_line(v)}\r\n" for n, v in fields if v) + "\r\n"


def derivatives(source: dict) -> Iterator[tuple]:
    """The two records of a response, as rows of ``SCHEMA``."""
    block = source["block"] or b""
    status, headers, payload = split_http(block)
    page = body_of(headers, payload)
    block_digest = source["block_digest"] or digest(block)
    payload_digest = source["payload_digest"] or digest(payload)
    text = visible_text(page)
    title = TITLE.search(page)
    fields = [
        ("status", status),
        *((f"http-header-{n.lower()}", v) for n, v in headers),
        ("source-block-digest", block_digest),
        ("source-payload-digest", payload_digest),
        ("title", html.unescape(title[1]) if title else ""),
        ("text-characters", str(len(text))),
        ("text-words", str(len(text.split()))),
        *(("outlink", html.unescape(m[1].strip("\"'"))) for m in LINK.finditer(page)),
    ]
    metadata = "".join(f"{n}: {one_line(v)}\r\n" for n, v in fields if v)
    for kind, content_type, content in (("metadata", "application/warc-fields", metadata), ("conversion", "text/plain; charset=utf-8", text)):
        data = content.encode("utf-8", "replace")
        record_id = f"<urn:uuid:{uuid.uuid5(SPACE, source['record_id'] + ' ' + kind)}>"
        own = digest(data)
        header = header_of(
            [
                ("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", source["date"]), ("WARC-Target-URI", source["target_uri"]),
                ("WARC-Refers-To", source["record_id"]), ("WARC-Refers-To-Target-URI", source["target_uri"]), ("WARC-Refers-To-Date", source["date"]),
                ("WARC-Block-Digest", own), ("WARC-Payload-Digest", payload_digest if kind == "metadata" else own),
                ("Content-Type", content_type), ("Content-Length", str(len(data))),
            ]
        )
        yield source["record_id"], source["target_uri"], record_id, kind, content_type, len(data), own, block_digest, payload_digest, header, content


def build_derivatives(responses: DataFrame, key: str) -> DataFrame:
    """The key and the columns of ``SCHEMA``, two rows for each response.

    ``responses``: ``key`` (a long that comes back with the records), record_id,
    target_uri, date (text as in WARC-Date), block (binary: HTTP head and body),
    block_digest, payload_digest (text or null).
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64() if n == "content_length" else pa.string() for n in NAMES]

        def part(keys: list, rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(NAMES)
            return pa.record_batch([pa.array(keys, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [key, *NAMES])

        for batch in batches:
            keys, rows, size = [], [], 0
            for i in range(batch.num_rows):
                source = batch.slice(i, 1).to_pylist()[0]
                for row in derivatives(source):
                    keys.append(source[key])
                    rows.append(row)
                    size += len(row[-1])
                if size >= PART_BYTES:
                    yield part(keys, rows)
                    keys, rows, size = [], [], 0
            yield part(keys, rows)

    wanted = [F.col(key).cast("long").alias(key), "record_id", "target_uri", "date", F.col("block").cast("binary").alias("block"), "block_digest", "payload_digest"]
    return responses.where("record_id IS NOT NULL").select(*wanted).mapInArrow(build, f"{key} long, {SCHEMA}")


def serialised(records: DataFrame) -> Column:
    """A record's bytes in a WARC file."""
    return F.concat(F.encode("header", "utf-8"), F.encode("block", "utf-8"), F.lit(b"\r\n\r\n"))


def responses_of_pages(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Crawled pages (page_id, url, html) as response records with ids derived from page and URL."""
    name = F.md5(F.concat_ws(" ", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")))).alias("name")
    parts = [F.substring("name", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    return pages.select("page_id", "url", "html", name).select(
        "page_id",
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.encode(F.concat(head, F.coalesce("html", F.lit(""))), "utf-8").alias("block"),
        F.lit(None).cast("string").alias("block_digest"),
        F.lit(None).cast("string").alias("payload_digest"),
    )
