"""Derived records of web archives.

Each response record gives a metadata record (what was received: status, source
headers, digests, title, links) and, if its payload is text, a conversion
record (its plain text).  Both refer to the response by its identifier and
carry its address and date; digests of the source are preserved beside those of
the new blocks.

Records are rows (see :data:`RECORD`).  ``read_archives`` makes them of WARC
files, plain or compressed by record, and ``to_bytes`` gives the bytes of a
record, so that written files are a concatenation of rows.  Each record is
worked on by itself in Arrow batches; nothing is shuffled, and new identifiers
are functions of the old ones, so that a task that runs again gives the same.

Defined cases: null html is an empty payload; null url leaves the address out;
repeated rows give equal records; other columns are ignored; records of other
types derive nothing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphfold.llm.dom import HIDDEN_TEXT, parse, title_and_links

HEADER = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))
#: A record: its type and identifier, all its headers in order, and its block.
RECORD = T.StructType(
    [
        T.StructField("warc_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("headers", HEADER),
        T.StructField("block", T.BinaryType()),
    ]
)
_HEADER_ARROW = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
NO_DATE = "1970-01-01T00:00:00Z"
#: For the identifiers of derived records.
NAMESPACE = uuid.UUID("0c6cf8a2-9a2e-5f63-9d2c-5a8c5f3f7b11")
#: Digits of base 32 as Spark writes them and as digests do.
BASE32_DIGITS, BASE32_LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = b"\r\n"

Headers = list[tuple[str, str]]


def digest_of(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind} of {source}')}>"


def value_of(headers: Headers, name: str) -> str | None:
    """The first value of a header; names have no case."""
    return next((value for key, value in headers if key.lower() == name.lower()), None)


def split_http(block: bytes) -> tuple[str, Headers, bytes]:
    """(status line, headers, payload as sent) of an HTTP response."""
    head, gap, payload = block.partition(CRLF + CRLF)
    if not gap:
        head, gap, payload = block.partition(b"\n\n")
    status, *lines = head.decode("latin-1").splitlines() or [""]
    pairs = [line.partition(":") for line in lines if ":" in line]
    return status, [(name.strip(), value.strip()) for name, _, value in pairs], payload


def _unchunked(payload: bytes) -> bytes:
    parts, at = [], 0
    while True:
        end = payload.find(CRLF, at)
        try:
            size = int(payload[at:end].split(b";")[0], 16) if end >= 0 else 0
        except ValueError:
            return payload
        if not size:
            return b"".join(parts)
        parts.append(payload[end + 2 : end + 2 + size])
        at = end + 4 + size


def decoded(headers: Headers, payload: bytes) -> bytes:
    """The payload without transfer and content encodings; as it is where they do not hold."""
    if "chunked" in (value_of(headers, "Transfer-Encoding") or "").lower():
        payload = _unchunked(payload)
    coding = (value_of(headers, "Content-Encoding") or "").lower()
    try:
        if coding in ("gzip", "x-gzip"):
            return gzip.decompress(payload)
        if coding == "deflate":
            return zlib.decompress(payload)
    except (OSError, EOFError, zlib.error):
        return payload
    return payload


_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.IGNORECASE)


def text_of(headers: Headers, payload: bytes) -> str:
    named = _CHARSET.search(value_of(headers, "Content-Type") or "") or _CHARSET.search(payload[:1024].decode("latin-1"))
    try:
        return payload.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def plain_text(source: str) -> str:
    """All shown text of a page, one block a line."""
    nodes, blocks = parse(source)
    hidden = [False] * len(nodes)
    for i, node in enumerate(nodes):
        hidden[i] = node.tag in HIDDEN_TEXT or (i > 0 and hidden[node.parent])
    return "\n".join(b.text for b in blocks if not hidden[b.node])


def derive(record_id: str, headers: Headers, block: bytes) -> list[tuple[str, str, Headers, bytes]]:
    """The metadata and conversion records of one response: (type, id, headers, block)."""
    status, http, payload = split_http(block)
    body = decoded(http, payload)
    kind = (value_of(http, "Content-Type") or "").split(";")[0].strip().lower()
    is_html = kind in ("text/html", "application/xhtml+xml")
    source = text_of(http, body) if is_html or kind.startswith("text/") else ""
    payload_digest = value_of(headers, "WARC-Payload-Digest") or digest_of(payload)
    block_digest = value_of(headers, "WARC-Block-Digest") or digest_of(block)
    carried = [(name, v) for name in ("WARC-Target-URI", "WARC-Date") if (v := value_of(headers, name)) is not None]

    def record(of: str, content_type: str, content: bytes, more: Headers) -> tuple[str, str, Headers, bytes]:
        own = derived_id(record_id, of)
        listed = [("WARC-Type", of), ("WARC-Record-ID", own), ("WARC-Refers-To", record_id), *carried, *more]
        listed += [("WARC-Block-Digest", digest_of(content)), ("Content-Type", content_type)]
        return of, own, [*listed, ("Content-Length", str(len(content)))], content

    title, links = title_and_links(source) if is_html else ("", [])
    fields = [("http-status", status), ("source-block-digest", block_digest), ("source-payload-digest", payload_digest)]
    fields += [(f"source-header-{name.lower()}", value) for name, value in http]
    fields += [("title", title)] * bool(title) + [("outlink", link) for link in links]
    described = "".join(f"{name}: {' '.join(value.split())}\r\n" for name, value in fields).encode("utf-8", "replace")
    out = [record("metadata", "application/warc-fields", described, [("WARC-Payload-Digest", payload_digest)])]
    if is_html or kind.startswith("text/"):
        text = (plain_text(source) if is_html else source).encode("utf-8", "replace")
        out.append(record("conversion", "text/plain; charset=utf-8", text, [("WARC-Source-Payload-Digest", payload_digest)]))
    return out


def to_bytes(headers: Headers, block: bytes, compress: bool = True) -> bytes:
    """A record as it stands in a file; compressed, it is a gzip member of its own."""
    lines = b"".join(f"{name}: {value}".encode() + CRLF for name, value in headers)
    data = b"WARC/1.1" + CRLF + lines + CRLF + block + CRLF + CRLF
    return gzip.compress(data, mtime=0) if compress else data


def records_of(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """(headers, block) of each record of a file's bytes."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(CRLF + CRLF, at)
        if end < 0:
            return
        headers: Headers = []
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in (" ", "\t") and headers:
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
            elif ":" in line:
                name, _, value = line.partition(":")
                headers.append((name.strip(), value.strip()))
        size = int(value_of(headers, "Content-Length") or 0)
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def _batch(rows: list[tuple[str, str, Headers, bytes]]) -> list[pa.Array]:
    return [
        pa.array([r[0] for r in rows], pa.string()),
        pa.array([r[1] for r in rows], pa.string()),
        pa.array([[{"name": n, "value": v} for n, v in r[2]] for r in rows], _HEADER_ARROW),
        pa.array([r[3] for r in rows], pa.binary()),
    ]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, a row each.  A file is read whole by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in records_of(content.as_py()):
                    rows.append((value_of(headers, "WARC-Type") or "", value_of(headers, "WARC-Record-ID") or "", headers, block))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays(_batch(rows), names=RECORD.names)
                        rows = []
                yield pa.RecordBatch.from_arrays(_batch(rows), names=RECORD.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = NO_DATE) -> DataFrame:
    """Response records of a table of pages, with its id: what a crawler would have stored."""
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.concat(head.cast("binary"), body)
    seed = F.md5(F.concat_ws("\n", F.col(id_col).cast("string"), F.col(url_col), F.sha2(body, 256)).cast("binary"))
    parts = [F.substring(seed, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]

    def header(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    def sha1(data: Column) -> Column:
        # Base 32, ten hexadecimal digits at a time.
        parts = [F.lpad(F.conv(F.substring(F.sha1(data), at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
        return F.concat(F.lit("sha1:"), F.translate(F.concat(*parts), BASE32_DIGITS, BASE32_LETTERS))

    named = pages.select(
        F.col(id_col).alias("_id"),
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        F.col(url_col).alias("_url"),
        block.alias("block"),
        body.alias("_body"),
    )
    return named.select(
        F.col("_id").alias(id_col),
        F.lit("response").alias("warc_type"),
        "record_id",
        F.filter(
            F.array(
                header("WARC-Type", F.lit("response")),
                header("WARC-Record-ID", F.col("record_id")),
                header("WARC-Target-URI", F.col("_url")),
                header("WARC-Date", F.lit(date)),
                header("WARC-Block-Digest", sha1(F.col("block"))),
                header("WARC-Payload-Digest", sha1(F.col("_body"))),
                header("Content-Type", F.lit("application/http; msgtype=response")),
                header("Content-Length", F.octet_length("block").cast("string")),
            ),
            lambda h: h["value"].isNotNull(),
        ).alias("headers"),
        "block",
    )


def derivatives(records: DataFrame, id_col: str | None = None) -> DataFrame:
    """Derived records of the responses among ``records``; with ``id_col``, that column of the response beside them."""
    own = [T.StructField(id_col, records.schema[id_col].dataType)] if id_col else []
    schema = T.StructType([*own, *RECORD.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few source rows at a time: texts and links of a batch need not be held together.
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                rows, owners = [], []
                columns = [part.column(i).to_pylist() for i in range(part.num_columns - 3, part.num_columns)]
                for i, (record_id, headers, block) in enumerate(zip(*columns, strict=True)):
                    made = derive(record_id or "", [(h["name"], h["value"]) for h in headers or []], block or b"")
                    rows += made
                    owners += [i] * len(made)
                kept = [part.column(0).take(pa.array(owners, pa.int64()))] if id_col else []
                yield pa.RecordBatch.from_arrays([*kept, *_batch(rows)], names=schema.names)

    wanted = [*([id_col] if id_col else []), "record_id", "headers", "block"]
    return records.filter(F.col("warc_type") == "response").select(*wanted).mapInArrow(run, schema)


def digest(pages: DataFrame) -> DataFrame:
    """One row for each derived record, its main headers as columns."""
    made = derivatives(responses(pages), "page_id")

    def value(name: str) -> Column:
        return F.get(F.filter("headers", lambda h: h["name"] == name), F.lit(0))["value"]

    return made.select(
        "page_id",
        "warc_type",
        "record_id",
        value("WARC-Refers-To").alias("refers_to"),
        value("WARC-Target-URI").alias("target_uri"),
        value("WARC-Date").alias("warc_date"),
        value("Content-Type").alias("content_type"),
        value("Content-Length").cast("long").alias("content_length"),
        value("WARC-Block-Digest").alias("block_digest"),
        F.coalesce(value("WARC-Payload-Digest"), value("WARC-Source-Payload-Digest")).alias("source_payload_digest"),
        F.col("block").cast("string").alias("block"),
    )
