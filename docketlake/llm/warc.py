"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

A response record becomes a ``metadata`` record (JSON of the envelope: WARC headers, HTTP status
and headers, title, links) and a ``conversion`` record (plain text). Both name the response in
WARC-Refers-To, keep its target URI and date, and carry digests of their own blocks; the metadata
keeps the source headers and both source digests.

Bodies are read as their headers say: chunks are joined, gzip and deflate undone, and the charset is that of the
Content-Type, else of a meta element, else UTF-8. Only responses are derived.

Defined cases: a null URL or body counts as empty and still yields both records; a broken record
raises in ``parse``, and gives a row with its error in ``derived_records``; a body that does not fit its encoding is read as it
is, an unknown charset as UTF-8; headers that occur several times are all kept, in order, and
a header may lack the blank after its colon or go on in the next line; malformed HTML is read as far
as it goes, in time that grows with its length; repeated pages give records with identifiers of
their own, made of their content and their number among equals, so that they do not depend on partitions; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

DATE = "1970-01-01T00:00:00Z"
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"<\s*/?\s*(?:p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|section|article|header|footer|nav|main|title|head|body|blockquote|pre|hr|dl|dt|dd|form)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>?")
_TITLE = re.compile(r"<title[^<>]*>(.*?)(?:</title|\Z)", re.S | re.I)
_LINK = re.compile(r"""<(a|img|link|script|iframe)\b[^<>]*?\b(?:href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    """A WARC/1.0 record; Content-Length is set here."""
    head = {"WARC-Type": kind, **headers, "Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


Headers = list[tuple[str, str]]


def fields(lines: list[str]) -> Headers:
    """Names and values of header lines; a line that begins with a blank goes on with the one before."""
    out: Headers = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def first(headers: Headers, name: str) -> str | None:
    """The first value of a header, in any case."""
    return next((v for n, v in headers if n.lower() == name.lower()), None)


def grouped(headers: Headers) -> dict[str, str | list[str]]:
    """By name; the values of a header that occurs several times as a list."""
    out: dict[str, list[str]] = {}
    for n, v in headers:
        out.setdefault(n, []).append(v)
    return {n: v if len(v) > 1 else v[0] for n, v in out.items()}


def parse(raw: bytes) -> tuple[Headers, bytes]:
    """Headers and block of one record."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = fields(lines[1:])
    size = first(headers, "Content-Length")
    if size is None or not size.isdigit():
        raise ValueError("a WARC record without a length")
    if len(rest) < int(size):
        raise ValueError("truncated WARC record")
    return headers, rest[: int(size)]


def _identifier(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def _clean(url: str) -> str:
    return re.sub(r"[\r\n]+", " ", url)


def response(url: str, body: str, date: str = DATE, number: str = "") -> bytes:
    """A response record around an HTML body; ``number`` tells repeated captures apart."""
    payload = body.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    paid = digest(payload)
    headers = {
        "WARC-Record-ID": _identifier("response", url, paid, number), "WARC-Date": date, "WARC-Target-URI": _clean(url),
        "WARC-Payload-Digest": paid, "WARC-Block-Digest": digest(http), "Content-Type": "application/http; msgtype=response",
    }
    return record("response", headers, http)


def plain_text(page: str) -> str:
    """Visible text: one line per block element, blanks collapsed, empty lines dropped."""
    page = _TAG.sub(" ", _BREAK.sub("\n", _HIDDEN.sub(" ", page)))
    lines = (" ".join(x.split()) for x in html.unescape(page).split("\n"))
    return "\n".join(x for x in lines if x)


_META = re.compile(rb"""<meta\b[^<>]*?\bcharset\s*=\s*["']?\s*([\w.:-]+)""", re.I)
_CHARSET = re.compile(r"""\bcharset\s*=\s*["']?\s*([\w.:-]+)""", re.I)


def unchunked(body: bytes) -> bytes:
    """The data of a chunked body, as far as it is well formed; a body without a first chunk size stays as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            return b"".join(out) if out else body
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def decoded(headers: Headers, body: bytes) -> str:
    """The page of an HTTP body."""
    if "chunked" in (first(headers, "Transfer-Encoding") or "").lower():
        body = unchunked(body)
    for coding in reversed([c.strip() for c in (first(headers, "Content-Encoding") or "").lower().split(",")]):
        windows = {"gzip": [31], "x-gzip": [31], "deflate": [15, -15]}.get(coding, [])
        for w in windows:
            try:
                body = zlib.decompressobj(w).decompress(body)
                break
            except zlib.error:
                continue
    named = _CHARSET.search(first(headers, "Content-Type") or "")
    meta = _META.search(body[:4096])
    charset = named[1] if named else meta[1].decode("ascii", "replace") if meta else "utf-8"
    try:
        return body.decode(charset, "replace")
    except (LookupError, ValueError, UnicodeError):
        return body.decode("utf-8", "replace")


def derive(raw: bytes) -> tuple[bytes, ...]:
    """The metadata and the conversion record of a response record; nothing of other records."""
    source, block = parse(raw)
    if (first(source, "WARC-Type") or "").lower() != "response":
        return ()
    head, _, payload = block.partition(b"\r\n\r\n")
    if not head.startswith(b"HTTP/"):  # a response of another protocol has no headers
        head, payload = b"", block
    status, *lines = head.decode("latin-1").split("\r\n")
    page = decoded(fields(lines), payload)
    bare = _HIDDEN.sub(" ", page)
    title = _TITLE.search(bare)
    links = [{"tag": m[1].lower(), "url": html.unescape(m[2] or m[3] or m[4] or "")} for m in _LINK.finditer(bare)]
    envelope = {
        "WARC-Header-Metadata": grouped(source),
        "HTTP-Response-Metadata": {
            "Status": status, "Headers": grouped(fields(lines)), "Entity-Length": len(payload),
            "HTML-Metadata": {"Title": " ".join(html.unescape(title[1]).split()) if title else "", "Links": links},
        },
    }
    own, out = first(source, "WARC-Record-ID") or "", []
    for kind, mime, body in (
        ("metadata", "application/json", json.dumps({"Envelope": envelope}, ensure_ascii=False).encode()),
        ("conversion", "text/plain; charset=utf-8", plain_text(page).encode()),
    ):
        headers = {
            "WARC-Record-ID": _identifier(kind, own), "WARC-Refers-To": own, "WARC-Date": first(source, "WARC-Date") or "",
            "WARC-Target-URI": first(source, "WARC-Target-URI") or "", "WARC-Block-Digest": digest(body), "Content-Type": mime,
        }
        out.append(record(kind, headers, body))
    return tuple(out)


SCHEMA = (
    "page_id long, warc_type string, record_id string, refers_to string, target_uri string, source_payload_digest string, "
    "block_digest string, content_length long, record binary"
)


def numbered(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, number): equal rows are numbered from 1, others have 0.

    Which rows are repeated is found by hashes; only those rows are shuffled (all others only where the list of repeated ones is too
    long for Spark to broadcast). They are numbered by the partition where they stand, with offsets, so a page with any number of
    copies is no single task's work.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    key = {"k1": F.xxhash64("page_id", "url", "html"), "k2": F.xxhash64(F.lit(41), "html", "url", "page_id", F.col("url").isNull(), F.col("html").isNull())}
    rows = rows.withColumns(key)
    often = written(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2"), "repeated")
    once = rows.join(often, ["k1", "k2"], "left_anti").withColumn("number", F.lit(0).cast("long"))
    many = written(rows.join(often, ["k1", "k2"], "left_semi").withColumn("part", F.spark_partition_id()), "copies")
    counts = many.groupBy("k1", "k2", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("k1", "k2").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("k1", "k2", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("k1", "k2", "part").orderBy("k1"))
    copies = many.withColumn("i", inside).join(starts, ["k1", "k2", "part"]).withColumn("number", F.col("start") + F.col("i"))
    return once.select("page_id", "url", "html", "number").unionByName(copies.select("page_id", "url", "html", "number"))


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
KINDS = [pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]


def _described(key: object, raw: bytes) -> list[tuple]:
    """Rows of SCHEMA of what is derived from a response."""
    source, _ = parse(raw)
    rows = []
    for made in derive(raw):
        h, _ = parse(made)
        mine = [first(h, f"WARC-{c}") for c in ("Type", "Record-ID", "Refers-To", "Target-URI")]
        rows.append((key, *mine, first(source, "WARC-Payload-Digest"), first(h, "WARC-Block-Digest"), int(first(h, "Content-Length")), made))
    return rows


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names)


def derivatives(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Two records of every page, each with its key fields and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, bodies, numbers = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "number"))
            for lo in range(0, len(ids), 500):
                part = zip(*(x[lo : lo + 500] for x in (ids, urls, bodies, numbers)))
                rows = [row for i, url, body, number in part for row in _described(i, response(url or "", body or "", date, f"{i} {number}"))]
                yield _batch(rows, NAMES, KINDS)

    return numbered(pages).mapInArrow(run, SCHEMA)


def derived_records(records: DataFrame, column: str = "record") -> DataFrame:
    """SCHEMA without page_id, and ``error``, of a table of raw WARC records (bytes): two rows of every response, one with its error of what cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(column).to_pylist()
            for lo in range(0, len(raws), 500):
                rows = []
                for raw in raws[lo : lo + 500]:
                    try:
                        rows += [(*row[1:], None) for row in _described(None, raw or b"")]
                    except ValueError as broken:
                        rows.append((*[None] * (len(NAMES) - 1), str(broken)))
                yield _batch(rows, [*NAMES[1:], "error"], [*KINDS[1:], pa.string()])

    return records.select(column).mapInArrow(run, SCHEMA.partition(", ")[2] + ", error string")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(table(spark, sf_dir, "pages"))
