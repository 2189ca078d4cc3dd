"""WARC derivatives: responses become linked metadata and plain-text conversion records."""

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
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

VERSION, CRLF = b"WARC/1.1", b"\r\n"
#: Pages carry no crawl time; a builder over them gives them this one.
CRAWLED = "2024-01-01T00:00:00Z"

_HIDDEN = re.compile(r"(?i)<(script|style|noscript|template)\b|<!--")
_ENDS = {n: re.compile(rf"(?i)</{n}\s*>") for n in ("script", "style", "noscript", "template")} | {"": re.compile("-->")}
_BREAK = re.compile(r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|blockquote|pre|title)\b[^>]*>")
_TAG = re.compile(r"<[^>]*>")
_LINK = re.compile(r"""(?is)<(a|img|link|script|iframe)\b[^<>]*?\b(href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_TITLE, _TITLE_END = re.compile(r"(?i)<title\b[^<>]*>"), re.compile("(?i)</title>")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324  the format's digest


def record_id(*parts: str) -> str:
    """The same parts, the same id: a rerun gives equal records."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value) if "\n" in value or "\r" in value else value


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"".join(f"{k}: {_one_line(v)}".encode() + CRLF for k, v in [*headers, ("Content-Length", str(len(block)))])
    return VERSION + CRLF + head + CRLF + block + CRLF + CRLF


def parse(record: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """(headers in order, block) of a record; its length is checked."""
    head, found, rest = record.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if not found or not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = [(k.decode(), v.strip().decode()) for k, _, v in (x.partition(b":") for x in lines[1:])]
    n = int(next(v for k, v in headers if k.lower() == "content-length"))
    if len(rest) < n:
        raise ValueError("a record is cut short")
    return headers, rest[:n]


def response(url: str, page: str, date: str = CRAWLED, key: str = "") -> bytes:
    """An HTTP response record of a page."""
    body = page.encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + CRLF + CRLF + body
    payload = digest(body)
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url, date, payload)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", payload), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
    return build(headers, block)


def visible(page: str) -> str:
    """Without comments and what scripts and styles hold; their opening tags stay, for their links."""
    out, at, open_ = [], 0, set()
    for m in _HIDDEN.finditer(page):
        name = (m[1] or "").lower()
        if m.start() < at or name in open_:
            continue
        end = _ENDS[name].search(page, m.end())
        if end is None:  # nor is there one for a later beginning
            open_.add(name)
            continue
        out += [page[at : m.start()], page[m.start() : page.index(">", m.start()) + 1] if name else " "]
        at = end.end()
    return "".join([*out, page[at:]])


def title_of(page: str) -> str:
    """What stands in the first title that ends."""
    begin = _TITLE.search(page)
    end = _TITLE_END.search(page, begin.end()) if begin else None
    return html.unescape(_without_tags(page[begin.end() : end.start()], "")).strip() if end else ""


def _without_tags(text: str, by: str = " ") -> str:
    last = text.rfind(">") + 1  # what begins before the last end has one: so each character is looked at once
    return _TAG.sub(by, text[:last]) + text[last:]


def plain_text(page: str, seen: str | None = None) -> str:
    """What a reader sees: scripts, styles and comments go, blocks become lines, character references are resolved."""
    seen = visible(page) if seen is None else seen
    last = seen.rfind(">") + 1
    text = _without_tags(_BREAK.sub("\n", seen[:last]) + seen[last:])
    text = html.unescape(text) if "&" in text else text
    return "\n".join([x for x in [" ".join(x.split()) for x in text.split("\n")] if x])


def outlinks(page: str, seen: str | None = None) -> list[str]:
    return [f"{m[1].lower()}@/{m[2].lower()} {html.unescape(m[3] or m[4] or m[5] or '').strip()}" for m in _LINK.finditer(visible(page) if seen is None else seen)]


def derive(record: bytes) -> dict:
    """The metadata and the conversion record of a response, and what they say."""
    headers, block = parse(record)
    named = {k.lower(): v for k, v in headers}
    head, _, body = block.partition(CRLF + CRLF)
    payload_digest = digest(body)
    if named.get("warc-payload-digest", payload_digest) != payload_digest:
        raise ValueError(f"payload digest of {named.get('warc-record-id')}")
    page = body.decode("utf-8", "replace")
    source, url, date = named["warc-record-id"], named.get("warc-target-uri", ""), named.get("warc-date", CRAWLED)
    seen = visible(page)
    text, links = plain_text(page, seen), outlinks(page, seen)
    kept = [("WARC-Refers-To", source), ("WARC-Target-URI", url), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date), ("WARC-Date", date)]
    conversion_id, metadata_id = record_id("conversion", source), record_id("metadata", source)
    body_text = text.encode()
    text_digest = digest(body_text)
    conversion = build([("WARC-Type", "conversion"), ("WARC-Record-ID", conversion_id), *kept, ("WARC-Source-Payload-Digest", payload_digest), ("WARC-Block-Digest", text_digest), ("Content-Type", "text/plain; charset=utf-8")], body_text)
    http = [x.decode("latin-1") for x in head.split(CRLF)]
    fields = [("conversion", conversion_id), ("title", title_of(page)), ("http-status", http[0]), *[("http-header", x) for x in http[1:]], ("text-bytes", str(len(body_text))), *[("outlink", x) for x in links]]
    about = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields).encode()
    metadata = build([("WARC-Type", "metadata"), ("WARC-Record-ID", metadata_id), *kept, ("WARC-Concurrent-To", conversion_id), ("WARC-Source-Payload-Digest", payload_digest), ("WARC-Block-Digest", digest(about)), ("Content-Type", "application/warc-fields")], about)
    return {"response_id": source, "metadata_id": metadata_id, "conversion_id": conversion_id, "url": url, "payload_digest": payload_digest, "text_digest": text_digest, "n_links": len(links), "text": text, "metadata": metadata, "conversion": conversion}


def _response_batches(batches):
    for batch in batches:
        ids, urls, pages = (batch.column(c).to_pylist() for c in ("page_id", "url", "html"))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([response(u or "", p or "", key="" if i is None else str(i)) for i, u, p in zip(ids, urls, pages, strict=True)], pa.binary())], names=["page_id", "record"])


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, record): a response record for each row of ``pages`` (page_id, url, html); null urls and pages are empty."""
    shared.ship(pages.sparkSession)
    return shared.columns_only(pages, "page_id", "url", "html").select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(_response_batches, "page_id long, record binary")


_DERIVED = pa.schema([("page_id", pa.int64()), *[(k, pa.string()) for k in ("response_id", "metadata_id", "conversion_id", "url", "payload_digest", "text_digest")], ("n_links", pa.int64()), ("text", pa.string()), ("metadata", pa.binary()), ("conversion", pa.binary()), ("error", pa.string())])


def _derived(record: bytes | None) -> dict:
    try:
        return derive(record or b"") | {"error": None}
    except (ValueError, KeyError, StopIteration) as e:  # a broken record is a row that says so
        return dict.fromkeys(_DERIVED.names) | {"error": str(e) or type(e).__name__}


def _derive_batches(batches):
    for batch in batches:
        made = [_derived(r) for r in batch.column("record").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), *[pa.array([m[f.name] for m in made], f.type) for f in list(_DERIVED)[1:]]], schema=_DERIVED)


def derivatives(records: DataFrame) -> DataFrame:
    """One row per row of ``records`` (page_id, record): ids, digests, text, and the metadata and conversion records.

    Both records refer to the response (WARC-Refers-To, with its URI and date) and keep its payload digest; metadata
    names its conversion. A record that cannot be parsed, or whose digest is wrong, has an ``error`` and nothing else. No shuffle.
    """
    shared.ship(records.sparkSession)
    return shared.columns_only(records, "page_id", "record").mapInArrow(_derive_batches, "page_id long, response_id string, metadata_id string, conversion_id string, url string, payload_digest string, text_digest string, n_links long, text string, metadata binary, conversion binary, error string")


def _write_batches(folder: str):
    def run(batches):
        store, path = shared.open_store(folder)
        context, out, n = TaskContext.get(), None, 0
        name = f"part-{context.partitionId():06d}.warc.gz"
        for batch in batches:
            out = out or store.open_output_stream(f"{path}/.{context.taskAttemptId()}-{name}", compression=None)
            for record in batch.column(0).to_pylist():
                out.write(gzip.compress(record, 6, mtime=0))  # a member for each record, so that any can be read alone
                n += 1
        if out is not None:
            out.close()
            shared.publish(store, f"{path}/.{context.taskAttemptId()}-{name}", f"{path}/{name}")
        yield pa.RecordBatch.from_pydict({"records": pa.array([n], pa.int64())})

    return run


def write_warc(records: DataFrame, folder: str, column: str = "record") -> int:
    """Writes a column of records into .warc.gz files of a shared folder; how many."""
    spark = records.sparkSession
    shared.ship(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).mkdirs(path)
    return records.select(column).mapInArrow(_write_batches(shared.normal_uri(folder)), "records long").agg(F.sum("records")).first()[0] or 0


def read_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a .warc.gz file that comes in chunks: at most one of them, and a chunk, is held."""
    held, gz = b"", zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            held += gz.decompress(chunk)
            chunk = gz.unused_data
            if gz.eof:
                gz = zlib.decompressobj(31)  # the next member
            while (end := held.find(CRLF + CRLF)) >= 0:
                n = re.search(rb"(?im)^content-length:\s*(\d+)", held[:end])
                if n is None:
                    raise ValueError("a record without a length")
                size = end + 4 + int(n[1]) + 4
                if len(held) < size:
                    break
                yield held[:size]
                held = held[size:]
    if held:
        raise ValueError("a record is cut short")


def _read_batches(batches):
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            store, path = shared.open_store(shared.normal_uri(uri))
            with store.open_input_stream(path, compression=None) as f:
                for record in read_records(iter(lambda: f.read(1 << 20), b"")):  # noqa: B023  read within the turn
                    yield pa.RecordBatch.from_pydict({"record": pa.array([record], pa.binary())})


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(record) of every .warc.gz file below a folder; files are listed by Spark, and read in streams of 1 MB."""
    shared.ship(spark)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", True).load(folder).select("path")
    return listed.mapInArrow(_read_batches, "record binary")
