"""WARC derivatives: linked metadata and plain-text conversion records of responses.

``read_records`` parses WARC files (plain or gzipped a record at a time) into rows; ``responses``
makes response records of fetched pages. ``derive`` gives two records for each response: metadata
(application/warc-fields: title, language, charset, source headers, out-links) and conversion
(text/plain). Both carry WARC-Refers-To with the response's identifier, its target and date, the
payload digest of their source, and SHA-1 digests of their own block. Record identifiers are
name-based, so a task that runs again gives the same ones. ``serialize`` spells rows as gzip members,
which concatenate to a valid file.

Cases: a null url or page counts as empty; an empty page gives records with an empty text; repeated
rows give repeated records with the same identifiers (nothing is ranked, so there are no ties); an empty
table gives no rows; other columns are not read, and clashing names do no harm; pages of any length are
converted whole, in one pass in time proportional to their length, and markup that is never closed runs
to the end. Bodies are decoded by their headers; an unknown charset is read as UTF-8, an encoding other
than gzip and deflate stays as it is. A plain file whose block holds the bytes between two records may
lose that block if the file is split just there.
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.llm.common import table

FETCHED = "2024-01-01T00:00:00Z"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:veridoc:warc")
#: Elements whose content isn't shown, and those that stand on lines of their own.
_HIDDEN = {"script", "style", "template", "noscript"}
_BLOCK = set(
    "address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul".split()
)
#: A tag up to its end, or to the end of the page: quotes count where a value begins. Nothing is given back, so a page is read once.
_TAG = re.compile(r"<(/?)([!?a-zA-Z][^\s/>]*+)(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+(?:>|\Z)")
_VALUE = r"\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))"
_HREF, _LANG, _CHARSET = (re.compile(rf"[\s;\"']{name}{_VALUE}", re.I) for name in ("href", "lang", "charset"))
_CONTENT_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_CLOSERS = {name: re.compile(rf"</{name}\s*+>", re.I) for name in (*_HIDDEN, "title")}


def digest(data: bytes) -> str:
    """A labelled SHA-1 digest, base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """A name-based record identifier."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(31).join(map(str, parts)))}>"


class Page:
    """What one pass over a page's markup finds: shown text, title, language, charset, links."""

    def __init__(self, page: str):
        self.title: str | None = None
        self.language: str | None = None
        self.charset: str | None = None
        self.links: list[str] = []
        shown: list[str] = []
        at, end = 0, len(page)
        while at < end:
            start = page.find("<", at)
            if start < 0:
                break
            shown.append(page[at:start])
            if page.startswith("<!--", start):
                close = page.find("-->", start + 4)
                at = end if close < 0 else close + 3
                shown.append(" ")
                continue
            tag = _TAG.match(page, start)
            if not tag:
                shown.append("<")
                at = start + 1
                continue
            at, name = tag.end(), tag[2].lower()
            if name in _BLOCK:
                shown.append("\n")
            if tag[1]:
                continue
            if name in _CLOSERS:
                close = _CLOSERS[name].search(page, at)
                if name == "title":
                    if self.title is None:
                        self.title = html.unescape(page[at : close.start() if close else end])
                else:
                    shown.append(" ")
                at = close.end() if close else end
            elif name == "a":
                if link := _HREF.search(tag[0]):
                    self.links.append(next(x for x in link.groups() if x is not None))
            elif name == "html" and self.language is None:
                if own := _LANG.search(tag[0]):
                    self.language = next(x for x in own.groups() if x is not None)
            elif name == "meta" and self.charset is None:
                if own := _CONTENT_CHARSET.search(tag[0]):
                    self.charset = own[1]
        shown.append(page[at:])
        self.shown = "".join(shown)

    def text(self) -> str:
        """Blocks on lines of their own, entities decoded, blanks collapsed."""
        return "\n".join(line for x in html.unescape(self.shown).split("\n") if (line := " ".join(x.split())))

    def describe(self, headers: str, source_digest: str) -> str:
        """The application/warc-fields block."""
        flat = lambda x: " ".join(x.split())
        fields = [(k, flat(v)) for k, v in (("title", self.title), ("language", self.language), ("charset", self.charset)) if v is not None]
        fields.append(("source-payload-digest", source_digest))
        fields += [("source-header", flat(h)) for h in headers.split("\r\n") if h.strip()]
        fields += [("outlink", flat(html.unescape(x))) for x in self.links]
        return "".join(f"{k}: {v}\r\n" for k, v in fields)


def to_text(page: str) -> str:
    """The visible text of a page."""
    return Page(page).text()


def _dechunked(body: bytes) -> bytes:
    """A chunked body in one piece; as it is, where it isn't chunked after all."""
    out, at = [], 0
    while (line := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:line].partition(b";")[0], 16)
        except ValueError:
            return body
        if not size:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + size])
        at = line + 4 + size
    return b"".join(out) if out else body


def decoded(headers: str, body: bytes) -> str:
    """A body as text, by its headers: chunks, gzip and deflate undone, the charset of the content type or else of the page, UTF-8 without one."""
    fields = {}
    for line in headers.split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = _dechunked(body)
    for coding in reversed(fields.get("content-encoding", "").lower().replace(" ", "").split(",")):
        for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
            try:
                body = zlib.decompressobj(bits).decompress(body)
                break
            except zlib.error:
                continue  # stored as it was sent on, or raw deflate
    named = _CONTENT_CHARSET.search(fields.get("content-type", "")) or _CONTENT_CHARSET.search(body[:1024].decode("latin-1"))
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace")


RECORD = "record_id string, type string, date string, target_uri string, content_type string, refers_to string, source_headers string, payload_digest string, block_digest string, length long, block binary"
_FIELDS = [(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in RECORD.split(", ")]


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", fetched: str = FETCHED) -> DataFrame:
    """A response record for each fetched page (columns source_id and those of RECORD)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, url, page in zip(*(c.to_pylist() for c in batch.columns)):
                body = (page or "").encode("utf-8", "surrogatepass")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n"
                block = head.encode() + b"\r\n" + body
                rows.append((key, record_id("response", key, url or "", digest(body)), "response", fetched, url or "", "application/http; msgtype=response", None, head, digest(body), digest(block), len(block), block))
            yield _batch(rows)

    source = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return source.mapInArrow(run, f"source_id long, {RECORD}")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [("source_id", pa.int64()), *_FIELDS]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def split_http(block: bytes) -> tuple[str, bytes]:
    """The header lines and the body of an HTTP response."""
    head, gap, body = block.partition(b"\r\n\r\n")
    return (head.decode("utf-8", "replace") + "\r\n", body) if gap else ("", block)


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, size = [], 0
        for key, source, date, url, block in zip(*(c.to_pylist() for c in batch.columns)):
            headers, body = split_http(block or b"")
            page, payload = Page(decoded(headers, body)), digest(body)
            for kind, content, text in (("metadata", "application/warc-fields", page.describe(headers, payload)), ("conversion", "text/plain; charset=utf-8", page.text())):
                out = text.encode("utf-8", "replace")
                rows.append((key, record_id(kind, source), kind, date, url, content, source, headers, payload, digest(out), len(out), out))
            size += len(body)
            if size > 8_000_000:
                yield _batch(rows)
                rows, size = [], 0
        yield _batch(rows)


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the response records; other types give none."""
    source = records.where("type = 'response'").select("source_id", "record_id", "date", "target_uri", "block")
    return source.mapInArrow(_derived, f"source_id long, {RECORD}")


def spell(row: dict) -> bytes:
    """One record as WARC/1.1 bytes."""
    head = [("WARC-Type", row["type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"]), ("WARC-Target-URI", row["target_uri"])]
    if row["refers_to"]:
        head += [("WARC-Refers-To", row["refers_to"]), ("WARC-Refers-To-Target-URI", row["target_uri"]), ("WARC-Refers-To-Date", row["date"])]
    head += [("WARC-Block-Digest", row["block_digest"])]
    if row["type"] == "response":
        head += [("WARC-Payload-Digest", row["payload_digest"])]
    head += [("Content-Type", row["content_type"]), ("Content-Length", len(row["block"]))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v not in (None, "")) + "\r\n").encode() + row["block"] + b"\r\n\r\n"


def serialize(records: DataFrame) -> DataFrame:
    """record_id and member: each record as a gzip member of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = [gzip.compress(spell(row), mtime=0) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), pa.array(members, pa.binary())], names=["record_id", "member"])

    return records.mapInArrow(run, "record_id string, member binary")


#: Where one record ends and the next begins.
_BETWEEN = "\r\n\r\nWARC/"


def parse(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a file's pieces (file, bytes) between ``_BETWEEN``: header fields (names in lower case) and block.

    A block that holds those bytes itself is put together again by its length.
    """
    name, held, head, size = "", b"", None, 0
    for file, piece in pieces:
        if head is not None and file == name:
            held += _BETWEEN.encode() + piece
        else:
            if head is not None:
                yield head, held[:size]  # cut short
            name = file
            start, _, held = piece.partition(b"\r\n\r\n")
            lines = start.decode("utf-8", "replace").split("\r\n")
            if not re.match(r"(?:WARC/)?\d+\.\d+\s*$", lines[0]):
                head = None
                continue
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(head.get("content-length") or 0) if (head.get("content-length") or "0").isdigit() else 0
        if len(held) >= size:
            yield head, held[:size]
            head = None
    if head is not None:
        yield head, held[:size]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files at path, in the columns that ``derive`` takes; source_id is null.

    Spark's text reader cuts the files (gzipped ones by their name) between records, so a task holds a
    record at a time however long a file is, and plain files are read by many tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((file, piece) for batch in batches for file, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        rows, held = [], 0
        for h, block in parse(pieces):
            headers, body = split_http(block) if h.get("warc-type") == "response" else ("", block)
            rows.append((None, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-date"), h.get("warc-target-uri", ""), h.get("content-type"), h.get("warc-refers-to"), headers, digest(body), h.get("warc-block-digest"), len(block), block))
            held += len(block)
            if held > 8_000_000:
                yield _batch(rows)
                rows, held = [], 0
        yield _batch(rows)

    lines = spark.read.option("lineSep", _BETWEEN).text(path)
    return lines.select(F.input_file_name(), F.col("value").cast("binary")).mapInArrow(run, f"source_id long, {RECORD}")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derive(responses(table(spark, sf_dir, "pages")))
    return made.select(F.col("source_id").alias("page_id"), "type", "record_id", "refers_to", "target_uri", "date", "content_type", "source_headers", "payload_digest", "block_digest", "length", F.col("block").cast("string").alias("content"))
