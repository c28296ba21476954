"""WARC records: responses, and the metadata and plain-text conversion records derived from them.

A response record holds the HTTP message as captured. derive() reads response records and builds two more for each:
a metadata record (JSON: the source record's headers, the HTTP status and headers, title, links) and a conversion
record (the page's plain text). Both name the response in WARC-Refers-To and keep its target URI and date; blocks and
payloads carry SHA-1 digests in base 32, and the source's own digests are kept in the metadata and checked against
its bytes. Ids are name-based UUIDs, so deriving again gives the same records. read() takes records from WARC files,
plain or of gzip members, and save() writes derived ones as such files.

A page is scanned once, from left to right, as HTML is: comments, declarations, scripts, styles, noscript and template
elements are left out, other tags end at the first ">" outside a quoted value, and whatever is not closed runs to the
end of the page. The title is that of the first title element that is closed; links are the href of a elements.

Defined cases: records that are no responses are passed over; a record that cannot be read, or whose status is not
three digits, gives a derived pair with empty text and the reason in the metadata's error. A null url is the empty URI;
null or empty html is an empty payload, with empty text. Pages that repeat give records that repeat. An empty table
gives no rows. Other columns are ignored. Pages are read whole, in time that grows with their length.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import os
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import mapped

DATE = "2024-01-01T00:00:00Z"
DIGESTS = (
    "page_id long, uri string, response_id string, metadata_id string, conversion_id string, metadata_refers_to string,"
    " conversion_refers_to string, payload_digest string, payload_ok boolean, metadata_digest string,"
    " conversion_digest string, status int, title string, n_links int, text_length long"
)

#: Elements that stand on lines of their own.
BREAKS = frozenset(
    "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr"
    " li main nav ol p pre section table td th tr ul title body head html".split()
)
#: Elements that are left out with all they hold, and their ends.
DROPPED = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in ("script", "style", "noscript", "template")}
#: What begins a tag, comment or declaration.
_OPEN = re.compile(r"<(?=[a-zA-Z!?/])")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
#: The rest of a tag without quotes.
_PLAIN = re.compile(r"[^>\"']*>")
_ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|(=?[^\s/>=]*)(\s*=\s*)?)")
_VALUE = re.compile(r"[^\s>]*")
#: Blanks that are not just one space, and line breaks that are more than one.
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]{2,}|[\t\r\f\v\xa0]")
_LINES = re.compile(r"\n{2,}")
_LENGTH = re.compile(rb"\r\nContent-Length:\s*([0-9]{1,15})\s*(?:\r\n|\Z)", re.I)
_STATUS = re.compile(r"HTTP/\S+ +([0-9]{3})(?: |$)")
#: Bytes of records that are handed on together, and of a written file, about.
BATCH_BYTES = 1 << 22
FILE_BYTES = 1 << 26


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(parts))}>"


def build(headers: dict[str, str], block: bytes) -> bytes:
    """A record with its length, block digest and the two line ends behind it."""
    headers = headers | {"WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
    head = "WARC/1.0\r\n" + "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in headers.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names as they are) and block of one record."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    found: list[tuple[str, list[str]]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and found:
            found[-1][1].append(line.strip())
        else:
            name, _, value = line.partition(":")
            found.append((name.strip(), [value.strip()]))
    headers = {name: " ".join(parts) for name, parts in found}
    length = int(field(headers, "Content-Length", "-1"))
    if not 0 <= length <= len(rest):
        raise ValueError("block is cut off")
    return headers, rest[:length]


def field(headers: dict[str, str], name: str, default: str | None = None) -> str | None:
    """A header's value, whatever the case of its name."""
    if name in headers:
        return headers[name]
    return next((v for k, v in headers.items() if k.lower() == name.lower()), default)


def split_http(block: bytes) -> tuple[int, dict[str, str], bytes]:
    """Status, headers and payload of an HTTP message."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    status = _STATUS.match(lines[0])
    if not status:
        raise ValueError("no HTTP response")
    return int(status[1]), {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, payload


def response(page_id: int | None, url: str | None, body: str | None, date: str = DATE) -> bytes:
    """A response record of a page."""
    payload = (body or "").encode("utf-8", "replace")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    headers = {
        "WARC-Type": "response",
        "WARC-Record-ID": record_id("response", str(page_id), url or "", digest(payload)),
        "WARC-Date": date,
        "WARC-Target-URI": url or "",
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": digest(payload),
    }
    return build(headers, head.encode() + payload)


def _attributes(page: str, at: int) -> tuple[int, str | None]:
    """From behind a tag's name: the position behind its end, -1 if it has none, and its href."""
    href = None
    while True:
        found = _ATTRIBUTE.match(page, at)
        at = found.end()
        if found[1]:
            return at, href
        if at >= len(page):
            return -1, None
        if found[3]:
            quote = page[at]
            if quote in "\"'":
                end = page.find(quote, at + 1)
                if end < 0:
                    return -1, None
                value, at = page[at + 1 : end], end + 1
            else:
                found_value = _VALUE.match(page, at)
                value, at = found_value[0], found_value.end()
            if href is None and found[2].lower() == "href":
                href = value


def scan(page: str) -> tuple[str, str, list[str]]:
    """Plain text, title and links of a page."""
    out: list[str] = []
    links: list[str] = []
    title, title_from, at, end = None, -1, 0, len(page)

    def text(lo: int, hi: int) -> None:
        if lo < hi:
            part = page[lo:hi]
            out.append(html.unescape(part) if "&" in part else part)

    while opened := _OPEN.search(page, at):
        text(at, opened.start())
        at = opened.end()
        if page.startswith("!--", at):
            stop = page.find("-->", at + 1)
            out.append(" ")
            at = stop + 3 if stop >= 0 else end
            continue
        name = _NAME.match(page, at)
        if not name:  # a declaration or the like
            stop = page.find(">", at)
            out.append(" ")
            at = stop + 1 if stop >= 0 else end
            continue
        closing, tag, at = page[at] == "/", name[1].lower(), name.end()
        plain = _PLAIN.match(page, at) if tag != "a" or closing else None
        at, href = (plain.end(), None) if plain else _attributes(page, at)
        if at < 0:
            at = end
            break
        if href is not None and tag == "a" and not closing:
            links.append(html.unescape(href))
        if tag in DROPPED and not closing:
            stop = DROPPED[tag].search(page, at)
            out.append(" ")
            at = stop.start() if stop else end
        elif tag in BREAKS:
            if tag == "title" and title is None:
                if closing and title_from >= 0:
                    title = " ".join("".join(out[title_from:]).split())
                elif not closing and title_from < 0:
                    title_from = len(out)
            out.append("\n")
    text(at, end)
    shown = _BLANKS.sub(" ", "".join(out)).replace(" \n", "\n").replace("\n ", "\n")
    return _LINES.sub("\n", shown).strip(), title or "", links


def plain_text(page: str) -> str:
    """Text of a page: without scripts, styles, comments and tags, a line for each block, entities resolved."""
    return scan(page)[0]


def links(page: str) -> list[str]:
    return scan(page)[2]


def title(page: str) -> str:
    return scan(page)[1]


def derive_record(record: bytes) -> tuple[bytes, bytes] | None:
    """Metadata and conversion record of a response record; None for other records."""
    error, status, http, payload = "", 0, {}, b""
    try:
        source, block = parse(record)
    except ValueError as e:
        source, block, error = {}, b"", str(e)
    if not error:
        if field(source, "WARC-Type") != "response":
            return None
        try:
            status, http, payload = split_http(block)
        except ValueError as e:
            error = str(e)
    shown, heading, targets = scan(payload.decode("utf-8", "replace"))
    origin = field(source, "WARC-Record-ID") or record_id("unreadable", digest(record))
    shared = {"WARC-Date": field(source, "WARC-Date", DATE), "WARC-Target-URI": field(source, "WARC-Target-URI", ""), "WARC-Refers-To": origin}
    own = digest(payload)
    payload_ok = field(source, "WARC-Payload-Digest", own) == own
    block_ok = field(source, "WARC-Block-Digest") in (None, digest(block))
    facts = {
        "source": source,
        "http": {"status": status, "headers": http},
        "payload": {"digest": own, "length": len(payload), "digest-ok": payload_ok, "block-digest-ok": block_ok},
        "html": {"title": heading, "links": targets},
    } | ({"error": error} if error else {})
    metadata = build(
        {"WARC-Type": "metadata", "WARC-Record-ID": record_id("metadata", origin), **shared, "Content-Type": "application/json"},
        json.dumps(facts, ensure_ascii=False).encode(),
    )
    conversion = build(
        {"WARC-Type": "conversion", "WARC-Record-ID": record_id("conversion", origin), **shared, "Content-Type": "text/plain; charset=utf-8"},
        shown.encode(),
    )
    return metadata, conversion


def _grouped(values, size):
    """Lists of values that have about BATCH_BYTES together."""
    held, total = [], 0
    for x in values:
        held.append(x)
        total += size(x)
        if total >= BATCH_BYTES:
            yield held
            held, total = [], 0
    if held:
        yield held


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, record): a response record of each page(page_id, url, html)."""

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c) for c in ("page_id", "url", "html")))
            made = ((i.as_py(), response(i.as_py(), u.as_py(), h.as_py())) for i, u, h in rows)
            for group in _grouped(made, lambda x: len(x[1])):
                ids, records = zip(*group)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(records, pa.binary())], ["page_id", "record"])

    return mapped(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), run, "page_id long, record binary")


def derive(records: DataFrame) -> DataFrame:
    """(page_id, response, metadata, conversion) records, from (page_id, record)."""

    def run(batches):
        for batch in batches:
            every = ((i.as_py(), r.as_py() or b"") for i, r in zip(batch.column("page_id"), batch.column("record")))
            made = ((i, record, *pair) for i, record in every if (pair := derive_record(record)))
            for group in _grouped(made, lambda x: sum(map(len, x[1:]))):
                a, *rest = zip(*group)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), *(pa.array(x, pa.binary()) for x in rest)], ["page_id", "response", "metadata", "conversion"])

    return mapped(records.select(F.col("page_id").cast("long").alias("page_id"), "record"), run, "page_id long, response binary, metadata binary, conversion binary")


def records_of(data: bytes):
    """The records of a WARC file, one after the other; of gzip members, if it begins as one. What follows a record that
    cannot be read is one record more, as it is."""
    if data[:2] == b"\x1f\x8b":
        while data[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            yield from records_of(member.decompress(data) + member.flush())
            data = member.unused_data
        return
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        length = _LENGTH.search(data, at, stop) if stop >= 0 else None
        end = stop + 4 + int(length[1]) if length else len(data)
        yield data[at:end]
        while data[end : end + 2] == b"\r\n":
            end += 2
        at = end


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record): the records of all WARC files at path, each file read by one task; page_id is null."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                for group in _grouped(records_of(content.as_py()), len):
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(group), pa.int64()), pa.array(group, pa.binary())], ["page_id", "record"])

    return mapped(spark.read.format("binaryFile").load(path).select("content"), run, "page_id long, record binary")


def write(derived: DataFrame, path: str) -> None:
    """Write derived records as files of gzip members, one a record, in <path>/kind=wat (metadata) and <path>/kind=wet
    (conversion): Parquet tables of (part, data), data being a whole file of about FILE_BYTES. A table, so that any store
    that Spark writes to will do and a task that runs twice leaves its files once; save() unpacks it."""

    def run(batches):
        import gzip

        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        held: dict[str, list[bytes]] = {"wat": [], "wet": []}
        size = {"wat": 0, "wet": 0}

        def flush(kind):
            nonlocal count
            count += 1
            data = b"".join(held[kind])
            held[kind], size[kind] = [], 0
            return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([f"{part:06d}-{count:04d}.warc.{kind}.gz"]), pa.array([data], pa.binary())], ["kind", "part", "data"])

        for batch in batches:
            for kind, column in (("wat", "metadata"), ("wet", "conversion")):
                for record in batch.column(column):
                    held[kind].append(gzip.compress(record.as_py(), 6, mtime=0))
                    size[kind] += len(held[kind][-1])
                    if size[kind] >= FILE_BYTES:
                        yield flush(kind)
        for kind in held:
            if held[kind]:
                yield flush(kind)

    mapped(derived, run, "kind string, part string, data binary").write.partitionBy("kind").parquet(path)


def save(spark: SparkSession, path: str, folder: str) -> int:
    """Unpack what write() wrote at path to plain files in folder, which driver and executors all mount; returns how
    many. A file appears whole or not at all, so a task may run twice."""
    os.makedirs(folder, exist_ok=True)

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("part").to_pylist(), batch.column("data")):
                part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
                with open(part, "wb") as file:
                    file.write(data.as_py())
                os.replace(part, os.path.join(folder, name))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return mapped(spark.read.parquet(path).select("part", "data"), run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def digests(derived: DataFrame) -> DataFrame:
    """What the derived records say, read back from their bytes; see DIGESTS."""

    def run(batches):
        for batch in batches:
            out = []
            for page_id, source, metadata, conversion in zip(*(batch.column(c).to_pylist() for c in ("page_id", "response", "metadata", "conversion"))):
                (m, facts), (c, text) = parse(metadata), parse(conversion)
                facts = json.loads(facts)
                out.append(
                    (page_id, m["WARC-Target-URI"], field(facts["source"], "WARC-Record-ID"), m["WARC-Record-ID"], c["WARC-Record-ID"], m["WARC-Refers-To"], c["WARC-Refers-To"])
                    + (facts["payload"]["digest"], facts["payload"]["digest-ok"], m["WARC-Block-Digest"], c["WARC-Block-Digest"], facts["http"]["status"])
                    + (facts["html"]["title"], len(facts["html"]["links"]), len(text.decode()))
                )
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)

    names = [x.split()[0] for x in DIGESTS.split(",")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    kinds = [types[x.split()[1]] for x in DIGESTS.split(",")]
    return mapped(derived, run, DIGESTS)
