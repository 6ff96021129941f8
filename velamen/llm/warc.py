"""Derivatives of archived responses: for each response record a metadata and a plain-text conversion record.

Both refer to the response by its record id, and name its target, its date and its digests as the response has them;
the metadata record also keeps the source's HTTP headers. Records are WARC/1.1 bytes and can be written one behind
another. Record ids derive from the response's id, so that a task that runs again gives the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, tuned

CRLF = b"\r\n"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs, fixed by RFC 9562
DATE = "1970-01-01T00:00:00Z"

#: What nothing closes reaches to the end of the page, so that each of these is read once.
_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*(?:>|\Z)", re.IGNORECASE | re.DOTALL)
_BREAK = re.compile(r"<(?:/?(?:p|div|section|article|header|footer|nav|main|aside|h[1-6]|ul|ol|li|dl|dt|dd|table|thead|tbody|tr|blockquote|pre|form|figure|figcaption|title|body|html|head|address)\b[^>]*|[bh]r\b[^>]*)>", re.IGNORECASE)
_CELL = re.compile(r"</t[dh]\s{0,99}>", re.IGNORECASE)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>")
_TITLE, _TITLE_END = re.compile(r"<title\b[^>]*>", re.IGNORECASE), re.compile(r"</title\b", re.IGNORECASE)
_HTML, _ANCHOR, _META = (re.compile(rf"<{x}\b[^>]*>", re.IGNORECASE) for x in ("html", "a", "meta"))
_LANG = re.compile(r"\blang\s{0,99}=\s{0,99}[\"']?([A-Za-z0-9-]+)", re.IGNORECASE)
_CHARSET = re.compile(r"\bcharset\s{0,99}=\s{0,99}[\"']?([A-Za-z0-9_.:-]+)", re.IGNORECASE)
_HREF = re.compile(r"\bhref\s{0,99}=\s{0,99}(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_SPACES = re.compile(r"[ \t\f\v\xa0]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join(parts))}>"


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def pack_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {_one_line(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + CRLF + CRLF + block + CRLF + CRLF


def _fields(lines: list[bytes]) -> list[tuple[str, str]]:
    """Named fields; a line that begins with a blank continues the one above."""
    out: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in " \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif ":" in text:
            k, _, v = text.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def parse_record(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of one record. The block has Content-Length bytes, or all that is left where that is missing."""
    head, _, rest = data.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = _fields(lines[1:])
    length = next((v for k, v in headers if k.lower() == "content-length"), "")
    return headers, rest[: int(length)] if length.isdigit() else rest.removesuffix(CRLF + CRLF)


def parse_http(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """Status, headers and payload as sent; a block without a status line is all payload."""
    head, mark, body = block.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if not lines[0].startswith(b"HTTP/"):
        return None, [], block
    status = re.match(rb"HTTP/\S+\s+(\d{3})", lines[0])
    return int(status[1]) if status else None, _fields(lines[1:]), body


def _dechunked(data: bytes) -> bytes:
    out, at = [], 0
    while (end := data.find(CRLF, at)) >= 0:
        try:
            size = int(data[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            break
        if not size:
            break
        out.append(data[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def decoded(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """The payload without transfer and content codings; one that can't be undone stays as it is."""
    of = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in of.get("transfer-encoding", ""):
        payload = _dechunked(payload)
    try:
        if "gzip" in of.get("content-encoding", ""):
            return gzip.decompress(payload)
        if "deflate" in of.get("content-encoding", ""):
            return zlib.decompress(payload)
    except (OSError, EOFError, zlib.error):
        pass
    return payload


def _sub(pattern: re.Pattern, new: str, page: str) -> str:
    """pattern replaced where a tag can still close: what stands behind the last `>` is no tag, and looking for its end
    from every `<` would take the square of its length."""
    at = page.rfind(">") + 1
    return pattern.sub(new, page[:at]) + page[at:]


def _tags(pattern: re.Pattern, page: str):
    """All tags of a kind, each read once."""
    return (m.group() for m in pattern.finditer(page, 0, page.rfind(">") + 1))


def _declared(body: bytes) -> str | None:
    """The charset that a page's first <meta> with one names, wherever it stands."""
    return next((m[1] for tag in _tags(_META, body.decode("latin-1")) if (m := _CHARSET.search(tag))), None)


def _title(page: str) -> str | None:
    begin = _TITLE.search(page, 0, page.rfind(">") + 1)
    end = begin and _TITLE_END.search(page, begin.end())
    return page[begin.end() : end.start()] if end else None


def plain_text(page: str) -> str:
    """What a reader sees: no scripts, styles, comments or tags; one line a block, entities resolved, blanks folded."""
    page = _sub(_TAG, "", _sub(_CELL, "\t", _sub(_BREAK, "\n", _DROP.sub(" ", page))))
    lines = (_SPACES.sub(" ", x).strip() for x in html.unescape(page).replace("\r", "\n").split("\n"))
    return "\n".join(x for x in lines if x)


def response_record(url: str | None, page: str | None, name: str, date: str = DATE) -> bytes:
    """A response record of a page's url and html, as an archive would hold it."""
    payload = (page or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    # rows alike in all three are the same capture
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", name, url or "", digest(payload))), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", url)] if url else []
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block))]
    return pack_record(headers, block)


def derivatives(record: bytes) -> list[dict]:
    """The metadata record and, of a text payload, the conversion record of a response record.

    A record that is no response, or no record at all, has none. The source's digests are taken over as they stand
    and formed where they are missing.
    """
    try:
        headers, block = parse_record(record)
    except ValueError:
        return []
    of = {k.lower(): v for k, v in reversed(headers)}
    if of.get("warc-type", "").lower() != "response":
        return []
    status, http, payload = parse_http(block)
    kind = next((v for k, v in http if k.lower() == "content-type"), "text/html" if status is None else "")
    source = of.get("warc-record-id") or record_id("response", digest(record))
    payload_digest, block_digest = of.get("warc-payload-digest") or digest(payload), of.get("warc-block-digest") or digest(block)
    body = decoded(http, payload)
    media = kind.split(";")[0].strip().lower()
    is_html, is_text = media in ("text/html", "application/xhtml+xml"), media.startswith("text/") or media == "application/xhtml+xml"
    charset = re.search(r"charset\s*=\s*[\"']?([^\s\"';]+)", kind, re.IGNORECASE)
    found = charset[1] if charset else (_declared(body) if is_html else None) or "utf-8"
    try:
        page = body.decode(found, "replace")
    except LookupError:
        found, page = "utf-8", body.decode("utf-8", "replace")
    fields = [("http-status", str(status or "")), ("content-type", kind), ("charset", found.lower()), ("source-payload-digest", payload_digest), ("source-block-digest", block_digest), ("source-length", str(len(payload)))]
    if is_html:
        fields += [("title", _SPACES.sub(" ", html.unescape(title)).strip())] if (title := _title(page)) is not None else []
        fields += [("lang", m[1]) for tag in islice(_tags(_HTML, page), 1) if (m := _LANG.search(tag))]
        fields += [("outlink", html.unescape(next((x for x in m.groups("") if x), ""))) for tag in _tags(_ANCHOR, page) if (m := _HREF.search(tag))]
    fields += [("source-header", f"{k}: {v}") for k, v in http]
    linked = [("WARC-Date", of.get("warc-date", DATE)), ("WARC-Refers-To", source)]
    if uri := of.get("warc-target-uri"):
        linked += [("WARC-Target-URI", uri), ("WARC-Refers-To-Target-URI", uri)]
    linked.append(("WARC-Refers-To-Date", of.get("warc-date", DATE)))
    outputs = [("metadata", "application/warc-fields", "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields).encode())]
    if is_text:
        outputs.append(("conversion", "text/plain; charset=utf-8", (plain_text(page) if is_html else page).encode("utf-8", "replace")))
    rows, of_type = [], {name: record_id(name, source) for name, _, _ in outputs}
    for name, media_type, data in outputs:
        other = [("WARC-Concurrent-To", i) for n, i in of_type.items() if n != name]
        block_id = digest(data)
        head = [("WARC-Type", name), ("WARC-Record-ID", of_type[name]), *linked, *other, ("Content-Type", media_type), ("WARC-Block-Digest", block_id), ("WARC-Source-Payload-Digest", payload_digest), ("WARC-Source-Block-Digest", block_digest)]
        rows.append({"record_type": name, "record_id": of_type[name], "refers_to": source, "concurrent_to": other[0][1] if other else None, "target_uri": uri, "warc_date": of.get("warc-date", DATE), "content_type": media_type, "content_length": len(data), "block_digest": block_id, "source_payload_digest": payload_digest, "source_block_digest": block_digest, "record": pack_record(head, data)})
    return rows


SCHEMA = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in ("record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "warc_date", "content_type")), ("content_length", pa.int64()), *((c, pa.string()) for c in ("block_digest", "source_payload_digest", "source_block_digest")), ("record", pa.binary())])
DDL = "page_id long, record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_payload_digest string, source_block_digest string, record binary"


def derived(responses: DataFrame) -> DataFrame:
    """The derivative records of each row of responses (page_id, record: bytes of one response record); see
    derivatives(). Null records give none; repeated rows give repeated records; other columns are ignored; an empty table
    has no records."""
    tuned(responses.sparkSession)

    def run(batches):
        for batch in batches:
            rows = [{"page_id": i, **x} for i, r in zip(batch.column("page_id").to_pylist(), batch.column("record"), strict=True) for x in derivatives(r.as_py() or b"")]
            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    return responses.select(F.col("page_id").cast("long").alias("page_id"), "record").mapInArrow(batched(run), DDL)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, record: a response record of each row of pages (page_id, url, html). Null html is an empty page; a null
    url leaves the target out; rows that differ in any of the three have ids of their own."""
    tuned(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("record", pa.binary())])

    def run(batches):
        for batch in batches:
            ids, urls, texts = (batch.column(c).to_pylist() for c in ("page_id", "url", "html"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([response_record(u, t, str(i), date) for i, u, t in zip(ids, urls, texts, strict=True)], pa.binary())], schema=schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(batched(run), "page_id long, record binary")
