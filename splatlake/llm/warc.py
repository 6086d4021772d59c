"""WARC derivatives: linked metadata (WAT-like) and plain-text conversion (WET-like) records of responses.

A response becomes a metadata record and a conversion record. Both keep the response's URI and date and
refer to it by WARC-Refers-To and WARC-Concurrent-To ids; record ids are made from the response's id, so
a task that runs again writes the same ones. The metadata record holds the source headers (WARC and
HTTP), links of the page and the source digests; the conversion record holds the main text. Each has its
own block digest.

Records are rows: headers (map of strings) and content (bytes). ``read_warc`` cuts whole .warc or .warc.gz
files into rows in the tasks that read them; what can't be read is a row of type ``unreadable`` with a reason,
and reading goes on at the next record that begins a gzip member or a line. ``build`` works on rows of any
source, without a shuffle.

Defined results: records of other types than response are left out; responses without an id, with null
content or without an HTTP header block give a metadata record with what there is and an empty
conversion record; pages without text give an empty one, too; repeated rows give repeated records; extra
columns are ignored. Headers that begin with X- are carried over.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splatlake.llm.htmltext import TreeModel, default_model, main_texts

SCHEMA = "headers map<string,string>, content binary"
_HEADERS = pa.map_(pa.string(), pa.string())
# Each expression reads on from where it stopped and never goes back, so a page takes time in proportion to its length.
_TAG = re.compile(r"<(a|img|script|link|iframe|form)(?=[\s/>])((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)", re.I)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_TITLE, _TITLE_END = re.compile(r"<title(?=[\s>])[^<>]*+>", re.I), re.compile("</title", re.I)
_SOURCES = {"href", "src", "action"}
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the namespace of URLs


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{kind} {source}')}>"


_BEGIN = re.compile(rb"(?:^|(?<=\n))WARC/[0-9.]+\r?\n")
_MEMBER = b"\x1f\x8b\x08"


def _members(data: bytes) -> Iterator[bytes]:
    """What gzip members hold; of a broken one what comes before the fault, then the next that can be begun."""
    at = 0
    while at < len(data):
        inflate = zlib.decompressobj(31)
        out, end = [], 0
        try:
            for k in range(at, len(data), 1 << 16):
                part = data[k : k + (1 << 16)]
                out.append(inflate.decompress(part))
                if inflate.eof:
                    end = k + len(part) - len(inflate.unused_data)
                    break
        except zlib.error:
            pass
        yield b"".join(out)
        found = data.find(_MEMBER, end if inflate.eof else at + 1)
        at = found if found >= 0 else len(data)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a WARC file, gzip members or plain; odd parts become records of type unreadable."""
    parts: Iterable[bytes] = _members(data) if data[:2] == b"\x1f\x8b" else [data]
    for part in parts:
        at, n = 0, len(part)
        while at < n:
            begin = _BEGIN.search(part, at)
            start = begin.start() if begin else n
            if odd := part[at:start].lstrip(b"\r\n"):
                yield _unreadable("no record begins here", odd)
            if not begin:
                break
            edge = re.compile(rb"\r?\n\r?\n").search(part, begin.end() - 1)
            if not edge:
                yield _unreadable("headers don't end", part[start:])
                break
            headers: dict[str, str] = {}
            for raw in part[begin.end() : edge.start()].split(b"\n"):
                name, _, value = raw.decode("utf-8", "replace").partition(":")
                if name.strip():
                    headers[name.strip()] = value.strip()
            size = headers.get("Content-Length", "")
            at = edge.end()
            if size.isascii() and size.isdigit() and at + int(size) <= n:
                yield headers, part[at : at + int(size)]
                at += int(size)
            else:
                after = _BEGIN.search(part, at)
                yield _unreadable("cut off" if size.isdigit() else "no length", part[start : after.start() if after else n])
                at = after.start() if after else n


def _unreadable(reason: str, data: bytes) -> tuple[dict[str, str], bytes]:
    return {"WARC-Type": "unreadable", "X-Reason": reason, "Content-Length": str(len(data))}, data


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all records of WARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                part, size = [], 0
                for record in parse_records(value.as_py()):
                    part.append(record)
                    size += len(record[1])
                    if size > 1 << 23:
                        yield _table(part)
                        part, size = [], 0
                yield _table(part)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def _table(records: list[tuple[dict, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([list(h.items()) for h, _ in records], _HEADERS), pa.array([c for _, c in records], pa.binary())], ["headers", "content"])


def _http(content: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of a response."""
    head, found, body = content.partition(b"\r\n\r\n")
    if not found:
        head, found, body = content.partition(b"\n\n")
    if not found or not head.startswith(b"HTTP/"):
        return "", [], b""
    status, *lines = head.decode("iso-8859-1").splitlines()
    return status, [(n.strip(), v.strip()) for n, _, v in (x.partition(":") for x in lines)], body


def _page(headers: list[tuple[str, str]], body: bytes) -> str:
    kind = next((v for n, v in headers if n.lower() == "content-type"), "")
    if kind and "html" not in kind.lower() and "text/plain" not in kind.lower():
        return ""
    charset = re.search(r"charset=[\"']?([\w.:-]+)", kind, re.I) or re.search(rb"<meta[^>]+charset=[\"']?([\w.:-]+)", body[:4096], re.I)
    name = charset[1].decode() if charset and isinstance(charset[1], bytes) else charset[1] if charset else "utf-8"
    try:
        return body.decode(name, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def derive_all(responses: list[tuple[dict[str, str], bytes]], model: TreeModel) -> list[tuple[dict[str, str], bytes]]:
    """Metadata and conversion records of responses; their pages go through the model together."""
    parsed = [_http(content) for _, content in responses]
    pages = [_page(http, body) for _, http, body in parsed]
    texts = main_texts(pages, model)
    return [r for (source, content), http, page, text in zip(responses, parsed, pages, texts, strict=True) for r in derive(source, content, http, page, text)]


def page_title(page: str) -> str:
    """Text of the first title element that is closed."""
    begin = _TITLE.search(page)
    end = begin and _TITLE_END.search(page, begin.end())
    return " ".join(html.unescape(page[begin.end() : end.start()]).split()) if end else ""


def page_links(page: str) -> list[dict[str, str]]:
    """The first address of each tag that has one."""
    out = []
    for tag in _TAG.finditer(page):
        for m in _ATTRIBUTE.finditer(tag[2]):
            if m[1].lower() in _SOURCES and any(v is not None for v in m.groups()[1:]):
                out.append({"path": f"{tag[1].lower()}@/{m[1].lower()}", "url": html.unescape(m[2] or m[3] or m[4] or "")})
                break
    return out


def derive(source: dict[str, str], content: bytes, parsed: tuple[str, list, bytes], page: str, text: str) -> list[tuple[dict[str, str], bytes]]:
    """Metadata and conversion records of a response, given its parts and main text."""
    status, http, body = parsed
    target, own = source.get("WARC-Target-URI", ""), source.get("WARC-Record-ID", "")
    key = own or f"{target} {source.get('WARC-Date', '')} {digest(content)}"
    ids = {kind: record_id(key, kind) for kind in ("metadata", "conversion")}
    meta = {
        "Envelope": {"WARC-Header-Metadata": source, "Block-Digest": source.get("WARC-Block-Digest") or digest(content), "Payload-Digest": source.get("WARC-Payload-Digest") or digest(body)},
        "HTTP-Response-Metadata": {"Status": status, "Headers": http, "Entity-Length": len(body), "Entity-Digest": digest(body)},
        "HTML-Metadata": {"Title": page_title(page), "Links": page_links(page)},
    }
    out = []
    for kind, mime, block in (("metadata", "application/json", json.dumps(meta, ensure_ascii=False).encode()), ("conversion", "text/plain", text.encode("utf-8", "replace"))):
        other = ids["conversion" if kind == "metadata" else "metadata"]
        headers = {"WARC-Type": kind, "WARC-Record-ID": ids[kind], "WARC-Refers-To": own, "WARC-Concurrent-To": other, "WARC-Target-URI": target, "WARC-Date": source.get("WARC-Date", ""), "WARC-Refers-To-Digest": meta["Envelope"]["Payload-Digest"], "WARC-Block-Digest": digest(block), "Content-Type": mime, "Content-Length": str(len(block))}
        headers |= {k: v for k, v in source.items() if k.startswith("X-")}
        out.append(({k: v for k, v in headers.items() if v or k == "Content-Length"}, block))
    return out


def build(records: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """Metadata and conversion records of all responses."""
    shared = records.sparkSession.sparkContext.broadcast(model or default_model())  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, size = [], 0
            for headers, content in zip(batch.column(0), batch.column(1), strict=True):
                part.append((dict(headers.as_py() or []), content.as_py() or b""))
                size += len(part[-1][1])
                if size > 1 << 20:
                    yield _table(derive_all(part, shared.value))
                    part, size = [], 0
            yield _table(derive_all(part, shared.value))

    return records.where(F.col("headers")["WARC-Type"] == "response").select("headers", "content").mapInArrow(run, SCHEMA)


def serialize(headers: dict[str, str], content: bytes) -> bytes:
    """A record as it stands in a file."""
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + content + b"\r\n\r\n"


def pages_as_responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A table of pages (page_id, url, html) as response records; those without a page_id have no X-Page-ID."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, url, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = (source or "").encode()
                content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + body
                headers = {"WARC-Type": "response", "WARC-Record-ID": record_id(f"{page} {url}", "response"), "WARC-Target-URI": url or "", "WARC-Date": date, "WARC-Block-Digest": digest(content), "WARC-Payload-Digest": digest(body), "Content-Length": str(len(content))}
                out.append((headers if page is None else headers | {"X-Page-ID": str(page)}, content))
            yield _table(out)

    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(run, SCHEMA)
