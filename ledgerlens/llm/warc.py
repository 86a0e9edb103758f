"""WARC derivatives: responses become linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlens.llm.common import raw, with_columns
from ledgerlens.llm.markup import plain_text

VERSION = b"WARC/1.1"
#: Headers of the source that both derivatives carry over unchanged.
CARRIED = ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address", "WARC-Identified-Payload-Type")
#: Date of the records made from a table of pages, which has none.
PAGE_DATE = "2024-01-01T00:00:00Z"
CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: bytes) -> str:
    """A name-based identifier: reruns and retried tasks give the same one."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(b'|'.join(parts)).digest()[:16], version=5)}>"


def _text(data: bytes) -> str:
    """Header bytes as text that ``_wire`` turns into the same bytes, whatever their encoding."""
    return data.decode("utf-8", "surrogateescape")


def _wire(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


def _clean(text: str | None) -> str | None:
    """For a string column: bytes that are no UTF-8 become replacement characters."""
    return None if text is None else _wire(text).decode("utf-8", "replace")


def build(headers: dict[str, str], block: bytes) -> bytes:
    lines = [VERSION, *[_wire(f"{k}: {v}") for k, v in headers.items() if v is not None], f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


class Headers(dict):
    """The last value of each name in lower case, codings joined; ``pairs`` has all names and values in order, as spelled."""

    def __init__(self, pairs: list[tuple[str, str]]):
        super().__init__()
        self.pairs = pairs
        for name, value in pairs:
            name = name.lower()
            self[name] = f"{self[name]}, {value}" if name in self and name.endswith("-encoding") else value


#: Headers end at the first empty line, be it ended by CRLF or by a bare LF.
EMPTY_LINE = re.compile(rb"\r?\n\r?\n")


def split_headers(data: bytes) -> tuple[bytes, Headers, bytes]:
    """First line, headers (folded lines joined) and the rest. Lines end with CRLF or a bare LF."""
    end = EMPTY_LINE.search(data)
    head, rest = (data[: end.start()], data[end.end() :]) if end else (data, b"")
    lines = re.split(rb"\r?\n", re.sub(rb"\r?\n[ \t]+", b" ", head))
    pairs = []
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            pairs.append((_text(name.strip()), _text(value.strip())))
    return lines[0], Headers(pairs), rest


def parse(record: bytes) -> tuple[Headers, bytes]:
    """Headers and block of one record; ValueError if it is malformed or shorter than it says."""
    first, headers, rest = split_headers(record)
    if not first.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    size = headers.get("content-length", "")
    if not size.isdigit() or int(size) > len(rest):
        raise ValueError("bad Content-Length")
    return headers, rest[: int(size)]


def response(url: str | None, page: bytes, key: str) -> bytes:
    """A response record of a stored page."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(page) + page
    uri = re.sub(r"\s+", "%20", url or "")
    return build({
        "WARC-Type": "response", "WARC-Record-ID": record_id(b"response", key.encode(), uri.encode(), page), "WARC-Target-URI": uri, "WARC-Date": PAGE_DATE,
        "WARC-Block-Digest": digest(block), "WARC-Payload-Digest": digest(page), "Content-Type": "application/http; msgtype=response",
    }, block)


def _unchunked(data: bytes) -> bytes:
    """The parts of a chunked body joined; as it stands if it is not chunked after all, as some crawlers store it."""
    parts, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = data[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return b"".join(parts) if parts and at >= len(data) else data
        n = int(size, 16)
        if n == 0:
            return b"".join(parts)
        parts.append(data[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def _inflated(data: bytes, window: int) -> tuple[bytes, bool]:
    """All members of a stream joined, and whether the last one is whole; what follows that is no member is left out."""
    parts = []
    while True:
        stream = zlib.decompressobj(window)
        try:
            parts.append(stream.decompress(data))
        except zlib.error:
            if not parts:
                raise
            return b"".join(parts), False
        data = stream.unused_data
        if not stream.eof or window != 31 or not data.startswith(b"\x1f\x8b"):
            return b"".join(parts), stream.eof


def entity(http: dict[str, str], payload: bytes) -> bytes:
    """The payload without transfer and content coding; a coding that is unknown or does not fit leaves it as it is."""
    return _opened(http, payload)[0]


def _opened(http: dict[str, str], payload: bytes) -> tuple[bytes, bool]:
    """The entity, and whether its compressed streams are whole."""
    whole = True
    if "chunked" in http.get("transfer-encoding", "").lower():
        payload = _unchunked(payload)
    for coding in reversed(http.get("content-encoding", "").lower().replace(" ", "").split(",")):
        for window in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
            try:
                payload, ended = _inflated(payload, window)
                whole = whole and ended
                break
            except zlib.error:
                continue
    return payload, whole


#: Byte order marks, which tell more than any header.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def _decoded(http: dict[str, str], payload: bytes) -> str:
    for mark, name in MARKS:
        if payload.startswith(mark):
            return payload[len(mark) :].decode(name, "replace")
    found = CHARSET.search(_wire(http.get("content-type", ""))) or CHARSET.search(payload[:1024])
    try:
        return payload.decode(found[1].decode("latin-1") if found else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derive(record: bytes | None) -> list[dict]:
    """The metadata and the conversion record of one response; nothing for other records.

    A malformed record gives one 'error' row with the reason and no bytes. Responses whose payload is no text have a
    metadata record only. That record has all headers of the source, repeated ones too, byte for byte, and a list of
    their names as spelled. Digests and lengths are those of the stored bytes; chunked, gzip and deflate bodies are opened
    for the text, and the metadata record says if such a stream ends early. Byte order marks are no text.
    """
    try:
        headers, block = parse(record or b"")
    except ValueError as problem:
        return [{"warc_type": "error", "error": str(problem)}]
    if headers.get("warc-type", "").lower() != "response":
        return []
    status, http, payload = split_headers(block)
    source = headers.get("warc-record-id", "")
    block_digest, payload_digest = headers.get("warc-block-digest") or digest(block), headers.get("warc-payload-digest") or digest(payload)
    shared = {k: headers.get(k.lower()) for k in CARRIED}
    fields = [
        ("source-record-id", source), ("source-block-digest", block_digest), ("source-payload-digest", payload_digest), ("source-content-length", str(len(block))),
        ("http-status-line", _text(status)), *[(f"http-header-{k.lower()}", v) for k, v in http.pairs], *[(f"source-header-{k.lower()}", v) for k, v in headers.pairs],
        ("http-header-names", ", ".join(k for k, _ in http.pairs)), ("source-header-names", ", ".join(k for k, _ in headers.pairs)), ("payload-length", str(len(payload))),
        ("payload-digest-valid", str(digest(payload) == payload_digest or not payload_digest.startswith("sha1:")).lower()),
    ]
    body, ended = _opened(http, payload)
    if not ended:
        fields.append(("payload-coding-truncated", "true"))
    out = [("metadata", "application/warc-fields", _wire("".join(f"{k}: {v}\r\n" for k, v in fields)))]
    kind = http.get("content-type", "text/html").lower()
    if kind.startswith("text/") or "html" in kind or "xml" in kind:
        text = _decoded(http, body)
        lines = plain_text(text) if "html" in kind or "xml" in kind else [x for x in (" ".join(y.split()) for y in text.splitlines()) if x]
        out.append(("conversion", "text/plain; charset=utf-8", "".join(f"{x}\n" for x in lines).encode()))
    rows = []
    for warc_type, content_type, body in out:
        name = record_id(warc_type.encode(), _wire(source), body)
        made = digest(body)
        whole = build({
            "WARC-Type": warc_type, "WARC-Record-ID": name, "WARC-Refers-To": source, **shared, "WARC-Block-Digest": made,
            "X-Source-Block-Digest": block_digest, "X-Source-Payload-Digest": payload_digest, "Content-Type": content_type,
        }, body)
        rows.append({
            "warc_type": warc_type, "record_id": name, "refers_to": _clean(source), "target_uri": _clean(shared["WARC-Target-URI"]), "source_block_digest": _clean(block_digest),
            "source_payload_digest": _clean(payload_digest), "block_digest": made, "content_length": len(body), "record": whole, "error": None,
        })
    return rows


FIELDS = {
    "warc_type": T.StringType(), "record_id": T.StringType(), "refers_to": T.StringType(), "target_uri": T.StringType(), "source_block_digest": T.StringType(),
    "source_payload_digest": T.StringType(), "block_digest": T.StringType(), "content_length": T.LongType(), "record": T.BinaryType(), "error": T.StringType(),
}
_ARROW = {"LongType": pa.int64(), "BinaryType": pa.binary(), "StringType": pa.string()}


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Replace url and html of each page by ``record``, a response record; null html is an empty payload, null url ''.

    Other columns stay, but for one that is named ``record`` itself.
    """
    pages = pages.select(*[c for c in pages.columns if c.lower() != "record"])
    kept = [f for f in pages.schema.fields if f.name not in (url_col, html_col)]

    def scan(batches):
        for batch in batches:
            made = [response(u, h or b"", str(k)) for k, u, h in zip(batch.column(id_col).to_pylist(), batch.column(url_col).to_pylist(), raw(batch.column(html_col)))]
            yield with_columns(batch, (url_col, html_col), record=pa.array(made, pa.binary()))

    return pages.mapInArrow(scan, T.StructType([*kept, T.StructField("record", T.BinaryType())]))


def derivatives(records: DataFrame, record_col: str = "record") -> DataFrame:
    """One row of FIELDS for each record derived from a row of ``records``; its other columns are repeated, but for those
    that bear a name of FIELDS.

    Needs no shuffle: the link from a derivative to its source is the source's own identifier. Repeated rows give
    repeated derivatives with equal identifiers.
    """
    records = records.select(record_col, *[c for c in records.columns if c != record_col and c.lower() not in FIELDS])
    kept = [f for f in records.schema.fields if f.name != record_col]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in FIELDS.items()])

    def scan(batches):
        for batch in batches:
            found = [derive(x) for x in raw(batch.column(record_col))]
            at = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
            rows = [r for rows in found for r in rows]
            columns = [batch.column(f.name).take(at) for f in kept] + [pa.array([r.get(n) for r in rows], _ARROW[type(t).__name__]) for n, t in FIELDS.items()]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return records.mapInArrow(scan, schema)
