"""WARC derivatives: metadata and plain-text conversion records from response records.

Each response gives a ``metadata`` record (title, links and the source's headers, as JSON) and, if
its payload is HTML or text, a ``conversion`` record with the visible text. Both name the response
in WARC-Refers-To, carry its target, date and payload digest on, and have block digests of their
own; the metadata record names the conversion in WARC-Concurrent-To. ``read_warc`` reads records
from (gzipped) WARC files, ``as_record`` writes one.

Transfer and content encodings (chunked, gzip, deflate) are undone before a payload is read, but
digests and lengths are those of the payload as it was sent. Links are those of tags and attributes
outside comments, scripts and the like, resolved against ``<base href>`` and the target.

Defined results: a null payload or header block is empty; a null target stays null; responses with
the same id give records with the same ids; records of other types give nothing; a payload whose
encoding is unknown or broken gives a metadata record only; an unknown charset is read as UTF-8, bytes
that do not fit become U+FFFD; a link that cannot be resolved stays as written; other columns are
ignored; an empty table gives an empty result. ``read_warc`` reads a truncated file as far as it goes.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from html.entities import html5
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Capture date of responses that are made from a table of pages.
CAPTURED = "2024-01-01T00:00:00Z"

RESPONSE = "source_key long, record_id string, warc_type string, target_uri string, warc_date string, http_headers string, payload binary, payload_digest string"
DERIVED = "source_key long, warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_payload_digest string, n_links long, block string"

#: What stands in a tag after its name. Quoted values may hold angle brackets; a tag that began ends at the
#: first ">" outside of them or with the page, as browsers have it. So what begins to match always does, and with
#: possessive repetitions no page takes quadratic time.
INSIDE = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+(?:>|\Z)"""
HIDDEN = re.compile(rf"(<(script|style|noscript|template)\b{INSIDE}).*?(?:</\2\s*>|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)
TITLE = re.compile(rf"<title\b{INSIDE}(.*?)(?:</title|\Z)", re.S | re.I)
LINKING = re.compile(rf"<(a|area|link|img|iframe|frame|script|source|form|base)(?=[\s/])({INSIDE})", re.I)
ATTRIBUTE = re.compile(r"""([^\s=/>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
BREAK = re.compile(rf"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|main|title|head|body|html|blockquote|pre|hr|dd|dt|dl|form|aside|figure|option)(?=[\s/>]){INSIDE}", re.I)
CELL = re.compile(rf"</?t[dh](?=[\s/>]){INSIDE}", re.I)
TAG = re.compile(rf"<[a-zA-Z/!?]{INSIDE}")
REFERENCE = re.compile(r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]*+;?)")
#: A payload that unpacks to more than this has no text here, only metadata.
MOST_BYTES = 64 << 20
BLANKS = re.compile(r"[^\S\n]+")
LINES = re.compile(r" ?\n[ \n]*")
CHARSET = re.compile(r"charset=[\"']?([A-Za-z0-9_-]+)", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def visible_text(page: str) -> str:
    """The text of a page: blocks on lines of their own, blanks collapsed, entities resolved."""
    page = HIDDEN.sub(" ", page)
    page = BREAK.sub("\n", page)
    page = TAG.sub("", CELL.sub(" ", page))
    if "&" in page:
        page = html.unescape(page)
    return LINES.sub("\n", BLANKS.sub(" ", page)).strip()


def _resolved(base: str | None, url: str) -> str:
    """``url`` as seen from ``base``; as written if either makes no sense."""
    if url.startswith(("http://", "https://")) or not base:
        return url
    try:
        return urljoin(base, url) if urlsplit(base).scheme else url
    except ValueError:
        return url


def attribute_value(text: str) -> str:
    """The value of an attribute with its references resolved: a name without its semicolon is one only
    if neither "=" nor a letter or digit follows, so that queries of addresses stay as they are."""
    def resolved(m: re.Match) -> str:
        name = m[0][1:]
        if name[0] == "#":
            return html.unescape(m[0])
        bare = not name.endswith(";") and text[m.end():m.end() + 1] == "="
        return m[0] if bare else html5.get(name, m[0])

    return REFERENCE.sub(resolved, text) if "&" in text else text


def links(page: str, base: str | None) -> list[dict[str, str]]:
    """Of every tag that can point somewhere its first href, src or action that is not blank."""
    out, based = [], False
    for m in LINKING.finditer(HIDDEN.sub(lambda m: m[1] or " ", page)):
        given = (attribute_value(a[2] or a[3] or a[4] or "").strip() for a in ATTRIBUTE.finditer(m[2]) if a[1].lower() in ("href", "src", "action"))
        tag, url = m[1].lower(), next(filter(None, given), "")
        if not url:
            continue
        url = _resolved(base, url)
        if tag == "base":
            base, based = base if based else url, True  # the first one counts
        else:
            out.append({"tag": tag, "url": url})
    return out


def header_fields(block: str | None) -> tuple[str, dict[str, str]]:
    """Status line and fields of an HTTP header block; the last of repeated fields counts."""
    lines = (block or "").replace("\r\n", "\n").split("\n")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return lines[0], fields


def decoded(payload: bytes, content_type: str) -> str:
    """The text of a payload: by the charset of its header, its byte order mark or its own ``meta``."""
    m = CHARSET.search(content_type)
    named = m[1] if m else "utf-8-sig" if payload.startswith(codecs.BOM_UTF8) else None
    if named is None and (m := CHARSET.search(payload[:1024].decode("latin-1"))):
        named = m[1]
    try:
        return payload.decode(named or "utf-8", "replace")
    except (LookupError, ValueError):  # unknown, or no charset of texts; UnicodeError is a ValueError
        return payload.decode("utf-8", "replace")


def unchunked(payload: bytes) -> bytes:
    """The body of a chunked message; what follows a chunk that makes no sense is left out."""
    out, at = [], 0
    while (end := payload.find(b"\r\n", at)) >= 0:
        try:
            size = int(payload[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if size <= 0:
            break
        out.append(payload[end + 2:end + 2 + size])
        at = end + 4 + size
    return b"".join(out)


def inflated(data: bytes, bits: int, most: int) -> bytes | None:
    """All members of a compressed stream; None if they have over ``most`` bytes. What follows the first
    member and is none is left out."""
    out, size = [], 0
    while data:
        opener = zlib.decompressobj(bits)
        try:
            while not opener.eof and data:
                out.append(opener.decompress(data, 1 << 20))
                data, size = opener.unconsumed_tail, size + len(out[-1])
                if size > most:
                    return None
                if not data and not out[-1]:
                    break
        except zlib.error:
            if not size:
                raise
            break
        data = opener.unused_data if bits == 31 else b""
    return b"".join(out)


def unpacked(payload: bytes, fields: dict[str, str], most: int = MOST_BYTES) -> bytes | None:
    """The payload without its transfer and content encodings; None if one is unknown or broken, or what
    comes out has over ``most`` bytes."""
    if "chunked" in fields.get("transfer-encoding", "").lower():
        payload = unchunked(payload) or payload
    for coding in reversed([x.strip() for x in fields.get("content-encoding", "").lower().split(",") if x.strip()]):
        if coding == "identity":
            continue
        if coding not in ("gzip", "x-gzip", "deflate"):
            return None
        for bits in (31,) if "gzip" in coding else (15, -15):
            try:
                payload = inflated(payload, bits, most)
                break
            except zlib.error:
                continue
        else:
            return None
        if payload is None:
            return None
    return payload


def responses(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", captured: str = CAPTURED) -> DataFrame:
    """Response records of a table of pages, with ids derived from key and address."""
    name = F.md5(F.concat_ws("\n", F.coalesce(F.col(key_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))).cast("binary"))
    urn = F.concat(F.lit("<urn:uuid:"), *_dashed(name), F.lit(">"))
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length(payload).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        F.col(key_col).cast("long").alias("source_key"), urn.alias("record_id"), F.lit("response").alias("warc_type"), F.col(url_col).alias("target_uri"),
        F.lit(captured).alias("warc_date"), head.alias("http_headers"), payload.alias("payload"), F.lit(None).cast("string").alias("payload_digest"))


def _dashed(digits: Column) -> list[Column]:
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    parts: list[Column] = []
    for i, (a, n) in enumerate(cuts):
        parts += [F.lit("-")] * bool(i) + [F.substring(digits, a, n)]
    return parts


def _derived(row: dict) -> list[dict]:
    status, fields = header_fields(row["http_headers"])
    payload = row["payload"] or b""
    kind = fields.get("content-type", "")
    source_digest = row["payload_digest"] or digest(payload)
    ids = {k: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{k} {row["record_id"]}')}>" for k in ("metadata", "conversion")}
    body = unpacked(payload, fields)
    markup = "html" in kind.lower() and body is not None
    text_kind = markup or (kind.lower().startswith("text/") and body is not None)
    page = decoded(body, kind) if text_kind else ""
    found = links(page, row["target_uri"]) if markup else []
    title = TITLE.search(page) if markup else None
    meta = {
        "refers_to": row["record_id"], "status": status, "http_headers": fields, "payload_length": len(payload), "payload_digest": source_digest,
        "title": BLANKS.sub(" ", html.unescape(title[1])).strip() if title else None, "links": found,
    }
    blocks = [("metadata", "application/json", json.dumps(meta, ensure_ascii=False, sort_keys=True))]
    if text_kind:
        blocks.append(("conversion", "text/plain; charset=utf-8", visible_text(page) if markup else page))
    out = []
    for kind_, content_type, block in blocks:
        raw = block.encode("utf-8", "replace")
        out.append({
            "source_key": row["source_key"], "warc_type": kind_, "record_id": ids[kind_], "refers_to": row["record_id"],
            "concurrent_to": ids["conversion"] if kind_ == "metadata" and text_kind else None, "target_uri": row["target_uri"], "warc_date": row["warc_date"],
            "content_type": content_type, "content_length": len(raw), "block_digest": digest(raw), "source_payload_digest": source_digest,
            "n_links": len(found), "block": raw.decode()})
    return out


_SHAPE = pa.schema([
    ("source_key", pa.int64()), *((c, pa.string()) for c in ("warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "warc_date", "content_type")),
    ("content_length", pa.int64()), ("block_digest", pa.string()), ("source_payload_digest", pa.string()), ("n_links", pa.int64()), ("block", pa.string())])


def derive(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of response records (columns as in ``RESPONSE``). One
    pass, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                rows = [x for row in batch.slice(first, 256).to_pylist() for x in _derived(row)]
                yield pa.RecordBatch.from_pylist(rows, _SHAPE)

    want = [x.split()[0] for x in RESPONSE.split(", ")]
    return records.where(F.col("warc_type") == "response").select(*want).mapInArrow(run, DERIVED)


def as_record(row: dict, compress: bool = True) -> bytes:
    """One derived record as it stands in a WARC file (a gzip member of its own)."""
    block = (row["block"] or "").encode()
    fields = {
        "WARC-Type": row["warc_type"], "WARC-Record-ID": row["record_id"], "WARC-Refers-To": row["refers_to"], "WARC-Concurrent-To": row["concurrent_to"],
        "WARC-Target-URI": row["target_uri"], "WARC-Date": row["warc_date"], "WARC-Block-Digest": row["block_digest"],
        "WARC-Source-Payload-Digest": row["source_payload_digest"], "Content-Type": row["content_type"], "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    raw = head.encode() + block + b"\r\n\r\n"
    if not compress:
        return raw
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def serialised(derived: DataFrame) -> DataFrame:
    """(source_key, record): the bytes of each record, for any binary sink."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                rows = batch.slice(first, 256).to_pylist()
                yield pa.record_batch({"source_key": pa.array([r["source_key"] for r in rows], pa.int64()), "record": pa.array([as_record(r) for r in rows], pa.binary())})

    return derived.mapInArrow(run, "source_key long, record binary")


def _plain(data: bytes) -> Iterator[bytes]:
    """The bytes of a WARC file in parts, gzip members undone one after another. What is broken ends it."""
    step = 1 << 20
    if data[:2] != b"\x1f\x8b":
        yield from (data[at:at + step] for at in range(0, len(data), step))
        return
    opener, at, rest = zlib.decompressobj(31), 0, b""
    while rest or at < len(data):
        if not rest:
            rest, at = data[at:at + step], at + step
        try:
            yield opener.decompress(rest, step)
        except zlib.error:
            return
        rest = opener.unconsumed_tail
        if opener.eof:
            rest, opener = opener.unused_data, zlib.decompressobj(31)
    yield opener.flush()


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of the records in the bytes of a WARC file, gzipped or plain. No more than a
    record is held unpacked at a time."""
    parts, held = _plain(data), bytearray()

    def more() -> bool:
        part = next(parts, None)
        held.extend(part or b"")
        return part is not None
    while True:
        at = 0
        while (begin := held.find(b"WARC/", at)) < 0 or (end := held.find(b"\r\n\r\n", max(begin, at))) < 0:
            at = max(0, len(held) - 8) if begin < 0 else begin
            if not more():
                return
        fields = header_fields(bytes(held[begin:end]).decode("utf-8", "replace"))[1]
        size = int(n) if (n := fields.get("content-length", "0")).isdecimal() else 0
        del held[:end + 4]
        while len(held) < size:
            if not more():
                break
        yield fields, bytes(held[:size])
        del held[:size]


#: Bytes of payload in a batch of responses.
BATCH_BYTES = 16 << 20


def _response(fields: dict[str, str], block: bytes) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n")
    return {
        "source_key": None, "record_id": fields.get("warc-record-id"), "warc_type": "response", "target_uri": fields.get("warc-target-uri"),
        "warc_date": fields.get("warc-date"), "http_headers": head.decode("utf-8", "replace") + "\r\n\r\n", "payload": payload, "payload_digest": fields.get("warc-payload-digest")}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response records (columns as in ``RESPONSE``) of WARC files of under 2 GB; a file is read by
    one task."""
    shape = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RESPONSE.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in parse(content.as_py()):
                    if fields.get("warc-type") == "response":
                        rows.append(_response(fields, block))
                        size += len(block)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, shape)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, shape)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RESPONSE)
