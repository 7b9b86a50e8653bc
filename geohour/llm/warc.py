"""Derived archive records: metadata and plain-text conversions of stored responses."""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType

from geohour.llm.common import struct_type
from geohour.llm.markup import tags

WARC_DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space for addresses
# Tags that end a line of text; others lie inside one.
_BREAKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol br tr td th table article section header footer nav aside title form "
                    "blockquote pre hr figure dl dt dd body head html main".split())
_HIDDEN = ("script", "style", "noscript", "template")
RECORD = ("record_type string, record_id string, refers_to string, target_uri string, "
          "content_type string, content_length long, block_digest string, payload_digest string, "
          "record binary")
NAMES = [x.split()[0] for x in RECORD.split(", ")]


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(kind: str, url: str, payload: bytes) -> str:
    """The same record always gets the same identifier, so tasks can run again."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind} {url} {hashlib.sha1(payload).hexdigest()}')}>"


def plain_text(page: str) -> str:
    """Text outside markup, scripts and styles: one line per block, one space between words."""
    parts, at = [], 0
    for tag in tags(page, _HIDDEN):
        parts.append(page[at:tag.start])
        if tag.name in _BREAKS or not tag.name:
            parts.append("\n")
        at = tag.end
    parts.append(page[at:])
    text = entities.unescape("".join(parts))
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def _record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _line(value: str) -> str:
    """A header value may not end its line."""
    return re.sub(r"[\r\n]+", " ", value)


def response(url: str, body: str) -> dict:
    payload = body.encode()
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
             + str(len(payload)).encode() + b"\r\n\r\n" + payload)
    return _made("response", record_id("response", url, payload), None, url,
                 "application/http; msgtype=response", block, digest(payload))


def _made(kind: str, rid: str, refers: str | None, url: str, content: str, block: bytes,
          payload: str | None) -> dict:
    own = digest(block)
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Refers-To", refers),
        ("WARC-Target-URI", url or None), ("WARC-Date", WARC_DATE), ("Content-Type", content),
        ("WARC-Block-Digest", own), ("WARC-Payload-Digest", payload), ("Content-Length", str(len(block))),
    ]
    return dict(zip(NAMES, (kind, rid, refers, url, content, len(block), own, payload, _record(headers, block))))


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def derive(source: bytes) -> list[dict]:
    """The metadata and conversion records of one response record.

    Both refer to the response's identifier and keep its target address. The metadata block
    holds the source's own headers (HTTP and archive) and its digests as name: value lines;
    the conversion's block is the plain text of the payload.
    """
    headers, block = parse(source)
    rid, url = headers["WARC-Record-ID"], headers.get("WARC-Target-URI", "")
    http, _, payload = block.partition(b"\r\n\r\n")
    lines = http.decode(errors="replace").split("\r\n")
    fields = [("source-record-id", rid), ("source-date", headers["WARC-Date"]),
              ("source-block-digest", headers["WARC-Block-Digest"]),
              ("source-payload-digest", headers["WARC-Payload-Digest"]), ("http-status", lines[0])]
    fields += [("http-" + k.lower(), v) for k, _, v in (x.partition(": ") for x in lines[1:])]
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    text = plain_text(payload.decode(errors="replace")).encode()
    return [
        _made("metadata", record_id("metadata", url, meta), rid, url, "application/warc-fields", meta, None),
        _made("conversion", record_id("conversion", url, payload), rid, url, "text/plain; charset=utf-8",
              text, headers["WARC-Payload-Digest"]),
    ]


@arrow_udf(ArrayType(struct_type(RECORD)))
def _records(url: pa.Array, body: pa.Array) -> pa.Array:
    kinds = pa.list_(pa.struct([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string()))
                                for n, t in (x.split() for x in RECORD.split(", "))]))
    out = []
    for u, b in zip(url.to_pylist(), body.to_pylist()):
        made = response(_line(u or ""), b or "")
        out.append([made, *derive(made["record"])])
    return pa.array(out, kinds)


def build_records(pages: DataFrame, keep: tuple[str, ...] = ("page_id",), url: str = "url",
                  body: str = "html") -> DataFrame:
    """Three records per row of `pages`: the response, and its metadata and conversion records.

    Columns: `keep`, then RECORD. `record` holds the whole record, ready to be appended to an
    archive file. Digests are SHA-1 in base 32, identifiers depend on kind, address and
    payload only, so repeated rows give equal records. Null html is an empty payload; a null or
    empty address gives a record without target address and an empty target_uri; line ends in
    an address become spaces. An empty table gives no records.
    """
    rows = pages.select(*keep, F.explode(_records(F.col(url), F.col(body))).alias("__r"))
    return rows.select(*keep, *[F.col(f"__r.{n}").alias(n) for n in NAMES])
