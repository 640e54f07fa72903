"""WARC derivatives: metadata and plain-text conversion records from response records.

A response becomes a ``metadata`` record (fields about it) and a ``conversion`` record (its plain text). Both
refer to the response by ``WARC-Refers-To`` and carry its target address and date; the metadata
record also names the conversion record, so the three are linked. Headers of the source (HTTP
content type, status) and its block and payload digests are preserved. Record identifiers are name-based: the same
response always gives the same identifiers. Digests are SHA-1 in Base32, as archives write them.

Plain text: comments, scripts, styles and titles go with what they hold, ends of blocks become line breaks, other
tags vanish, character references (named, decimal and hexadecimal) are resolved once, runs of blanks shrink, blank lines go. A tag
begins with a letter, "/", "!" or "?" behind "<", so "a < b" stays; quoted values of attributes may hold ">"; what is never closed
ends with the page. All mark-up is matched in one pass, which is linear in the page.

A null page is an empty payload, a null address an empty one; an empty page gives an empty conversion block with
length 0. Rows may repeat: equal rows give equal records. An empty table gives no records; very long pages are
taken whole. Pages hold no headers of their own, so ``responses`` writes those of a plain answer. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of the format.
VERSION = "WARC/1.1"
CRLF = "\r\n"
BLOCK_ENDS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section nav header footer blockquote pre".split())
_ATTRIBUTES = r"""(?:=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+(?:>|\Z)"""
MARKUP = re.compile(
    rf"<!--(?s:.*?)(?:-->|\Z)|<(?P<whole>script|style|title)(?![a-z0-9]){_ATTRIBUTES}(?s:.*?)(?:</(?P=whole)(?![a-z0-9])[^>]*(?:>|\Z)|\Z)|</?(?P<name>[a-z][a-z0-9]*){_ATTRIBUTES}|<[!?/][^>]*(?:>|\Z)",
    re.IGNORECASE,
)
_BLANKS, _SPACES, _BREAKS = re.compile(r"[ \t\r\n\f]+"), re.compile(r" +"), re.compile(r" ?\n[ \n]*")
_HEADERS = {"content_type": re.compile(r"(?i)content-type:[ ]*([^\r\n]*)"), "status": re.compile(r"\AHTTP/[0-9.]+ ([0-9]+)")}


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def urn(name: str) -> str:
    """Name-based identifier (version 5 layout)."""
    h = hashlib.sha1(name.encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-{'89ab'[int(h[16], 16) % 4]}{h[17:20]}-{h[20:32]}>"


def plain_text(markup: str) -> str:
    def tag(m: re.Match) -> str:
        name = m["name"]
        return " " if name is None else "\n" if name.lower() in BLOCK_ENDS else ""

    out = MARKUP.sub(tag, _BLANKS.sub(" ", markup))
    if "&" in out:  # a reference may be a blank or a line break
        out = html.unescape(out).replace("\xa0", " ").replace("\t", " ").replace("\f", " ").replace("\r", "\n")
    return _BREAKS.sub("\n", _SPACES.sub(" ", out)).strip(" \n")


@F.arrow_udf(StringType())
def _urns(names: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for n in names:
        yield pa.array(map(urn, n.to_pylist()), pa.string())


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Response records of fetched pages: ``key, record_id, target_uri, date, http, payload``."""
    address, body = F.coalesce(F.col(url), F.lit("")), F.coalesce(F.col(html), F.lit(""))
    out = pages.select(F.col(key).alias("key"), address.alias("target_uri"), body.alias("payload"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF + CRLF))
    return out.select(
        "key", _urns(F.concat_ws("|", F.lit("response"), F.coalesce(F.col("key").cast("string"), F.lit("")), "target_uri", F.sha1(F.col("payload").cast("binary")))).alias("record_id"),
        "target_uri", F.lit(date).alias("date"), http.alias("http"), "payload",
    )


def _records(source: dict) -> tuple[list[dict], dict]:
    """Metadata and conversion record of one response, and what both carry."""
    http, payload = source["http"], source["payload"].encode()
    found = {name: (m[1] if (m := pattern.search(http)) else "") for name, pattern in _HEADERS.items()}
    shared = {"source_payload_digest": digest(payload), "source_block_digest": digest(http.encode() + payload), "source_content_type": found["content_type"]}
    text = plain_text(source["payload"])
    metadata, conversion = (urn(f"{kind}|{source['record_id']}") for kind in ("metadata", "conversion"))
    fields = {
        "status": found["status"], "source-content-type": found["content_type"], "source-payload-digest": shared["source_payload_digest"],
        "source-block-digest": shared["source_block_digest"], "conversion": conversion, "text-length": len(text.encode()),
    }
    block = "".join(f"{name}: {value}{CRLF}" for name, value in fields.items())
    return [
        {"warc_type": "metadata", "record_id": metadata, "content_type": "application/warc-fields", "block": block, "block_digest": digest(block.encode())},
        {"warc_type": "conversion", "record_id": conversion, "content_type": "text/plain", "block": text, "block_digest": digest(text.encode())},
    ], shared


def derivatives(source: DataFrame) -> DataFrame:
    """Two rows for each response: ``key, warc_type, record_id, refers_to, target_uri, date, content_type, block, block_digest, source_payload_digest, source_block_digest, source_content_type``."""
    names = ["key", "warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "block", "block_digest", "source_payload_digest", "source_block_digest", "source_content_type"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.select(["record_id", "target_uri", "date", "http", "payload"]).to_pylist()
            rows = []
            for g in given:
                records, shared = _records(g)
                rows += [r | shared | {"refers_to": g["record_id"], "target_uri": g["target_uri"], "date": g["date"]} for r in records]
            key = batch.column("key").take(pa.array([i for i in range(len(given)) for _ in range(2)], pa.int64()))
            yield pa.RecordBatch.from_arrays([key, *(pa.array([r[n] for r in rows], pa.string()) for n in names[1:])], names)

    kind = source.schema["key"].dataType.simpleString()
    return source.select("key", "record_id", "target_uri", "date", "http", "payload").mapInArrow(run, f"key {kind}, " + ", ".join(f"{n} string" for n in names[1:]))


def record_text(out: DataFrame) -> DataFrame:
    """Whole records as text: header lines, an empty line, the block. Line breaks in an address are written as %0D and %0A."""
    lines = [
        F.lit(VERSION), F.concat(F.lit("WARC-Type: "), "warc_type"), F.concat(F.lit("WARC-Record-ID: "), "record_id"), F.concat(F.lit("WARC-Refers-To: "), "refers_to"),
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace("target_uri", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), F.concat(F.lit("WARC-Date: "), "date"), F.concat(F.lit("WARC-Block-Digest: "), "block_digest"),
        F.concat(F.lit("WARC-Source-Payload-Digest: "), "source_payload_digest"), F.concat(F.lit("WARC-Source-Block-Digest: "), "source_block_digest"),
        F.concat(F.lit("Content-Type: "), "content_type"), F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    ]
    return out.select(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), "block").alias("record"))


def write_warc(out: DataFrame, path: str, compression: str = "gzip") -> None:
    """Archive files at ``path``, one a task; a record ends with two line breaks."""
    record_text(out).write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``warc_type, record_id, refers_to, target_uri, date, content_type, block, block_digest`` and the source's headers, from files that ``write_warc`` made."""
    raw = spark.read.option("lineSep", VERSION + CRLF).text(path).where(F.length("value") > 0)
    split = raw.select(F.regexp_extract("value", r"(?s)^(.*?)\r\n\r\n", 1).alias("head"), F.regexp_extract("value", r"(?s)^.*?\r\n\r\n(.*)\r\n\r\n$", 1).alias("block"))
    field = lambda name: F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1)
    return split.select(
        field("WARC-Type").alias("warc_type"), field("WARC-Record-ID").alias("record_id"), field("WARC-Refers-To").alias("refers_to"), field("WARC-Target-URI").alias("target_uri"),
        field("WARC-Date").alias("date"), field("Content-Type").alias("content_type"), "block", field("WARC-Block-Digest").alias("block_digest"),
        field("WARC-Source-Payload-Digest").alias("source_payload_digest"), field("WARC-Source-Block-Digest").alias("source_block_digest"),
    )
