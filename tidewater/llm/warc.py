"""WARC derivatives: responses become linked metadata and plain-text conversion records.

Each response gives a metadata record (``application/warc-fields``: status, source headers, source
digest, title, outlinks) and a conversion record (``text/plain``: all text that the page shows, menus and footers too), both with
``WARC-Refers-To`` the response's id and its target, date and payload digest. Ids are version-5
style names of the response's id and the kind, so reruns agree.

Defined cases: a null or empty payload gives a conversion of no bytes and a metadata record without
links; a block without a full HTTP header has no headers and is all payload; a null target or id
stays null (the derived id is then made of what is there); repeated rows each get their records;
extra columns are ignored; whole payloads are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as html_lib
import io
import re
import uuid
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches
from .html_consensus import walk

DATE = "2024-01-01T00:00:00Z"


@dataclass
class Record:
    """A WARC record: header fields in order, and the block."""

    fields: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def bytes(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in (self.fields | {"Content-Length": str(len(self.block))}).items())
        return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + self.block + b"\r\n\r\n"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


#: What stands between records, with the part of the version line that all versions share.
SEPARATOR = b"\r\n\r\nWARC/1."


def records(pieces: Iterable[bytes]) -> Iterator[Record]:
    """Records of a WARC file from its pieces between separators; a block that holds a separator is put together again.

    A piece that is no record is passed over; a block that the file cuts short is what there is of it.
    """
    held: list[bytes] = []
    size, wanted = 0, 0
    for piece in pieces:
        if held and size < wanted:
            held.append(SEPARATOR + piece)
            size += len(SEPARATOR) + len(piece)
            continue
        if held:
            yield _record(b"".join(held))
        held, size, wanted = [], len(piece), 0
        head = re.match(rb"(?:WARC/1\.)?\d+\r?\n(.*?)(?:\r?\n\r?\n|\Z)", piece, re.S)
        if head:
            held = [piece]
            length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head[1])
            wanted = head.end() + int(length[1]) if length else 0
    if held:
        yield _record(b"".join(held))


def parse(data: bytes) -> Iterator[Record]:
    """Records of a small WARC file, gzipped or not."""
    return records((gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).split(SEPARATOR))


def _record(data: bytes) -> Record:
    f = io.BytesIO(data)
    f.readline()
    fields: dict[str, str] = {}
    last = None
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and last:
            fields[last] += " " + text.strip()
        elif ":" in text:
            last, _, value = text.partition(":")
            fields[last] = value.strip()
    length = next((int(v) for k, v in fields.items() if k.lower() == "content-length" and v.isdigit()), 0)
    return Record({k: v for k, v in fields.items() if k.lower() != "content-length"}, f.read(length))


def split_http(block: bytes) -> tuple[str | None, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP message."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        return None, [], block
    status, *lines = head.decode("latin-1").split("\r\n")
    pairs = [(k.strip(), v.strip()) for k, m, v in (x.partition(":") for x in lines) if m]
    return status, pairs, payload


def derive(record_id: str | None, target: str | None, date: str | None, block: bytes | None) -> tuple[Record, Record]:
    """The metadata and the conversion record of a response."""
    status, headers, payload = split_http(block or b"")
    charset = next((m[1] for k, v in headers if k.lower() == "content-type" and (m := re.search(r"charset=\"?([\w-]+)", v, re.I))), "utf-8")
    try:
        page = payload.decode(charset, "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    payload_digest = digest(payload)
    source = {"WARC-Refers-To": record_id, "WARC-Target-URI": target, "WARC-Date": date}
    linked = {k: v for k, v in source.items() if v is not None}
    own = lambda kind: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {record_id} {target}')}>"
    seen = walk(page, whole=True)
    title = seen.titles[0] if seen.titles else None
    facts = [("source-status", status), *(("source-header", f"{k}: {v}") for k, v in headers), ("source-payload-digest", payload_digest), ("source-payload-length", str(len(payload)))]
    facts += [("title", " ".join(html_lib.unescape(title).split()) if title is not None else None)]
    facts += [("outlink", link) for link in seen.links]
    info = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in facts if v is not None).encode()
    text = "\n".join(t for t, *_ in seen.blocks).encode("utf-8", "replace")
    make = lambda kind, form, body: Record(
        {"WARC-Type": kind, "WARC-Record-ID": own(kind), **linked, "Content-Type": form, "WARC-Block-Digest": digest(body), "WARC-Source-Payload-Digest": payload_digest}, body
    )
    return make("metadata", "application/warc-fields", info), make("conversion", "text/plain; charset=utf-8", text)


def responses(pages: DataFrame) -> DataFrame:
    """Response records of a table of pages: page_id, record_id, target_uri, date, block."""
    name = F.md5(F.concat_ws("\n", F.col("page_id").cast("string"), F.col("url")))
    uid = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", uid.alias("record_id"), F.col("url").alias("target_uri"), F.lit(DATE).alias("date"), F.concat(head.cast("binary"), body).alias("block"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files under ``path``, plain or gzipped (.gz), by record or as a whole.

    Spark's text reader cuts the files between records, so plain files are read by splits and no file is held whole. A
    plain file that holds a whole other WARC file as a block may give its records too, where a split begins inside it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[str] = []

        def one_file() -> Iterator[bytes]:
            while queue and queue[0][0] == last[0]:
                yield queue.popleft()[1]
                if not queue:
                    more()

        def more() -> None:
            for b in batches:
                queue.extend(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
                if queue:
                    return

        queue: deque[tuple[str, bytes]] = deque()
        more()
        while queue:
            last[:] = [queue[0][0]]
            rows, size = [], 0
            for r in records(one_file()):
                if r.fields.get("WARC-Type") == "response":
                    rows.append((r.fields.get("WARC-Record-ID"), r.fields.get("WARC-Target-URI"), r.fields.get("WARC-Date"), r.block))
                    size += len(r.block)
                if size > 32 << 20 or len(rows) >= 1000:
                    yield made(rows)
                    rows, size = [], 0
            yield made(rows)

    names = ["record_id", "target_uri", "date", "block"]
    kinds = [pa.string()] * 3 + [pa.binary()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    small_batches(spark, 500)
    pieces = spark.read.option("lineSep", SEPARATOR.decode()).text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return pieces.mapInArrow(run, "record_id string, target_uri string, date string, block binary")


def derivatives(source: DataFrame, carry: str | None = None, serialized: bool = True) -> DataFrame:
    """Two rows per response: the linked records, their fields, and (``serialized``) the record as WARC text."""
    small_batches(source.sparkSession, 500)
    extra = [f"{carry} {source.schema[carry].dataType.simpleString()}"] if carry else []
    schema = ", ".join([*extra, "record_type string, record_id string, refers_to string, target_uri string, source_digest string, block_digest string, content_length long, n_links long, payload string", *(["warc string"] if serialized else [])])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            rows = []
            carried = x[carry].tolist() if carry else [None] * len(x)
            for key, record_id, target, date, block in zip(carried, x.record_id, x.target_uri, x.date, x.block, strict=True):
                for d in derive(record_id, target, date, block):
                    f = d.fields
                    links = d.block.count(b"\r\noutlink: ") if f["WARC-Type"] == "metadata" else 0
                    row = (f["WARC-Type"], f["WARC-Record-ID"], f.get("WARC-Refers-To"), f.get("WARC-Target-URI"), f["WARC-Source-Payload-Digest"], f["WARC-Block-Digest"], len(d.block), links, d.block.decode())
                    rows.append(((key,) if carry else ()) + row + ((d.bytes().decode(),) if serialized else ()))
            yield pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in schema.split(", ")])

    return source.select(*([carry] if carry else []), "record_id", "target_uri", "date", "block").mapInPandas(run, schema)


def save(records: DataFrame, path: str) -> None:
    """Write the records as gzipped WARC files through Spark's writer, wherever that can write."""
    lines = records.select(F.expr("substring(warc, 1, length(warc) - 1)").alias("value"))
    lines.write.option("lineSep", "\n").option("compression", "gzip").text(path)
