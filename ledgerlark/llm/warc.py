"""WARC archives: write, normalise, read back.

``archives`` writes records into archives that are one gzip stream each, as many crawlers' files are. ``normalised``
inflates such a stream once, rewrites every record as a gzip member of its own and adds a sidecar index of offsets.
``records`` reads single members by that index. An archive is a binary value in a table, so Spark's own committed
writes store it in any file system; ``export`` puts archives out as ``.warc.gz`` files with their ``.cdxj`` sidecars.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, map_batches, stored

PROFILE = b"http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "array<struct<page_id:bigint,record_type:string,offset:bigint,length:bigint>>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record of ``refers_to`` without the payload."""
    digest = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: <urn:page:%s>" % str(page_id).encode(), b"WARC-Date: " + date.encode()]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + b"".join(b"%%%02X" % c if c < 33 or c == 127 else bytes([c]) for c in url.encode()))
    lines += [b"WARC-Payload-Digest: sha1:" + base64.b32encode(digest), b"Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(body), b"", b""]) + body + b"\r\n\r\n"


def _headers(block: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in block.split(b"\r\n")[1:])}


def split_records(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Whole records from pieces of an inflated stream, by their Content-Length."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while (end := held.find(b"\r\n\r\n")) >= 0:
            whole = end + 4 + int(_headers(bytes(held[:end]))[b"content-length"]) + 4
            if len(held) < whole:
                break
            yield bytes(held[:whole])
            del held[:whole]
    if held.strip():
        raise ValueError("the archive ends within a record")


def inflate(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The stream of a gzip file of one or many members, inflated piece by piece."""
    rest = content
    while rest:
        z = zlib.decompressobj(31)
        while rest and not z.eof:
            yield z.decompress(rest, step)
            rest = z.unconsumed_tail if not z.eof else z.unused_data
        if not z.eof:
            raise ValueError("the archive is cut off")


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(member: bytes) -> dict:
    """A record's page_id, payload length and digest (computed where the payload is there), type and refers_to."""
    head, _, rest = member.partition(b"\r\n\r\n")
    h = _headers(head)
    body = rest[: int(h[b"content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    number = lambda urn: None if urn == b"<urn:page:None>" else int(urn[len(b"<urn:page:") : -1])
    kind, told = h[b"warc-type"].decode(), base64.b32decode(h[b"warc-payload-digest"].removeprefix(b"sha1:")).hex()
    size, digest = int(_headers(http)[b"content-length"]), told
    if kind == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if digest != told:
            raise ValueError(f"payload of {h[b'warc-record-id'].decode()} doesn't match its digest")
    return {"page_id": number(h[b"warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(h[b"warc-refers-to"]) if b"warc-refers-to" in h else None}


def normalise(content: bytes, level: int = 6) -> tuple[bytes, list[dict]]:
    """One gzip stream to a member per record, and the index: page_id, record_type, offset, length."""
    out, index, at = [], [], 0
    for r in split_records(inflate(content)):
        member, about = _gzip(r, level), parse(r)
        out.append(member)
        index.append({"page_id": about["page_id"], "record_type": about["record_type"], "offset": at, "length": len(member)})
        at += len(member)
    return b"".join(out), index


def with_revisits(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 1000) -> DataFrame:
    """(page_id, url, html, refers_to): of equal payloads of ``least_bytes`` or more the largest page_id is referred to.

    Payloads that occur once aren't looked up. The others' digests go to all executors where they are few enough; else
    ids meet them first, without any html, and pages then meet the result by id, so that no popular payload gathers its pages.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.when(F.octet_length("html") >= least_bytes, F.unhex(F.sha2("html", 256))))
    lead = stored(rows.where("key is not null").groupBy("key").agg(F.max("page_id").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead"), "warc-leads")
    if lead.count() <= BROADCAST_IDS:
        placed = rows.join(F.broadcast(lead), "key", "left")
    else:
        placed = rows.join(rows.where("key is not null").select("page_id", "key").distinct().join(lead, "key"), ["page_id", "key"], "left")
    return placed.select("page_id", "url", "html", F.when(F.col("page_id") < F.col("lead"), F.col("lead")).alias("refers_to"))


def archives(rows: DataFrame, *, date: str = "2024-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Archives of one gzip stream each, one per Arrow batch: (name, content)."""

    def write(b: pa.RecordBatch) -> pa.RecordBatch:
        z, out, name = zlib.compressobj(level, zlib.DEFLATED, 31), [], hashlib.sha1()
        for r in b.to_pylist():
            data = record(r["page_id"], r["url"], r["html"].encode(), r["refers_to"], date)
            name.update(data)
            out.append(z.compress(data))
        out.append(z.flush())
        return pa.RecordBatch.from_arrays([pa.array([name.hexdigest()[:20]]), pa.array([b"".join(out)], pa.binary())], names=["name", "content"])

    return map_batches(rows, write, "name string, content binary")


def normalised(table: DataFrame, *, level: int = 6) -> DataFrame:
    """Each archive with a member per record, and its sidecar ``index``."""

    def rewrite(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for r in b.to_pylist():
            content, index = normalise(r["content"], level)
            kind = pa.list_(pa.struct([("page_id", pa.int64()), ("record_type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
            out.append(pa.RecordBatch.from_arrays([pa.array([r["name"]]), pa.array([content], pa.binary()), pa.array([index], kind)], names=["name", "content", "index"]))
        return out

    return map_batches(table, rewrite, f"name string, content binary, index {INDEX}")


def records(table: DataFrame) -> DataFrame:
    """Every record, each inflated alone from its place in the index."""

    def read(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for r in b.to_pylist():
            found = [parse(zlib.decompress(r["content"][e["offset"] : e["offset"] + e["length"]], 31)) for e in r["index"]]
            out.append(pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]))
        return out

    return map_batches(table, read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(spark: SparkSession, pages: DataFrame, **columns: str) -> DataFrame:
    """Write all pages, normalise the archives, read them back.

    Null html is an empty payload; a null url gives a record without target; null page_ids and rows of the largest
    page_id stay responses (also where repeated); an empty table gives no archive; other columns are not read.
    """
    raw = stored(archives(with_revisits(pages, **columns)), "warc-raw")
    return records(stored(normalised(raw), "warc"))


def export(table: DataFrame, folder: str) -> list[str]:
    """Write normalised archives as files with sidecars to a local folder, one archive in memory at a time."""
    names = []
    for r in table.toLocalIterator():
        at = Path(folder, f"{r['name']}.warc.gz")
        at.write_bytes(r["content"])
        at.with_suffix("").with_suffix(".cdxj").write_text("".join(json.dumps(e.asDict()) + "\n" for e in r["index"]))
        names.append(str(at))
    return names
