"""WARC archives with revisit records.

Pages are staged once in blocks, each of which becomes an archive. Only headers (digest, length, id, and where the record
lies) are shuffled by payload digest, to find each group's original; the decisions go back to the blocks, which write their
records with fresh headers as gzip members. An archive is a row of (archive, content): content is a valid .warc.gz file
of bounded size, written by Spark's own committer, so lost executors leave no half archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Blocks, block_ids, staged, table, unstage, with_facts
from ._words import slices, trim

#: Bytes of payload after which an archive is closed.
ARCHIVE_BYTES = 8 << 20
_NAMESPACE = uuid.UUID("8f1b3c52-9d2e-5c44-8a11-3d6a5f0c7e21")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{digest}')}>"


def _line(value: str | None) -> str:
    """A header's value: no line breaks or other controls."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def write_record(kind: str, page_id, url, digest: str, payload: bytes, origin, date: str) -> bytes:
    """One gzip member: a response with its payload, or a revisit without, whose headers name the original record."""
    block = _HTTP + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(origin, digest)}", f"X-Refers-To-Page-ID: {origin}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


#: Bytes of an archive that the reader hands to the decompressor at a time.
_STEP = 1 << 16


def read_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each gzip member of an archive, in time that grows with the archive's size."""
    view, at = memoryview(content), 0
    while at < len(view):
        reader, parts = zlib.decompressobj(31), []
        while not reader.eof:
            if at >= len(view):
                raise ValueError("an archive is cut short")
            parts.append(reader.decompress(view[at : at + _STEP]))
            at += min(_STEP, len(view) - at) - len(reader.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        if not lines[0].startswith("WARC/") or rest[size:] != b"\r\n\r\n":
            raise ValueError("not a WARC record")
        yield headers, rest[:size]


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, place, page_id, url, payload, digest, size) of pages; a block closes after ARCHIVE_BYTES."""
    from pyspark import TaskContext

    ids, rows, size = block_ids(TaskContext.get().partitionId()), 0, 0
    block = next(ids)
    for whole in batches:
        for batch in slices(whole, "html", ARCHIVE_BYTES // 2):
            raw = [(h or "").encode() for h in batch.column("html").to_pylist()]
            digests = [hashlib.sha1(r).digest() + hashlib.sha256(r).digest()[:12] for r in raw]
            n = len(raw)
            columns = [pa.array(np.full(n, block)), pa.array(np.arange(rows, rows + n)), batch.column("page_id"), batch.column("url"), pa.array(raw, pa.binary()), pa.array(digests, pa.binary()), pa.array([len(r) for r in raw], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "place", "page_id", "url", "payload", "digest", "size"])
            rows, size = rows + n, size + sum(map(len, raw)) + 500 * n
            if size >= ARCHIVE_BYTES:
                block, rows, size = next(ids), 0, 0


def originals(heads: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(digest, origin, members) of payloads of at least `least_bytes` that several rows of `heads` (page_id, digest, size) share; origin: the largest page_id."""
    groups = heads.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("origin"), F.count("*").alias("members"))
    return groups.where("members > 1 and origin is not null")


def _writer(date: str):
    def write(pages: pa.Table, decided: pa.Table) -> pa.Table:
        origins = dict(zip(decided.column("place").to_pylist(), decided.column("origin").to_pylist(), strict=True))
        members = []
        for place, page_id, url, payload, digest in zip(*(pages.column(c).to_pylist() for c in ("place", "page_id", "url", "payload", "digest")), strict=True):
            origin = origins.get(place)
            kind = "response" if origin is None else "revisit"
            members.append(write_record(kind, page_id, url, base64.b32encode(digest[:20]).decode(), payload, origin, date))
        trim()
        name = f"block-{pages.column('block')[0].as_py():016x}.warc.gz"
        return pa.table({"archive": [name], "content": pa.array([b"".join(members)], pa.binary())})

    return write


def write_archives(pages: DataFrame, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(archive, content) rows of the archives of `pages` (page_id, url, html), staged.

    Of rows with equal payloads of at least `least_bytes` bytes, that with the largest page_id is a response and others
    are revisits of it; rows that repeat that page_id are responses too, and so are all rows of a group without ids and
    all smaller payloads. Null html is an empty payload; a null url has no target header; a row with null page_id
    in a group with ids is a revisit. Other columns are left out. A payload beyond ARCHIVE_BYTES ends its archive.
    """
    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    blocks = Blocks(kept.mapInArrow(_block, "block long, place long, page_id long, url string, payload binary, digest binary, size long"), "pages")
    heads = blocks.rows.select("block", "place", "page_id", "digest", "size")
    firsts = staged(originals(heads, least_bytes), "firsts")
    revisits = with_facts(heads, firsts, "digest", "members", heads.count()).where(~F.col("page_id").eqNullSafe(F.col("origin"))).select("block", "place", "origin")
    both = blocks.grouped("place", "page_id", "url", "payload", "digest").cogroup(revisits.groupBy("block"))
    archives = staged(both.applyInArrow(_writer(date), "archive string, content binary"), "warc")
    blocks.close()
    unstage(blocks.rows)
    return archives


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for headers, block in read_records(content.as_py()):
                digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                size = int(headers["X-Payload-Length"])
                payload = block.partition(b"\r\n\r\n")[2]
                if kind == "response" and (payload_digest(payload) != digest or len(payload) != size):
                    raise ValueError("a payload differs from its digest")
                page, origin = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
                rows.append((page and int(page), size, digest, kind, origin and int(origin), headers.get("WARC-Target-URI"), payload if kind == "response" else None))
            cols = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (null for revisits). A record that is cut short or whose payload differs from its digest is an error."""
    return archives.select("content").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """Records with revisits' payloads filled in from the responses they refer to."""
    first = records.where("record_type = 'response'").select(F.col("page_id").alias("_p"), F.col("payload_digest").alias("_d"), F.col("payload").alias("_body")).dropDuplicates(["_p", "_d"])
    joined = records.join(first, (F.col("refers_to") == F.col("_p")) & (F.col("payload_digest") == F.col("_d")), "left")
    return joined.withColumn("payload", F.coalesce("payload", "_body")).drop("_p", "_d", "_body")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages"))).drop("url", "payload")


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS origin FROM pages)
SELECT page_id, octet_length(encode(body)) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN origin IS NULL OR page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM origin THEN origin END AS refers_to
FROM p
"""
