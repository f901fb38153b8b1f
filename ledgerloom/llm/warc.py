"""WARC archives, index first.

Writing gives one gzip member per record and, from the same task, one index row per record: archive,
offset, length, url and payload digest. Archives roll at ``ARCHIVE_BYTES``. The first of equal
payloads (smallest page_id) is a ``response``; the others are ``revisit`` records that refer to it and
hold its headers but not its payload. Reading never scans an archive: it takes selected index rows,
sorts them by archive and offset, coalesces ranges that lie close together, and reads each range once.

Every write attempt makes files of its own name, and the index, committed by Spark, names only files
of attempts that succeeded: a lost executor leaves unreferenced files, never wrong offsets. Files go to
the shared folder through pyarrow's file systems (file, S3, HDFS by URI).

Edge cases: a null html is an empty payload; null urls and page_ids are written as empty headers and read
back as null. Groups without any page_id are responses. Repeated rows that hold the smallest page_id
of their payload are responses each. Empty tables write no archive. Extra columns are ignored.
Payloads of any length are written whole; a reader holds one coalesced range at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, new_path

ARCHIVE_BYTES = 32 << 20
#: Ranges with at most this gap are read as one, up to RANGE_BYTES.
GAP_BYTES = 64 << 10
RANGE_BYTES = 8 << 20
#: Reading tasks, at most; each takes archives one after another.
MOST_TASKS = 20_000
#: Fixed value: the base32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
INDEX = "page_id long, url string, archive string, offset long, length long, digest string, record_type string, refers_to long, payload_bytes long"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column, in built-in functions (20 bits at a time)."""

    def letters(digest: Column) -> Column:
        def four(i: Column) -> Column:
            v = F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("long")
            letter = lambda shift: F.substring(F.lit(BASE32), (F.shiftright(v, shift) % 32 + 1).cast("int"), F.lit(1))
            return F.concat(letter(15), letter(10), letter(5), letter(0))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")

    # The digest is an array's one element, so that the loop over its parts sees a value and not the hashing.
    return F.get(F.transform(F.array(F.sha1(payload)), letters), 0)


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, digest, record_type, refers_to: what each row's record will be."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.length(payload).cast("long").alias("payload_bytes"), sha1_base32(payload).alias("digest"))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("same"))
    # Only payloads that repeat need the join; hot ones are many rows of one key, which adaptive execution splits.
    again = first.where("same > 1").select(F.col("digest").alias("d"), "first")
    out = rows.join(again, F.col("digest") == F.col("d"), "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return out.select("page_id", "url", "html", "payload_bytes", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The record's fields, from its bytes alone; a response's payload is digested anew."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(next(line[16:] for line in http.decode().split("\r\n") if line.startswith("Content-Length: ")))
    page = fields["WARC-Record-ID"][10:-1]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record of page {page} does not match its digest")
    return {
        "page_id": int(page) if page else None,
        "url": fields["WARC-Target-URI"] or None,
        "payload": payload,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": int(fields["WARC-Refers-To"][10:-1]) if "WARC-Refers-To" in fields else None,
    }


def write(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives to ``folder`` (in the shared folder by default) and returns their index, as a table."""
    folder = folder or new_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, at, name = None, 0, ""
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                raw = record(r["page_id"], r["url"], (r["html"] or "").encode(), r["payload_bytes"], r["digest"], r["record_type"], r["refers_to"])
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = z.compress(raw) + z.flush()
                out.write(member)
                rows.append({**{k: r[k] for k in ("page_id", "url", "digest", "record_type", "refers_to", "payload_bytes")}, "archive": name, "offset": at, "length": len(member)})
                at += len(member)
            out.flush()
            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA) if rows else pa.RecordBatch.from_pylist([], schema=SCHEMA)
        if out is not None:
            out.close()

    return cut(plan(pages).mapInArrow(run, INDEX), "warc-index").withColumn("folder", F.lit(folder))


SCHEMA = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.strip().split() for x in INDEX.split(","))])


def ranges(rows: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> Iterator[list[tuple[int, int]]]:
    """Groups of (offset, length), sorted, that are read as one range."""
    group: list[tuple[int, int]] = []
    for offset, length in rows:
        if group and (offset - (group[-1][0] + group[-1][1]) > gap or offset + length - group[0][0] > most):
            yield group
            group = []
        group.append((offset, length))
    if group:
        yield group


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The selected records: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked, payload.

    Rows are dealt by archive, whose size is bounded, and sorted by offset in each task.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"payload": pa.binary(), "url": pa.string(), "payload_digest": pa.string(), "record_type": pa.string()}
    shape = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, str] | None = None
        wanted: list[tuple[int, int]] = []

        def fetch() -> Iterator[pa.RecordBatch]:
            store, root = fs.FileSystem.from_uri(held[0])
            with store.open_input_file(f"{root}/{held[1]}") as f:
                for group in ranges(wanted):
                    start = group[0][0]
                    raw = f.read_at(group[-1][0] + group[-1][1] - start, start)
                    rows = [parse(zlib.decompress(raw[o - start : o - start + n], 31)) for o, n in group]
                    yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema=shape)

        for b in batches:
            for folder, archive, offset, length in zip(*(b.column(c).to_pylist() for c in ("folder", "archive", "offset", "length")), strict=True):
                if held != (folder, archive):
                    if held:
                        yield from fetch()
                    held, wanted = (folder, archive), []
                wanted.append((offset, length))
        if held:
            yield from fetch()

    wanted_ = index.select("folder", "archive", "offset", "length")
    # A number of its own, as index rows are so short that adaptive execution would deal all archives to one task.
    tasks = max(1, min(MOST_TASKS, wanted_.select("folder", "archive").distinct().count()))
    dealt = wanted_.repartition(tasks, "folder", "archive").sortWithinPartitions("folder", "archive", "offset")
    return dealt.mapInArrow(run, schema)


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, payload_bytes, hex, min(page_id) OVER (PARTITION BY hex) AS first,
         list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5))::BIGINT >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
