"""WARC archives, index first.

Writing returns an index row (archive, offset, length, URL, digest) per record; reading
takes any selection of index rows, sorts them by place, coalesces neighbours into
byte-range reads and parses the records out of them. Records are gzip members of their
own, so a range of one archive can be read without the rest of it.

Archives go to the shared folder through pyarrow's filesystem layer (local, HDFS, object
stores). A task that runs again writes a file of a new name and returns an index of that
file, so a lost executor leaves an orphan at worst, never a wrong offset.

Defined cases: a null html is an empty payload; a null or odd URL is left out of, or
escaped in, the record's header; a null page_id is never a revisit, nor is a row whose
page_id is its payload's smallest (repeated rows of it are all responses); payloads below
``min_bytes`` are all responses; other columns are ignored; an empty table gives no
archives.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_folder, table, tasks_for

INDEX = "archive string, offset long, length long, url string, payload_digest string, record_type string, page_id long"
PARSED = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
DATE = "2024-01-01T00:00:00Z"
#: An archive is closed at this size; a range read is at most this long and skips at most this gap.
ARCHIVE_BYTES, RANGE_BYTES, GAP_BYTES = 256 << 20, 4 << 20, 64 << 10


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """One gzip member holding a response, or a revisit without the payload; and the digest."""
    digest = base32_sha1(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block += f"Content-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    else:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to)}",
            f"Refers-To-Page-Id: {refers_to}",
        ]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()
    return member, digest


def decode_record(member: bytes) -> dict:
    """Parses one record and checks what it says of itself."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != n or base32_sha1(payload) != digest):
        raise ValueError("a payload differs from its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("Page-Id"), "payload_bytes": n, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("Refers-To-Page-Id"), "payload": payload}


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes a record per row (page_id, url, html) and returns the index, durably kept.

    The first page of each payload is an aggregate by digest, and pages and digests alone meet
    it; payloads meet the result by page and digest, so a hot payload is no hot key.
    """
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    first = keyed.where(F.octet_length("html") >= min_bytes).groupBy(F.col("sha").alias("first_sha")).agg(F.min("page_id").alias("first_id"))
    keys = pages.select("page_id", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("sha"))
    later = keys.join(first, F.col("sha") == F.col("first_sha")).where(F.col("page_id") != F.col("first_id")).select("page_id", "sha", "first_id").distinct()
    told = keyed.join(later, ["page_id", "sha"], "left").select("page_id", "url", "html", F.col("first_id").alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        out, name, at, rows = None, "", 0, []
        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        fs.create_dir(root, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    member, digest = encode_record(r["page_id"], r["url"], r["html"].encode(), r["refers_to"])
                    out.write(member)
                    rows.append((name, at, len(member), r["url"], digest, "response" if r["refers_to"] is None else "revisit", r["page_id"]))
                    at += len(member)
                if rows:
                    yield _batch(rows, INDEX)
                    rows = []
        finally:
            if out is not None:
                out.close()

    return materialize(told.mapInArrow(write, INDEX))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Parses the selected records (any subset of an index) back out of the archives."""
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    placed = index.select("archive", "offset", "length").withColumn("slab", F.floor(F.col("offset") / RANGE_BYTES))
    sorted_ = placed.repartition(tasks_for(size, RANGE_BYTES), "archive", "slab").sortWithinPartitions("archive", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        held: list[tuple[str, int, int]] = []
        for batch in batches:
            done = []
            for a, o, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (a != held[0][0] or o - (held[-1][1] + held[-1][2]) > GAP_BYTES or o + n - held[0][1] > RANGE_BYTES):
                    done += _read_range(fs, root, held)
                    held = []
                held.append((a, o, n))
            if done:
                yield _batch(done, PARSED)
        if held:
            yield _batch(_read_range(fs, root, held), PARSED)

    return sorted_.mapInArrow(read, PARSED)


def _read_range(fs: pafs.FileSystem, root: str, held: list[tuple[str, int, int]]) -> list[tuple]:
    name, start, _ = held[0]
    with fs.open_input_file(f"{root}/{name}") as f:
        f.seek(start)
        data = f.read(held[-1][1] + held[-1][2] - start)
    parsed = (decode_record(data[o - start : o - start + n]) for _, o, n in held)
    return [tuple(p[k] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for p in parsed]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def op2_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    return read_records(write_archives(table(spark, sf_dir, "pages"), folder), folder)


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY h) AS first_id,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""

QUERIES = {"op2_warc_roundtrip": op2_warc_roundtrip}
ORACLES = {"op2_warc_roundtrip": ORACLE_SQL}
