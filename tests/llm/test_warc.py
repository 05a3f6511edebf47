import base64
import hashlib

from pyspark.sql import functions as F

from biblioforge.llm import warc
from biblioforge.llm.common import shared_folder


def rows():
    big = "<p>é" * 300000
    return [(1, "http://a/1", "<p>x"), (2, "http://a/2\r\nEvil: 1", "<p>x"), (3, None, None), (4, "http://ü/", ""), (5, "u", big), (6, "u", big), (7, "v", "\r\n\r\nWARC/1.1\r\n\r\n"), (1, "http://a/1", "<p>x"), (None, "w", "<p>x")]


def expected(data, min_bytes=0):
    out = []
    for p, _, h in data:
        raw = (h or "").encode()
        same = [q for q, _, g in data if (g or "") == (h or "") and q is not None]
        first = min(same) if same and len(raw) >= min_bytes else None
        to = first if p is not None and first is not None and p != first else None
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


def test_round_trip_and_selection(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "k", 9) for r in data], "page_id long, url string, html string, sha string, refers_to long")
    for least in (0, 100):
        folder = shared_folder(spark)
        index = warc.write_archives(df, folder, least)
        got = sorted((tuple(r) for r in warc.read_records(index, folder).collect()), key=str)
        assert got == expected(data, least)
        some = warc.read_records(index.where(F.col("page_id").isin(5, 7)), folder).collect()
        assert sorted(r.page_id for r in some) == [5, 7]


def test_record_bytes():
    member, digest = warc.encode_record(9, "http://x/?a=1", b"abc", None)
    parsed = warc.decode_record(member)
    assert parsed["payload"] == b"abc" and parsed["payload_digest"] == digest == warc.base32_sha1(b"abc")


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    folder = shared_folder(spark)
    assert warc.read_records(warc.write_archives(df, folder), folder).count() == 0
