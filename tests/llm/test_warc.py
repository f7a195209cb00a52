"""WARC archives: round trips against brute force, the files as they stand, broken archives."""

import base64
import glob
import gzip
from hashlib import sha1

import pytest
from common import AWKWARD
from pyspark.sql import functions as F

from sourceloom.llm import warc
from sourceloom.llm.workdir import new_path

SCHEMA = "page_id long, url string, html string"
TEXTS = [t for t in AWKWARD if t is not None] + ["<p>WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n0\r\n\r\n</p>", "é中" * 9_000, "<b>" * 400_000, None, None]


def digest(data):
    return base64.b32encode(sha1(data).digest()).decode()


def brute(rows, least=0):
    """Sorted rows; of repeated rows with the largest id one is the response."""
    groups, out = {}, []
    for page_id, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page_id)
    for data, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        for n, i in enumerate(ids):
            again = n > 0 and len(data) >= least
            out.append((i, len(data), digest(data), "revisit" if again else "response", ids[0] if again else None, None))
    return sorted(out, key=str)


def pages(spark, texts=TEXTS):
    rows = [(k, f"http://h/{k}", t) for k, t in enumerate(texts)] + [(7, "http://h/7", "same text here"), (99, None, "same text here"), (99, None, "same text here")]
    return rows + [(None, "http://h/a b\r\nX-Page-ID: 5", "only here"), (None, "u", "same text here")]


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("digest", "row", "payload", "block", "record_type", "n"):
        df = df.withColumn(name, F.lit("clash"))
    got = warc.round_trip(df, **options).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, options.get("least_bytes", 0))


@pytest.mark.parametrize("options", [{}, {"segment_bytes": 150, "chunk_bytes": 7, "file_records": 3}, {"least_bytes": 14}, {"least_bytes": 15}])
def test_round_trip(spark, options):
    rows = pages(spark, TEXTS if len(options) < 3 else [t for t in TEXTS if len(t or "") < 50_000])
    check(spark, rows, **options)


def test_payloads_come_back(spark):
    rows = pages(spark)
    folder = new_path(spark, "warc-test")
    warc.write(spark.createDataFrame(rows, SCHEMA), folder)
    got = [(r["page_id"], r["payload"].decode()) for r in warc.read(spark, folder).filter("record_type = 'response'").collect()]
    assert sorted(got, key=str) == sorted({(i, t or "") for (i, _, t) in rows if any(b[:2] == (i, len((t or "").encode())) and b[3] == "response" for b in brute(rows))}, key=str)
    # the files by themselves: records one after the other, each followed by two line breaks
    seen = []
    for name in glob.glob(f"{folder.removeprefix('file:')}/*.gz"):
        data = gzip.open(name).read()
        records = list(warc.parse(data))
        assert data.count(b"WARC-Type: ") == len(records) <= 4_096 and all(len(block) <= 8_192 for _, block in records)
        seen += [h["warc-type"] for h, _ in records]
    assert {"response", "revisit", "continuation"} == set(seen)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_broken_segments(spark):
    folder = new_path(spark, "warc-test")
    warc.write(spark.createDataFrame([(k, "u", f"{k}" * 1_000) for k in range(4)], SCHEMA), folder, segment_bytes=200, chunk_bytes=300)
    records = warc.read_records(spark, folder).cache()
    assert records.count() > 20
    first = {r["page_id"]: r["record_id"] for r in records.filter("segment = 1").collect()}
    of = F.coalesce("origin_id", "record_id")
    broken = records.filter((of != first[0]) | (F.col("segment") != 3)).filter((of != first[1]) | F.col("total_length").isNull()) \
        .withColumn("total_length", F.when(of == first[2], F.col("total_length") + 1).otherwise(F.col("total_length")))
    got = {r["page_id"]: (r["block"] is None, r["error"]) for r in warc.reassemble(broken).collect()}
    assert got == {0: (True, "segments missing or repeated"), 1: (True, "last segment missing"), 2: (True, "total length differs"), 3: (False, None)}


def test_framing():
    assert warc.dechunk(b"3;x=1\r\nabc\r\nA\r\n0123456789\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc0123456789"
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\nTransfer-encoding:  chunked\r\n\r\n0\r\n\r\n") == b""
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\n\r\n5\r\nabc") == b"5\r\nabc"
    for bad in (b"3\r\nab", b"z\r\nabc\r\n", b"2\r\nabc\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.dechunk(bad)
    with pytest.raises(ValueError):
        list(warc.parse(b"HTTP/1.1\r\n\r\n"))


def test_changed_payload_is_found(spark):
    folder = new_path(spark, "warc-test")
    warc.write(spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc")], SCHEMA), folder)
    text = b"".join(gzip.open(n).read() for n in glob.glob(f"{folder.removeprefix('file:')}/*.gz")).replace(b"abc", b"abd")
    other = new_path(spark, "warc-test")
    spark.createDataFrame([(text.decode()[:-4],)], "value string").write.option("lineSep", "\r\n\r\n").text(other)
    assert {(r["page_id"], r["error"]) for r in warc.index(warc.read(spark, other)).collect()} == {(2, "digest differs"), (1, "response missing")}
