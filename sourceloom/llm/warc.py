"""WARC archives of web pages, written and read back.

Writing.  A page is a ``response`` record: HTTP headers and the payload in chunked transfer framing.  Of pages with equal payloads only the one
with the largest page_id is; the others are ``revisit`` records that name it and carry no payload.  A record whose block is
longer than ``segment_bytes`` is cut: the first segment has segment number 1, ``continuation`` records name the first one as
their origin, and the last one gives the total length.  So no record is longer than a segment and its headers, and a file,
which holds ``file_records`` records at most, is bounded too, whatever the pages' lengths.  Records end with two line breaks, and
Spark's text writer puts these as its line separator: the files are plain gzipped WARC files.

Reading.  Files are read one by one and their records taken by content length.  Segments are grouped by origin, ordered by
number and joined; numbers without gap and the total length are verified, chunked framing is decoded, and the SHA-1 of what comes
out is compared with the record's payload digest.  Revisits take payload length and page from the record they refer to.

Only pages that share a payload with another one are joined; their table is written first, so its true size decides how Spark joins it,
and a payload that a third of all pages share is split by adaptive execution.  The pages' row numbers are written with them, so a
repeated task gives the same record ids.

Defined cases: null html is an empty payload; a null page_id or url has no header and is read back as null, and is smaller than any
other; of repeated rows with the largest page_id one is the response; urls with blanks or control characters are form-encoded; payloads under
``least_bytes`` are always responses; records that fail a check have ``error`` and no payload; an empty table gives no records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import split_lookup
from .workdir import new_path, stored

CRLF = "\r\n"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Transfer-Encoding: chunked{CRLF}{CRLF}"
HTTP_ONLY = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
# Fixed values of the WARC 1.1 format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_MESSAGE = "application/http; msgtype=response"
# Digits of radix 32 as Spark's conv writes them, and the base32 alphabet.
RADIX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD = ("record_id string, record_type string, page_id long, url string, refers_to string, declared_digest string, "
          "origin_id string, segment int, total_length long, block binary")


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 SHA-1: 40 bits are ten hex digits and eight of base32."""
    hexed = F.sha1(data)
    return F.concat(*[F.translate(F.lpad(F.conv(F.substring(hexed, k * 10 + 1, 10), 16, 32), 8, "0"), RADIX32, BASE32) for k in range(4)])


def _uuid(c: Column) -> Column:
    hexed = F.md5(c)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _pieces(data: Column, size: int) -> Column:
    """Arrays of at most ``size`` bytes; none for empty data."""
    n = F.octet_length(data)
    starts = F.when(n > 0, F.sequence(F.lit(0), ((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.substring(data, k * size + 1, F.lit(size)))


def chunked(data: Column, chunk_bytes: int) -> Column:
    """Chunked transfer framing of binary data, as text."""
    framed = F.transform(_pieces(data, chunk_bytes), lambda c: F.concat(
        F.lower(F.hex(F.octet_length(c).cast("long"))), F.lit(CRLF), c.cast("string"), F.lit(CRLF)))
    return F.concat(F.array_join(framed, ""), F.lit(f"0{CRLF}{CRLF}"))


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def _keyed(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """The pages with row number, payload and digest; written, as the digests are needed twice."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    return stored(rows.select("*", F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload").cast("binary")).alias("digest"),
                              F.monotonically_increasing_id().alias("row")), "warc-pages")


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0,
          segment_bytes: int = 8_192, chunk_bytes: int = 4_096, file_records: int = 4_096) -> None:
    """One record per row of ``pages``, in gzipped WARC files below ``folder``."""
    keyed = _keyed(pages, page_id, url, html)
    last = F.max(F.struct(F.col("page_id").isNotNull().alias("a"), "page_id", "row")).alias("last")
    shared = keyed.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(last, F.count(F.lit(1)).alias("n")).filter("n > 1")
    heads = stored(shared.select("digest", F.col("last.row").alias("head")), "warc-shared")
    marked = keyed.join(heads, "digest", "left")
    c = F.col
    revisit = F.coalesce((c("bytes") >= least_bytes) & (c("head") != c("row")), F.lit(False))
    own = _uuid(F.concat(F.lit("page "), c("row").cast("string")))
    safe = F.when(c("url").rlike(r"[\x00-\x20\x7f]"), F.url_encode("url")).otherwise(c("url"))
    block = F.when(revisit, F.lit(HTTP_ONLY)).otherwise(F.concat(F.lit(HTTP), chunked(c("payload").cast("binary"), chunk_bytes))).cast("binary")
    common = F.concat(_header("WARC-Target-URI", safe), _header("WARC-Date", F.lit("1970-01-01T00:00:00Z")), _header("X-Page-ID", c("page_id")))
    about = F.concat(
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{CRLF}"), _header("WARC-Refers-To", _uuid(F.concat(F.lit("page "), c("head").cast("string"))))))
        .otherwise(F.lit("")), _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), c("digest"))))
    cut = marked.select(own.alias("id"), F.when(revisit, "revisit").otherwise("response").alias("type"), common.alias("common"), about.alias("about"),
                        block.alias("block")).select("id", "type", "common", "about", F.octet_length("block").alias("total"), F.posexplode(_pieces(c("block"), segment_bytes)).alias("at", "piece"))
    first, many, final = c("at") == 0, c("total") > segment_bytes, (c("at") + 1) * segment_bytes >= c("total")
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _header("WARC-Type", F.when(first, c("type")).otherwise("continuation")),
        _header("WARC-Record-ID", F.when(first, c("id")).otherwise(_uuid(F.concat(c("id"), c("at").cast("string"))))), c("common"),
        F.when(first, c("about")).otherwise(_header("WARC-Segment-Origin-ID", c("id"))), _header("WARC-Segment-Number", F.when(many, c("at") + 1)),
        _header("WARC-Segment-Total-Length", F.when(many & final, c("total"))), F.lit(f"Content-Type: {HTTP_MESSAGE}{CRLF}"),
        _header("Content-Length", F.octet_length("piece")), F.lit(CRLF), c("piece").cast("string"))
    cut.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip") \
        .option("maxRecordsPerFile", file_records).text(folder)


def parse(data: bytes):
    """(headers with lower-case names, block) of the records of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict((name.lower(), value) for name, _, value in (line.partition(": ") for line in lines[1:]))
        at = end + 4 + int(headers["content-length"])
        yield headers, data[end + 4:at]
        if data[at:at + 4] != b"\r\n\r\n":
            raise ValueError(f"record ends without separator at byte {at}")
        at += 4


def dechunk(data: bytes) -> bytes:
    """The payload of chunked transfer framing; chunk extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        at = end + 2 + size
        if len(data) < at + 2 or data[at:at + 2] != b"\r\n":
            raise ValueError("chunk of wrong length")
        parts.append(data[end + 2:at])
        at += 2


def payload_of(block: bytes) -> bytes:
    """The decoded body of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = [line.lower().replace(b" ", b"") for line in head.split(b"\r\n")[1:]]
    return dechunk(body) if b"transfer-encoding:chunked" in fields else body


def _records(batches):
    """Rows of the records of (content) files, a few megabytes at a time."""
    import gzip

    import pyarrow as pa
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[k])
                        for n, k in (field.split() for field in RECORD.split(", "))])
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            data = content.as_py()
            for h, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                number = lambda name: int(h[name]) if name in h else None
                rows.append((h["warc-record-id"], h["warc-type"], number("x-page-id"), h.get("warc-target-uri"), h.get("warc-refers-to"),
                             h.get("warc-payload-digest", "").removeprefix("sha1:") or None, h.get("warc-segment-origin-id"), number("warc-segment-number"),
                             number("warc-segment-total-length"), block))
                size += len(block)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _decode(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Payload, or what is wrong with it, of HTTP messages."""
    for blocks in series:
        found = []
        for block in blocks:
            try:
                found.append((None if block is None else payload_of(block), None))
            except ValueError as wrong:
                found.append((None, f"framing: {wrong}"))
        yield pd.DataFrame(found, columns=["payload", "error"])


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives below ``folder`` as they stand, segments apart."""
    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(_records, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Records with their segments joined: ``block`` is null and ``error`` set where segments are missing or of a wrong total length."""
    parts = F.col("parts")
    head = lambda name: parts[0][name].alias(name)
    joined = records.filter("segment IS NOT NULL").groupBy(F.coalesce("origin_id", "record_id").alias("origin")).agg(
        F.array_sort(F.collect_list(F.struct("segment", "record_type", "page_id", "url", "refers_to", "declared_digest", "total_length", "block"))).alias("parts"))
    # text of raw bytes, as only text is joined in one go
    text = F.array_join(F.transform(parts, lambda p: p["block"].cast("string")), "")
    whole = joined.select("origin", "parts", text.alias("text"), F.element_at("parts", -1)["total_length"].alias("total"))
    in_order = F.transform(parts, lambda p: p["segment"]) == F.sequence(F.lit(1), F.size(parts))
    error = F.when(~in_order, "segments missing or repeated").when(F.col("total").isNull(), "last segment missing") \
        .when(F.octet_length("text") != F.col("total"), "total length differs")
    long = whole.select(F.col("origin").alias("record_id"), head("record_type"), head("page_id"), head("url"), head("refers_to"), head("declared_digest"),
                        F.when(error.isNull(), F.col("text").cast("binary")).alias("block"), error.alias("error"))
    short = records.filter("segment IS NULL").select(
        "record_id", "record_type", "page_id", "url", "refers_to", "declared_digest", "block", F.lit(None).cast("string").alias("error"))
    return short.unionByName(long)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """record_id, record_type, page_id, url, refers_to (record id), declared_digest, payload (binary; null for revisits), error."""
    decode = F.pandas_udf(_decode, "payload binary, error string")
    rows = reassemble(read_records(spark, folder)).withColumn("d", decode(F.when(F.col("record_type") != "revisit", F.col("block"))))
    kept = rows.select("record_id", "record_type", "page_id", "url", "refers_to", "declared_digest", F.col("d.payload").alias("payload"),
                       F.coalesce("error", "d.error").alias("error"))
    wrong = F.coalesce(base32_sha1(F.col("payload")) != F.col("declared_digest"), F.lit(False))
    return kept.withColumn("error", F.when(wrong, "digest differs").otherwise(F.col("error"))).withColumn("payload", F.when(~wrong, F.col("payload")))


def index(records: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (page_id), error; revisits resolved through the record they name."""
    lines = stored(records.select("record_id", "record_type", "page_id", "url", "refers_to", "declared_digest", "error",
                                  F.octet_length("payload").cast("long").alias("payload_bytes"),
                                  base32_sha1(F.col("payload")).alias("payload_digest")), "warc-index")
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type"]
    revisits = lines.filter("record_type = 'revisit'")
    asked = revisits.groupBy(F.col("refers_to").alias("record_id")).agg(F.count(F.lit(1)).alias("asks"))
    named = lines.filter("record_type <> 'revisit'").join(asked, "record_id").select(
        F.col("record_id").alias("refers_to"), "asks", F.col("page_id").alias("head"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    found = split_lookup(revisits, named, ["refers_to"], "asks", how="left").select(
        "page_id", "url", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", F.col("head").alias("refers_to"),
        F.when(F.col("_digest").isNull(), "response missing").when(F.col("_digest") != F.col("declared_digest"), "digest differs").alias("error"))
    others = lines.filter("record_type <> 'revisit'").select(*columns, F.lit(None).cast("long").alias("refers_to"), "error")
    return others.unionByName(found)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """The index of archives written to a fresh shared folder."""
    folder = new_path(pages.sparkSession, "warc")
    write(pages, folder, **options)
    return index(read(pages.sparkSession, folder))
