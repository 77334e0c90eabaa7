"""Operator 1: legacy ARC archives to WARC.

An ARC file starts with a version block that names the fields of its record
header lines; version 1 has five (URL, IP, date, type, length), version 2 ten,
length last in both. Records are found by their declared lengths alone. Each
becomes a WARC record: identifier from payload digest and source row, date from
the 14 digits, a type (response, or revisit of an equal payload), and digests.

The archives are ordinary WARC/1.1 text: Spark's own writer puts them in the
shared folder, the line separator being the blank lines that end a record, so
commits, retries and any file system are Spark's affair.

Defined cases: null html is an empty payload; a null url becomes a urn with the
row's id; white space in a url is percent-encoded, as ARC fields are split at
it; rows with a null page_id are responses; repeated rows with one id and one
payload are both responses if the id is the payload's smallest.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, python_batches, table

LEAST_REVISIT = 100
FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def write_arc(rows, version: int, name: str = "pages.arc") -> bytes:
    """An ARC file of (url, 14-digit date, block)."""
    about = b"%d 0 foliant\n%s\n" % (version, FIELDS[version])
    head = b"filedesc://%s 0.0.0.0 20000101000000 text/plain" % name.encode()
    if version == 2:
        head += b" 200 - - 0 " + name.encode()
    out = [head + b" %d\n" % len(about), about, b"\n"]
    at = sum(map(len, out))
    for url, date, block in rows:
        line = b"%s 0.0.0.0 %s text/html" % (url.encode(), date.encode())
        if version == 2:
            line += b" 200 %s - %d %s" % (hashlib.md5(block).hexdigest().encode(), at, name.encode())
        out += [line + b" %d\n" % len(block), block, b"\n"]
        at += sum(map(len, out[-3:]))
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file: fields by the names its version block gives, block, offset.

    Stops at the end or at a header line that has no usable length.
    """
    at, names, version = 0, None, 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            return
        line = data[at:end].rstrip(b"\r")
        if not line:
            at = end + 1
            continue
        got = line.split(b" ")
        try:
            length = int(got[-1])
        except ValueError:
            return
        block = data[end + 1 : end + 1 + length]
        if names is None:
            about = block.split(b"\n")
            version = int(about[0].split(b" ")[0])
            names = (about[1] if len(about) > 1 and about[1].strip() else FIELDS.get(version, FIELDS[1])).decode().split(" ")
        else:
            # old crawlers left blanks in URLs: surplus fields belong to the first
            extra = len(got) - len(names)
            if extra > 0:
                got = [b"%20".join(got[: extra + 1]), *got[extra + 1 :]]
            yield dict(zip(names, (x.decode("utf-8", "replace") for x in got), strict=False)) | {"block": block, "offset": at, "version": version}
        at = end + 1 + length


def record_id(row, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{row}:{digest}'.encode()).digest()[:16])}>"


def warc_record(arc: dict, row, refers_to=None) -> bytes:
    """One WARC record, without the blank lines that end it."""
    payload = arc["block"].split(b"\r\n\r\n", 1)[-1]
    digest = hashlib.sha256(payload).hexdigest()
    d = (arc["Archive-date"] + "0" * 14)[:14]
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    block = b"" if refers_to is not None else arc["block"]
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(row, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {arc['URL']}",
        f"WARC-IP-Address: {arc['IP-address']}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http;msgtype=response",
        f"X-Source-Row: {'' if row is None else row}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block


def read_warc(stream) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of the records of a WARC stream, by their declared lengths."""
    while line := stream.readline():
        if not line.strip():
            continue
        head = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            head[k.strip()] = v.strip()
        yield head, stream.read(int(head["Content-Length"]))


def _uri(url, row) -> str:
    if url is None or not url.strip():
        return f"urn:row:{row}"
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def _to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for n, batch in enumerate(batches):
        for at in range(0, batch.num_rows, 64):
            ids, urls, pages, refs = (c.to_pylist() for c in batch.slice(at, 64).columns)
            dates = [(datetime(2000, 1, 1) + timedelta(seconds=(i or 0) % (1 << 30))).strftime("%Y%m%d%H%M%S") for i in ids]
            arc = write_arc([(_uri(u, i), d, HTTP + (p or "").encode()) for i, u, p, d in zip(ids, urls, pages, dates, strict=True)], 1 + n % 2)
            out = [warc_record(a, i, r) for a, i, r in zip(read_arc(arc), ids, refs, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def _from_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "record_type", "page_id", "refers_id", "payload_bytes", "payload_digest", "uri", "date"]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())))
            for head, block in read_warc(stream):
                payload = block.split(b"\r\n\r\n", 1)[-1]
                new = head["WARC-Type"] == "response"
                row = head.get("X-Source-Row", "")
                rows.append((
                    head["WARC-Record-ID"], head["WARC-Type"], int(row) if row else None, head.get("WARC-Refers-To"),
                    len(payload) if new else None, hashlib.sha256(payload).hexdigest() if new else None,
                    head["WARC-Target-URI"], head["WARC-Date"],
                ))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def convert_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives; rows of all records read back."""
    scratch = Scratch(spark, "warc")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keyed = p.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    sized = keyed.where(F.octet_length("html") >= LEAST_REVISIT).select("page_id", "digest")
    first = sized.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    again = sized.join(first, "digest").where("page_id <> first").select("page_id", "digest", "first").distinct()
    again = scratch.keep(again, "again")
    python_batches(spark)
    records = keyed.join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "first").mapInArrow(_to_warc, "record binary")
    path = scratch.path("warc")
    records.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 1000).text(path)
    python_batches(spark, 1)  # a row is a whole archive
    files = spark.read.format("binaryFile").load(path).select("content")
    back = scratch.keep(
        files.mapInArrow(_from_warc, "record_id string, record_type string, page_id long, refers_id string, payload_bytes long, payload_digest string, uri string, date string"),
        "back",
    )
    python_batches(spark)
    return back


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = convert_pages(spark, table(spark, sf_dir, "pages"))
    # equal ids and payloads give equal identifiers: one of them is enough
    whole = back.where("record_type = 'response'").dropDuplicates(["record_id"])
    whole = whole.selectExpr("record_id as refers_id", "page_id as refers_to", "payload_bytes as b", "payload_digest as d")
    return back.join(whole, "refers_id", "left").select(
        "page_id",
        F.coalesce("payload_bytes", "b").alias("payload_bytes"),
        F.coalesce("payload_digest", "d").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


ORACLE = f"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS f FROM p WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY 1)
SELECT p.page_id, payload_bytes, p.payload_digest,
  CASE WHEN f.f IS NULL OR f.f = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.f <> p.page_id THEN f.f END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
