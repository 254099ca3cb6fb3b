"""WARC archives: written as segmented records, read back by segment reassembly.

A record's block is an HTTP response whose body is the payload in chunked
transfer framing.  A block longer than ``SEGMENT`` bytes is cut into segments:
the first is the response record (WARC-Segment-Number 1), the others are
continuation records naming it by WARC-Segment-Origin-ID, the last with the
total length.  Equal payloads of at least ``REVISIT_FROM`` bytes are stored
once, by the page of largest id; the others become revisit records that name it.

Writing: one shuffle of the payloads by digest; each record is one row of
Spark's text writer with the record's closing CRLF CRLF as line separator, so
archives are committed (gzipped) like any other Spark output, on any file system.
Reading: whole archive files (bounded by ``FILE_RECORDS`` and by the writing
task), records by their Content-Length; continuation records are grouped by origin,
ordered by number, checked against the total length and de-chunked.

Edge cases: a null html is the empty payload, a null url leaves the target out.
Rows that repeat the largest id of their payload are all responses. A null
page_id comes back null; such a row revisits only if a row with an id shares its
payload. An incomplete or damaged block gives null bytes and digest, never a
crash. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch

SEGMENT, CHUNK, REVISIT_FROM, FILE_RECORDS = 16384, 4096, 1000, 1000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
RECORD_SCHEMA = "page_id long, type string, origin string, number int, total long, refers_to long, digest string, block binary"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunk(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP response, framed or not."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        return None
    return unchunk(body) if re.search(rb"(?i)^transfer-encoding:\s*chunked", head, re.M) else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without its closing CRLF CRLF; fields of value None are left out."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.0\r\n%bContent-Length: %d\r\n\r\n%b" % (head.encode(), len(block), block)


def records_of(page_id, uid: str, url: str | None, payload: bytes, digest: str, refers_to, date: str, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page: a revisit, or a response with its continuations."""
    me, target = f"<urn:page:{uid}>", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None
    common = [("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Page-ID", page_id)]
    if refers_to is not None:
        more = [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Refers-To-Page-ID", refers_to), ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")]
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", me), *common, *more], HTTP + b"\r\n")]
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = []
    for n, part in enumerate(parts, 1):
        fields = [("WARC-Type", "response" if n == 1 else "continuation"), ("WARC-Record-ID", me if n == 1 else f"<urn:page:{uid}:{n}>"), *common, ("WARC-Payload-Digest", f"sha1:{digest}" if n == 1 else None)]
        if len(parts) > 1:
            fields += [("WARC-Segment-Number", n), ("WARC-Segment-Origin-ID", me if n > 1 else None), ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)]
        out.append(record(fields, part))
    return out


def parse(data: bytes):
    """(header fields by lower-case name, block) of each record of an archive file."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields[k.strip().lower().decode("ascii", "replace")] = v.strip().decode("utf-8", "replace")
        n = int(fields.get("content-length", "0"))
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n


def write(pages: DataFrame, path: str, segment: int = SEGMENT, date: str = "2024-01-01T00:00:00Z") -> None:
    """``pages``: page_id, url, html -> archive files under ``path``."""
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    long_ = F.octet_length("html") >= REVISIT_FROM
    first = p.where(long_).groupBy(F.col("digest").alias("same")).agg(F.max("page_id").alias("first"))
    # short pages revisit none: they are dealt out by keys of their own, however many share a digest
    j = p.withColumn("same", F.when(long_, F.col("digest")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))).join(first, "same", "left")
    revisits = long_ & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = j.select("page_id", "url", "digest", F.when(revisits, F.col("first")).alias("refers_to"), F.when(revisits, F.lit(None)).otherwise(F.col("html")).alias("html"), F.monotonically_increasing_id().alias("row"))

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                uid = f"{r['page_id']}:{r['row']}"
                out += records_of(r["page_id"], uid, r["url"], (r["html"] or "").encode("utf-8", "surrogatepass"), r["digest"], r["refers_to"], date, segment)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    lines = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Archive files under ``path`` -> page_id, payload, digest_ok, record_type, refers_to, declared_digest of each page."""
    files = spark.read.format("binaryFile").load(path)

    def rows_of(content: bytes):
        number = lambda f, k: int(f[k]) if k in f else None
        for f, block in parse(content):
            n = number(f, "warc-segment-number")
            origin = f.get("warc-segment-origin-id") or f.get("warc-record-id")
            yield number(f, "warc-page-id"), f.get("warc-type"), origin, n, number(f, "warc-segment-total-length"), number(f, "warc-refers-to-page-id"), f.get("warc-payload-digest", "").removeprefix("sha1:"), block

    def run(batches):
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for b in batches:
            for content in b.column("content"):
                data = content.as_py()
                rows = rows_of(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
                while some := list(islice(rows, 500)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), kinds)], names=names)

    # archives are unpacked and parsed once
    records = materialize(files.select("content").mapInArrow(run, RECORD_SCHEMA), "warc-records")
    # segments of a block meet again by origin; their number is bounded by the block's own length
    part = F.struct("number", "block", "total")
    joined = records.where("number IS NOT NULL").groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.max(F.when(F.col("number") == 1, F.col("digest"))).alias("digest"),
        F.max(F.when(F.col("number") == 1, F.col("type"))).alias("type"), F.array_sort(F.collect_list(part)).alias("parts"),
    )
    in_order = F.transform("parts", lambda x: x["number"]) == F.sequence(F.lit(1), F.size("parts"))
    total = F.element_at("parts", -1)["total"]
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda acc, x: acc + F.octet_length(x["block"]))
    blocks = F.transform("parts", lambda x: x["block"])
    whole = F.when(in_order & (length == total), blocks)
    segmented = joined.select("page_id", "type", F.lit(None).cast("long").alias("refers_to"), "digest", whole.alias("blocks"))
    single = records.where("number IS NULL").select("page_id", "type", "refers_to", "digest", F.array("block").alias("blocks"))
    return single.unionByName(segmented)


def payloads(records: DataFrame) -> DataFrame:
    """Records of ``read`` with their decoded payload's length and SHA-1 (of responses; null for revisits and damaged blocks)."""

    def run(batches):
        for b in batches:
            n, sha, body = [], [], []
            for kind, blocks in zip(b.column("type").to_pylist(), b.column("blocks")):
                p = payload_of(b"".join(blocks.as_py())) if kind == "response" and blocks.is_valid else None
                n.append(None if p is None else len(p))
                sha.append(None if p is None else hashlib.sha1(p).hexdigest())
                body.append(p)
            cols = [b.column(c) for c in ("page_id", "type", "refers_to", "digest")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(body, pa.binary())], names=["page_id", "type", "refers_to", "digest", "payload_bytes", "payload_digest", "payload"])

    return records.mapInArrow(run, "page_id long, type string, refers_to long, digest string, payload_bytes long, payload_digest string, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder, read them back: one row a page with payload_bytes, payload_digest, record_type, refers_to.

    A revisit's length and digest are those of the response it names.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path)
    r = materialize(payloads(read(spark, path)).drop("payload"), "warc-pages")
    own = r.where("type = 'response'")
    named = own.where("payload_bytes IS NOT NULL").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("payload_bytes"))
    back = r.where("type = 'revisit'").drop("payload_bytes", "payload_digest").join(named, ["refers_to", "digest"], "left")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return own.withColumn("record_type", F.col("type")).select(cols).unionByName(back.withColumn("record_type", F.col("type")).withColumn("payload_digest", F.when(F.col("payload_bytes").isNotNull(), F.col("digest"))).select(cols))
