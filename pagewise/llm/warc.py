"""WARC archives: written with segmented, chunked records, read back by segment reassembly.

Writing: every page becomes a WARC/1.1 record whose block is an HTTP response with the payload in chunked
transfer framing.  A block longer than ``SEGMENT_BYTES`` is cut into a first segment and continuation records.
Among records with equal payloads of at least ``REVISIT_BYTES`` bytes one is a response and the others revisit it.
The archives are written by Spark's text writer into the given folder, one record a row, with the two line breaks
that end a record as the row separator.

Reading: each archive is parsed by its records' lengths.  Continuation records are grouped by the identifier of
their origin, ordered by segment number and checked against the total length; the block's chunked framing is then
decoded.  An archive has at most ``RECORDS_PER_FILE`` records of at most ``SEGMENT_BYTES``, which bounds a task.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, by_bytes, work_folder, written

SEGMENT_BYTES = 64 << 10
RECORDS_PER_FILE = 1024
CHUNK_BYTES = 8 << 10
REVISIT_BYTES = 1000
#: A large group of equal payloads is dealt out over so many keys.
SALTS = 32
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


# --------------------------------------------------------------------------------------
# Framing and records
# --------------------------------------------------------------------------------------

def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i:i + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken or cut off.  Chunk extensions and
    trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(body[at:at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response, out of its transfer framing."""
    head, found, body = block.partition(END)
    if not found:
        raise ValueError("no end of the HTTP header")
    framed = any(line.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for line in head.split(b"\r\n"))
    return dechunked(body) if framed else body


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + END + block


def _line(value: str | None) -> str:
    """A header value: no line breaks."""
    return " ".join((value or "").split())


def records(page_id: int | None, record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None,
            segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The WARC records of a page, without the line breaks that end each of them."""
    own = [("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
           ("WARC-Target-URI", _line(url)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        own.append(("X-Page-ID", str(page_id)))
    http = [("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        return [_record("revisit", [*own, ("WARC-Refers-To", f"<urn:uuid:{refers_to}>"),
                                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *http],
                        b"HTTP/1.1 200 OK" + END)]
    block = HTTP + chunked(payload)
    if len(block) <= segment_bytes:
        return [_record("response", own + http, block)]
    out = []
    for n, i in enumerate(range(0, len(block), segment_bytes), 1):
        piece, last = block[i:i + segment_bytes], i + segment_bytes >= len(block)
        if n == 1:
            out.append(_record("response", [*own, ("WARC-Segment-Number", "1"), *http], piece))
            continue
        fields = [("WARC-Record-ID", f"<urn:uuid:{record_id[:-4]}{n & 0xffff:04x}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
                  ("WARC-Segment-Origin-ID", f"<urn:uuid:{record_id}>"), ("WARC-Segment-Number", str(n))]
        out.append(_record("continuation", fields + [("WARC-Segment-Total-Length", str(len(block)))] * last, piece))
    return out


def parse(archive: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names; ``warc-type`` and so on) and block of each record of an archive."""
    while True:
        line = archive.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := archive.readline()).strip():
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = archive.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError("a record is cut off")
        yield fields, block


# --------------------------------------------------------------------------------------
# Writing
# --------------------------------------------------------------------------------------

def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "payload"):
        cols = (batch.column(c).to_pylist() for c in ("page_id", "record_id", "url", "payload", "digest", "refers_to"))
        out = [r for row in zip(*cols) for r in records(*row)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def _record_id(page_id: F.Column, uid: F.Column) -> F.Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("")), uid.cast("string")).cast("binary"))
    # the last four digits count the segments
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"),
                    F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 8), F.lit("0001"))


def write_archives(pages: DataFrame, folder: str) -> None:
    """Write a record for each row of ``pages(page_id, url, html)`` into gzipped archives in ``folder``.

    Null html is an empty payload.  Of rows with equal payloads of at least ``REVISIT_BYTES`` bytes that with the
    largest page_id is the response (null ids count as least; of repeated rows the last one read); the others
    revisit it.  Equal means equal SHA-1 and length.  An empty table gives no records; other columns are not read."""
    rows = pages.select(F.monotonically_increasing_id().alias("uid"), F.col("page_id").cast("bigint").alias("page_id"),
                        F.col("url").cast("string").alias("url"),
                        F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"))
    # the response of each group of equal payloads: one row a group, pre-aggregated in every task
    groups = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(
        F.max(F.struct("page_id", "uid")).alias("top"), F.count("*").alias("n")).where("n > 1")
    tops = written(groups.select(F.col("digest").alias("of"), F.col("size").alias("of_size"), "top"), "warc-responses")
    salted = tops.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = rows.withColumn("own", F.pmod(F.col("uid"), F.lit(SALTS)).cast("int")).join(
        broadcast_if_small(salted, 100), (F.col("digest") == F.col("of")) & (F.col("size") == F.col("of_size")) & (F.col("own") == F.col("salt")), "left")
    refers = F.when(F.col("top.uid") != F.col("uid"), _record_id(F.col("top.page_id"), F.col("top.uid")))
    out = joined.select("page_id", _record_id(F.col("page_id"), F.col("uid")).alias("record_id"), "url", "payload", "digest", refers.alias("refers_to"))
    text = out.mapInArrow(_encode, "record binary").select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


# --------------------------------------------------------------------------------------
# Reading
# --------------------------------------------------------------------------------------

_FIELDS = ("record_id string, page_id long, url string, record_type string, refers_id string, origin string, "
           "segment int, total long, told_digest string, block binary")
_TYPES = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                    ("refers_id", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()),
                    ("told_digest", pa.string()), ("block", pa.binary())])


def _uuid(value: str | None) -> str | None:
    return value.removeprefix("<urn:uuid:").rstrip(">") if value else None


def _number(value: str | None) -> int | None:
    return int(value) if value else None


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows: list[tuple] = []
            held = 0
            with gzip.GzipFile(fileobj=io.BytesIO(content.as_py())) as archive:
                for f, block in parse(archive):
                    rows.append((_uuid(f.get("warc-record-id")), _number(f.get("x-page-id")), f.get("warc-target-uri"), f["warc-type"],
                                 _uuid(f.get("warc-refers-to")), _uuid(f.get("warc-segment-origin-id")), _number(f.get("warc-segment-number")),
                                 _number(f.get("warc-segment-total-length")), f.get("warc-payload-digest"), block))
                    held += len(block)
                    if held > 4 << 20:
                        yield _batch(rows, _TYPES)
                        rows, held = [], 0
            yield _batch(rows, _TYPES)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)


def reassembled(records_: DataFrame) -> DataFrame:
    """Whole records from parsed ones, with a column ``error`` (null if the record is whole).

    Records without a segment number are whole.  Segments are grouped by their origin's identifier and ordered
    by number; the numbers must run from 1 without a gap, the last must state the total length, and the blocks
    must add up to it.  Of a segment that was written twice one copy counts.  A group is one record's block."""
    single = records_.where("segment is null").select(*(c for c in records_.columns if c not in ("origin", "segment", "total")), F.lit(None).cast("string").alias("error"))
    parts = records_.where("segment is not null").withColumn("of", F.coalesce("origin", "record_id"))
    first = {c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("page_id", "url", "record_type", "refers_id", "told_digest")}
    groups = parts.groupBy("of").agg(F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"), *first.values())
    block = F.aggregate("parts", F.lit(b""), lambda s, p: F.concat(s, p["block"]))
    groups = groups.withColumn("block", block)
    n = F.size("parts")
    error = (F.when(F.col("parts")[0]["segment"] != 1, "the first segment is missing")
             .when(F.element_at("parts", -1)["segment"] != n, "a segment is missing or differs from its copy")
             .when(F.col("total").isNull(), "the last segment is missing")
             .when(F.octet_length("block") != F.col("total"), "the segments do not add up to the total length"))
    whole = groups.select(F.col("of").alias("record_id"), "page_id", "url", "record_type", "refers_id", "told_digest", "block", error.alias("error"))
    return single.unionByName(whole.select(*single.columns))


def _decoded(keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "block"):
            size, digest, payloads, errors = [], [], [], []
            for kind, block, error, told in zip(*(batch.column(c).to_pylist() for c in ("record_type", "block", "error", "told_digest"))):
                payload = None
                if error is None and kind == "response":
                    try:
                        payload = payload_of(block)
                    except ValueError as broken:
                        error = f"the transfer framing is broken: {broken}"
                own = None if payload is None else hashlib.sha1(payload).hexdigest()
                if own is not None and told is not None and told != f"sha1:{own}":
                    error = "the payload does not have the digest that is told"
                size.append(None if payload is None else len(payload))
                digest.append(own)
                payloads.append(payload if keep_payload else None)
                errors.append(error)
            cols = [batch.column(c) for c in ("record_id", "page_id", "url", "record_type", "refers_id")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(payloads, pa.binary()),
                                              pa.array(errors, pa.string())],
                                             names=["record_id", "page_id", "url", "record_type", "refers_id", "payload_bytes", "payload_digest", "payload", "error"])
    return run


def read_archives(spark: SparkSession, folder: str, keep_payload: bool = True) -> DataFrame:
    """The records of the archives in ``folder``: identifier, page id, URL, type, what a revisit refers to, the
    payload's length, SHA-1 and bytes (null for revisits and broken records) and ``error``.  A broken record is
    told, not dropped; continuation records are part of their origin's row."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    parsed = files.mapInArrow(_parsed, _FIELDS)
    return reassembled(parsed).mapInArrow(_decoded(keep_payload), "record_id string, page_id long, url string, record_type string, refers_id string, "
                                          "payload_bytes long, payload_digest string, payload binary, error string")


def resolved(records_: DataFrame) -> DataFrame:
    """Records with the length and digest of the full payload: a revisit takes those of the response that it
    refers to (``refers_to``: that response's page id).  A revisit whose response is missing has an error."""
    whole = written(records_.drop("payload"), "warc-records")
    revisits = whole.where("record_type = 'revisit'")
    named = revisits.select(F.col("refers_id").alias("named")).distinct()
    targets = written(whole.where("record_type = 'response'").join(named, F.col("record_id") == F.col("named"), "left_semi").select(
        F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("sha")), "warc-targets")
    salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = revisits.withColumn("own", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int")).join(
        broadcast_if_small(salted, 120), (F.col("refers_id") == F.col("target")) & (F.col("own") == F.col("salt")), "left")
    told = told.select("record_id", "page_id", "url", "record_type", "refers_to", F.col("bytes").alias("payload_bytes"), F.col("sha").alias("payload_digest"),
                       F.coalesce("error", F.when(F.col("target").isNull(), "the response is missing")).alias("error"))
    own = whole.where("record_type != 'revisit'").withColumn("refers_to", F.lit(None).cast("bigint"))
    return own.select(*told.columns).unionByName(told)


def op2(spark, pages: DataFrame) -> DataFrame:
    """Write the archives, read them back, and tell each page's payload and record."""
    folder = work_folder(spark, "warc")
    write_archives(pages, folder)
    if pages.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, error string")
    return resolved(read_archives(spark, folder, keep_payload=False)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
