"""WARC archives: distributed writing with revisit records, and a reader that splits gzip files by byte range."""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import slices, small_batches, staged

#: Payloads under this many bytes are never replaced by a revisit record.
LEAST_REVISIT = 100
#: An archive file is closed, and the next one begun, at this size.
FILE_BYTES = 256 << 20
SPLIT_BYTES = 4 << 20
MAGIC = b"\x1f\x8b\x08"

FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("records", T.LongType())])
RECORDS = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType()),
    T.StructField("record_id", T.StringType()), T.StructField("intact", T.BooleanType()),
])
PAGE = re.compile(r"<urn:page:(\d*)>")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record: an HTTP response, or a revisit that has its headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict | None:
    """The fields of a whole record of any type, or None if it isn't one.

    The payload is the body of an HTTP message, else the whole block; its length and SHA-256 are those found. A record
    is intact if they, or a SHA-1, are as its headers say; other digests aren't checked. A revisit has no payload, and
    the length and digest of its headers. page_id and refers_to are null unless ids are those of write_warc().
    """
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
    length = fields.get("content-length", "")
    if not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n") or "warc-type" not in fields:
        return None
    kind, block = fields["warc-type"], rest[:-4]
    http, _, body = block.partition(b"\r\n\r\n")
    if not http.startswith(b"HTTP/"):
        http, body = b"", block
    said = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    n, intact = int(said[1]) if said else None, True
    if kind != "revisit":
        made = hashlib.sha256(body).hexdigest()
        known = {made, "", *(f"sha1:{f(hashlib.sha1(body).digest()).decode()}" for f in (base64.b32encode, binascii.hexlify))}
        intact = digest in known and n in (None, len(body)) or ":" in digest and not digest.startswith("sha1:")
        n, digest = len(body), made
    url = fields.get("warc-target-uri")
    number = lambda x: int(m[1]) if (m := PAGE.fullmatch(x)) and m[1] else None
    return {
        "page_id": number(fields.get("warc-record-id", "")), "url": None if url is None else re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url),
        "record_type": kind, "refers_to": number(fields.get("warc-refers-to", "")), "payload_bytes": n, "payload_digest": digest or None,
        "payload": None if kind == "revisit" else body, "record_id": fields.get("warc-record-id"), "intact": intact,
    }


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write one gzip member per page under `folder`, a folder that all executors share; returns (path, bytes, records).

    Of pages with equal payloads of at least LEAST_REVISIT bytes that with the smallest id is a response, the others
    revisit it; a null html is an empty payload. Pages with a null id are written without one; a group of equal
    payloads that has no id at all is all responses, as are repeated rows of the smallest id. Only files of tasks that
    succeeded are listed: a task that is run again writes files of new names. An empty table gives an empty list.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    long = F.octet_length("html") >= LEAST_REVISIT
    first = rows.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    first = staged(first.select("digest", "first"), "warc-first")  # its size on disk decides how it is joined
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{context.partitionId():05d}-{context.attemptNumber()}-{uuid.uuid4().hex}" if context else uuid.uuid4().hex
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        out, path, size, n, done = None, "", 0, 0, []
        for batch in batches:
            for part in slices(batch):
                columns = [part.column(part.schema.names.index(c)) for c in ("page_id", "url", "html", "digest", "refers_to")]
                for ident, target, payload, digest, to in zip(*(c.cast(pa.binary()).to_pylist() if i == 2 else c.to_pylist() for i, c in enumerate(columns)), strict=True):
                    if out is None:
                        path = f"{root}/{name}-{len(done)}.warc.gz"
                        out, size, n = store.open_output_stream(path, compression=None), 0, 0
                    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                    member = packer.compress(record_bytes(ident, target, payload, digest, to)) + packer.flush()
                    out.write(member)
                    size, n = size + len(member), n + 1
                    if size >= FILE_BYTES:
                        out.close()
                        done.append((f"{folder}/{path.rpartition('/')[2]}", size, n))
                        out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{path.rpartition('/')[2]}", size, n))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], names=FILES.names)

    small_batches(pages.sparkSession)
    return staged(rows.mapInArrow(run, FILES), "warc-files")


def read_range(uri: str, start: int, end: int) -> Iterator[tuple[int, int, dict]]:
    """(first byte, byte after it, record) of the gzip members that begin in [start, end) of a file; the last may run on beyond the end.

    Members are found by the gzip magic and accepted only if they decode to a whole record, so that a range may begin
    anywhere, also inside of a record: one that lies in another's payload as it is can't be told here (read_warc() does).
    A record is held in memory whole, the file is not; more is read in steps that grow with what is held.
    """
    store, path = _open(uri)
    with store.open_input_file(path) as f:
        f.seek(start)
        buffer, base, step = f.read(max(1 << 16, min(end - start, SPLIT_BYTES)) + 2), start, 1 << 18
        at = 0
        while True:
            at = buffer.find(MAGIC, at)
            if at < 0 or base + at >= end:
                if base + len(buffer) >= end + 2 or not (more := f.read(step)):
                    return
                keep = buffer[-2:]
                base, buffer, at = base + len(buffer) - len(keep), keep + more, 0
                continue
            unpack, raw, fed, size, whole = zlib.decompressobj(31), [], at, 0, False
            try:
                while True:
                    piece = buffer[fed : fed + (step if size else 1 << 10)]
                    fed += len(piece)
                    raw.append(unpack.decompress(piece))
                    size += len(raw[-1])
                    if 5 <= size <= 1 << 21 and not b"".join(raw[:8]).startswith(b"WARC/"):
                        break
                    if unpack.eof:
                        fed -= len(unpack.unused_data)
                        whole = True
                        break
                    if fed >= len(buffer):
                        if not (more := f.read(max(step, len(buffer) - at))):
                            break
                        buffer = buffer[at:] + more
                        base, fed, at = base + at, fed - at, 0
            except zlib.error:
                pass
            record = parse_record(b"".join(raw)) if whole else None
            if record is None:
                at += 1
                continue
            yield base + at, base + fed, record
            at = fed


def read_warc(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """All records of the listed files (path, bytes): page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, record_id, intact.

    Files are cut into byte ranges that tasks read on their own; see parse_record() for the columns. A range that begins
    inside of a record may find records in its payload, as of an archive in an archive. They all lie before the end of
    a record that began in an earlier range, and go: what is written and compared is a number for each range, so that the
    rows don't depend on the ranges. Archives of other writers may be read, one gzip member a record.
    """
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start")
    ranges = files.select("path", "bytes", at).where("bytes > 0")
    n = max(1, ranges.count())
    ranges = ranges.repartition(min(n, 100_000), "path", "start")
    placed = T.StructType([*RECORDS.fields, T.StructField("path", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("range", "first", "after")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[dict]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(placed.names, kinds, strict=True)], names=placed.names)

        for batch in batches:
            for row in batch.to_pylist():
                held, size = [], 0
                for first, after, record in read_range(row["path"], row["start"], min(row["start"] + split_bytes, row["bytes"])):
                    size += len(record["payload"] or b"")
                    held.append(record | {"path": row["path"], "range": row["start"], "first": first, "after": after} | ({} if payloads else {"payload": None}))
                    if size > 8 << 20:
                        yield packed(held)
                        held, size = [], 0
                if held:
                    yield packed(held)

    found = staged(ranges.mapInArrow(run, placed), "warc-records")
    reach = found.groupBy("path", "range").agg(F.max("after").alias("after"))
    before = F.max("after").over(W.partitionBy("path").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    reach = reach.withColumn("until", before).where(F.col("until") > F.col("range")).select("path", "range", "until")
    reach = staged(reach, "warc-reach")  # a row for each range that begins inside of a record
    owned = found.join(reach, ["path", "range"], "left").where(F.col("first") >= F.coalesce("until", F.lit(0)))
    return owned.select(*RECORDS.names)
