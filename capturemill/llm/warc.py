"""WARC archives: one gzip member per record, revisit records for repeated payloads, a splittable reader.

The reader cuts archives into byte ranges.  A task looks for gzip magic in its range, takes a
place for a member only if its first bytes decode to a WARC header, and owns the records that
start inside; the last may end beyond the range.  From a valid member the next one follows at
its end, so payload bytes that look like magic are not tried.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturemill.llm.common import byte_texts, releasing, saved, scratch
from capturemill.sources.ranges import file_system

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 16 << 20
# Beyond this many ranges a task reads several, one after the other.
MOST_TASKS = 50_000
BLOCK = 1 << 20
# Payloads below this size are never stored as revisits.
LEAST_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = ("path string, offset bigint, page_id bigint, url string, record_type string, refers_to bigint, "
           "payload_bytes bigint, payload_digest string, digest_matches boolean")


def plan_records(pages: DataFrame) -> DataFrame:
    """Each page with its digest and, where an equal payload belongs to a smaller page_id, that id.

    Only digests that occur twice or more are joined back; they are counted before the shuffle, and
    the skew join splits a payload that many pages share.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    digest = F.sha2(payload.cast("binary"), 256)
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), digest.alias("digest"))
    firsts = pages.where(F.octet_length(payload) >= LEAST_REVISIT).groupBy(digest.alias("digest")).agg(
        F.min(F.col("page_id").cast("long")).alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first_id")
    return known.join(firsts, "digest", "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))).drop("first_id")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A WARC record as one gzip member; a revisit keeps the HTTP header and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{_text(page_id)}>", f"WARC-Date: {date}"]
    if url is not None:
        # control characters would end the header line
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    record = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _text(page_id: int | None) -> str:
    return "null" if page_id is None else str(page_id)


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write one archive per task into the shared folder; gives (path, bytes, records), saved.

    Null html is an empty payload, a null url leaves its header out, rows with the same page_id and payload
    are all responses.  A task that runs again writes a new file; only files of the saved list count.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        path = f"{folder}/part-{task:05d}-{uuid.uuid4().hex}.warc.gz"
        size = records = 0
        out = None
        for batch in batches:
            payloads = byte_texts(batch["payload"])
            columns = [batch[c].to_pylist() for c in ("page_id", "url", "digest", "refers_to")]
            for payload, page_id, url, digest, refers_to in zip(payloads, *columns, strict=True):
                if out is None:
                    system, inner = file_system(path)
                    system.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(inner, compression=None)
                member = record_bytes(page_id, url, payload, digest, refers_to, date)
                out.write(member)
                size, records = size + len(member), records + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [records]})

    return saved(plan_records(pages).mapInArrow(releasing(write), "path string, bytes bigint, records bigint"), "warc-list")


class RangeReader:
    """Members that start inside one byte range of a file."""

    def __init__(self, path: str, start: int, end: int):
        system, inner = file_system(path)
        self.file = system.open_input_file(inner)
        self.start, self.end, self.size = start, end, self.file.size()
        self.data = self.file.read_at(min(end, self.size) - start, start)

    def _more(self) -> bool:
        at = self.start + len(self.data)
        if at >= self.size:
            return False
        self.data += self.file.read_at(min(BLOCK, self.size - at), at)
        return True

    def _head(self, at: int) -> bool:
        """Whether the bytes at ``at`` open a gzip member that starts with a WARC header."""
        while len(self.data) - at < 4096 and self._more():
            pass
        try:
            head = zlib.decompressobj(31).decompress(self.data[at:at + 4096], 512)
        except zlib.error:
            return False
        return head.startswith(b"WARC/1.") and b"\r\nWARC-Type:" in head

    def _member(self, at: int) -> tuple[bytes, int] | None:
        """The decoded member at ``at`` and the place of its end; None if it is damaged."""
        reader, out, fed = zlib.decompressobj(31), [], at
        try:
            while not reader.eof:
                if fed >= len(self.data) and not self._more():
                    return None
                part = self.data[fed:fed + BLOCK]
                fed += len(part)
                out.append(reader.decompress(part))
        except zlib.error:
            return None
        return b"".join(out), fed - len(reader.unused_data)

    def members(self) -> Iterator[tuple[int, bytes]]:
        at, last = 0, self.end - self.start
        while True:
            at = self.data.find(MAGIC, at)
            if at < 0 and len(self.data) < last + 2 and self._more():
                at = max(0, last - 2)
                continue
            if at < 0 or at >= last:
                return
            found = self._member(at) if self._head(at) else None
            if found is None:
                at += 1
                continue
            yield self.start + at, found[0]
            at = found[1]


def parsed(record: bytes) -> dict:
    """Fields of a decoded record of this module or any HTTP response record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip()
    block = rest[:int(fields.get(b"content-length", b"0"))]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?mi)^content-length:\s*(\d+)", http)
    return {
        "type": fields.get(b"warc-type", b"").decode(), "page_id": _page(fields.get(b"warc-record-id")),
        "url": _url(fields.get(b"warc-target-uri")), "refers_to": _page(fields.get(b"warc-refers-to")),
        "digest": fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha256:"), "payload": payload,
        "length": int(length[1]) if length else len(payload),
    }


def _page(name: bytes | None) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?\d+)>", name or b"")
    return int(found[1]) if found else None


def _url(value: bytes | None) -> str | None:
    return None if value is None else re.sub(
        r"%([01][0-9A-F]|7F|25)", lambda m: chr(int(m[1], 16)), value.decode("utf-8", "replace"))


def read_archives(spark: SparkSession, archives: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = False) -> DataFrame:
    """Records of the archives (path, bytes), one task per byte range.

    Gives one row per record; the digest and length of a response are computed from its whole payload, those of
    a revisit are read from its headers.  ``with_payload`` adds the payload, null for revisits.  No archives give no rows.
    """
    ranges = archives.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    count = max(1, archives.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 0)
    # ranges hold bytes, so rows need no balance
    spread = ranges.repartition(min(int(count), MOST_TASKS), "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
                rows, payloads = [], []
                for offset, record in RangeReader(path, start, start + range_bytes).members():
                    one = parsed(record)
                    revisit = one["type"] == "revisit"
                    digest = one["digest"] if revisit else hashlib.sha256(one["payload"]).hexdigest()
                    rows.append((path, offset, one["page_id"], one["url"], one["type"], one["refers_to"],
                                 one["length"] if revisit else len(one["payload"]), digest, digest == one["digest"]))
                    payloads.append(None if revisit else one["payload"])
                    if len(rows) >= 500:
                        yield _batch(rows, payloads, with_payload)
                        rows, payloads = [], []
                if rows:
                    yield _batch(rows, payloads, with_payload)

    return spread.mapInArrow(releasing(read), RECORDS + (", payload binary" if with_payload else ""))


def _batch(rows: list[tuple], payloads: list[bytes | None], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    names = [part.split()[0] for part in RECORDS.split(", ")]
    if with_payload:
        columns, names = [*columns, pa.array(payloads, pa.binary())], [*names, "payload"]
    return pa.RecordBatch.from_arrays(columns, names=names)
