"""WARC archives: a writer with revisit records and a splittable reader.

Archives are gzip files with a member for each record. The reader divides every file into byte ranges;
a task scans its range for the gzip magic, takes a candidate only if its bytes decompress to a WARC
header and the member ends where the file or another gzip header follows, and owns the records that
start in its range, reading the last one beyond the range's end. Behind each record another must start: a reader raises
where none does, so no record is passed over without a word. So a file of any size is read by as
many tasks as it has ranges, and no index is needed. (A payload that itself is a gzip archive of WARC
records and is stored uncompressed could pass for records where a range starts within it.)

The writer leaves one file a task and a row for each file in a manifest; readers go by the manifest, so
files of lost or repeated attempts are never read.

Defined results: a null payload is empty; a null target leaves out its header; control and other
characters outside ASCII in a target are percent-encoded; a null id is written as such and read as null,
and nothing refers to it; of repeated rows of the largest id all are responses; no rows make no files;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir

MAGIC = b"\x1f\x8b\x08"
SPLIT, BLOCK = 16 << 20, 1 << 20
#: A header is looked for by so many bytes at a time.
HEADER = 1 << 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "path string, offset long, record_id string, record_type string, target string, refers_to string, payload_digest string, payload_length long, payload binary"


def _record_id(number: int | None, salt: str) -> str:
    return f"<urn:record:{number}>" if number is not None else f"<urn:record:none:{salt}>"



def record(number: int | None, target: str | None, payload: bytes, size: int, sha1_hex: str, refers_to: int | None, revisit: bool, salt: str, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """One gzip member. A revisit has the HTTP header alone, with the length of the payload it stands for."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(number, salt)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if target is not None:
        lines.append("WARC-Target-URI: " + quote(target, safe="!#$%&'()*+,/:;=?@[]~"))
    if revisit:
        lines += [f"WARC-Refers-To: {_record_id(refers_to, '')}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packed.flush()


def deduplicated(pages: DataFrame, id_col: str = "page_id", target_col: str = "url", payload_col: str = "html", least: int = 1000) -> DataFrame:
    """(id, target, payload, size, sha1, refers_to, revisit): of equal payloads of `least` bytes or more the largest id is the response."""
    keyed = pages.select(F.col(id_col).cast("long").alias("id"), F.col(target_col).alias("target"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    keyed = keyed.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    first = keyed.where(F.col("size") >= least).groupBy("sha1").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    joined = keyed.join(cut(first.select("sha1", "first")), "sha1", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return joined.select("id", "target", F.when(~revisit, F.col("payload")).alias("payload"), "size", "sha1", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of deduplicated() as archives under `folder`; returns the manifest (path, bytes, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get()
        name = f"part-{at.partitionId():06d}-{at.taskAttemptId()}"
        fs, root = pafs.FileSystem.from_uri(folder)
        path, n, size, out = f"{root}/{name}.warc.gz", 0, 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{path}.open")
                member = record(row["id"], row["target"], row["payload"] or b"", row["size"], row["sha1"], row["refers_to"], row["revisit"], f"{name}-{n}")
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            fs.move(f"{path}.open", path)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}.warc.gz"], "bytes": [size], "records": [n]})

    return cut(records.mapInArrow(run, "path string, bytes long, records long"))


class _Window:
    """Bytes of a file from a moving offset on, read a block at a time."""

    def __init__(self, file, size: int, at: int):
        self.file, self.size, self.at, self.data = file, size, at, b""

    def end(self) -> int:
        return self.at + len(self.data)

    def more(self) -> bool:
        if self.end() >= self.size:
            return False
        self.file.seek(self.end())
        got = self.file.read(min(BLOCK, self.size - self.end()))
        self.data += got
        return bool(got)

    def drop(self, to: int) -> None:
        self.data, self.at = self.data[to - self.at :], to

    def upto(self, n: int, offset: int) -> bytes:
        while self.end() < offset + n and self.more():
            pass
        return self.data[offset - self.at : offset - self.at + n]


def _is_record(window: _Window, offset: int) -> bool:
    """Whether a member at the offset decompresses to a WARC header, however long."""
    unpack, head, at = zlib.decompressobj(31), bytearray(), offset
    try:
        while not unpack.eof:
            data = unpack.unconsumed_tail
            if not data:
                data = window.upto(HEADER, at)
                at += len(data)
            got = unpack.decompress(data, HEADER)
            if not data and not got:
                return False
            head += got
            if len(head) >= 64 and not re.match(rb"WARC/\d+\.\d+\r\n", head):
                return False
            if head.find(b"\r\n\r\n", max(0, len(head) - len(got) - 3)) >= 0:
                break
    except zlib.error:
        return False
    return re.match(rb"WARC/\d+\.\d+\r\n", head) is not None and b"\r\n\r\n" in head


def _member(window: _Window, offset: int) -> tuple[bytes, int] | None:
    """(content, offset behind the member); None if it is damaged or what follows is no gzip member."""
    unpack, out, at = zlib.decompressobj(31), [], offset
    try:
        while not unpack.eof:
            data = window.upto(BLOCK, at)
            if not data:
                return None
            out.append(unpack.decompress(data))
            at += len(data) - len(unpack.unused_data)
    except zlib.error:
        return None
    after = window.upto(len(MAGIC), at)
    return (b"".join(out), at) if not after or after == MAGIC else None


def scan(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the records that start in [start, end) of an archive of `size` bytes.

    Behind a record and at the file's start another must stand, also where the next range begins: else the archive is damaged. So every byte
    belongs to a record that some range has read.
    """
    window = _Window(file, size, start)
    at, due = start, start == 0
    while at < end:
        window.drop(at)
        window.upto(BLOCK, at)
        found = window.data.find(MAGIC) if not due else 0
        if found < 0:
            if window.end() >= min(size, end + len(MAGIC)):
                return
            at = window.end() - len(MAGIC) + 1
            continue
        at += found
        if at >= end:
            return
        window.drop(at)
        got = _member(window, at) if _is_record(window, at) else None
        if got is not None:
            yield at, got[0]
            at, due = got[1], True
        elif due:
            raise ValueError(f"the archive is damaged: no record at byte {at}")
        else:
            at += 1
    window.drop(at)
    if due and at < size and not (_is_record(window, at) and _member(window, at)):
        raise ValueError(f"the archive is damaged: no record at byte {at}")


def parse(content: bytes) -> dict:
    """Fields of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields.get("content-length", len(rest)))]
    http, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    digest = base64.b32decode(digest).hex() if len(digest) == 32 else digest.lower()
    if fields.get("warc-type") == "response" and digest and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {fields.get('warc-record-id')} differs from its digest")
    return {
        "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "target": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
        "payload_digest": digest or None, "payload_length": int(length[1]) if length else len(payload), "payload": None if fields.get("warc-type") == "revisit" else payload,
    }


def read(manifest: DataFrame, split: int = SPLIT) -> DataFrame:
    """Rows (RECORD) of the archives of (path, bytes), by byte ranges of `split`."""
    ranges = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = pafs.FileSystem.from_uri(row["path"])
                rows, held = [], 0
                with fs.open_input_file(path) as file:
                    for offset, content in scan(file, row["bytes"], row["start"], min(row["bytes"], row["start"] + split)):
                        rows.append({"path": row["path"], "offset": offset} | parse(content))
                        held += len(content)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(n, "path", "start").mapInArrow(run, RECORD)


def archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", target_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes pages as archives, a new folder of the shared one by default, and returns their manifest."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return write(deduplicated(pages, id_col, target_col, payload_col), _qualified(pages.sparkSession, folder))


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system, as Spark itself takes a plain path; a file system other than the local one must be known to Arrow too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", found)


def digests(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target) of records: of responses from the payload itself, of revisits from the record."""
    own = F.col("payload").isNotNull()
    return records.select(
        F.expr("try_cast(nullif(regexp_extract(record_id, '^<urn:record:(-?[0-9]+)>$', 1), '') AS BIGINT)").alias("page_id"),
        F.when(own, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(own, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.expr("try_cast(nullif(regexp_extract(refers_to, '^<urn:record:(-?[0-9]+)>$', 1), '') AS BIGINT)").alias("refers_to"),
        "target",
    )
