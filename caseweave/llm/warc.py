"""WARC archives: a writer with revisit records, and a splittable reader.

Writer: every task writes record-at-a-time gzip members to files of its own under names no other attempt uses. The manifest, a table in
the shared folder, names the files that count.

Reader: a task gets a byte range of a file and scans it for the gzip magic. A candidate is taken for a member only if its header decodes to
a WARC version line and if members follow one another from it to the end of the range (or file), so that an archive stored inside a payload
is not mistaken for records. A task owns the records that start inside its range and reads past the end to finish the last.

Edges: a null payload is empty; a null url gives a record without target; control characters and spaces in urls are percent-encoded in the
header. Payloads below ``least`` bytes are never revisits. Among repeated rows with the same id and payload each is a response. Without an
id a row is a response, unless another with an id has its payload. An empty table gives no files and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, open_store, slices, work_folder

LEAST = 100
LEVEL = 6
SPLIT = 32 << 20
FILE_BYTES = 256 << 20
MAGIC = b"\x1f\x8b\x08"
WINDOW = 1 << 20
#: Enough compressed bytes to decode a version line.
PROBE = 4096
ID = "urn:x-page:"
RECORDS = "path string, position bigint, record_type string, record_id string, target_uri string, refers_to string, digest string, http_length bigint, payload binary"


def member(record: bytes) -> bytes:
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


def as_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: HTTP header and payload, or for a revisit the header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID}{refers_to}>"]
    block = http + payload if refers_to is None else http
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def written(folder: str, file_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = uri = None
        size = records = 0

        def done() -> pa.RecordBatch:
            stream.close()
            return pa.record_batch({"path": pa.array([uri]), "bytes": pa.array([size], pa.int64()), "records": pa.array([records], pa.int64())})

        for part in slices(batches):
            for row in zip(*(c.to_pylist() for c in part.columns)):
                if stream is not None and size >= file_bytes:
                    yield done()
                    stream = None
                if stream is None:
                    uri, size, records = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    store, path = open_store(uri)
                    stream = store.open_output_stream(path, compression=None)
                data = member(as_record(*row))
                stream.write(data)
                size += len(data)
                records += 1
        if stream is not None:
            yield done()

    return run


def with_revisits(pages: DataFrame, least: int = LEAST, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, payload, digest, refers_to): of rows with equal payloads of ``least`` bytes or more, that with the least key is referred to."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    digested = rows.withColumn("digest", F.sha2("payload", 256))
    keys = digested.where(F.octet_length("payload") >= least).select("key", "digest")
    first = materialize(keys.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    refers = F.when(F.col("key").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    return digested.join(first, "digest", "left").select("key", "url", "payload", "digest", refers.alias("refers_to"))


def write_warc(pages: DataFrame, folder: str | None = None, least: int = LEAST, file_bytes: int = FILE_BYTES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per row; returns the manifest (path, bytes, records)."""
    folder = folder or work_folder(pages.sparkSession, "warc")
    rows = with_revisits(pages, least, key, url, html)
    return materialize(rows.mapInArrow(written(folder, file_bytes), "path string, bytes bigint, records bigint").repartition(1))  # a row per file


def archives(spark, folder: str) -> DataFrame:
    """(path, bytes) of the archives of a folder, as Spark lists them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"))


class Members:
    """The gzip members of one file."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size = file, size

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(min(n, self.size - at))

    def opens_record(self, at: int) -> bool:
        """Whether a member at this place decodes to the start of a WARC record."""
        try:
            return zlib.decompressobj(31).decompress(self.read(at, PROBE), 16).startswith(b"WARC/")
        except zlib.error:
            return False

    def take(self, at: int, keep: bool) -> tuple[bytes, int]:
        """(data, end) of the member at this place; without ``keep`` the data is dropped."""
        inflate, parts, place = zlib.decompressobj(31), [], at
        while not inflate.eof:
            data = self.read(place, WINDOW)
            if not data:
                raise zlib.error("the member is cut off")
            place += len(data)
            part = inflate.decompress(data)
            if keep:
                parts.append(part)
        return b"".join(parts), place - len(inflate.unused_data)

    def next_magic(self, at: int, end: int) -> int:
        """First place of the magic in [at, end), else ``end``."""
        while at < end:
            data = self.read(at, min(WINDOW, end - at) + len(MAGIC) - 1)
            found = data.find(MAGIC)
            if found >= 0:
                return at + found
            at += WINDOW
        return end

    def chain(self, at: int, end: int) -> list[int] | None:
        """Starts of the members that follow one another from here to ``end``; None if they break off before."""
        starts = []
        while at < end:
            if not self.opens_record(at):
                return None
            starts.append(at)
            try:
                at = self.take(at, False)[1]
            except zlib.error:
                return None
        if at < self.size and not self.opens_record(at):
            return None
        return starts

    def owned(self, begin: int, end: int) -> list[int]:
        """Starts of the records that start in [begin, end). A candidate that opens a record but whose chain breaks off is either within a record or
        before a break of the archive; which of them, the members from the start of the file tell."""
        at = self.next_magic(begin, end)
        while at < end:
            if self.opens_record(at):
                starts = self.chain(at, end)
                return self.walked(begin, end) if starts is None else starts
            if at == 0:
                raise broken(0)
            at = self.next_magic(at + 1, end)
        return []

    def walked(self, begin: int, end: int) -> list[int]:
        """The same by following the members from the start of the file; an error if they break off."""
        at, starts = 0, []
        while at < end:
            if not self.opens_record(at):
                raise broken(at)
            if at >= begin:
                starts.append(at)
            try:
                at = self.take(at, False)[1]
            except zlib.error as error:
                raise broken(at) from error
        if at < self.size and not self.opens_record(at):
            raise broken(at)
        return starts


def broken(at: int) -> ValueError:
    return ValueError(f"the archive is broken: its members do not follow one another at byte {at}")


def parsed(data: bytes) -> tuple:
    """(type, id, target, refers to, digest, http length, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {n.strip().lower(): v.strip() for n, v in (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)}
    block = rest[: int(fields.get("content-length", len(rest)))]
    payload, length = block, None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        found = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        length = int(found[1]) if found else None
    bare = lambda name: (fields.get(name) or "").strip("<>") or None
    return fields.get("warc-type"), bare("warc-record-id"), fields.get("warc-target-uri"), bare("warc-refers-to"), fields.get("warc-payload-digest"), length, payload


def scanned(at_once: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORDS.split(", ")]
        kinds = [pa.int64() if "bigint" in f else pa.binary() if "binary" in f else pa.string() for f in RECORDS.split(", ")]
        for batch in batches:
            for path, size, begin, end in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "begin", "end"))):
                store, name = open_store(path)
                with store.open_input_file(name) as file:
                    members, rows, held = Members(file, size), [], 0
                    for at in members.owned(begin, end):
                        rows.append((path, at, *parsed(members.take(at, True)[0])))
                        held += len(rows[-1][-1])
                        if held >= at_once:
                            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                    if rows:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def read_warc(files: DataFrame, split: int = SPLIT, at_once: int = 4 << 20) -> DataFrame:
    """Every record of the files (path, bytes): RECORDS. Byte ranges of ``split`` bytes are dealt to tasks."""
    steps = F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split).cast("bigint"))
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(steps).alias("begin")).withColumn("end", F.least(F.col("begin") + split, F.col("bytes")))
    tasks = max(1, ranges.count())
    return ranges.repartition(tasks).mapInArrow(scanned(at_once), RECORDS)
