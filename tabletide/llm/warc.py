"""WARC archives through a chunked record table.

Writing. A page's payload is its html in UTF-8. Of equal payloads of `least` bytes or more the one with the largest
page_id is the response and the others are revisits of it; smaller payloads are responses each. Payloads go to the
writers as rows (page_id, chunk_no, chunk), made by Spark's own functions and sorted by record and number, so a writer
task holds one chunk and a compressor, never a record. Each task attempt writes archives of its own name, one gzip
member a record, to the shared folder; only the manifest of attempts that ended is read, so a lost or repeated attempt
leaves at most a file that nobody reads. A manifest row is a segment of whole records of about `segment` bytes.

Reading. A segment's records come back as rows (record, chunk_no, chunk) with the payload's running length and SHA-1
after each chunk; the last row of a record carries the whole payload's. Memory is one chunk, whatever the record's size.
A response whose digest differs from its header is an error.

The archive folder is opened with pyarrow.fs from its URI (file, hdfs, s3, gs, ...).

Cases: null html is an empty payload; a null url has no target header, and control characters and spaces in a url are
percent-encoded in the header; rows that repeat page_id and payload are records each, of the same type; rows that
repeat a page_id with other payloads are records each; an empty table writes no archive and gives an empty result; a
null page_id never names a response while the payload has another page; other columns are ignored."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletide.llm.common import materialize, scratch

MANIFEST = "path string, offset long, size long, records long"
CHUNKS = (
    "page_id long, record_type string, refers_to long, chunk_no long, chunk binary, bytes_so_far long, "
    "sha1_so_far string, last boolean, payload_bytes long, payload_digest string, url string"
)
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def record_types(pages: DataFrame, least: int = 1000) -> DataFrame:
    """A row for each distinct (page_id, payload): page_id, digest, payload_bytes, record_type, refers_to."""
    heads = pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("payload_bytes")).distinct()
    best = heads.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("first"))
    joined = heads.join(best, "digest", "left")
    revisit = F.coalesce((F.col("payload_bytes") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return joined.select(
        "page_id", "digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def chunk_table(pages: DataFrame, least: int = 1000, chunk: int = 1 << 20) -> DataFrame:
    """The rows that are written: a response has its payload in chunks, a revisit (and an empty payload) one empty chunk."""
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    kinds = record_types(pages, least).withColumnRenamed("page_id", "of").withColumnRenamed("digest", "of_digest")
    joined = own.join(kinds, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")))
    payload = F.when(F.col("record_type") == "response", F.col("html").cast("binary")).otherwise(F.lit(b""))
    n = F.greatest(F.ceil(F.octet_length("body") / chunk), F.lit(1)).cast("int")
    return (
        joined.withColumn("body", payload)
        .withColumn("record", F.monotonically_increasing_id())
        .withColumn("chunk_no", F.explode(F.sequence(F.lit(0), n - 1)))
        .select("record", "page_id", "url", "digest", "payload_bytes", "record_type", "refers_to", "chunk_no", F.substring("body", F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("chunk"))
    )


def header(row: dict, date: str) -> bytes:
    """The record's header and its HTTP header; the payload follows."""
    name = lambda x: f"<urn:page:{'null' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    own = row["payload_bytes"] if row["record_type"] == "response" else 0
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {name(row['page_id'])}", f"WARC-Date: {date}"]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"]))
    lines += [f"WARC-Payload-Digest: sha1:{row['digest']}", "Content-Type: application/http; msgtype=response"]
    if row["record_type"] == "revisit":
        lines += [f"WARC-Refers-To: {name(row['refers_to'])}", f"WARC-Profile: {REVISIT}"]
    lines.append(f"Content-Length: {len(http) + own}")
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def write_archives(chunks: DataFrame, folder: str, segment: int = 8 << 20, archive: int = 1 << 30, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write the rows of chunk_table, in the order in which they stand, and return the manifest, which is stored."""
    columns = ["page_id", "url", "digest", "payload_bytes", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_folder(folder)
        files.create_dir(path, recursive=True)
        out = packer = None
        name, start, records, done = "", 0, 0, []

        def end_record() -> None:
            out.write(packer.compress(b"\r\n\r\n") + packer.flush())

        for b in batches:
            for row in b.to_pylist():
                if row["chunk_no"] == 0:
                    if packer:
                        end_record()
                    if out and out.tell() - start >= segment:
                        done.append((name, start, out.tell() - start, records))
                        start, records = out.tell(), 0
                        if start >= archive:
                            out.close()
                            out = None
                    if not out:
                        name = f"{path}/{uuid.uuid4().hex}.warc.gz"
                        out, start = files.open_output_stream(name, compression=None), 0
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(packer.compress(header({k: row[k] for k in columns}, date)))
                    records += 1
                out.write(packer.compress(row["chunk"]))
        if packer:
            end_record()
            done.append((name, start, out.tell() - start, records))
            out.close()
        yield pa.record_batch([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["path", "offset", "size", "records"])

    return materialize(chunks.mapInArrow(run, MANIFEST), "warc-manifest")


class Part(io.RawIOBase):
    """Bytes [offset, offset + size) of an open file."""

    def __init__(self, file: pa.NativeFile, offset: int, size: int) -> None:
        self.file, self.left = file, size
        file.seek(offset)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer: bytearray) -> int:
        data = self.file.read(min(len(buffer), self.left))
        self.left -= len(data)
        buffer[: len(data)] = data
        return len(data)


def fields(source: gzip.GzipFile) -> dict[str, str]:
    """Header lines up to the empty one; the first line as ''."""
    found = {"": source.readline().decode().strip()}
    while (line := source.readline()) not in (b"\r\n", b""):
        k, _, v = line.decode().partition(":")
        found[k.strip().lower()] = v.strip()
    return found


def read_archives(manifest: DataFrame, folder: str, chunk: int = 1 << 20, with_chunks: bool = True) -> DataFrame:
    """The chunked record table of the segments of the manifest. Without with_chunks the chunk column is null."""
    number = lambda x: None if x in (None, "<urn:page:null>") else int(x[10:-1])

    def records(path: str, offset: int, size: int) -> Iterator[tuple]:
        with open_folder(folder)[0].open_input_file(path) as file, gzip.GzipFile(fileobj=io.BufferedReader(Part(file, offset, size), 1 << 16)) as source:
            while True:
                head = fields(source)
                if not head[""]:
                    break
                left, at = int(head["content-length"]), source.tell()
                http = fields(source)
                left -= source.tell() - at
                whole, said = int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha1:")
                so_far, digest, k = 0, hashlib.sha1(), 0
                fixed = (number(head["warc-record-id"]), head["warc-type"], number(head.get("warc-refers-to")))
                while True:
                    data = source.read(min(chunk, left))
                    digest.update(data)
                    so_far, left = so_far + len(data), left - len(data)
                    if not left and head["warc-type"] == "response" and (digest.hexdigest(), so_far) != (said, whole):
                        raise ValueError(f"{path}: record {head['warc-record-id']} isn't what its header says")
                    yield (*fixed, k, data if with_chunks else None, so_far, digest.hexdigest(), not left, whole, said, head.get("warc-target-uri"))
                    k += 1
                    if not left:
                        break
                source.readline()
                source.readline()

    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        pack = lambda rows: pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
        for b in batches:
            for s in b.to_pylist():
                for r in records(s["path"], s["offset"], s["size"]):
                    held.append(r)
                    size += len(r[4] or b"") + 200
                    if size >= 4 << 20:
                        yield pack(held)
                        held, size = [], 0
        if held:
            yield pack(held)

    return manifest.select("path", "offset", "size").repartition("path", "offset").mapInArrow(run, CHUNKS)


def round_trip(pages: DataFrame, least: int = 1000, chunk: int = 1 << 20) -> DataFrame:
    """Write the pages' records, read them back, and return one row a record from what the archives say: page_id,
    payload_bytes and payload_digest (of the full payload), record_type, refers_to, url."""
    folder = scratch(pages.sparkSession, "warc")
    manifest = write_archives(chunk_table(pages, least, chunk), folder)
    back = read_archives(manifest, folder, chunk, with_chunks=False).where("last")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
