"""WARC archives: a writer, and a reader that splits gzipped archives at any byte.

Each record is a gzip member of its own. The reader's tasks take byte ranges of the archives: a task looks for gzip's
magic bytes from its start, takes the first place where a member opens with a whole WARC header, and from there reads
record after record until one starts beyond its range. A record belongs to the range that its first byte is in, so
each is read once, however the ranges are laid.

Files are reached through Spark-independent but scheme-aware file systems, in the shared folder. A task's file has a
name of its own, and only files that a finished task reported are read; a task that is run again leaves no trace.

Defined results: a null html is an empty payload. Of pages with equal payloads of at least ``min_bytes``, the one with
the smallest page_id is the response; rows that repeat its page_id are responses too; a null page_id is a response
unless another page with an id has its payload. A null URL is an empty one. Further columns are ignored, and an empty
table gives empty archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, as_uri, shared_dir

MAGIC = b"\x1f\x8b\x08"
CHUNK, PART = 1 << 20, 1 << 16
ID = "urn:page:"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit that holds only the HTTP header."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url or ""))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID}{refers_to}>"]
    else:
        block += payload
    head += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


RESULT = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _page(urn: str | None) -> int | None:
    text = (urn or "").strip("<>").removeprefix(ID)
    return int(text) if text else None


def parse(data: bytes) -> tuple:
    """A row of RESULT from a whole record; a response's digest and length are worked out anew and must agree."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "response" and (len(payload), digest_of(payload)) != (size, digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return _page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), digest, size, payload


class _Bytes:
    """A file's bytes from a place on, read in chunks; ``at`` is the place in the file of the first byte not dropped."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.at, self.held, self.pos = file, at, b"", 0
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(CHUNK)
        self.held, self.pos = self.held[self.pos :] + got, 0
        return bool(got)

    def left(self) -> int:
        return len(self.held) - self.pos

    def peek(self, start: int, n: int) -> bytes:
        return self.held[self.pos + start : self.pos + start + n]

    def drop(self, n: int) -> None:
        self.pos, self.at = self.pos + n, self.at + n

    def to_magic(self) -> bool:
        """Drop what comes before the next magic bytes; whether there are any in what is held."""
        found = self.held.find(MAGIC, self.pos)
        self.drop(max(0, self.left() - len(MAGIC) + 1) if found < 0 else found - self.pos)
        return found >= 0


def _unpack(source: _Bytes) -> bytes | None:
    """The member at the source's place, which moves past it; None at the end of the file."""
    if not source.left() and not source.more():
        return None
    unpacker, out, start = zlib.decompressobj(31), [], source.at
    while not unpacker.eof:
        if not source.left() and not source.more():
            raise ValueError(f"the archive ends within the record at byte {start}")
        part = source.peek(0, PART)
        out.append(unpacker.decompress(part))
        source.drop(len(part) - len(unpacker.unused_data))
    return b"".join(out)


def _opens(source: _Bytes) -> bool:
    """Whether a member that begins with a whole WARC header stands at the source's place."""
    unpacker, out, used = zlib.decompressobj(31), b"", 0
    while True:
        try:
            out += unpacker.decompress(source.peek(used, 4096))
        except zlib.error:
            return False
        used = min(used + 4096, source.left())
        if out and not out.startswith(b"WARC/"[: len(out)]):
            return False
        if b"\r\n\r\n" in out:
            head = out.partition(b"\r\n\r\n")[0]
            return b"\r\nWARC-Record-ID: " in head and b"\r\nContent-Length: " in head
        if unpacker.eof or used >= source.left() and not source.more():
            return False


def read_range(file: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    """The records that start in the bytes from ``start`` up to ``end``."""
    source = _Bytes(file, start)
    while not (source.to_magic() and (source.at >= end or _opens(source))):  # to the first record
        if source.left() >= len(MAGIC):
            source.drop(1)  # magic bytes by chance
        elif source.at >= end or not source.more():
            return
    while source.at < end and (data := _unpack(source)) is not None:
        yield data


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 6) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); returns path and size of each file, a table."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"))
    pages = pages.withColumn("sha", F.sha1("html"))
    scratch = Scratch(pages.sparkSession, "warc-files")
    repeated = pages.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    repeated = scratch.table(repeated.where("n > 1").drop("n"), "repeated")  # so few, as a rule, that pages needn't be shuffled
    both = pages.join(repeated, "sha", "left")
    refers_to = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")), F.col("first_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        path, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
        out = None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                for row in zip(*(batch.column(k).slice(at, 64).to_pylist() for k in range(4)), strict=True):
                    member = _member(record(*row), level)
                    out.write(member)
                    size += len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rpartition('/')[2]}"]), pa.array([size], pa.int64())], ["path", "size"])

    return scratch.result(both.select("page_id", "url", "html", refers_to.alias("refers_to")).mapInArrow(run, "path string, size long"))


def read_archives(files: DataFrame, split_bytes: int = 128 << 20) -> DataFrame:
    """The rows of RESULT of all records in ``files`` (path, size), in ranges of ``split_bytes``; small files share tasks."""
    ranges = files.where("size > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    n, size = ranges.count(), files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(1, min(n, max(-(-size // split_bytes), 3 * files.sparkSession.sparkContext.defaultParallelism)))
    ranges = ranges.repartition(tasks, "path", "start")  # a fixed number: the rows are few, but each is much work

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as file:
                    rows: list[tuple] = []
                    held = 0
                    for data in read_range(file, start, start + split_bytes):
                        rows.append(parse(data))
                        held += len(data)
                        if held > 8 * CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return ranges.mapInArrow(run, RESULT)


def new_folder(pages: DataFrame) -> str:
    """A fresh folder for archives among the shared ones, as a URI."""
    return as_uri(f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}")
