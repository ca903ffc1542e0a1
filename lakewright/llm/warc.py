"""WARC archives as a Python data source, to write and to read.

Reading: partitions are planned from the manifest (or the files found, one partition each, for archives made elsewhere).
Filters on record type and other header columns are pushed down; a record's headers are parsed first, and the payload of
a record that fails them, or that the reader was told not to want, is skipped without being read or decoded.
Writing: every task attempt writes files of its own name and bounded size; the manifest of a committed write names those that
count, so a lost executor or a repeated attempt leaves nothing a reader would see.

Compressed archives have a gzip member per record. Members written here carry their length in an extra field, so a
reader inflates a record's headers and jumps over the rest; members of others are inflated one after the other.

Folders are reached through ``pyarrow.fs``, so a file system Arrow knows is needed: local, shared mounts, HDFS, S3, GCS.

Edge cases: a missing payload is an empty one; a missing URL leaves the header out; line breaks in a header value become
blanks; repeated rows give repeated records; an empty table writes a manifest without files and reads back as no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes bigint, payload binary"
WRITTEN = "record_id string, record_type string, target_uri string, refers_to string, payload binary, payload_digest string, payload_bytes bigint"
ARROW = pa.schema(
    [(c, pa.string()) for c in ("record_id", "record_type", "target_uri", "date", "payload_digest", "refers_to")]
    + [("payload_bytes", pa.int64()), ("payload", pa.binary())]
)
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPLIT_BYTES = 32 << 20
FILE_BYTES = 256 << 20
BATCH_BYTES = 4 << 20


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/")


def digest_to_hex(value: str | None) -> str | None:
    """Bare lower-case hexadecimal SHA-1 of a digest header in base 32 or hexadecimal."""
    if value is None:
        return None
    value = value.rpartition(":")[2]
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def header(name: str, value: object) -> bytes:
    return f"{name}: {' '.join(str(value).splitlines())}\r\n".encode()


def record_bytes(row: dict, date: str) -> bytes:
    """One record. A revisit keeps the HTTP headers of its payload, with the length, and not the payload."""
    revisit = row["record_type"] == "revisit"
    payload = row["payload"] or b""
    size = row["payload_bytes"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + header("Content-Length", size) + b"\r\n"
    block = http if revisit else http + payload
    head = b"WARC/1.1\r\n" + header("WARC-Type", row["record_type"]) + header("WARC-Record-ID", f"<{row['record_id']}>") + header("WARC-Date", date)
    if row["target_uri"] is not None:
        head += header("WARC-Target-URI", row["target_uri"])
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    head += header("WARC-Payload-Digest", f"sha1:{digest}")
    if revisit:
        head += header("WARC-Refers-To", f"<{row['refers_to']}>") + header("WARC-Profile", REVISIT_PROFILE)
    head += header("Content-Type", "application/http; msgtype=response") + header("Content-Length", len(block))
    return head + b"\r\n" + block + b"\r\n\r\n"


SKIP = struct.Struct("<4B4x2BH2sHI")  # gzip header with one extra field, "sl": the length of the whole member


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = SKIP.pack(0x1F, 0x8B, 8, 4, 0, 255, 8, b"sl", 4, SKIP.size + len(body) + 8)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def member_length(head: bytes) -> int | None:
    """Length of the member that starts so, if it carries one."""
    if len(head) < SKIP.size:
        return None
    a, b, _, flags, _, _, extra, name, size, length = SKIP.unpack(head)
    return length if (a, b, flags, extra, name, size) == (0x1F, 0x8B, 4, 8, b"sl", 4) else None


class _Inflate(io.RawIOBase):
    """The content of a member, inflated only as far as it is read."""

    def __init__(self, source, length: int):
        self.source, self.left, self.unpack, self.rest = source, length, zlib.decompressobj(-15), b""

    def readable(self):
        return True

    def readinto(self, buffer):
        while not self.unpack.eof:
            if not self.rest and self.left:
                self.rest = self.source.read(min(self.left, 1 << 16))
                self.left -= len(self.rest)
            data = self.unpack.decompress(self.rest, len(buffer))
            self.rest = self.unpack.unconsumed_tail
            if data:
                buffer[: len(data)] = data
                return len(data)
            if not self.rest and not self.left:
                break
        return 0


def read_headers(stream: io.BufferedIOBase) -> dict | None:
    """Headers up to the empty line, names in lower case, and their size as ``bytes``; None at the end of the stream."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    found, size = {"": line.decode("utf-8", "replace").strip()}, len(line)
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
        size += len(line)
    return found | {"bytes": size + len(line)}


@dataclass
class Piece(InputPartition):
    """Parts of files: path, first byte, end byte (-1: to the end)."""

    parts: list[tuple[str, int, int]]


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for test in filters:
            if isinstance(test, (EqualTo, In, IsNotNull, IsNull, StringStartsWith)) and len(test.attribute) == 1 and test.attribute[0] in HEADERS:
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> list[InputPartition]:
        system, root = open_folder(self.path)
        names = [x for x in system.get_file_info(fs.FileSelector(root, recursive=False)) if x.is_file]
        manifests = [x for x in names if x.base_name.startswith("_manifest-")]
        if manifests:
            files = [f for m in manifests for f in json.loads(system.open_input_stream(m.path).read())]
            parts = [(f"{root}/{f['name']}", a, b) for f in files for a, b in zip(f["splits"], [*f["splits"][1:], f["bytes"]]) if b > a]
        else:
            parts = [(x.path, 0, -1) for x in names if x.base_name.endswith((".warc", ".warc.gz"))]
        pieces, held = [Piece([])], 0
        for part in sorted(parts):
            size = part[2] - part[1] if part[2] >= 0 else self.split
            if held and held + size > self.split:
                pieces.append(Piece([]))
                held = 0
            pieces[-1].parts.append(part)
            held += size
        return pieces

    def wanted(self, row: dict) -> bool:
        for test in self.tests:
            value = row[test.attribute[0]]
            if isinstance(test, IsNull):
                ok = value is None
            elif isinstance(test, IsNotNull):
                ok = value is not None
            elif value is None:
                ok = False
            elif isinstance(test, EqualTo):
                ok = value == test.value
            elif isinstance(test, In):
                ok = value in test.value
            else:
                ok = value.startswith(test.value)
            if not ok:
                return False
        return True

    def record(self, stream: io.BufferedIOBase) -> tuple[dict | None, int]:
        """The next record, None if it is not wanted, and how many bytes of it are left unread (-1: no record)."""
        found = read_headers(stream)
        if found is None:
            return None, -1
        left = int(found.get("content-length", 0))
        row = {c: found.get(name) for c, name in HEADERS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c] and row[c].strip("<>")
        row["payload_digest"] = digest_to_hex(row["payload_digest"])
        if not self.wanted(row):
            return None, left
        row |= {"payload_bytes": left, "payload": None}
        if found.get("content-type", "").startswith("application/http"):
            http = read_headers(stream) or {}
            left -= http.get("bytes", 0)
            row["payload_bytes"] = int(http.get("content-length", left))
        if self.payload and left:
            row["payload"] = stream.read(left)
            left = 0
        return row, left

    def records(self, path: str, start: int, end: int) -> Iterator[dict]:
        """Records that start in the given part of a file."""
        system, _ = open_folder(self.path)
        with system.open_input_file(path) as source:
            source.seek(start)
            if not path.endswith(".gz"):
                stream = io.BufferedReader(_From(source), 1 << 16)
                while end < 0 or stream.tell() < end:
                    row, left = self.record(stream)
                    if left < 0:
                        return
                    if row:
                        yield row
                    if left:
                        stream.seek(left, 1)
                return
            while end < 0 or start < end:
                length = member_length(source.read(SKIP.size))
                source.seek(start)
                if length is None:
                    break
                source.seek(start + SKIP.size)
                row, _ = self.record(io.BufferedReader(_Inflate(source, length - SKIP.size - 8), 1 << 12))
                if row:
                    yield row
                start += length
                source.seek(start)
            else:
                return
            stream = gzip.GzipFile(fileobj=source)
            while (got := self.record(stream))[1] >= 0:
                if got[0]:
                    yield got[0]
                stream.read(got[1])

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for path, start, end in partition.parts:
            for row in self.records(path, start, end):
                held.append(row)
                size += len(row["payload"] or b"") + 200
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(held, ARROW)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, ARROW)


class _From(io.RawIOBase):
    """An Arrow file as a raw stream, for buffering."""

    def __init__(self, source):
        self.source = source

    def readable(self):
        return True

    def seekable(self):
        return True

    def tell(self):
        return self.source.tell()

    def seek(self, to, whence=0):
        to += self.source.tell() if whence == 1 else self.source.size() if whence == 2 else 0
        self.source.seek(to)
        return to

    def readinto(self, buffer):
        data = self.source.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.gzip = options.get("compression", "none") == "gzip"
        self.limit = int(options.get("filebytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = open_folder(self.path)
        system.create_dir(root, recursive=True)
        files, out = [], None
        for batch in iterator:
            for row in batch.to_pylist():
                data = record_bytes(row, self.date)
                if self.gzip:
                    data = gzip_member(data)
                if out is not None and files[-1]["bytes"] + len(data) > self.limit:
                    out.close()
                    out = None
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    files.append({"name": name, "bytes": 0, "splits": [0]})
                last = files[-1]
                if last["bytes"] - last["splits"][-1] >= SPLIT_BYTES:
                    last["splits"].append(last["bytes"])
                out.write(data)
                last["bytes"] += len(data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = open_folder(self.path)
        system.create_dir(root, recursive=True)
        before = [x.path for x in system.get_file_info(fs.FileSelector(root)) if x.base_name.startswith("_manifest-")] if self.overwrite else []
        files = [f for m in messages if m for f in m.files]
        with system.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())
        for path in before:
            system.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = open_folder(self.path)
        for m in messages:
            for f in m.files if m else []:
                system.delete_file(f"{root}/{f['name']}")


class WarcSource(DataSource):
    """``format("warc")``: options path, payload (read payloads or not), splitBytes, date, compression, fileBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known to the session and let filters reach it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, **options: object) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(path=path, **options).load()


def page_records(pages: DataFrame, least: int = 1000, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows to write for pages: payloads of at least ``least`` bytes that several pages share are kept once.

    The page with the largest id keeps the payload as a response, the others become revisits of it. Only digests that
    occur again are joined back, so most pages meet no partner; adaptive execution splits the rows of a hot digest.
    """
    content = F.coalesce(F.col(html), F.lit("")).cast("binary")
    sized = pages.select(
        F.col(key).alias("id"), F.col(url).alias("url"), content.alias("payload"), F.sha1(content).alias("digest"), F.octet_length(content).cast("bigint").alias("size")
    )
    groups = (
        sized.filter(F.col("size") >= least)
        .groupBy(F.col("digest").alias("same"), F.col("size").alias("same_size"))
        .agg(F.max("id").alias("kept"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    joined = sized.join(groups, (F.col("digest") == F.col("same")) & (F.col("size") == F.col("same_size")), "left")
    revisit = F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("id"))

    def name(column: str):
        return F.concat(F.lit("urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("")))

    return joined.select(
        name("id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(revisit, name("kept")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.col("digest").alias("payload_digest"),
        F.col("size").alias("payload_bytes"),
    )


def write_warc(spark: SparkSession, records: DataFrame, path: str, mode: str = "append", **options: object) -> None:
    """Write rows as ``page_records`` gives them."""
    register(spark)
    records.select(*[c.split()[0] for c in WRITTEN.split(", ")]).write.format("warc").options(path=path, **options).mode(mode).save()
