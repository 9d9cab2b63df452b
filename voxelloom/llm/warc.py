"""WARC archives as a Python data source.

Reading plans partitions from the archives' sizes, takes predicates on record
type and headers from Spark, parses a record's headers before anything else,
and neither inflates nor decodes the payload of a record that is not wanted:
each record is a gzip member of its own whose `sl` extra field says how many
bytes to skip. Members without that field are inflated to find their end. An
archive above the size of a partition is cut between members, as far as `sl`
fields tell where those are.

Writing makes archives of `archiveBytes` at most, in a folder of the write's own,
and moves them into place on commit; commit and abort remove that folder, so a
task that fails, or is lost and run again, leaves nothing behind.

Of records with equal payloads of at least `least` bytes, the one with the
largest id is a response and the others are revisits that refer to it.

Null payloads are empty. Null ids are written as empty ones and refer to nothing;
null urls are empty. Repeated rows that share the largest id are all responses.
An empty table makes no archive and reads back as no rows. Other columns are
ignored."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from voxelloom.storage import located

from .common import durable, in_small_batches, lookup, set_where_unset

SCHEMA = (
    "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, "
    "payload_bytes long, headers map<string,string>, payload binary"
)
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]
#: Columns that come from headers alone and take equality predicates.
HEADER = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
END = b"\r\n\r\n"
#: Least and most bytes of archives that one task reads, unless told otherwise.
LEAST_READ, MOST_READ = 4 << 20, 64 << 20


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member with its packed and full sizes in an `sl` field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 12 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + struct.pack("<IBB", 0, 0, 255) + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(record_id: str, uri: str, payload: bytes, refers_to: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(uri, safe=':/?#[]@!$&()*+,;=%~-._')}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[5:5] = [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + END + block + END


def parse_headers(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")
    return {name.strip(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:]) if value}


@dataclass
class Archives(InputPartition):
    """Parts of archives: path, where the first member starts, and where to stop
    (-1: at the end)."""

    parts: list[tuple[str, int, int]] = field(default_factory=list)
    size: int = 0


#: Bytes of a member that tell its size.
HEAD = 24


def packed_size(head: bytes) -> int | None:
    """A member's size from its `sl` field, None without one."""
    has_size = len(head) == HEAD and head[:2] == b"\x1f\x8b" and head[3] & 4 and head[12:14] == b"sl"
    return struct.unpack("<I", head[16:20])[0] if has_size else None


class Inflater:
    """A member's bytes, as far as they are asked for."""

    def __init__(self, file: pa.NativeFile, start: int):
        self.file, self.start = file, start
        file.seek(start)
        self.raw = file.read(HEAD)
        size = packed_size(self.raw)
        self.end = None if size is None else start + size
        self.inflate, self.data, self.fed = zlib.decompressobj(31), bytearray(), False

    def more(self, step: int) -> bool:
        if self.inflate.eof:
            return False
        packed = self.inflate.unconsumed_tail or (self.raw if not self.fed else self.file.read(self._span(step)))
        self.fed = True
        if not packed:
            return False
        self.data += self.inflate.decompress(packed, step)
        return True

    def _span(self, step: int) -> int:
        return step if self.end is None else max(0, min(step, self.end - self.file.tell()))

    def until(self, mark: bytes, at: int = 0) -> int:
        """Where mark ends; -1 at the member's end."""
        while (found := self.data.find(mark, at)) < 0:
            at = max(at, len(self.data) - len(mark) + 1)
            if not self.more(2048):
                return -1
        return found + len(mark)

    def upto(self, size: int) -> bytearray:
        while len(self.data) < size and self.more(1 << 16):
            pass
        return self.data

    def close(self) -> int:
        """Where the next member starts."""
        if self.end is None:
            while self.more(1 << 16):
                self.data.clear()
            self.end = self.file.tell() - len(self.inflate.unused_data)
        return self.end


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        options = {name.lower(): value for name, value in options.items()}
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.most = int(options.get("partitionbytes", MOST_READ))
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for test in filters:
            column = test.attribute[0] if isinstance(test, EqualTo | In) and len(test.attribute) == 1 else None
            if column in HEADER:
                values = {test.value} if isinstance(test, EqualTo) else set(test.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield test

    def partitions(self) -> Sequence[InputPartition]:
        system, root = located(self.path)
        infos = system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if system.get_file_info(root).type != fs.FileType.File else [system.get_file_info(root)]
        files = sorted((i for i in infos if i.type == fs.FileType.File and i.base_name[0] not in "._"), key=lambda i: (-i.size, i.path))
        plans: list[Archives] = []
        for info in files:
            for start, stop in self.cuts(system, info):
                size = (info.size if stop < 0 else stop) - start
                if not plans or plans[-1].size + size > self.most:
                    plans.append(Archives([], 0))
                plans[-1].parts.append((info.path, start, stop))
                plans[-1].size += size
        return plans or [Archives([], 0)]

    def cuts(self, system: fs.FileSystem, info: fs.FileInfo) -> list[tuple[int, int]]:
        """Parts of an archive of about `most` bytes each. Members are hopped over
        by their `sl` fields; from the first one without it, nothing is cut."""
        starts = [0]
        if info.size > self.most:
            with system.open_input_file(info.path) as file:
                at = 0
                while at < info.size and (size := packed_size(file.read_at(HEAD, at))):
                    at += size
                    if at - starts[-1] >= self.most and info.size > at:
                        starts.append(at)
        return list(zip(starts, [*starts[1:], -1], strict=True))

    def read(self, partition: Archives) -> Iterator[tuple]:
        system, _ = located(self.path)
        for path, at, stop in partition.parts:
            with system.open_input_file(path) as file:
                size = file.size() if stop < 0 else stop
                while at < size:
                    source = Inflater(file, at)
                    if (row := self.row(source)) is not None:
                        yield row
                    at = source.close()

    def row(self, source: Inflater) -> tuple | None:
        body = source.until(END)
        if body < 0:
            return None
        headers = parse_headers(source.data[: body - len(END)])
        cells = {column: self.cell(headers.get(name)) for column, name in HEADER.items()}
        if any(cells[column] not in values for column, values in self.wanted.items()):
            return None
        stop, full = body + int(headers.get("Content-Length", 0)), None
        payload, inner = None, body
        if headers.get("Content-Type", "").startswith("application/http"):
            inner = source.until(END, body)
            if inner < 0 or inner > stop:
                inner = stop
            length = parse_headers(source.data[body:inner]).get("Content-Length", "")
            full = int(length) if length.isdigit() else None
        if self.payload:
            payload = bytes(memoryview(source.upto(stop))[inner:stop])
        return (*cells.values(), stop - inner if full is None else full, headers, payload)

    @staticmethod
    def cell(value: str | None) -> str | None:
        if value is None:
            return None
        return value.removeprefix("sha1:").removeprefix("<").removesuffix(">")


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        options = {name.lower(): value for name, value in options.items()}
        self.path, self.level = options["path"], int(options.get("level", 1))
        self.most = int(options.get("archivebytes", MOST_READ))
        self.folder = f"_{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = located(self.path)
        moves, stream, size = [], None, 0
        try:
            for batch in iterator:
                rows = batch.select(["record_id", "target_uri", "payload", "refers_to"])
                for record_id, uri, payload, refers_to in zip(*rows.columns, strict=True):
                    if stream is None:
                        name, size = uuid.uuid4().hex, 0
                        system.create_dir(f"{root}/{self.folder}")
                        moves.append((f"{root}/{self.folder}/{name}", f"{root}/{name}.warc.gz"))
                        stream = system.open_output_stream(moves[-1][0], compression=None)
                    body = payload.as_py() or b""
                    body = body.encode() if isinstance(body, str) else body
                    packed = member(record(record_id.as_py() or "", uri.as_py() or "", body, refers_to.as_py()), self.level)
                    stream.write(packed)
                    size += len(packed)
                    if size >= self.most:
                        stream.close()
                        stream = None
        finally:
            if stream is not None:
                stream.close()
        return Written(moves)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = located(self.path)
        system.create_dir(root)
        for message in messages:
            for temporary, final in message.moves if message is not None else []:
                system.move(temporary, final)
        self.clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.clear()

    def clear(self) -> None:
        system, root = located(self.path)
        if system.get_file_info(f"{root}/{self.folder}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.folder}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: object, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    set_where_unset(spark, "spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True, partition_bytes: int | None = None) -> DataFrame:
    """All records of a folder's archives or of one archive. Small folders are
    dealt in two parts a core."""
    register(spark)
    if partition_bytes is None:
        system, root = located(path)
        files = system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if system.get_file_info(root).type == fs.FileType.Directory else []
        share = sum(f.size or 0 for f in files) // (2 * spark.sparkContext.defaultParallelism)
        partition_bytes = min(max(share, LEAST_READ), MOST_READ)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("partitionBytes", partition_bytes).load(path)


def write_warc(records: DataFrame, path: str, level: int = 1, archive_bytes: int = MOST_READ) -> None:
    """records: record_id, target_uri, payload (text or bytes), refers_to."""
    register(records.sparkSession)
    rows = in_small_batches(records.select("record_id", "target_uri", "payload", "refers_to"))
    rows.write.format("warc").option("level", level).option("archiveBytes", archive_bytes).mode("append").save(path)


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html and refers_to, null where the page is a response."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= least, F.unhex(F.sha2("html", 256))))
    heads = rows.filter("digest is not null").groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n"))
    heads = durable(heads.filter("n > 1").drop("n"))
    found = lookup(rows, heads, "digest")
    return found.select("page_id", "url", "html", F.when(F.col("page_id") < F.col("head"), F.col("head")).alias("refers_to"))


PREFIX = "urn:page:"


def archive_pages(pages: DataFrame, path: str, least: int = 0) -> None:
    name = lambda c: F.concat(F.lit(PREFIX), F.col(c).cast("string"))
    rows = with_revisits(pages, least)
    write_warc(rows.select(name("page_id").alias("record_id"), F.col("url").alias("target_uri"), F.col("html").alias("payload"), name("refers_to").alias("refers_to")), path)
