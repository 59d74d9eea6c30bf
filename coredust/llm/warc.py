"""WARC archives as a PySpark Python data source, for reading and writing.

Reading plans partitions of whole files, packed up to ``PARTITION_BYTES``. Predicates on the record type and other header
columns are pushed down. A record's headers are parsed first, from the first bytes of its gzip member; a record that a
predicate rejects, or whose payload the schema does not ask for, is skipped by the member's skip lengths (the ``sl``
extra field of the WARC standard's gzip annex) without decoding the rest. Members without that field are decoded piece by
piece to find their end, nothing of it being kept; one member may hold many records. Plain ``.warc`` files are skipped by
content length. Header names have no case.

Writing takes Arrow batches and gives every record a gzip member of its own. Payloads are equal if their SHA-1 and their
length are. Tasks write to hidden files; the commit on the driver renames those
of the successful attempts only, so lost executors and repeated tasks leave no double records. Paths go through
pyarrow's file systems, so any shared store it knows will do.

Edge cases: a null payload is written as an empty one; a null url gives no target header; of records with equal payloads
every one with the smallest page_id is a response and the others revisit it (a null page_id counts as larger than any);
an empty table writes no archive and reads as an empty result; headers that clash with columns stay in ``headers``; a
truncated last record is read as far as it goes, and what cannot be decoded after it ends the file.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from ._common import materialize

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, http_length long, headers map<string,string>, actual_digest string, payload binary"
#: Column -> WARC header.
COLUMNS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
PARTITION_BYTES = 128 << 20
FILE_BYTES = 1 << 30
#: Records of a batch are handed on beyond so many bytes.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000
HEAD = 4096
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """The bare upper-case base32 SHA-1 of a payload."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# --- writing ---------------------------------------------------------------------------------------------------------


def member(record: bytes) -> bytes:
    """A gzip member whose extra field tells its compressed and plain length."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(record_type: str, record_id: str, target: str | None, refers_to: str | None, payload: bytes, payload_digest: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP headers and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", f"WARC-Payload-Digest: sha1:{payload_digest}"]
    if target is not None:
        lines.append("WARC-Target-URI: " + target.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows of (record_type, record_id, target_uri, refers_to, payload)."""

    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path, file_bytes

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for b in batches:
            texts = (b.column(c).to_pylist() for c in ("record_type", "record_id", "target_uri", "refers_to"))
            for *head, payload in zip(*texts, b.column("payload"), strict=True):
                if out is None or size >= self.file_bytes:
                    if out is not None:
                        out.close()
                    names.append(f"_{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(posixpath.join(root, names[-1]), compression=None), 0
                raw = payload.as_py() or b""
                data = member(record(*head, raw, digest(raw)))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        for name in (n for m in messages if m for n in m.files):
            fs.move(posixpath.join(root, name), posixpath.join(root, name[1:]))

    def abort(self, messages: list) -> None:
        fs, root = file_system(self.path)
        for name in (n for m in messages if m for n in m.files):
            fs.delete_file(posixpath.join(root, name))


# --- reading ---------------------------------------------------------------------------------------------------------


def parse_headers(block: bytes) -> dict[str, str]:
    """Header lines after the first; a line that starts with white space goes on with the one before."""
    found: dict[str, str] = {}
    name = ""
    for line in block.split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            found[name] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            found[name := name.strip()] = value.strip()
    return found


class Records:
    """The records of a file in order. A record's headers are at hand first; its block is read only if asked for.

    ``_pull`` adds plain bytes to ``plain``, at most about ``PIECE`` at a time; ``_jump`` leaves out the rest of a record.
    """

    PIECE = 1 << 20

    def __init__(self, f: pa.NativeFile, size: int):
        self.f, self.size, self.at, self.plain = f, size, 0, bytearray()

    def _read(self, n: int) -> bytes:
        self.f.seek(self.at)
        data = self.f.read(max(0, min(n, self.size - self.at)))
        self.at += len(data)
        return data

    def _pull(self) -> bool:
        data = self._read(self.PIECE if self.plain else HEAD)
        self.plain += data
        return bool(data)

    def _jump(self, n: int, whole: int) -> None:
        self.at = min(self.size, self.at + n)

    def _start(self) -> None:
        """Called where a record begins."""

    def __iter__(self) -> Iterator[dict[str, str]]:
        while True:
            self._start()
            while not self.plain.strip(b"\r\n") and self._pull():
                pass
            blank = len(self.plain) - len(self.plain.lstrip(b"\r\n"))
            del self.plain[:blank]
            looked = 0
            while (end := self.plain.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
                looked = len(self.plain)
                if not self._pull():
                    return
            headers = parse_headers(bytes(self.plain[:end]))
            length = next((v for k, v in headers.items() if k.lower() == "content-length"), "0")
            self.left = int(length) if length.isdigit() else 0
            self.whole = end + 4 + self.left + 4
            del self.plain[: end + 4]
            yield headers
            self._skip()

    def peek(self, n: int) -> bytes:
        """The first bytes of the block, which stay in it."""
        while len(self.plain) < min(n, self.left) and self._pull():
            pass
        return bytes(self.plain[: min(n, self.left)])

    def until(self, mark: bytes) -> bytes:
        """The block up to and with the mark, or all of it; what was read of it is given."""
        looked = 0
        while True:
            have = min(len(self.plain), self.left)
            at = self.plain.find(mark, max(0, looked - len(mark)), have)
            if at >= 0 or have == self.left or not self._pull():
                n = at + len(mark) if at >= 0 else min(len(self.plain), self.left)
                out = bytes(self.plain[:n])
                del self.plain[:n]
                self.left -= n
                return out
            looked = have

    def rest(self) -> bytes:
        """What the block still holds."""
        while len(self.plain) < self.left and self._pull():
            pass
        out = bytes(self.plain[: self.left])
        del self.plain[: self.left]
        self.left -= len(out)
        return out

    def _skip(self) -> None:
        if self.left > len(self.plain):
            self.left -= len(self.plain)
            self.plain.clear()
            self._jump(self.left, self.whole)
        else:
            del self.plain[: self.left]


class GzipRecords(Records):
    """The same in gzip members."""

    def __init__(self, f: pa.NativeFile, size: int):
        super().__init__(f, size)
        self.raw, self.z, self.lengths, self.begun = b"", None, None, None

    def _start(self) -> None:
        self.begun = None

    def _pull(self) -> bool:
        while True:
            if self.z is None:
                if len(self.raw) < 24:
                    self.raw += self._read(HEAD)
                if self.raw[:2] != b"\x1f\x8b":  # the end, or padding after it
                    return False
                place = self.at - len(self.raw)
                self.lengths = None
                if len(self.raw) >= 24 and self.raw[3] & 4 and self.raw[12:14] == b"sl":
                    self.lengths = (place, *struct.unpack("<II", self.raw[16:24]))
                if not self.plain:
                    self.begun = place  # the record at hand is the first of this member
                self.z = zlib.decompressobj(31)
            # Of a member with skip lengths little is read before it is known whether its record is wanted.
            data = self.raw or self._read(HEAD if self.lengths and len(self.plain) < HEAD else self.PIECE)
            try:
                out = self.z.decompress(data, self.PIECE)
            except zlib.error:
                return False
            self.raw = self.z.unconsumed_tail
            if self.z.eof:
                self.raw, self.z = self.z.unused_data, None
            self.plain += out
            if out:
                return True
            if not data:
                return False

    def _jump(self, n: int, whole: int) -> None:
        # A member that holds this record only is left by its skip length; else the rest is decoded and dropped.
        if self.z is not None and self.lengths and self.begun == self.lengths[0] and self.lengths[2] == whole & 0xFFFFFFFF and whole >> 32 == 0:
            self.at, self.raw, self.z = self.lengths[0] + self.lengths[1], b"", None
            return
        while n and self._pull():
            cut = min(n, len(self.plain))
            del self.plain[:cut]
            n -= cut


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, partition_bytes: int):
        self.path, self.names, self.partition_bytes = path, schema.names, partition_bytes
        self.schema = schema
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list) -> Iterator:
        """Keep what headers can decide: equality, IN, prefix and presence of a header column."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            header = COLUMNS.get(column or "")
            if header and isinstance(f, EqualTo):
                self.tests.append((header, "in", (f.value,)))
            elif header and isinstance(f, In):
                self.tests.append((header, "in", tuple(f.value)))
            elif header and isinstance(f, StringStartsWith):
                self.tests.append((header, "prefix", (f.value,)))
            elif header and isinstance(f, IsNotNull):
                self.tests.append((header, "present", ()))
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, root = file_system(self.path)
        if fs.get_file_info(root).type == pafs.FileType.NotFound:
            return [Files([])]
        found = [i for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.is_file and not i.base_name.startswith(("_", ".")) and i.base_name.endswith((".warc", ".warc.gz"))]
        groups: list[list[str]] = []
        room = 0
        for i in sorted(found, key=lambda i: i.path):
            if not groups or i.size > room:
                groups.append([])
                room = self.partition_bytes
            groups[-1].append(i.path)
            room -= i.size
        return [Files(g) for g in groups] or [Files([])]

    def accepts(self, headers: dict[str, str]) -> bool:
        """Whether the headers, with names in lower case, pass all tests."""
        for header, kind, values in self.tests:
            value = headers.get(header.lower())
            if value is not None and header == "WARC-Payload-Digest":
                value = value.removeprefix("sha1:")
            if value is None or (kind == "in" and value not in values) or (kind == "prefix" and not value.startswith(values[0])):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        wants_block = bool({"payload", "actual_digest", "http_length"} & set(self.names))
        whole = bool({"payload", "actual_digest"} & set(self.names))
        rows: list[dict] = []
        held = 0
        for path in partition.paths:
            with fs.open_input_file(path) as f:
                records = (GzipRecords if path.endswith(".gz") else Records)(f, f.size())
                for headers in records:
                    lower = {k.lower(): v for k, v in headers.items()}
                    if not self.accepts(lower):
                        continue
                    row = {c: lower.get(h.lower()) for c, h in COLUMNS.items()} | {"headers": list(headers.items())}
                    row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
                    if wants_block:
                        http = records.until(b"\r\n\r\n") if records.peek(5) == b"HTTP/" else b""
                        known = next((v for k, v in parse_headers(http).items() if k.lower() == "content-length"), None)
                        row["http_length"] = int(known) if known and known.isdigit() else None
                        if whole and row["record_type"] != "revisit":
                            row["payload"] = records.rest()
                            row["actual_digest"] = digest(row["payload"])
                            held += len(row["payload"])
                    rows.append(row)
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"http_length": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in self.names], names=self.names)


class WarcDataSource(DataSource):
    """Options: path; partition_bytes; file_bytes. A schema with fewer columns of ``SCHEMA`` decodes less."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)))


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """Records under a path. Switches the session's pushdown into Python data sources on: without it nothing is skipped."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").schema(columns).load(path)


def page_urn(page_id) -> F.Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_pages(pages: DataFrame, path: str, revisit_bytes: int = 0) -> None:
    """Write a record per row of (page_id, url, html); payloads of at least ``revisit_bytes`` are stored once."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcDataSource)
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"_sha": F.sha1("payload"), "_len": F.length("payload")})
    # Only digests that occur more than once travel; the counts are summed before the shuffle, whatever the group's size.
    copies = rows.filter(F.col("_len") >= revisit_bytes).groupBy("_sha", "_len").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    # Written first, so the join knows their size: few are sent to all tasks, and payloads are shuffled only for many.
    copies = materialize(copies, "warc-copies")
    rows = rows.join(copies, ["_sha", "_len"], "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    out = rows.select(F.when(revisit, "revisit").otherwise("response").alias("record_type"), page_urn(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"), F.when(revisit, page_urn(F.col("_first"))).alias("refers_to"), "payload")
    out.write.format("warc").mode("append").option("path", path).save()


def page_of(urn) -> F.Column:
    return F.nullif(F.regexp_extract(urn, "<urn:x-page:(.*)>", 1), F.lit("")).cast("long")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record.

    Payloads are decoded of responses only; revisits are read from their headers.
    """
    full = read_warc(spark, path).filter("record_type = 'response'")
    full = full.select("record_id", F.length("payload").cast("long").alias("payload_bytes"), F.col("actual_digest").alias("payload_digest"), "record_type", "refers_to")
    light = read_warc(spark, path, "record_type string, record_id string, refers_to string, payload_digest string, http_length long").filter("record_type = 'revisit'")
    light = light.select("record_id", F.col("http_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    both = full.unionByName(light)
    return both.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))
