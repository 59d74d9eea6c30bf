"""Captured memory images: containers, and a Python data source that reads them as chunks.

Containers: raw, LiME, ELF64 core, 64-bit crash dump (full), AVML (snappy frames). Partitions are slices of segments, so
one large image is read by many tasks; every chunk carries an overlap into the next one for scans.
"""

from __future__ import annotations

import json
import posixpath
import struct
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "image string, layer string, start long, size long, bytes binary"
CHUNK, OVERLAP, SLICE = 1 << 20, 4096, 64 << 20

#: Container magics. Fixed values.
LIME, AVML, ELF, DUMP64 = b"EMiL", b"AVML", b"\x7fELF", b"PAGEDU64"


@dataclass(frozen=True)
class Segment:
    """``size`` bytes of physical memory at ``start`` that lie at ``offset`` in the file (packed: in snappy frames)."""

    start: int
    size: int
    offset: int
    packed: int = 0


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def segments(f: pa.NativeFile) -> list[Segment]:
    """The segments of an open image, by its magic; a file without one is a raw image."""
    size = f.size()
    head = _at(f, 0, min(size, 0x2000))
    if head[:4] == LIME:
        out, at = [], 0
        while at + 32 <= size:
            magic, _, first, last = struct.unpack("<4sIQQ", _at(f, at, 24))
            if magic != LIME or last < first:
                break
            out.append(Segment(first, last - first + 1, at + 32))
            at += 32 + last - first + 1
        return out
    if head[:4] == AVML:
        out, at = [], 0
        while at + 32 <= size:
            magic, version, first, last = struct.unpack("<4sIQQ", _at(f, at, 24))
            if magic != AVML:
                break
            n = last - first  # the end is exclusive here
            end = _frames_end(f, at + 32, n) if version == 2 else at + 32 + n
            out.append(Segment(first, n, at + 32, end - at - 32 if version == 2 else 0))
            at = end + (8 if version == 2 else 0)
        return out
    if head[:5] == ELF + b"\x02" and head[16:18] == b"\x04\0":
        table, = struct.unpack_from("<Q", head, 32)
        entry, count = struct.unpack_from("<HH", head, 54)
        raw = _at(f, table, entry * count)
        loads = (struct.unpack_from("<IIQQQQ", raw, i * entry) for i in range(count))
        return [Segment(paddr, filesz, offset) for kind, _, offset, _, paddr, filesz in loads if kind == 1 and filesz]
    if head[:8] == DUMP64 and struct.unpack_from("<I", head, 0xF98)[0] == 1:
        runs, = struct.unpack_from("<I", head, 0x88)
        out, at = [], 0x2000
        for i in range(runs):
            base, count = struct.unpack_from("<QQ", head, 0x98 + 16 * i)
            out.append(Segment(base << 12, count << 12, at))
            at += count << 12
        return out
    return [Segment(0, size, 0)]


def _at(f: pa.NativeFile, offset: int, size: int) -> bytes:
    f.seek(offset)
    return f.read(size)


def _frames(f: pa.NativeFile, at: int) -> Iterator[tuple[int, int, int]]:
    """(kind, offset of the body, its size) of snappy frames."""
    while True:
        head = _at(f, at, 4)
        if len(head) < 4:
            return
        size = int.from_bytes(head[1:], "little")
        yield head[0], at + 4, size
        at += 4 + size


def _unframed(f: pa.NativeFile, kind: int, at: int, size: int) -> bytes:
    body = _at(f, at, size)
    if kind == 1:
        return body[4:]
    if kind != 0:
        return b""
    n = shift = 0
    for i in range(4, 9):
        n |= (body[i] & 0x7F) << shift
        shift += 7
        if body[i] < 0x80:
            break
    return pa.decompress(body[4:], decompressed_size=n, codec="snappy", asbytes=True)


def _frames_end(f: pa.NativeFile, at: int, wanted: int) -> int:
    got = 0
    for kind, body, size in _frames(f, at):
        if kind in (0, 1):
            got += size - 4 if kind == 1 else len(_unframed(f, kind, body, size))
        if got >= wanted:
            return body + size
    return f.size()


class Memory:
    """Physical memory of one image: reads go through its segments; what is in none raises ``LookupError``."""

    def __init__(self, path: str):
        fs, at = file_system(path)
        self.f = fs.open_input_file(at)
        self.segments = sorted(segments(self.f), key=lambda s: s.start)
        self.starts = [s.start for s in self.segments]
        self._plain: dict[int, bytes] = {}

    def _segment(self, address: int) -> Segment:
        i = bisect_right(self.starts, address) - 1
        if i < 0 or address >= self.starts[i] + self.segments[i].size:
            raise LookupError(hex(address))
        return self.segments[i]

    def read(self, address: int, size: int) -> bytes:
        out = b""
        while len(out) < size:
            s = self._segment(address + len(out))
            skip = address + len(out) - s.start
            n = min(size - len(out), s.size - skip)
            if s.packed:
                if s.start not in self._plain:
                    self._plain = {s.start: b"".join(_unframed(self.f, *x) for x in _frames(self.f, s.offset) if x[1] < s.offset + s.packed)}
                out += self._plain[s.start][skip : skip + n]
            else:
                part = _at(self.f, s.offset + skip, n)
                if len(part) < n:
                    raise LookupError(hex(address))
                out += part
        return out

    def padded(self, address: int, size: int) -> bytes:
        """Like ``read``, with zeros where there is nothing."""
        out = bytearray(size)
        for s in self.segments:
            lo, hi = max(address, s.start), min(address + size, s.start + s.size)
            if lo < hi:
                out[lo - address : hi - address] = self.read(lo, hi - lo)
        return bytes(out)


@dataclass
class Slice(InputPartition):
    image: str
    path: str
    start: int
    size: int
    limit: int

    def __init__(self, image: str, path: str, start: int, size: int, limit: int):
        self.image, self.path, self.start, self.size, self.limit = image, path, start, size, limit


class ImageReader(DataSourceReader):
    def __init__(self, path: str, named: list[list[str]], chunk: int, overlap: int, slice_bytes: int):
        self.path, self.named, self.chunk, self.overlap, self.slice = path, named, chunk, overlap, max(chunk, slice_bytes // chunk * chunk)

    def _files(self) -> list[list[str]]:
        """(image, path) of what is to be read; files of a folder go by their own names."""
        if self.named:
            return self.named
        fs, root = file_system(self.path)
        info = fs.get_file_info(root)
        if info.is_file:
            return [[posixpath.basename(self.path), self.path]]
        prefix = self.path[: len(self.path) - len(root)]
        found = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.is_file and not i.base_name.startswith(("_", ".")))
        return [[posixpath.basename(p), prefix + p] for p in found]

    def partitions(self) -> list[Slice]:
        out = []
        for image, path in self._files():
            for s in Memory(path).segments:
                step = s.size if s.packed else self.slice  # packed segments are read whole
                out += [Slice(image, path, s.start + a, min(step, s.size - a), s.start + s.size) for a in range(0, s.size, step)]
        return out

    def read(self, p: Slice) -> Iterator[pa.RecordBatch]:
        memory = Memory(p.path)
        for at in range(p.start, p.start + p.size, self.chunk):
            end = min(at + self.chunk, p.start + p.size)
            data = memory.read(at, min(end + self.overlap, p.limit) - at)
            yield pa.RecordBatch.from_arrays([pa.array([p.image]), pa.array(["primary"]), pa.array([at], pa.int64()), pa.array([end - at], pa.int64()), pa.array([data], pa.binary())], names=["image", "layer", "start", "size", "bytes"])


class ImageSource(DataSource):
    """Options: path (a file or folder) or images (JSON pairs of name and path), chunk, overlap, slice."""

    @classmethod
    def name(cls) -> str:
        return "memimage"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ImageReader:
        o = self.options
        return ImageReader(o.get("path", ""), json.loads(o.get("images", "[]")), int(o.get("chunk", CHUNK)), int(o.get("overlap", OVERLAP)), int(o.get("slice", SLICE)))


def read_image(spark: SparkSession, path: str | None = None, images: Sequence[tuple[str, str]] = (), **options) -> DataFrame:
    """(image, layer, start, size, bytes) of all segments of an image, of a folder of images, or of (name, path) pairs.

    ``size`` is the length without the overlap.
    """
    spark.dataSource.register(ImageSource)
    reader = spark.read.format("memimage").options(**{k: str(v) for k, v in options.items()})
    return reader.option("images", json.dumps([list(i) for i in images])).load() if images else reader.load(path)
