"""Type layouts from symbol files (JSON, also gz, bz2, xz), and decoding of structs through 4-level page tables."""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
from collections.abc import Iterator
from pathlib import Path

from .image import Memory

PRESENT, LARGE = 1, 1 << 7
ADDRESS = 0x000F_FFFF_FFFF_F000
MASK = (1 << 64) - 1


def signed(address: int) -> int:
    """An address as the long that tables hold."""
    return address - (1 << 64) if address >> 63 else address


class Layout:
    """Types, enumerations and symbols of one kernel build."""

    def __init__(self, data: dict):
        self.types, self.base, self.enums, self.symbols = data["user_types"], data["base_types"], data.get("enums", {}), data.get("symbols", {})

    @staticmethod
    def load(path: str) -> "Layout":
        opener = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}.get(Path(path).suffix, open)
        with opener(path, "rb") as f:
            return Layout(json.load(f))

    def offset(self, kind: str, field: str) -> int:
        """Where a field is; dots go through embedded structs."""
        first, _, rest = field.partition(".")
        f = self.types[kind]["fields"][first]
        return f["offset"] + (self.offset(f["type"]["name"], rest) if rest else 0)

    def field(self, kind: str, field: str) -> tuple[int, dict]:
        first, _, rest = field.partition(".")
        f = self.types[kind]["fields"][first]
        if rest:
            offset, t = self.field(f["type"]["name"], rest)
            return f["offset"] + offset, t
        return f["offset"], f["type"]

    def has(self, kind: str, field: str) -> bool:
        return field.partition(".")[0] in self.types.get(kind, {}).get("fields", {})

    def size_of(self, t: dict) -> int:
        kind = t["kind"]
        if kind == "array":
            return t["count"] * self.size_of(t["subtype"])
        if kind == "pointer":
            return self.base.get("pointer", {"size": 8})["size"]
        if kind == "bitfield":
            return self.size_of(t["type"])
        if kind == "enum":
            return self.enums[t["name"]]["size"]
        return (self.base if kind == "base" else self.types)[t["name"]]["size"]


class Space:
    """A virtual address space over an image, by a page table root; ``shift`` moves symbols (kernel slide)."""

    def __init__(self, memory: Memory, layout: Layout, dtb: int, shift: int = 0):
        self.memory, self.layout, self.dtb, self.shift = memory, layout, dtb & ADDRESS, shift
        self._tables: dict[int, bytes] = {}

    def _entry(self, table: int, index: int) -> int:
        if table not in self._tables:
            if len(self._tables) > 4096:
                self._tables.clear()
            self._tables[table] = self.memory.read(table, 4096)
        return int.from_bytes(self._tables[table][8 * index : 8 * index + 8], "little")

    def translate(self, address: int) -> tuple[int, int]:
        """(physical address, bytes to the end of its page)."""
        table = self.dtb
        for level, bits in enumerate((39, 30, 21, 12)):
            e = self._entry(table, address >> bits & 0x1FF)
            if not e & PRESENT:
                raise LookupError(hex(address))
            if level == 3 or (level in (1, 2) and e & LARGE):
                size = 1 << bits
                return (e & ADDRESS & ~(size - 1)) + (address & (size - 1)), size - (address & (size - 1))
            table = e & ADDRESS
        raise LookupError(hex(address))

    def pages(self) -> Iterator[tuple[int, int, int, int]]:
        """(virtual, physical, size, flags) of every mapped page."""

        def below(table: int, level: int, prefix: int) -> Iterator[tuple[int, int, int, int]]:
            bits = (39, 30, 21, 12)[level]
            for i in range(512):
                try:
                    e = self._entry(table, i)
                except LookupError:
                    return
                if e & PRESENT:
                    virt = prefix | i << bits
                    if level == 3 or (level in (1, 2) and e & LARGE):
                        top = virt | 0xFFFF_0000_0000_0000 if virt >> 47 & 1 else virt
                        yield top, e & ADDRESS & ~((1 << bits) - 1), 1 << bits, e & 0xFFF
                    else:
                        yield from below(e & ADDRESS, level + 1, virt)

        yield from below(self.dtb, 0, 0)

    def read(self, address: int, size: int) -> bytes:
        out = b""
        while len(out) < size:
            phys, room = self.translate((address + len(out)) & 0xFFFF_FFFF_FFFF_FFFF)
            out += self.memory.read(phys, min(room, size - len(out)))
        return out

    def symbol(self, name: str) -> int:
        return (self.layout.symbols[name]["address"] + self.shift) & 0xFFFF_FFFF_FFFF_FFFF

    def value(self, kind: str, address: int, field: str):
        """A field as an integer or, for character arrays, as text; None where it cannot be read."""
        offset, t = self.layout.field(kind, field)
        try:
            raw = self.read(address + offset, self.layout.size_of(t))
        except LookupError:
            return None
        if t["kind"] == "array":
            return raw.split(b"\0")[0].decode("utf-8", "replace")
        if t["kind"] == "bitfield":
            return int.from_bytes(raw, "little") >> t["bit_position"] & ((1 << t["bit_length"]) - 1)
        base = self.layout.base.get(t.get("name", ""), {})
        return int.from_bytes(raw, "little", signed=bool(base.get("signed")))

    def maybe(self, kind: str, address: int, field: str):
        """``value``, or None where the build has no such field."""
        return self.value(kind, address, field) if self.layout.has(kind, field) else None

    def pointer(self, address: int) -> int:
        """What a pointer at an address points to; 0 where it cannot be read."""
        try:
            return int.from_bytes(self.read(address & MASK, 8), "little")
        except LookupError:
            return 0

    def at(self, kind: str, address: int, field: str) -> int:
        """The address of a field."""
        return (address + self.layout.offset(kind, field)) & MASK

    def unicode(self, address: int) -> str | None:
        """A counted UTF-16 string; None where it is empty or cannot be read."""
        size, buffer = self.value("_UNICODE_STRING", address, "Length"), self.value("_UNICODE_STRING", address, "Buffer")
        try:
            return self.read(buffer, size).decode("utf-16-le", "replace") if size and buffer else None
        except LookupError:
            return None

    def padded(self, address: int, size: int) -> bytes:
        """Like ``read``, with zeros for pages that are not there."""
        out = b""
        while len(out) < size:
            n = min(size - len(out), 4096 - (address + len(out)) % 4096)
            try:
                out += self.read((address + len(out)) & MASK, n)
            except LookupError:
                out += b"\0" * n
        return out

    def walk(self, head: int, kind: str, link: str, backward: str | None = None) -> Iterator[int]:
        """Addresses of the structs on a doubly linked list around ``head``: forward, then backward, each once.

        Either direction stops at the head, at a cycle, or where it cannot be read.
        """
        seen = set()
        at = self.layout.offset(kind, link)
        for step in (0, 8):
            try:
                now = int.from_bytes(self.read(head + step, 8), "little")
                here: set[int] = set()
                while now != head and now and now not in here:
                    here.add(now)
                    if now not in seen:
                        seen.add(now)
                        yield (now - at) & 0xFFFF_FFFF_FFFF_FFFF
                    now = int.from_bytes(self.read(now + step, 8), "little")
            except LookupError:
                continue
