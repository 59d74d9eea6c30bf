"""A small synthetic image through containers, paging, layouts, walks and scans."""

import json
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coredust.plans import extract, generic  # noqa: F401
from coredust.sources.image import Memory, read_image
from coredust.sources.layout import Layout, Space

KERNEL = 0xFFFF_8880_0000_0000
TASKS, SIZE = 130, 2 << 20
HEAD, CLASS = 0x20000, KERNEL + 0x1000
LAYOUT = {
    "base_types": {"int": {"size": 4, "signed": True}, "pointer": {"size": 8, "signed": False}, "char": {"size": 1, "signed": True}},
    "user_types": {
        "list_head": {"size": 16, "fields": {"next": {"offset": 0, "type": {"kind": "pointer"}}, "prev": {"offset": 8, "type": {"kind": "pointer"}}}},
        "task_struct": {"size": 256, "fields": {
            "sched_class": {"offset": 0, "type": {"kind": "pointer"}}, "tasks": {"offset": 16, "type": {"kind": "struct", "name": "list_head"}}, "pid": {"offset": 32, "type": {"kind": "base", "name": "int"}}, "tgid": {"offset": 36, "type": {"kind": "base", "name": "int"}},
            "comm": {"offset": 40, "type": {"kind": "array", "count": 16, "subtype": {"kind": "base", "name": "char"}}}, "real_parent": {"offset": 56, "type": {"kind": "pointer"}}, "mm": {"offset": 64, "type": {"kind": "pointer"}}, "cred": {"offset": 72, "type": {"kind": "pointer"}},
        }},
    },
    "enums": {}, "symbols": {"init_task": {"address": KERNEL + HEAD}, "fair_sched_class": {"address": CLASS}},
}


def build() -> bytes:
    """Page tables that map the kernel range to physical memory (two large pages less one small-page table), and tasks.

    Every third task is on no list; the others are chained in a circle.
    """
    m = bytearray(SIZE)
    put = lambda at, *q: struct.pack_into(f"<{len(q)}Q", m, at, *q)
    put(0x1000 + 8 * 0x111, 0x2000 | 3)
    put(0x2000, 0x3000 | 3)
    put(0x3000, 0x4000 | 3)
    for i in range(512):
        put(0x4000 + 8 * i, i << 12 | 3)
    listed = [i for i in range(TASKS) if i == 0 or i % 3]
    at = {i: HEAD + 300 * i for i in range(TASKS)}
    for i in range(TASKS):
        a = at[i]
        put(a, CLASS)
        if i in listed:
            n = listed.index(i)
            put(a + 16, KERNEL + at[listed[(n + 1) % len(listed)]] + 16, KERNEL + at[listed[n - 1]] + 16)
        struct.pack_into("<ii", m, a + 32, i, i)
        m[a + 40 : a + 56] = f"task{i}".encode().ljust(16, b"\0")
        put(a + 56, KERNEL + at[i // 2], 0 if i < 3 else 1, 0x1000 + i)
    m[0x1FFFF0 - 2 : 0x1FFFF0 + 12] = b"xxNEEDLE-12345"
    return bytes(m)


def lime(raw: bytes, cut: int) -> bytes:
    return b"".join(struct.pack("<4sIQQQ", b"EMiL", 1, a, a + len(p) - 1, 0) + p for a, p in ((0, raw[:cut]), (cut, raw[cut:])))


def elf(raw: bytes, cut: int) -> bytes:
    head = b"\x7fELF\x02\x01\x01" + b"\0" * 9 + struct.pack("<HHIQQQIHHHHHH", 4, 62, 1, 0, 64, 0, 0, 64, 56, 2, 0, 0, 0)
    body = 64 + 112
    ph = b"".join(struct.pack("<IIQQQQQQ", 1, 7, body + a, a, a, n, n, 0) for a, n in ((0, cut), (cut, len(raw) - cut)))
    return head + ph + raw


def dump(raw: bytes) -> bytes:
    h = bytearray(b"\0" * 0x2000)
    h[:8] = b"PAGEDU64"
    struct.pack_into("<IIQQQ", h, 0x88, 2, 0, len(raw) >> 12, 0, 16)
    struct.pack_into("<QQ", h, 0xA8, 16, (len(raw) >> 12) - 16)
    struct.pack_into("<I", h, 0xF98, 1)
    return bytes(h) + raw


def avml(raw: bytes) -> bytes:
    frames = b"\xff\x06\0\0sNaPpY"
    for i, a in enumerate(range(0, len(raw), 65536)):
        part = raw[a : a + 65536]
        body = b"\0\0\0\0" + (bytes(pa.compress(part, codec="snappy")) if i % 2 else part)
        frames += bytes([0 if i % 2 else 1]) + len(body).to_bytes(3, "little") + body
    return struct.pack("<4sIQQQ", b"AVML", 2, 0, len(raw), 0) + frames + struct.pack("<Q", len(frames))


@pytest.fixture(scope="module")
def images(tmp_path_factory):
    d = tmp_path_factory.mktemp("img")
    raw = build()
    for name, data in {"raw.bin": raw, "a.lime": lime(raw, 0x90000), "a.elf": elf(raw, 0x33000), "a.dmp": dump(raw), "a.avml": avml(raw)}.items():
        (d / name).write_bytes(data)
    (tmp_path_factory.getbasetemp() / "layout.json").write_text(json.dumps(LAYOUT))
    return d, raw, str(tmp_path_factory.getbasetemp() / "layout.json")


@pytest.mark.parametrize("name", ["raw.bin", "a.lime", "a.elf", "a.dmp", "a.avml"])
def test_containers_read_alike(spark, images, name):
    d, raw, _ = images
    m = Memory(str(d / name))
    assert m.read(0x8FFF0, 64) == raw[0x8FFF0 : 0x8FFF0 + 64] and m.padded(SIZE - 4, 8) == raw[-4:] + b"\0" * 4
    with pytest.raises(LookupError):
        m.read(SIZE - 4, 8)
    whole = bytearray(SIZE)
    for r in read_image(spark, str(d / name), chunk=1 << 16, overlap=64, slice=1 << 18).collect():
        whole[r.start : r.start + len(r.bytes)] = r.bytes
        assert len(r.bytes) <= (1 << 16) + 64
    assert bytes(whole) == raw


def test_pages_and_fields(images):
    d, raw, layout = images
    s = Space(Memory(str(d / "raw.bin")), Layout.load(layout), 0x1000)
    pages = list(s.pages())
    assert len(pages) == 512 and pages[3][:3] == (KERNEL + 0x3000, 0x3000, 4096)
    assert s.translate(KERNEL + 0x12345) == (0x12345, 4096 - 0x345)
    with pytest.raises(LookupError):
        s.translate(KERNEL + (1 << 30))
    assert s.value("task_struct", KERNEL + HEAD + 300, "comm") == "task1" and s.value("task_struct", 0x10, "pid") is None


def test_walk_scan_and_crossview(spark, images):
    d, raw, layout = images
    rows = [{"image": n, "path": str(d / n), "layout_path": layout, "dtb": 0x1000} for n in ("raw.bin", "a.lime")]
    s = extract.open_images(spark, rows, ["lin_tasks", "win_pages"])
    out = s.run("linux.pslist.PsList").filter("image = 'a.lime'").collect()
    want = {i for i in range(TASKS) if i == 0 or i % 3}
    assert {r.pid for r in out} == want and {r.ppid for r in out if r.pid == 101} == {50}
    tree = s.run("linux.pstree.PsTree").filter("image = 'raw.bin'")
    assert tree.count() > 0
    assert {r.image: r.n for r in s.table("chunks").groupBy("image").agg(F.sum("size").alias("n")).collect()} == {"raw.bin": SIZE, "a.lime": SIZE}
    carved = extract.carved_tasks(s.table("chunks").filter("image = 'raw.bin'"), Layout.load(layout), [CLASS], 1 << 20)
    assert {r.pid for r in carved.collect()} == set(range(1, TASKS))
    hidden = carved.join(s.run("linux.pslist.PsList").filter("image = 'raw.bin'"), "pid", "left_anti")
    assert {r.pid for r in hidden.collect()} == set(range(1, TASKS)) - want
    assert s.run("windows.memmap.Memmap").filter("image = 'raw.bin'").collect()[0].size == 512 * 4096


@pytest.mark.parametrize("chunk", [1 << 14, 1 << 16, 1 << 20])
def test_hits_do_not_depend_on_chunks(spark, images, chunk):
    from coredust.plans.session import Session

    d, _, _ = images
    s = Session(spark, {"chunks": read_image(spark, str(d / "raw.bin"), chunk=chunk, overlap=64)})
    assert [(r.offset, r.text) for r in s.run("regexscan.RegExScan", pattern=rb"NEEDLE-\d+").collect()] == [(0x1FFFF0, "NEEDLE-12345")]
    assert s.run("regexscan.RegExScan", pattern=rb"task\d+\0").count() == TASKS
