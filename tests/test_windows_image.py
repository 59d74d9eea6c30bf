"""A synthetic Windows image: processes, threads, regions, libraries, handles and pool blocks, from bytes to operators."""

import json
import struct
from datetime import datetime

import pytest

from coredust.plans import extract
from coredust.sources.image import Memory, read_image
from coredust.sources.layout import Layout, Space

KERNEL = 0xFFFF_8880_0000_0000
SIZE = 2 << 20
COOKIE = 0x5A


def base(n):
    return {"kind": "base", "name": n}


POINTER, CHARS = {"kind": "pointer"}, {"kind": "array", "count": 15, "subtype": base("char")}


def bits(at, n, of="u4"):
    return {"kind": "bitfield", "bit_position": at, "bit_length": n, "type": base(of)}


def kind(name):
    return {"kind": "struct", "name": name}


TYPES = {
    "_KPROCESS": (8, {"DirectoryTableBase": (0, base("u8"))}),
    "_RTL_AVL_TREE": (8, {"Root": (0, POINTER)}),
    "_RTL_BALANCED_NODE": (24, {"Left": (0, POINTER), "Right": (8, POINTER), "ParentValue": (16, base("u8"))}),
    "_UNICODE_STRING": (16, {"Length": (0, base("u2")), "MaximumLength": (2, base("u2")), "Buffer": (8, POINTER)}),
    "_EPROCESS": (200, {
        "UniqueProcessId": (0, base("u8")), "ActiveProcessLinks": (8, POINTER), "InheritedFromUniqueProcessId": (24, base("u8")), "ImageFileName": (32, CHARS), "ActiveThreads": (48, base("u4")), "CreateTime": (56, base("u8")), "ExitTime": (64, base("u8")),
        "Peb": (72, POINTER), "VadRoot": (80, kind("_RTL_AVL_TREE")), "ObjectTable": (88, POINTER), "ThreadListHead": (96, POINTER), "SectionBaseAddress": (112, POINTER), "WoW64Process": (120, POINTER), "Pcb": (128, kind("_KPROCESS")),
    }),
    "_CLIENT_ID": (16, {"UniqueProcess": (0, base("u8")), "UniqueThread": (8, base("u8"))}),
    "_KTHREAD": (2, {"State": (0, base("u1")), "SuspendCount": (1, base("u1"))}),
    "_ETHREAD": (80, {"ThreadListEntry": (0, POINTER), "Cid": (16, kind("_CLIENT_ID")), "StartAddress": (32, POINTER), "Win32StartAddress": (40, POINTER), "CreateTime": (48, base("u8")), "ExitTime": (56, base("u8")), "Tcb": (64, kind("_KTHREAD"))}),
    "_VAD_FLAGS": (4, {"Protection": (0, bits(3, 5)), "PrivateMemory": (0, bits(20, 1))}),
    "_VAD_FLAGS1": (4, {"CommitCharge": (0, bits(0, 31))}),
    "_U": (4, {"VadFlags": (0, kind("_VAD_FLAGS"))}), "_U1": (4, {"VadFlags1": (0, kind("_VAD_FLAGS1"))}),
    "_MMVAD_SHORT": (48, {"VadNode": (0, kind("_RTL_BALANCED_NODE")), "StartingVpn": (24, base("u4")), "EndingVpn": (28, base("u4")), "StartingVpnHigh": (32, base("u1")), "EndingVpnHigh": (33, base("u1")), "u": (36, kind("_U")), "u1": (40, kind("_U1"))}),
    "_MMVAD": (64, {"Subsection": (48, POINTER)}), "_SUBSECTION": (8, {"ControlArea": (0, POINTER)}), "_CONTROL_AREA": (8, {"FilePointer": (0, base("u8"))}),
    "_FILE_OBJECT": (24, {"DeletePending": (0, base("u1")), "FileName": (8, kind("_UNICODE_STRING"))}),
    "_PEB": (32, {"ImageBaseAddress": (0, POINTER), "Ldr": (8, POINTER), "ProcessParameters": (16, POINTER)}),
    "_RTL_USER_PROCESS_PARAMETERS": (56, {"ImagePathName": (0, kind("_UNICODE_STRING")), "CommandLine": (16, kind("_UNICODE_STRING")), "Environment": (32, POINTER), "EnvironmentSize": (40, base("u8"))}),
    "_PEB_LDR_DATA": (48, {"InLoadOrderModuleList": (0, POINTER), "InMemoryOrderModuleList": (16, POINTER), "InInitializationOrderModuleList": (32, POINTER)}),
    "_LDR_DATA_TABLE_ENTRY": (112, {"InLoadOrderLinks": (0, POINTER), "InMemoryOrderLinks": (16, POINTER), "InInitializationOrderLinks": (32, POINTER), "DllBase": (48, POINTER), "SizeOfImage": (56, base("u4")), "FullDllName": (64, kind("_UNICODE_STRING")), "BaseDllName": (80, kind("_UNICODE_STRING")), "LoadTime": (96, base("u8"))}),
    "_KLDR_DATA_TABLE_ENTRY": (112, {"InLoadOrderLinks": (0, POINTER), "DllBase": (48, POINTER), "SizeOfImage": (56, base("u4")), "FullDllName": (64, kind("_UNICODE_STRING")), "BaseDllName": (80, kind("_UNICODE_STRING"))}),
    "_HANDLE_TABLE": (8, {"TableCode": (0, base("u8"))}),
    "_HANDLE_TABLE_ENTRY": (16, {"ObjectPointerBits": (0, bits(20, 44, "u8")), "GrantedAccessBits": (8, bits(0, 25))}),
    "_OBJECT_HEADER": (48, {"InfoMask": (0, base("u1")), "TypeIndex": (1, base("u1")), "Body": (48, POINTER)}),
    "_OBJECT_HEADER_NAME_INFO": (16, {"Name": (0, kind("_UNICODE_STRING"))}), "_OBJECT_TYPE": (16, {"Name": (0, kind("_UNICODE_STRING"))}),
}
SYMBOLS = {"PsActiveProcessHead": 0x8000, "PsLoadedModuleList": 0x8010, "ObTypeIndexTable": 0x8100, "ObHeaderCookie": 0x8300, "ObpInfoMaskToOffset": 0x8310}
LAYOUT = {
    "base_types": {"u1": {"size": 1, "signed": False}, "u2": {"size": 2, "signed": False}, "u4": {"size": 4, "signed": False}, "u8": {"size": 8, "signed": False}, "char": {"size": 1, "signed": True}, "pointer": {"size": 8, "signed": False}},
    "user_types": {n: {"size": size, "fields": {f: {"offset": o, "type": t} for f, (o, t) in fields.items()}} for n, (size, fields) in TYPES.items()},
    "enums": {}, "symbols": {n: {"address": KERNEL + a} for n, a in SYMBOLS.items()},
}
WHEN = 132_000_000_000_000_000


class Builder:
    def __init__(self):
        self.m, self.top = bytearray(SIZE), 0x10000
        self.put(0x1000 + 8 * 0x111, 0x2000 | 3)
        self.put(0x2000, 0x3000 | 3)
        self.put(0x3000, 0x4000 | 3)
        for i in range(512):
            self.put(0x4000 + 8 * i, i << 12 | 3)

    def put(self, at, *q):
        struct.pack_into(f"<{len(q)}Q", self.m, at, *(x & (1 << 64) - 1 for x in q))

    def room(self, n, align=16):
        self.top = -(-self.top // align) * align
        at, self.top = self.top, self.top + n
        return at

    def text(self, at, s):
        raw = s.encode("utf-16-le")
        buffer = self.room(len(raw))
        self.m[buffer : buffer + len(raw)] = raw
        struct.pack_into("<HH", self.m, at, len(raw), len(raw) + 2)
        self.put(at + 8, KERNEL + buffer)

    def ring(self, head, nodes):
        """A doubly linked list through link addresses."""
        line = [head, *nodes, head]
        for a, b in zip(line, line[1:]):
            self.put(a, KERNEL + b)
            self.put(b + 8, KERNEL + a)


def build():
    b = Builder()
    m = b.m
    # types and names of objects
    types = {5: "File", 7: "Process", 9: "Mutant"}
    for i, name in types.items():
        at = b.room(16)
        b.text(at, name)
        b.put(SYMBOLS["ObTypeIndexTable"] + 8 * i, KERNEL + at)
    m[SYMBOLS["ObHeaderCookie"]] = COOKIE
    m[SYMBOLS["ObpInfoMaskToOffset"] : SYMBOLS["ObpInfoMaskToOffset"] + 4] = bytes([0, 32, 16, 48])

    def header(at, index, mask=0):
        m[at] = mask
        m[at + 1] = index ^ ((KERNEL + at) >> 8 & 0xFF) ^ COOKIE

    def process(pid, ppid, name):
        """In a pool block: header, padding, object header, struct."""
        block = b.room(16 + 48 + 208)
        m[block + 2], m[block + 3] = (16 + 48 + 208) // 16, 2
        m[block + 4 : block + 8] = b"Proc"
        at = block + 16 + 48
        header(at - 48, 7)
        b.put(at, pid)
        b.put(at + 24, ppid)
        m[at + 32 : at + 32 + len(name)] = name.encode()
        b.put(at + 56, WHEN)
        b.put(at + 128, 0x1000)
        return at

    listed = [process(4, 0, "System"), process(88, 4, "app.exe")]
    process(92, 88, "hidden.exe")
    b.ring(SYMBOLS["PsActiveProcessHead"], [p + 8 for p in listed])
    # threads
    for n, p in enumerate(listed):
        threads = [b.room(80) for _ in range(2 + n)]
        for k, t in enumerate(threads):
            b.put(t + 16, (4, 88)[n], 100 * n + 4 * k)
            b.put(t + 32, 0x7000_0000_1000 if k else 0x1234, KERNEL + 5)
            m[t + 64 : t + 66] = bytes([5, k])
        b.ring(p + 96, threads)
    app = listed[1]
    # regions: a private writable executable one, a mapped file, and a large one over 32 bits of pages
    file = b.room(24 + 48)
    header(file, 5)
    file += 48
    b.text(file + 8, r"\Windows\a.dll")
    area, section = b.room(8), b.room(8)
    b.put(area, KERNEL + file | 0xB)
    b.put(section, KERNEL + area)
    code = b.room(4096, 4096)
    m[code : code + 4] = b"MZ\x90\0"

    def region(tag, first, last, protect, private, left=0, right=0):
        block = b.room(16 + 64)
        m[block + 4 : block + 8] = tag
        at = block + 16
        b.put(at, left, right, 0)
        struct.pack_into("<IIBB", m, at + 24, first & 0xFFFFFFFF, last & 0xFFFFFFFF, first >> 32, last >> 32)
        struct.pack_into("<II", m, at + 36, protect << 3 | private << 20, 7)
        if tag == b"Vad ":
            b.put(at + 48, KERNEL + section)
        return at

    page = (KERNEL + code >> 12) & 0xFFFF_FFFF_F
    low = region(b"VadS", 0x10, 0x1F, 4, 1)
    high = region(b"Vad ", 0x7_0000_0000, 0x7_0000_0010, 7, 0)
    root = region(b"VadS", page, page, 6, 1, KERNEL + low, KERNEL + high)
    b.put(app + 80, KERNEL + root)
    # the environment block, loader lists
    peb, params, ldr = b.room(32), b.room(56), b.room(48)
    b.put(app + 72, KERNEL + peb)
    b.put(peb, 0x40_0000, KERNEL + ldr, KERNEL + params)
    b.text(params, r"C:\app.exe")
    b.text(params + 16, "app.exe -x")
    env = "A=1\0B=x=y\0\0".encode("utf-16-le")
    at = b.room(len(env))
    m[at : at + len(env)] = env
    b.put(params + 32, KERNEL + at, len(env))
    dlls = []
    for i, name in enumerate(("app.exe", "ntdll.dll")):
        e = b.room(112)
        b.put(e + 48, 0x40_0000 + i * 0x10000)
        struct.pack_into("<I", m, e + 56, 0x5000)
        b.text(e + 64, "C:\\" + name)
        b.text(e + 80, name)
        b.put(e + 96, WHEN)
        dlls.append(e)
    b.ring(ldr, dlls)
    b.ring(ldr + 16, [e + 16 for e in dlls])
    b.ring(ldr + 32, [dlls[1] + 32])
    # kernel modules
    mod = b.room(112)
    b.put(mod + 48, KERNEL)
    struct.pack_into("<I", m, mod + 56, 0x1000)
    b.text(mod + 64, r"\SystemRoot\ntoskrnl.exe")
    b.text(mod + 80, "ntoskrnl.exe")
    b.ring(SYMBOLS["PsLoadedModuleList"], [mod])
    # handles: two levels, with a file, a process and a named mutant
    name = b.room(16 + 48)
    b.text(name, "Global\\m")
    mutant = name + 16
    header(mutant, 9, 2)
    table, top, pages = b.room(8), b.room(4096, 4096), [b.room(4096, 4096) for _ in range(2)]
    b.put(app + 88, KERNEL + table)
    b.put(table, KERNEL + top | 1)
    b.put(top, *(KERNEL + p for p in pages))
    for slot, h, access in ((1, file - 48, 0x12), (2, listed[0] - 48, 0x1FFFFF), (256 + 3, mutant, 1)):
        b.put(pages[slot // 256] + 16 * (slot % 256), (KERNEL + h >> 4 & (1 << 44) - 1) << 20 | 1, access)
    return bytes(m), code


@pytest.fixture(scope="module")
def image(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("win")
    raw, code = build()
    (d / "w.bin").write_bytes(raw)
    (d / "l.json").write_text(json.dumps(LAYOUT))
    rows = [{"image": i, "path": str(d / "w.bin"), "layout_path": str(d / "l.json"), "dtb": 0x1000} for i in ("one", "two")]
    s = extract.open_images(spark, rows, ["win_processes", "win_threads", "win_vads", "win_ldr", "win_handles", "win_envars", "win_modules", "win_pages"])
    carved = extract.carved_processes(s.table("chunks"), Layout(LAYOUT), 1 << 20)
    s.tables["win_processes"] = s.table("win_processes").unionByName(extract.as_table(carved, "win_processes")).cache()
    for k in ("win_threads", "win_vads", "win_ldr", "win_handles", "win_envars", "win_modules"):
        s.tables[k] = s.tables[k].cache()
    return s, code


def one(df, *cols):
    return sorted((tuple(r) for r in df.filter("image = 'one'").select(*cols).collect()), key=str)


def test_processes_listed_and_carved(image):
    s, _ = image
    assert one(s.run("windows.pslist.PsList"), "pid", "ppid", "image_file_name") == [(4, 0, "System"), (88, 4, "app.exe")]
    assert one(s.run("windows.psscan.PsScan"), "pid", "image_file_name") == [(4, "System"), (88, "app.exe"), (92, "hidden.exe")]
    assert one(s.run("windows.psxview.PsXView"), "pid", "pslist", "psscan") == [(4, True, True), (88, True, True), (92, False, True)]
    assert one(s.run("windows.pstree.PsTree"), "pid", "depth") == [(4, 0), (88, 1)] and s.run("windows.pstree.PsTree").count() == 4
    assert one(s.run("windows.cmdline.CmdLine"), "pid", "args") == [(4, None), (88, "app.exe -x")]
    assert one(s.run("windows.envars.Envars"), "variable", "value") == [("A", "1"), ("B", "x=y")]
    assert one(s.run("windows.pslist.PsList", pid=88), "create_time") == [(datetime(2019, 4, 17, 18, 40),)]
    assert one(s.run("windows.malware.pebmasquerade.PebMasquerade", pid=88), "peb_path", "cmdline_spoofed") == [(r"C:\app.exe", False)]


def test_threads_and_regions(image):
    s, code = image
    assert one(s.run("windows.threads.Threads"), "pid", "tid", "start_path") == [(4, 0, None), (4, 4, None), (88, 100, None), (88, 104, r"\Windows\a.dll"), (88, 108, r"\Windows\a.dll")]
    assert one(s.run("windows.suspended_threads.SuspendedThreads"), "tid") == [(104,), (108,), (4,)]
    page = (KERNEL + code >> 12 & 0xFFFF_FFFF_F) << 12
    want = [(0x10000, 0x1FFFF, "VadS", "PAGE_READWRITE", 1, None), (page, page + 4095, "VadS", "PAGE_EXECUTE_READWRITE", 1, None), (0x7000_0000_0000, 0x7000_0001_0FFF, "Vad ", "PAGE_EXECUTE_WRITECOPY", 0, r"\Windows\a.dll")]
    assert one(s.run("windows.vadinfo.VadInfo"), "start", "end", "tag", "protection", "private_memory", "file") == sorted(want, key=str)
    assert one(s.run("windows.vadwalk.VadWalk"), "start") == sorted([(w[0],) for w in want], key=str)
    assert one(s.run("windows.vadinfo.VadInfo", address=0x10008), "commit_charge") == [(7,)]
    notes = one(s.run("windows.malware.suspicious_threads.SuspiciousThreads", pid=88), "tid", "context", "note")
    assert (100, "start", "No region holds the address") in notes


def test_libraries_handles_modules(image):
    s, _ = image
    assert one(s.run("windows.dlllist.DllList"), "base", "size", "name", "path") == [(0x400000, 0x5000, "app.exe", r"C:\app.exe"), (0x410000, 0x5000, "ntdll.dll", r"C:\ntdll.dll")]
    assert one(s.table("win_ldr"), "name", "in_load", "in_mem", "in_init") == [("app.exe", True, True, False), ("ntdll.dll", True, True, True)]
    assert one(s.run("windows.handles.Handles"), "pid", "handle_value", "type", "name") == [(88, 1036, "Mutant", r"Global\m"), (88, 4, "File", r"\Windows\a.dll"), (88, 8, "Process", "System Pid 4")]
    assert one(s.run("windows.modules.Modules"), "base", "size", "name", "path") == [(KERNEL - (1 << 64), 0x1000, "ntoskrnl.exe", r"\SystemRoot\ntoskrnl.exe")]
    assert one(s.run("windows.memmap.Memmap"), "size") == [(SIZE,)]


def test_pool_blocks_do_not_depend_on_chunks(spark, image, tmp_path):
    raw, _ = build()
    (tmp_path / "w.bin").write_bytes(raw)
    found = [sorted((r.header, r.block) for r in extract.pool_hits(read_image(spark, str(tmp_path / "w.bin"), chunk=c, overlap=512), {"p": b"Proc"}, c).collect()) for c in (4096, 1 << 16, 1 << 20)]
    assert len(found[0]) == 3 and found[0] == found[1] == found[2]


def test_fields_of_other_builds_are_left_out(tmp_path):
    raw, _ = build()
    (tmp_path / "w.bin").write_bytes(raw)
    bare = json.loads(json.dumps(LAYOUT))
    for f in ("Peb", "VadRoot", "WoW64Process", "SectionBaseAddress", "Pcb"):
        del bare["user_types"]["_EPROCESS"]["fields"][f]
    s = Space(Memory(str(tmp_path / "w.bin")), Layout(bare), 0x1000)
    assert [r["pid"] for r in extract.windows_processes(s)] == [4, 88] and not list(extract.windows_vads(s)) and not list(extract.windows_ldr(s))
