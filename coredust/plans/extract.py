"""Object tables from images: lists are walked by one task per image and list, scans run over all chunks in parallel.

Chasing a list is sequential, but images are not: the images to read are rows of a DataFrame, so thousands of captures
are walked side by side, each through random reads of its own file.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import scan
from ..sources import hive
from ..sources.image import Memory, read_image
from ..sources.layout import Layout, Space, signed
from . import linux, mac, windows  # noqa: F401  (they register operators and schemas)
from .session import SCHEMAS, Session


def _time(filetime: int | None) -> datetime | None:
    if not filetime:
        return None
    seconds = filetime // 10_000_000 - 11_644_473_600
    return datetime.fromtimestamp(seconds, timezone.utc).replace(tzinfo=None) if -62_135_596_800 < seconds < 253_402_300_800 else None


def linux_tasks(space: Space) -> Iterator[dict]:
    """Tasks from the initial task's list, both ways."""
    init = space.symbol("init_task")
    head = init + space.layout.offset("task_struct", "tasks")
    for n, t in enumerate([init, *space.walk(head, "task_struct", "tasks")]):
        get = lambda f, t=t: space.value("task_struct", t, f) if space.layout.has("task_struct", f) else None
        parent = get("real_parent")
        yield {
            "source": "list", "ord": n, "offset": signed(t), "pid": get("tgid"), "tid": get("pid"), "comm": get("comm"), "cred": signed(get("cred") or 0), "is_kernel": get("mm") == 0,
            "ppid": space.value("task_struct", parent, "tgid") if parent else None,
        }


def linux_modules(space: Space) -> Iterator[dict]:
    for n, m in enumerate(space.walk(space.symbol("modules"), "module", "list")):
        yield {"source": "list", "ord": n, "offset": signed(m), "name": space.value("module", m, "name"), "base": signed(space.value("module", m, "base") or 0), "size": space.value("module", m, "size")}


def _processes(space: Space) -> Iterator[int]:
    yield from space.walk(space.symbol("PsActiveProcessHead"), "_EPROCESS", "ActiveProcessLinks")


def _process(space: Space, p: int) -> dict:
    """What rows of a process's objects are known by."""
    return {"pid": space.value("_EPROCESS", p, "UniqueProcessId"), "process": space.value("_EPROCESS", p, "ImageFileName")}


def _user(space: Space, p: int) -> Space:
    """The address space of a process: its own tables, or the kernel's where the build does not say."""
    root = space.maybe("_EPROCESS", p, "Pcb.DirectoryTableBase") if space.layout.has("_KPROCESS", "DirectoryTableBase") else None
    return Space(space.memory, space.layout, root) if root else space


def windows_processes(space: Space) -> Iterator[dict]:
    """The active process list, both ways, with what the environment block of each says."""
    for n, p in enumerate(_processes(space)):
        get = lambda f, p=p: space.maybe("_EPROCESS", p, f)
        try:
            physical = space.translate(p)[0]
        except LookupError:
            physical = None
        row = {
            "source": "pslist", "ord": n, "offset": signed(p), "physical": physical, "pid": get("UniqueProcessId"), "ppid": get("InheritedFromUniqueProcessId"), "name": get("ImageFileName"), "threads": get("ActiveThreads"),
            "create_time": _time(get("CreateTime")), "exit_time": _time(get("ExitTime")), "wow64": bool(get("WoW64Process")), "section_base": signed(get("SectionBaseAddress") or 0),
        }
        peb, user = get("Peb"), _user(space, p)
        if peb and space.layout.has("_PEB", "ProcessParameters"):
            row["peb_base"] = signed(user.maybe("_PEB", peb, "ImageBaseAddress") or 0)
            params = user.value("_PEB", peb, "ProcessParameters")
            if params:
                kind = "_RTL_USER_PROCESS_PARAMETERS"
                for out, field in (("cmd", "CommandLine"), ("peb_path", "ImagePathName")):
                    at = user.at(kind, params, field)
                    row[out] = user.unicode(at)
                    short = "peb_cmd" if out == "cmd" else "peb_path"
                    row[f"{short}_len"], row[f"{short}_max"] = user.value("_UNICODE_STRING", at, "Length"), user.value("_UNICODE_STRING", at, "MaximumLength")
                row["path"] = row["peb_path"]
        yield row


def windows_envars(space: Space) -> Iterator[dict]:
    """The environment blocks: zero-terminated ``name=value`` strings up to an empty one."""
    for p in _processes(space):
        user, peb = _user(space, p), space.maybe("_EPROCESS", p, "Peb")
        params = user.maybe("_PEB", peb, "ProcessParameters") if peb else None
        block = user.maybe("_RTL_USER_PROCESS_PARAMETERS", params, "Environment") if params else None
        if block:
            size = user.maybe("_RTL_USER_PROCESS_PARAMETERS", params, "EnvironmentSize") or 4096
            text = user.padded(block, min(size, 1 << 20)).decode("utf-16-le", "replace").split("\0\0")[0]
            pairs = (x.split("=", 1) for x in text.split("\0") if "=" in x[1:])
            yield _process(space, p) | {"block": signed(block), "env": dict(pairs)}


def windows_threads(space: Space) -> Iterator[dict]:
    """The threads on each process's list."""
    for p in _processes(space):
        owner = _process(space, p)
        for n, t in enumerate(space.walk(space.at("_EPROCESS", p, "ThreadListHead"), "_ETHREAD", "ThreadListEntry")):
            get = lambda f, t=t: space.maybe("_ETHREAD", t, f)
            yield owner | {
                "source": "list", "ord": n, "offset": signed(t), "tid": get("Cid.UniqueThread"), "state": get("Tcb.State"), "suspend_count": get("Tcb.SuspendCount"), "start": signed(get("StartAddress") or 0), "win32_start": signed(get("Win32StartAddress") or 0),
                "create_time": _time(get("CreateTime")), "exit_time": _time(get("ExitTime")), "cross_flags": get("CrossThreadFlags"),
            }


#: Protection values of a region. The low three bits choose, then no-cache and write-combine are flags.
PROTECTIONS = ("PAGE_NOACCESS", "PAGE_READONLY", "PAGE_EXECUTE", "PAGE_EXECUTE_READ", "PAGE_READWRITE", "PAGE_WRITECOPY", "PAGE_EXECUTE_READWRITE", "PAGE_EXECUTE_WRITECOPY")


def protection(value: int) -> str:
    extra = ("", "PAGE_NOCACHE | ", "PAGE_GUARD | ", "PAGE_WRITECOMBINE | ")[value >> 3 & 3]
    return extra + PROTECTIONS[value & 7]


HEAD = 4096


def windows_vads(space: Space) -> Iterator[dict]:
    """The regions of each process: its balanced tree, left to right; a node met twice ends its branch."""
    for p in _processes(space):
        owner, user = _process(space, p), _user(space, p)
        root = space.maybe("_EPROCESS", p, "VadRoot.Root")
        seen: set[int] = set()
        stack: list[tuple[int, bool]] = [(root, False)] if root else []
        while stack:
            node, open_ = stack.pop()
            if not open_:
                if node in seen or not node:
                    continue
                seen.add(node)
                left, right = (space.value("_RTL_BALANCED_NODE", node, f) or 0 for f in ("Left", "Right"))
                stack += [(right, False), (node, True), (left, False)]
                continue
            get = lambda f, v=node: space.maybe("_MMVAD_SHORT", v, f)
            first, last = ((get(f"{f}Vpn") or 0) + ((get(f"{f}VpnHigh") or 0) << 32) for f in ("Starting", "Ending"))
            tag = space.padded(node - 12, 4).decode("latin-1")
            row = owner | {
                "offset": signed(node), "start": signed(first << 12), "end": signed(((last + 1) << 12) - 1), "tag": tag, "protection": protection(get("u.VadFlags.Protection") or 0), "private_memory": get("u.VadFlags.PrivateMemory"),
                "commit_charge": get("u1.VadFlags1.CommitCharge"), "left": signed(space.value("_RTL_BALANCED_NODE", node, "Left") or 0), "right": signed(space.value("_RTL_BALANCED_NODE", node, "Right") or 0), "parent": signed(space.value("_RTL_BALANCED_NODE", node, "ParentValue") or 0),
            }
            if tag != "VadS" and tag != "VadF":  # only the long form has a section
                area = space.value("_SUBSECTION", s, "ControlArea") if (s := space.maybe("_MMVAD", node, "Subsection")) else None
                file = (space.value("_CONTROL_AREA", area, "FilePointer") or 0) & ~15 if area else 0
                if file:
                    row |= {"file": space.unicode(space.at("_FILE_OBJECT", file, "FileName")), "file_object": signed(file)}
                    row |= {c: space.maybe("_FILE_OBJECT", file, f) for c, f in (("delete_pending", "DeletePending"),)}
            head = user.padded(first << 12, min(HEAD, (last + 1 - first) << 12))
            yield row | {"head": head, "zero_pages": not head.strip(b"\0")}


def windows_ldr(space: Space) -> Iterator[dict]:
    """Loaded libraries, by base, with the loader lists that name each."""
    lists = (("in_load", "InLoadOrderModuleList", "InLoadOrderLinks"), ("in_init", "InInitializationOrderModuleList", "InInitializationOrderLinks"), ("in_mem", "InMemoryOrderModuleList", "InMemoryOrderLinks"))
    kind = "_LDR_DATA_TABLE_ENTRY"
    for p in _processes(space):
        owner, user, peb = _process(space, p), _user(space, p), space.maybe("_EPROCESS", p, "Peb")
        ldr = user.maybe("_PEB", peb, "Ldr") if peb else None
        found: dict[int, dict] = {}
        for flag, head, link in lists if ldr else ():
            for e in user.walk(user.at("_PEB_LDR_DATA", ldr, head), kind, link):
                base = user.value(kind, e, "DllBase")
                if base is None:
                    continue
                row = found.setdefault(base, owner | {"ord": len(found), "base": signed(base), "size": user.value(kind, e, "SizeOfImage"), "name": user.unicode(user.at(kind, e, "BaseDllName")), "path": user.unicode(user.at(kind, e, "FullDllName")), "load_count": user.maybe(kind, e, "ObsoleteLoadCount"), "load_time": _time(user.maybe(kind, e, "LoadTime"))} | {f: False for f, *_ in lists})
                row[flag] = True
        yield from found.values()


def _object_name(space: Space, header: int) -> str | None:
    """The name in the optional header before an object header; the bits before the name's in the mask say how far."""
    mask = space.value("_OBJECT_HEADER", header, "InfoMask") or 0
    if not mask & 2:
        return None
    back = space.padded(space.symbol("ObpInfoMaskToOffset") + (mask & 3), 1)[0]
    return space.unicode(space.at("_OBJECT_HEADER_NAME_INFO", header - back, "Name"))


def _handle_entries(space: Space, table: int, level: int, first: int, size: int) -> Iterator[tuple[int, int]]:
    """(handle value, address of the entry) of a table page: entries, or pointers to pages of the level below."""
    if level == 0:
        for i in range(4096 // size):
            yield (first + i) * 4, table + i * size
        return
    span = (4096 // size) * 512 ** (level - 1)
    for i in range(512):
        if below := space.pointer(table + 8 * i):
            yield from _handle_entries(space, below, level - 1, first + i * span, size)


def windows_handles(space: Space) -> Iterator[dict]:
    """Open handles: the entries of each process's table that hold an object, with its type and name."""
    size = space.layout.types["_HANDLE_TABLE_ENTRY"]["size"]
    cookie = space.padded(space.symbol("ObHeaderCookie"), 1)[0] if "ObHeaderCookie" in space.layout.symbols else 0
    kinds = space.symbol("ObTypeIndexTable")
    for p in _processes(space):
        owner, table = _process(space, p), space.value("_EPROCESS", p, "ObjectTable")
        code = space.value("_HANDLE_TABLE", table, "TableCode") if table else None
        for handle, at in _handle_entries(space, code & ~7, code & 7, 0, size) if code else ():
            bits = space.value("_HANDLE_TABLE_ENTRY", at, "ObjectPointerBits")
            if not bits:
                continue
            header = (bits << 4) | 0xFFFF_0000_0000_0000
            index = (space.value("_OBJECT_HEADER", header, "TypeIndex") or 0) ^ (header >> 8 & 0xFF) ^ cookie
            type_ = space.pointer(kinds + 8 * index)
            kind = space.unicode(space.at("_OBJECT_TYPE", type_, "Name")) if type_ else None
            body = space.at("_OBJECT_HEADER", header, "Body")
            if kind == "File":
                name = space.unicode(space.at("_FILE_OBJECT", body, "FileName"))
            elif kind == "Process":
                name = "{process} Pid {pid}".format(**_process(space, body))
            elif kind == "Thread":
                name = f"Tid {space.maybe('_ETHREAD', body, 'Cid.UniqueThread')} Pid {space.maybe('_ETHREAD', body, 'Cid.UniqueProcess')}"
            else:
                name = _object_name(space, header)
            yield owner | {"offset": signed(body), "handle_value": handle, "type": kind, "granted_access": space.value("_HANDLE_TABLE_ENTRY", at, "GrantedAccessBits"), "name": name}


def windows_modules(space: Space) -> Iterator[dict]:
    kind = "_KLDR_DATA_TABLE_ENTRY"
    for n, m in enumerate(space.walk(space.symbol("PsLoadedModuleList"), kind, "InLoadOrderLinks")):
        get = lambda f, m=m: space.value(kind, m, f)
        text = lambda f, m=m: space.unicode(space.at(kind, m, f))
        yield {"source": "list", "ord": n, "offset": signed(m), "base": signed(get("DllBase") or 0), "size": get("SizeOfImage"), "name": text("BaseDllName"), "path": text("FullDllName")}


def _hives(space: Space) -> Iterator[int]:
    yield from space.walk(space.symbol("CmpHiveListHead"), "_CMHIVE", "HiveList")


def _hive_path(space: Space, h: int) -> str | None:
    return next((x for f in ("FileFullPath", "FileUserName", "HiveRootPath") if space.layout.has("_CMHIVE", f) and (x := space.unicode(space.at("_CMHIVE", h, f)))), None)


def windows_hives(space: Space) -> Iterator[dict]:
    for n, h in enumerate(_hives(space)):
        yield {"source": "list", "ord": n, "offset": signed(h), "path": _hive_path(space, h), "get_cell_routine": signed(space.maybe("_CMHIVE", h, "Hive.GetCellRoutine") or 0)}


def key_rows(read: hive.Reader, root: int, offset: int, path: str | None) -> Iterator[dict]:
    """Rows of ``win_keys`` from the cells of one hive."""
    for k in hive.keys(read, root):
        values = k["values"]
        yield {
            "hive_offset": offset, "hive_name": path, "cell": k["cell"], "parent": k["parent"], "name": k["name"], "last_write": _time(k["written"]), "volatile": k["volatile"], "class_name": k["class"], "value_names": [n for n, _, _ in values],
            "value_types": [t for _, t, _ in values], "value_data": [hive.shown(t, raw) for _, t, raw in values], "value_raw": [raw for _, _, raw in values],
        }


def windows_keys(space: Space) -> Iterator[dict]:
    """The keys of all hives on the system's list, through their storage maps."""
    for h in _hives(space):
        yield from key_rows(*hive.memory_reader(space, h), signed(h), _hive_path(space, h))


def hive_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``win_keys`` from whole hive files: rows (image, path, hive_offset, content)."""
    fields = [f.name for f in spark.createDataFrame([], SCHEMAS["win_keys"]).schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in b.itertuples():
                rows = [r | {"image": i.image} for r in key_rows(*hive.file_reader(bytes(i.content)), int(i.hive_offset), i.path)]
                yield pd.DataFrame(rows, columns=fields)

    return files.select("image", "path", "hive_offset", "content").mapInPandas(run, SCHEMAS["win_keys"])


def mapped_pages(space: Space) -> Iterator[dict]:
    for virt, phys, size, _ in space.pages():
        yield {"pid": 0, "virt": signed(virt), "phys": phys, "size": size, "class": "valid", "large": size > 4096}


#: Kind of object -> how one image's rows are read.
WALKS: dict[str, Callable[[Space], Iterator[dict]]] = {"lin_tasks": linux_tasks, "lin_modules": linux_modules, "win_processes": windows_processes, "win_modules": windows_modules, "win_pages": mapped_pages, "win_threads": windows_threads, "win_vads": windows_vads, "win_ldr": windows_ldr, "win_handles": windows_handles, "win_envars": windows_envars, "win_hives": windows_hives, "win_keys": windows_keys}


def walked(spark: SparkSession, images: DataFrame, kind: str) -> DataFrame:
    """The object table ``kind`` of images: rows (image, path, layout_path, dtb, shift)."""
    fields = [c.name for c in spark.createDataFrame([], SCHEMAS[kind]).schema]
    reader = WALKS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in b.itertuples():
                space = Space(Memory(i.path), Layout.load(i.layout_path), int(i.dtb), int(i.shift))
                rows = [r | {"image": i.image} for r in reader(space)]
                if rows:
                    out = pd.DataFrame(rows)
                    yield out.reindex(columns=fields).astype(object).where(lambda d: d.notna(), None)

    return images.repartition(max(1, images.count()), "image").mapInPandas(run, SCHEMAS[kind])


def carved_tasks(chunks: DataFrame, layout: Layout, classes: Sequence[int], size: int) -> DataFrame:
    """Linux tasks found by the scheduler class they point to, anywhere in physical memory.

    A hit is the class pointer; the struct starts its offset before. Fields are decoded from the chunk's bytes, so a
    struct must lie within a chunk and its overlap.
    """
    at = layout.offset("task_struct", "sched_class")
    patterns = {str(i): (c & 0xFFFF_FFFF_FFFF_FFFF).to_bytes(8, "little") for i, c in enumerate(classes)}
    keyed = chunks.withColumn("_key", F.concat_ws("@", "image", F.col("start").cast("string")))
    hits = scan.scan(keyed, "_key", patterns, size)
    d = keyed.join(hits, "_key").withColumn("o", (F.col("hit_offset") - F.col("start") - at).cast("int")).filter("o >= 0")
    u = lambda f: scalars.uint(F.col("bytes"), F.col("o") + layout.offset("task_struct", f), 4)
    comm = F.split_part(F.substring("bytes", F.col("o") + layout.offset("task_struct", "comm") + 1, F.lit(16)).cast("string"), F.lit("\0"), F.lit(1))
    rows = d.select("image", F.lit("scan").alias("source"), (F.col("start") + F.col("o")).alias("physical"), u("tgid").alias("pid"), u("pid").alias("tid"), comm.alias("comm"), F.lit("TASK_RUNNING").alias("exit_state"))
    return rows.filter("pid > 0 AND pid < 65535").dropDuplicates(["image", "physical"])


#: Bytes of a pool header and of the unit of its block sizes on 64-bit systems. Fixed values.
POOL_HEADER = POOL_UNIT = 16


def pool_hits(chunks: DataFrame, tags: Mapping[str, bytes], size: int, least: int = 32) -> DataFrame:
    """(image, tag, start, block, header, o): pool blocks with a tag, anywhere in physical memory.

    A header lies on its unit; its tag is four bytes in. Blocks smaller than ``least`` bytes and free ones fall away.
    ``o`` is where the header is in the chunk's ``bytes``, which come along for decoding.
    """
    keyed = chunks.withColumn("_key", F.concat_ws("@", "image", F.col("start").cast("string")))
    hits = scan.scan(keyed, "_key", tags, size)
    d = keyed.join(hits, "_key").withColumn("o", (F.col("hit_offset") - F.col("start") - 4).cast("int")).filter((F.col("o") >= 0) & (F.col("o") % POOL_UNIT == 0))
    block = scalars.uint(F.col("bytes"), F.col("o") + 2, 1) * POOL_UNIT
    kind = scalars.uint(F.col("bytes"), F.col("o") + 3, 1)
    return d.withColumns({"block": block.cast("int"), "_kind": kind}).filter((F.col("block") >= least) & (F.col("_kind") > 0)).select("image", F.col("pattern").alias("tag"), "start", "block", (F.col("start") + F.col("o")).alias("header"), "o", "bytes")


def carved_processes(chunks: DataFrame, layout: Layout, size: int) -> DataFrame:
    """Windows processes in pool blocks, listed or not: the struct ends where its block does.

    Needs the struct within a chunk and its overlap. Rows have the columns of ``win_processes`` that memory shows.
    """
    whole = -(-layout.types["_EPROCESS"]["size"] // POOL_UNIT) * POOL_UNIT
    d = pool_hits(chunks, {"Proc": b"Proc", "Pro\xe3": b"Pro\xe3"}, size, whole + POOL_HEADER)
    d = d.withColumn("_at", F.col("o") + F.col("block") - whole)

    def number(field: str) -> Column:
        offset, kind = layout.field("_EPROCESS", field)
        return scalars.uint(F.col("bytes"), F.col("_at") + offset, min(8, layout.size_of(kind)))

    name = F.split_part(F.substring("bytes", F.col("_at") + layout.offset("_EPROCESS", "ImageFileName") + 1, F.lit(15)).cast("string"), F.lit("\0"), F.lit(1))
    rows = d.select(
        "image", F.lit("psscan").alias("source"), F.row_number().over(Window.partitionBy("image").orderBy("header")).cast("long").alias("ord"), (F.col("header") + F.col("block") - whole).alias("physical"), number("UniqueProcessId").alias("pid"),
        number("InheritedFromUniqueProcessId").alias("ppid"), name.alias("name"), scalars.filetime(number("CreateTime")).alias("create_time"), scalars.filetime(number("ExitTime")).alias("exit_time"),
    )
    # Process ids are multiples of four below 2^24 or so; a name is printable.
    return rows.filter((F.col("pid") % 4 == 0) & F.col("pid").between(0, 1 << 24) & F.col("name").rlike(r"^[\x20-\x7e]+$")).dropDuplicates(["image", "physical"])


def open_images(spark: SparkSession, images: Sequence[Mapping], kinds: Sequence[str], folder: str | None = None) -> Session:
    """A session over images, each a mapping with image, path, layout_path, dtb and shift.

    Chunks come from the same files under the same image names; with ``folder`` from its files, under their own names.
    """
    rows = spark.createDataFrame([(i["image"], i["path"], i["layout_path"], i["dtb"], i.get("shift", 0)) for i in images], "image string, path string, layout_path string, dtb long, shift long")
    tables = {k: walked(spark, rows, k) for k in kinds}
    tables["chunks"] = read_image(spark, folder) if folder else read_image(spark, images=[(i["image"], i["path"]) for i in images])
    return Session(spark, tables)


def as_table(df: DataFrame, kind: str) -> DataFrame:
    """Rows with all columns of an object table, null where ``df`` has none, to be put beside other rows of it."""
    schema = df.sparkSession.createDataFrame([], SCHEMAS[kind]).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def symbols_table(spark: SparkSession, image: str, layout: Layout, shift: int = 0) -> DataFrame:
    data = [(image, signed((v["address"] + shift) & 0xFFFF_FFFF_FFFF_FFFF), n, None) for n, v in layout.symbols.items()]
    return spark.createDataFrame(data, SCHEMAS["symbols"])


def dump_layout(path: str, layout: dict) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(layout, f)
