"""Operators without an operating system: banners, scans, timelines, layers, symbol files."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import rules as byte_rules
from ..operators import scan, timeline
from .session import ALIASES, OPERATORS, Session, operator, schemas

CHUNK, OVERLAP = 1 << 20, 4096

schemas(
    chunks="layer string, start long, size long, bytes binary",
    layers="ord int, name string, type string, key string, value string",
    isf_files="uri string, content string",
    phys_owner="page long, owner string, virt long",
    strings_lines="line string",
)

#: Kernel banners as they lie in memory. Fixed values.
BANNERS = rb"(Linux version|Darwin Kernel Version) [0-9]+\.[0-9]+\.[0-9]+[^\x00]*"


def text_hits(df: DataFrame, keep: Sequence[str], start: str, data: str, pattern: bytes, maxsize: int) -> DataFrame:
    """(keep, offset, text, hex) of the matches of a byte regular expression in each row's bytes, none over ``maxsize``."""
    compiled = re.compile(pattern, re.DOTALL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at, raw = [], [], []
            for i in range(b.num_rows):
                whole = b.column(len(keep) + 1)[i].as_py() or b""
                base = b.column(len(keep))[i].as_py()
                for first, end in scan.matches(compiled, whole, 0, len(whole) + 1, maxsize):
                    rows.append(i)
                    at.append(base + first)
                    raw.append(whole[first:end])
            ix = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(ix) for k in range(len(keep))), pa.array(at, pa.int64()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string()), pa.array(raw, pa.binary())], names=[*keep, "offset", "text", "hex"])

    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, start, data).mapInArrow(run, f"{fields}, offset long, text string, hex binary")


def proper() -> Column:
    """Bytes of a chunk without its overlap; a chunk that does not say is one by itself."""
    return F.coalesce("size", F.length("bytes"))


def layer(s: Session, name: str = "primary") -> DataFrame:
    """Chunks of a layer, each with the first ``OVERLAP`` bytes of the next one."""
    return s.table("chunks").filter(F.col("layer") == name)


def layer_hits(s: Session, pattern: bytes, maxsize: int, grab: int = 0) -> DataFrame:
    """(image, offset, hex) of the matches of a byte regular expression in the primary layer of every image."""
    chunks = layer(s)
    if chunks.isEmpty():
        return chunks.select("image", F.col("start").alias("offset"), F.col("bytes").alias("hex"))
    return scan.regex_scan(chunks, ["image"], {"p": pattern}, maxsize, proper(), grab=grab).select("image", "offset", "hex")


def _text(hits: DataFrame) -> DataFrame:
    """With the bytes as text; what is not UTF-8 is replaced."""
    return hits.select("image", "offset", F.make_valid_utf8(F.decode("hex", "UTF-8")).alias("text"), "hex")


@operator("banners.Banners")
def banners(s):
    return _text(layer_hits(s, BANNERS, 512)).select("image", "offset", F.col("text").alias("banner"))


@operator("regexscan.RegExScan")
def regexscan(s, pattern=b".", maxsize=128):
    return _text(layer_hits(s, pattern, maxsize))


@operator("yarascan.YaraScan")
def yarascan(s, rules=""):
    """Hits of the strings of rules whose condition holds for the chunk; a hit seen by two chunks counts once."""
    return byte_rules.scan_rules(layer(s), ["image"], "start", "bytes", rules).dropDuplicates(["image", "offset", "rule", "component"])


def _areas(s, kind, rules, pid, carry):
    from .session import only

    d = only(s.table(kind).filter("head IS NOT NULL"), "pid", pid)
    # Equal regions are scanned once; the hits are joined back to all owners.
    d = d.withColumn("_sha", F.sha2("head", 256))
    hits = byte_rules.scan_rules(d.dropDuplicates(["_sha"]).withColumn("_zero", F.lit(0).cast("long")), ["_sha"], "_zero", "head", rules)
    return d.join(hits.withColumnRenamed("offset", "_o"), "_sha").select("image", (F.col("start") + F.col("_o")).alias("offset"), "pid", *carry, "rule", "component", "value")


@operator("windows.vadyarascan.VadYaraScan")
def vadyarascan(s, rules="", pid=None):
    return _areas(s, "win_vads", rules, pid, ["process"])


@operator("linux.vmayarascan.VmaYaraScan")
def vmayarascan(s, rules="", pid=None):
    return _areas(s, "lin_vmas", rules, pid, [])


@operator("windows.vadregexscan.VadRegExScan")
def vadregexscan(s, pattern=b".", pid=None, maxsize=128):
    from .session import only

    return text_hits(only(s.table("win_vads").filter("head IS NOT NULL"), "pid", pid), ["image", "pid", "process"], "start", "head", pattern, maxsize)


@operator("windows.strings.Strings")
def strings(s, pid=None):
    """Lines ``offset text`` with the owners of the physical page they lie in."""
    # What a line is: fixed value, the format that such files have. A decimal offset, then text that starts with a word character.
    e = lambda i: F.regexp_extract("line", r"^(?:\W*)([0-9]+)(?:\W*)(\w[\w\W]+)\n?", i)
    d = s.table("strings_lines").select("image", e(2).alias("string"), e(1).cast("long").alias("physical")).filter("string <> ''").withColumn("page", F.floor(F.col("physical") / 4096).cast("long"))
    owners = s.table("phys_owner")
    d = d.join(owners, ["image", "page"], "left")
    seen = F.array_join(F.array_sort(F.collect_set(F.when(F.col("owner").isNotNull(), F.concat("owner", F.lit(":"), F.lower(F.hex(F.col("virt") + F.col("physical") % 4096)))))), ", ")
    return d.groupBy("image", "string", "physical").agg(seen.alias("result"))


@operator("windows.truecrypt.Passphrase")
def truecrypt(s, min_length=5):
    """A little-endian length L of min_length..64, L printable bytes and three zeros."""
    pattern = b"|".join(re.escape(bytes([n, 0, 0, 0])) + b"[\\x20-\\x7e]{%d}\\x00{3}" % n for n in range(min_length, 65))
    # A look-ahead, so that a match out of line does not hide one in line behind it.
    d = layer_hits(s, b"(?=" + pattern + b")", 71, grab=71).filter(F.col("offset") % 4 == 0)
    n = F.conv(F.hex(F.substring("hex", 1, 1)), 16, 10).cast("int")
    return d.select("image", "offset", n.alias("length"), F.substring("hex", F.lit(5), n).cast("string").alias("password"))


@operator("windows.mbrscan.MBRScan")
def mbrscan(s):
    """Sectors that end in 55 AA and have boot code: a header row and its four partitions."""
    from ..functions import scalars

    d = layer_hits(s, rb"(?=.{510}\x55\xaa)", 512, grab=512).filter(F.col("offset") % 512 == 0)
    d = d.select("image", "offset", F.col("hex").alias("raw")).filter(F.substring("raw", 1, 440) != F.lit(b"\0" * 440))
    part = lambda i: F.struct(F.lit(i + 1).alias("partition"), (scalars.uint(F.col("raw"), 446 + 16 * i, 1) == 0x80).alias("bootable"), scalars.uint(F.col("raw"), 450 + 16 * i, 1).alias("type"), scalars.uint(F.col("raw"), 454 + 16 * i, 4).alias("starting_lba"), scalars.uint(F.col("raw"), 458 + 16 * i, 4).alias("sectors"))
    head = F.struct(F.lit(0).alias("partition"), *(F.lit(None).cast(k).alias(n) for n, k in (("bootable", "boolean"), ("type", "long"), ("starting_lba", "long"), ("sectors", "long"))))
    sig = F.concat_ws("-", *(F.lower(F.hex(F.substring("raw", 441 + i, 1))) for i in range(4)))
    return d.select("image", "offset", sig.alias("disk_signature"), F.md5(F.substring("raw", 1, 440)).alias("bootcode_md5"), F.md5("raw").alias("mbr_md5"), F.inline(F.array(head, *(part(i) for i in range(4)))))


@operator("windows.crashinfo.Crashinfo")
def crashinfo(s):
    """The header of a 64-bit crash dump, in the first chunk of the file layer."""
    from ..functions import scalars

    raw = F.col("bytes")
    u = lambda o, n: scalars.uint(raw, o, n)
    d = layer(s, "file").filter("start = 0").filter(F.substring(raw, 1, 8) == F.lit(b"PAGEDU64"))
    kind = F.when(u(0xF98, 4) == 1, "Full Dump (0x1)").when(u(0xF98, 4) == 5, "Bitmap Dump (0x5)").otherwise("Unknown")
    bitmap = lambda o: F.when(u(0xF98, 4) == 5, u(o, 8))
    return d.select("image", F.substring(raw, 1, 8).cast("string").alias("signature"), u(8, 4).alias("major_version"), u(12, 4).alias("minor_version"), u(16, 8).alias("directory_table_base"), u(24, 8).alias("pfn_data_base"), u(32, 8).alias("loaded_module_list"), u(40, 8).alias("active_process_head"), u(48, 4).alias("machine_image_type"), u(52, 4).alias("number_processors"), u(0x80, 8).alias("debugger_data_block"), kind.alias("dump_type"), scalars.filetime(u(0xFA8, 8)).alias("system_time"), bitmap(0x2020).alias("bitmap_header_size"), bitmap(0x2028).alias("bitmap_size"), bitmap(0x2030).alias("bitmap_pages"))


@operator("vmscan.Vmscan")
def vmscan(s, revisions=(0x10, 0x12, 0x04, 0x0E)):
    """Pages that start with a known VMCS revision id and hold a plausible link pointer."""
    from ..functions import scalars

    pages = layer(s).select("image", "start", "bytes", F.explode(F.sequence(F.lit(0), F.greatest(proper().cast("int") - 4096, F.lit(0)), F.lit(4096))).alias("o"))
    page = pages.select("image", (F.col("start") + F.col("o")).alias("offset"), F.substring("bytes", F.col("o") + 1, F.lit(4096)).alias("page")).filter(F.length("page") == 4096)
    p = F.col("page")
    return page.filter(scalars.uint(p, 0, 4).isin(*revisions) & (scalars.uint(p, 4, 4) == 0)).select("image", F.lit("Intel64").alias("architecture"), F.col("offset").alias("vmcs_offset"), F.expr("locate(unhex('FFFFFFFFFFFFFFFF'), page)").alias("_l")).filter("_l > 0").drop("_l").dropDuplicates(["image", "vmcs_offset"])


@operator("layerwriter.LayerWriter")
def layerwriter(s, path=None, layers=("primary",)):
    """Write the chunks of layers, without their overlap, as Parquet by layer; returns what was written."""
    d = s.table("chunks").filter(F.col("layer").isin(*layers)).withColumn("bytes", F.substring("bytes", F.lit(1), proper().cast("int")))
    if path:
        d.write.mode("errorifexists").partitionBy("image", "layer").parquet(path)
    return d.groupBy("image", F.col("layer").alias("layer_name")).agg(F.sum(F.length("bytes")).cast("long").alias("n_bytes"), F.lit("written" if path else "listed").alias("status"))


@operator("configwriter.ConfigWriter")
def configwriter(s):
    return s.table("layers").filter("key IS NOT NULL").select("image", F.concat_ws(".", "name", "key").alias("key"), "value")


@operator("frameworkinfo.FrameworkInfo")
def frameworkinfo(s):
    rows = [("operator", n) for n in sorted(OPERATORS)] + [("alias", n) for n in sorted(ALIASES)]
    return s.spark.createDataFrame(rows, "kind string, data string")


@operator("isfinfo.IsfInfo")
def isfinfo(s, filter=None):
    """How many types and symbols each symbol file has; null where it is no such file."""
    kind = "struct<base_types:map<string,string>,user_types:map<string,string>,symbols:map<string,string>,enums:map<string,string>>"
    d = s.table("isf_files")
    d = (d if filter is None else d.filter(F.contains("uri", F.lit(filter)))).withColumn("_j", F.from_json("content", kind))
    n = lambda c: F.when(F.col("_j.base_types").isNotNull(), F.coalesce(F.size(F.map_keys(f"_j.{c}")), F.lit(0))).alias(f"n_{c}")
    return d.select("uri", F.col("_j.base_types").isNotNull().alias("valid"), n("base_types"), n("user_types"), n("symbols"), n("enums"))


#: Operator -> (description, kind of time -> column). What the timeline takes from each.
EVENTS: dict[str, tuple] = {
    "windows.pslist.PsList": (lambda: F.format_string("Process: %d %s (%d)", "pid", "image_file_name", "offset"), {"Created": "create_time", "Modified": "exit_time"}),
    "windows.psscan.PsScan": (lambda: F.format_string("Process: %d %s (%d)", "pid", "image_file_name", "offset"), {"Created": "create_time", "Modified": "exit_time"}),
    "windows.dlllist.DllList": (lambda: F.format_string("DLL Load: Process %d %s Loaded %s (%s)", "pid", "process", "name", "path"), {"Created": "load_time"}),
    "windows.netscan.NetScan": (lambda: F.format_string("Network connection: Process %d %s Local Address %s:%d", "pid", "owner", "local_addr", "local_port"), {"Created": "created"}),
    "windows.netstat.NetStat": (lambda: F.format_string("Network connection: Process %d %s Local Address %s:%d", "pid", "owner", "local_addr", "local_port"), {"Created": "created"}),
    "windows.sessions.Sessions": (lambda: F.format_string("Process: %d %s started by user %s", "pid", "process", "user_name"), {"Created": "create_time"}),
    "windows.symlinkscan.SymlinkScan": (lambda: F.format_string("Symlink: %s -> %s", "from_name", "to_name"), {"Created": "create_time"}),
    "windows.thrdscan.ThrdScan": (lambda: F.format_string("Thread: %d of process %d", "tid", "pid"), {"Created": "create_time", "Modified": "exit_time"}),
    "windows.threads.Threads": (lambda: F.format_string("Thread: %d of process %d", "tid", "pid"), {"Created": "create_time", "Modified": "exit_time"}),
    "windows.orphan_kernel_threads.Threads": (lambda: F.format_string("Thread: %d of process %d", "tid", "pid"), {"Created": "create_time", "Modified": "exit_time"}),
    "windows.unloadedmodules.UnloadedModules": (lambda: F.format_string("Unloaded module: %s", "name"), {"Created": "time"}),
    "windows.registry.userassist.UserAssist": (lambda: F.format_string("UserAssist: %s", "name"), {"Modified": "last_updated"}),
    "windows.registry.amcache.Amcache": (lambda: F.format_string("Amcache: %s %s", "family", "path"), {"Created": "installed", "Modified": "modified", "Changed": "modified2"}),
    "windows.shimcachemem.ShimcacheMem": (lambda: F.format_string("Shimcache: File %s executed", "path"), {"Modified": "modified", "Accessed": "updated"}),
    "windows.mftscan.MFTScan": (lambda: F.format_string("MFT %s entry for %s", "attribute", "filename"), {"Created": "created", "Modified": "modified", "Changed": "updated", "Accessed": "accessed"}),
    "linux.pslist.PsList": (lambda: F.format_string("Process %d/%d %s", "pid", "tid", "comm"), {"Created": "creation_time"}),
    "linux.bash.Bash": (lambda: F.format_string("%d (%s): \"%s\"", "pid", "process", "command"), {"Created": "command_time"}),
    "linux.boottime.Boottime": (lambda: F.format_string("System boot time for time namespace %d", "time_ns"), {"Created": "boot_time"}),
    "linux.lsof.Lsof": (lambda: F.format_string("Process %s (%d/%d) Open \"%s\"", "process", "pid", "tid", "path"), {"Changed": "changed", "Modified": "modified", "Accessed": "accessed"}),
    "linux.pagecache.Files": (lambda: F.format_string("Cached file %s", "path"), {"Changed": "changed", "Modified": "modified", "Accessed": "accessed"}),
    "mac.bash.Bash": (lambda: F.format_string("%d (%s): \"%s\"", "pid", "process", "command"), {"Created": "command_time"}),
}


def events_of(s: Session, name: str) -> DataFrame:
    text, kinds = EVENTS[name]
    d = s.run(name)
    x = F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("time")) for k, c in kinds.items())))
    return d.select(F.lit(name).alias("plugin"), text().alias("description"), x)


@operator("timeliner.Timeliner")
def timeliner(s, plugins=None, bodyfile=False):
    """Events of all operators that have times, one row a (plugin, description); rows without a time sort last."""
    rows = timeline.pivoted(timeline.merge([events_of(s, n) for n in (plugins or EVENTS)]))
    return rows.withColumn("line", timeline.body_line(rows)) if bodyfile else rows


