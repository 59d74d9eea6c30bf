"""Linux operators over object tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import relational
from .session import Session, alias, containing, only, operator, resolve, schemas

schemas(
    lin_tasks="source string, ord long, offset long, physical long, pid long, tid long, ppid long, comm string, uid long, gid long, euid long, egid long, created timestamp, exit_state string, cred long, is_kernel boolean, threadfn long, thread_name string, args binary, env binary, exe string, cap_inheritable long, cap_permitted long, cap_effective long, cap_bounding long, cap_ambient long, cap_last int, time_ns long, boot_time timestamp, tracer long, tracees array<long>, ptrace_flags int, stack array<long>, stack_base long",
    lin_vmas="pid long, process string, is_user boolean, start long, end long, flags string, pgoff long, major int, minor int, inode long, path string, head binary, dirty_pages long",
    lin_modules="source string, ord long, offset long, base long, size long, name string, taints string, params map<string,string>",
    lin_files="pid long, tid long, process string, fd int, path string, device string, inode long, type string, mode string, changed timestamp, modified timestamp, accessed timestamp, size long",
    lin_libraries="pid long, process string, ord long, load_address long, path string",
    lin_history="pid long, process string, ord long, command_time timestamp, command string",
    lin_bpf="address long, name string, tag string, type string",
    lin_framebuffers="address long, device string, id string, size long, resolution string, bpp int, state string",
    lin_resources="node long, parent long, ord long, name string, start long, end long",
    lin_devices="net_ns long, ifindex int, interface string, mac string, promiscuous boolean, state string, mtu int, qdisc string, qlen int, flags array<string>, addresses array<struct<ip:string,prefix:int,scope:string>>",
    lin_kallsyms="source string, address long, type string, size long, exported boolean, module string, name string, description string",
    lin_kmsg="version int, seq long, facility string, level string, nanos long, caller string, line string",
    lin_handlers="kind string, ord long, name string, member string, idx int, table_address long, address long, priority int, net_ns long, proto string, hook string, detail string, owner long",
    lin_mounts="mnt_ns long, pid long, ord long, mount_id int, parent_id int, device string, root string, path string, options string, fields string, fs_type string, source string",
    lin_inodes="superblock long, mount_point string, device string, inode_no long, inode long, file_type string, pages long, cached_pages long, mode string, accessed timestamp, modified timestamp, changed timestamp, path string, size long",
    lin_inode_pages="inode long, virt long, phys long, mapping long, idx long, dump_safe boolean, flags string, bytes binary",
    lin_sockets="source string, net_ns long, process string, pid long, tid long, fd int, offset long, family string, type string, proto string, src_addr string, src_port string, dst_addr string, dst_port string, state string, filter string",
    lin_ftrace="ops long, callback long, flags string, hooked array<long>",
    lin_perf="pid long, process string, event string, short_name string, full_name string, address long",
    lin_notes="offset long, note string",
)


def _tasks(s: Session, source: str = "list") -> DataFrame:
    d = s.table("lin_tasks").filter(F.col("source") == source)
    return relational.first_seen(d.withColumn("_k", F.concat_ws("@", "image", F.col("offset").cast("string"))), "_k", ["ord"]).drop("_k")


def _leaders(s: Session, pid=None, threads=False) -> DataFrame:
    d = only(_tasks(s), "pid", pid)
    return d if threads else d.filter("pid = tid")


def _comm(decorate: bool):
    """Kernel threads in brackets, user threads in braces."""
    c = F.col("comm")
    return (F.when(F.col("is_kernel"), F.concat(F.lit("["), c, F.lit("]"))).when(F.col("pid") != F.col("tid"), F.concat(F.lit("{"), c, F.lit("}"))).otherwise(c) if decorate else c).alias("comm")


@operator("linux.pslist.PsList")
def pslist(s, pid=None, threads=False, decorate_comm=False):
    return _leaders(s, pid, threads).select("image", "offset", "pid", "tid", "ppid", _comm(decorate_comm), "uid", "gid", "euid", "egid", F.col("created").alias("creation_time"), "ord")


@operator("linux.psscan.PsScan")
def psscan(s):
    return s.table("lin_tasks").filter("source = 'scan' AND pid > 0 AND pid < 65535 AND exit_state IS NOT NULL").dropDuplicates(["image", "physical"]).select("image", F.col("physical").alias("offset"), "pid", "tid", "ppid", "comm", "exit_state")


@operator("linux.pidhashtable.PIDHashTable")
def pidhashtable(s, decorate_comm=False):
    return _tasks(s, "pidhash").select("image", "offset", "pid", "tid", "ppid", _comm(decorate_comm))


@operator("linux.pstree.PsTree")
def pstree(s, pid=None, threads=False, decorate_comm=False):
    """Children in ascending tid order under their parent; with ``pid`` the tasks below those asked for."""
    d = _leaders(s, None, threads)
    up = d.select("image", "tid", F.when(F.col("pid") != F.col("tid"), F.col("pid")).otherwise(F.col("ppid")).alias("up"))
    paths = relational.tree_paths(up, "tid", "up", ["image"])
    if pid is not None:
        wanted = F.arrays_overlap(F.split("path", "/"), F.array(*(F.lit(f"{p:016X}") for p in (pid if isinstance(pid, (list, tuple)) else [pid]))))
        paths = paths.filter(wanted)
    return d.join(paths, ["image", "tid"]).select("image", "offset", "pid", "tid", "ppid", _comm(decorate_comm), "depth", F.col("path").alias("tree_path"))


@operator("linux.psaux.PsAux")
def psaux(s, pid=None):
    d = _leaders(s, pid)
    text = F.regexp_replace(F.translate(F.decode("args", "UTF-8"), "\0", " "), " $", "")
    args = F.when(F.col("is_kernel"), F.concat(F.lit("["), "comm", F.lit("]"))).when(F.length("args").between(1, 4096), text)
    return d.select("image", "pid", "ppid", "comm", args.alias("args"), F.when(args.isNull(), scalars.UNREADABLE).alias("absent"))


@operator("linux.envars.Envars")
def envars(s, pid=None):
    """Variables up to the first entry without an equals sign."""
    d = _leaders(s, pid).filter(~F.coalesce("is_kernel", F.lit(False)) & F.length("env").between(1, 8192))
    e = d.select("image", "pid", "ppid", "comm", F.posexplode(F.split(F.decode("env", "UTF-8"), "\0")).alias("_i", "_e"))
    stop = F.min(F.when(~F.contains("_e", F.lit("=")), F.col("_i"))).over(Window.partitionBy("image", "pid"))
    e = e.withColumn("_stop", stop).filter("_stop IS NULL OR _i < _stop")
    return e.select("image", "pid", "ppid", "comm", F.split_part("_e", F.lit("="), F.lit(1)).alias("key"), F.expr("substring(_e, locate('=', _e) + 1)").alias("value"), F.col("_i").alias("ord"))


@operator("linux.boottime.Boottime")
def boottime(s):
    d = _tasks(s).filter("time_ns IS NOT NULL")
    return d.groupBy("image", "time_ns").agg(F.min_by("boot_time", "ord").alias("boot_time"))


#: Order of the capability bits. Fixed values.
CAPABILITIES = ("chown", "dac_override", "dac_read_search", "fowner", "fsetid", "kill", "setgid", "setuid", "setpcap", "linux_immutable", "net_bind_service", "net_broadcast", "net_admin", "net_raw", "ipc_lock", "ipc_owner", "sys_module", "sys_rawio", "sys_chroot", "sys_ptrace", "sys_pacct", "sys_admin", "sys_boot", "sys_nice", "sys_resource", "sys_time", "sys_tty_config", "mknod", "lease", "audit_write", "audit_control", "setfcap", "mac_override", "mac_admin", "syslog", "wake_alarm", "block_suspend", "audit_read", "perfmon", "bpf", "checkpoint_restore")


@operator("linux.capabilities.Capabilities")
def capabilities(s, pids=None):
    sets = ("cap_inheritable", "cap_permitted", "cap_effective", "cap_bounding", "cap_ambient")
    full = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("cap_last") + 1) - 1
    names = lambda c: F.array_join(F.array_compact(F.array(*(F.when(F.getbit(c, F.lit(i)) == 1, F.lit(f"cap_{n}")) for i, n in enumerate(CAPABILITIES)))), ", ")
    shown = [F.when(F.col(c) == 0, "").when(F.col(c) == full, "all").otherwise(F.when(F.col(c).isNotNull(), names(c))).alias(c) for c in sets]
    return only(_tasks(s), "pid", pids).select("image", F.col("comm").alias("name"), "tid", "pid", "ppid", "euid", *shown)


@operator("linux.kthreads.Kthreads")
def kthreads(s):
    d = _tasks(s).filter("is_kernel AND threadfn <> 0").select("image", "tid", F.coalesce("thread_name", "comm").alias("thread_name"), F.col("threadfn").alias("handler"))
    return resolve(s, d, "handler", _known(s)).select("image", "tid", "thread_name", "handler", "module", "symbol")


@operator("linux.ptrace.Ptrace")
def ptrace(s):
    """Tasks that trace or are traced; the depth is the tracee's place."""
    d = _tasks(s).filter("tracer IS NOT NULL OR size(tracees) > 0")
    return d.select("image", F.col("comm").alias("process"), "pid", "tid", F.col("tracer").alias("tracer_tid"), F.posexplode_outer("tracees").alias("_i", "tracee_tid"), "ptrace_flags").withColumn("depth", F.coalesce("_i", F.lit(0))).drop("_i")


@operator("linux.pscallstack.PsCallStack")
def pscallstack(s, pid=None, unresolved=False):
    """Words of the kernel stack that lie at or after a kernel symbol, by the greatest symbol not above them."""
    d = only(_tasks(s), "pid", pid).select("image", "tid", "comm", "stack_base", F.posexplode("stack").alias("position", "value")).filter("value <> 0")
    k = s.table("lin_kallsyms").groupBy("image", "address").agg(F.min("name").alias("name"), F.min("type").alias("type"), F.min("module").alias("module"), F.max(F.coalesce("size", F.lit(1 << 20))).alias("size"))
    k = k.withColumn("_last", F.col("address") + F.col("size")).withColumnRenamed("address", "_start")
    d = containing(d, "value", k, ["image"], "_start", "_last", ["name", "type", "module"], inclusive=False)
    d = d if unresolved else d.filter("name IS NOT NULL")
    return d.select("image", "tid", "comm", "position", (F.col("stack_base") + F.col("position") * 8).alias("address"), "value", "name", "type", "module")


# --- memory areas -------------------------------------------------------------------------------------------------


@operator("linux.proc.Maps")
def maps(s, pid=None, address=None):
    d = only(s.table("lin_vmas").filter("is_user"), "pid", pid)
    d = d if address is None else d.filter((F.col("start") <= address) & (F.col("end") > address))
    return d.drop("is_user", "head", "dirty_pages")


@operator("linux.elfs.Elfs")
def elfs(s, pid=None):
    return only(s.table("lin_vmas").filter("is_user"), "pid", pid).filter(F.substring("head", 1, 4) == F.lit(b"\x7fELF")).select("image", "pid", "process", "start", "end", F.col("path").alias("file_path"))


@operator("linux.malware.malfind.Malfind")
def malfind(s, pid=None, hexdump_size=64):
    f = F.substring("flags", 1, 3)
    odd = (f == "rwx") | ((f == "r-x") & F.coalesce(F.col("path"), F.lit("")).isin("", "Anonymous Mapping")) | (f.endswith("x") & (F.coalesce(F.col("dirty_pages"), F.lit(0)) > 0))
    return only(s.table("lin_vmas").filter("is_user"), "pid", pid).filter(odd).select("image", "pid", "process", "start", "end", "path", F.col("flags").alias("protection"), F.substring("head", 1, hexdump_size).alias("hexdump"))


@operator("linux.library_list.LibraryList")
def library_list(s, pids=None):
    d = only(s.table("lin_libraries").filter("path <> ''"), "pid", pids)
    w = Window.partitionBy("image", "pid", "load_address").orderBy("ord")
    return d.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("image", F.col("process").alias("name"), "pid", "load_address", "path")


@operator("linux.bash.Bash")
def bash(s, pid=None):
    return only(s.table("lin_history").filter("process IN ('bash', 'sh', 'dash')"), "pid", pid).select("image", "pid", "process", "command_time", "command", "ord")


# --- modules and hooks --------------------------------------------------------------------------------------------


def _params():
    return F.array_join(F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ").alias("load_arguments")


def _module_rows(d: DataFrame) -> DataFrame:
    return d.select("image", "offset", F.col("name").alias("module_name"), F.col("size").alias("code_size"), "taints", _params())


def _from(s: Session, source: str) -> DataFrame:
    return s.table("lin_modules").filter((F.col("source") == source) & F.col("name").isNotNull())


def _known(s: Session) -> str:
    s.tables["_lin_known"] = s.table("lin_modules").filter("source IN ('kernel', 'list')").select("image", "name", "base", "size", "ord")
    return "_lin_known"


@operator("linux.lsmod.Lsmod")
def lsmod(s):
    return _module_rows(_from(s, "list"))


@operator("linux.malware.check_modules.Check_modules")
def check_modules(s):
    return _module_rows(_from(s, "sysfs").join(_from(s, "list").select("image", "name").distinct(), ["image", "name"], "left_anti"))


@operator("linux.malware.hidden_modules.Hidden_modules")
def hidden_modules(s):
    known = _from(s, "list").unionByName(_from(s, "sysfs")).select("image", "offset").distinct()
    return _module_rows(_from(s, "scan").join(known, ["image", "offset"], "left_anti"))


@operator("linux.malware.modxview.Modxview")
def modxview(s):
    d = s.table("lin_modules").filter("source IN ('list', 'sysfs', 'scan')")
    return d.groupBy("image", "offset").agg(F.min_by("name", "ord").alias("name"), *(F.bool_or(F.col("source") == a).alias(b) for a, b in (("list", "in_procfs"), ("sysfs", "in_sysfs"), ("scan", "in_scan"))), F.max("taints").alias("taints"))


@operator("linux.module_extract.ModuleExtract")
def module_extract(s, base=None):
    return only(s.table("lin_modules"), "base", base).dropDuplicates(["image", "base"]).select("image", "base", F.col("size").alias("file_size"))


def _handlers(s: Session, kind: str) -> DataFrame:
    return s.table("lin_handlers").filter(F.col("kind") == kind)


@operator("linux.malware.check_syscall.Check_syscall")
def check_syscall(s):
    names = s.table("symbols").groupBy("image", "address").agg(F.min("name").alias("symbol"))
    d = _handlers(s, "syscall").join(names, ["image", "address"], "left")
    return d.select("image", "table_address", F.col("name").alias("table_name"), F.col("idx").alias("index"), F.col("address").alias("handler"), F.coalesce("symbol", F.lit("UNKNOWN")).alias("symbol"))


@operator("linux.malware.check_idt.Check_idt")
def check_idt(s):
    d = _handlers(s, "idt").filter("idx < 20 OR idx = 128")
    return resolve(s, d, "address", _known(s)).select("image", F.col("idx").alias("index"), "address", "module", "symbol")


@operator("linux.malware.check_afinfo.Check_afinfo")
def check_afinfo(s):
    """Protocol operation pointers at which no kernel symbol starts."""
    d = _handlers(s, "afinfo").filter("address <> 0").join(s.table("symbols").select("image", "address").distinct(), ["image", "address"], "left_anti")
    return d.select("image", F.col("name").alias("symbol_name"), "member", F.col("address").alias("handler"))


@operator("linux.malware.check_creds.Check_creds")
def check_creds(s):
    d = _leaders(s).filter("cred <> 0").select("image", "cred", "pid")
    return relational.shared_groups(d, ["image", "cred"], "pid").select("image", "cred", F.replace("members", F.lit(","), F.lit(", ")).alias("pids"))


@operator("linux.malware.keyboard_notifiers.Keyboard_notifiers")
def keyboard_notifiers(s):
    d = _handlers(s, "keyboard_notifier").filter("ord < 4096")
    return resolve(s, d, "address", _known(s)).select("image", "address", "module", "symbol", "ord")


@operator("linux.malware.tty_check.Tty_Check")
def tty_check(s):
    return resolve(s, _handlers(s, "tty"), "address", _known(s)).select("image", "name", "address", "module", "symbol")


@operator("linux.malware.netfilter.Netfilter")
def netfilter(s):
    d = resolve(s, _handlers(s, "netfilter"), "address", _known(s))
    return d.select("image", "net_ns", "proto", "hook", "priority", F.col("address").alias("handler"), "module", "symbol", F.col("module").isNull().alias("is_hooked"))


@operator("linux.malware.process_spoofing.ProcessSpoofing")
def process_spoofing(s, pid=None):
    d = _leaders(s, pid).filter("NOT coalesce(is_kernel, false) AND exe IS NOT NULL")
    clean = F.regexp_replace("exe", r" \(deleted\)$", "")
    exe, cmd = scalars.basename(clean), scalars.basename(F.split_part(F.decode("args", "UTF-8"), F.lit("\0"), F.lit(1)))
    return d.select("image", "pid", "ppid", F.col("exe").alias("exe_path"), cmd.alias("cmdline_basename"), "comm", (exe != F.ltrim(cmd, F.lit("-"))).alias("cmdline_spoofed"), (F.substring(exe, 1, 15) != F.col("comm")).alias("comm_spoofed"), F.col("exe").endswith(" (deleted)").alias("exe_deleted"))


@operator("linux.tracing.ftrace.CheckFtrace")
def ftrace(s):
    d = s.table("lin_ftrace").withColumn("address", F.explode_outer("hooked"))
    names = s.table("symbols").groupBy("image", "address").agg(F.min("name").alias("_s"))
    d = d.join(names, ["image", "address"], "left").groupBy("image", "ops", "callback", "flags").agg(F.array_join(F.array_sort(F.collect_set("_s")), ",").alias("hooked_symbols"))
    d = resolve(s, d, "callback", _known(s)).join(s.table(_known(s)).select("image", F.col("name").alias("module"), F.col("base").alias("module_address")), ["image", "module"], "left")
    return d.select("image", "ops", F.col("symbol").alias("callback_name"), "callback", "hooked_symbols", "module", "module_address", "flags")


@operator("linux.tracing.tracepoints.CheckTracepoints")
def tracepoints(s):
    d = resolve(s, _handlers(s, "tracepoint"), "address", _known(s))
    return d.select("image", F.col("name").alias("tracepoint"), F.col("table_address").alias("tracepoint_address"), F.col("symbol").alias("probe"), F.col("address").alias("probe_address"), F.col("priority").alias("probe_priority"), "module")


@operator("linux.tracing.perf_events.PerfEvents")
def perf_events(s):
    return s.table("lin_perf").filter("address <> 0")


@operator("linux.ebpf.EBPF")
def ebpf(s):
    blank = lambda c: F.nullif(F.trim(c), F.lit("")).alias(c)
    return s.table("lin_bpf").select("image", "address", blank("name"), blank("tag"), blank("type"))


@operator("linux.kallsyms.Kallsyms")
def kallsyms(s, core=True, modules=True, ftrace=True, bpf=True):
    wanted = [n for n, on in (("core", core), ("modules", modules), ("ftrace", ftrace), ("bpf", bpf)) if on]
    d = s.table("lin_kallsyms").filter(F.col("source").isin(*wanted))
    return d.select("image", "address", "type", F.when(F.col("size") > 0, F.col("size")).alias("size"), "exported", F.col("source").alias("subsystem"), "module", F.col("name").alias("symbol_name"), "description")


@operator("linux.kmsg.Kmsg")
def kmsg(s):
    stamp = F.format_string("%d.%06d", F.floor(F.col("nanos") / 1_000_000_000), F.floor(F.col("nanos") % 1_000_000_000 / 1000))
    return s.table("lin_kmsg").select("image", "facility", "level", stamp.alias("timestamp"), "caller", "line", "seq")


# --- system -------------------------------------------------------------------------------------------------------


@operator("linux.iomem.IOMem")
def iomem(s):
    d = s.table("lin_resources")
    return d.join(relational.tree_paths(d, "node", "parent", ["image"]), ["image", "node"]).filter("start IS NOT NULL AND end IS NOT NULL").select("image", "name", "start", "end", "depth", F.col("path").alias("tree_path"))


@operator("linux.ip.Addr")
def ip_addr(s):
    d = s.table("lin_devices").withColumn("_a", F.explode("addresses"))
    return d.select("image", "net_ns", F.col("ifindex").alias("index"), "interface", "mac", "promiscuous", F.col("_a.ip").alias("ip"), F.col("_a.prefix").alias("prefix"), F.col("_a.scope").alias("scope_type"), "state")


@operator("linux.ip.Link")
def ip_link(s):
    return s.table("lin_devices").select("image", F.col("net_ns").alias("ns"), "interface", "mac", "state", "mtu", "qdisc", "qlen", F.array_join("flags", ",").alias("flags"))


@operator("linux.graphics.fbdev.Fbdev")
def fbdev(s):
    return s.table("lin_framebuffers")


@operator("linux.lsof.Lsof")
def lsof(s, pid=None, files_only=False):
    d = only(s.table("lin_files"), "pid", pid)
    return d.filter("path LIKE '/%'") if files_only else d


@operator("linux.mountinfo.MountInfo")
def mountinfo(s, pids=None, mntns=None):
    d = only(only(s.table("lin_mounts"), "pid", pids), "mnt_ns", mntns)
    if pids is None:
        w = Window.partitionBy("image", "mnt_ns", "mount_id").orderBy("ord")
        d = d.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return d


@operator("linux.pagecache.Files")
def pagecache_files(s, type=None, find=None):
    return only(only(s.table("lin_inodes"), "file_type", type), "path", find).dropDuplicates(["image", "superblock", "inode", "path"])


@operator("linux.pagecache.InodePages")
def inode_pages(s, inode=None, find=None):
    d = only(s.table("lin_inode_pages"), "inode", inode)
    if find is not None:
        d = d.join(s.table("lin_inodes").filter(F.col("path") == find).select("image", "inode").distinct(), ["image", "inode"], "left_semi")
    return d.drop("bytes")


@operator("linux.pagecache.RecoverFs")
def recoverfs(s, tmpfs_only=False):
    """Files with their cached content in one binary column, zero-filled where pages are missing, cut at their size.

    Pages are gathered per inode; a file larger than a binary cell can hold should be written from ``InodePages``.
    """
    files = s.table("lin_inodes").filter("file_type = 'REG'")
    files = files.filter("device = 'tmpfs'") if tmpfs_only else files
    p = s.table("lin_inode_pages").filter("dump_safe").groupBy("image", "inode").agg(F.map_from_entries(F.collect_list(F.struct("idx", "bytes"))).alias("_cached"))
    d = files.join(p, ["image", "inode"]).filter("size > 0")
    blank = F.lit(b"\0" * 4096)
    whole = F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / 4096)), F.lit(b""), lambda a, i: F.concat(a, F.coalesce(F.element_at("_cached", i), blank)))
    return d.select("image", "path", F.expr("size").alias("recovered_size"), F.substring(whole, 1, F.col("size").cast("int")).alias("content"))


_SOCKET = ["offset", "family", "type", "proto", "src_addr", "src_port", "dst_addr", "dst_port", "state", "filter"]


@operator("linux.sockstat.Sockstat")
def sockstat(s, pids=None, netns=None):
    d = only(only(s.table("lin_sockets").filter("source = 'fd'"), "pid", pids), "net_ns", netns)
    return d.select("image", "net_ns", F.col("process").alias("process_name"), "pid", "tid", "fd", *_SOCKET)


@operator("linux.sockscan.Sockscan")
def sockscan(s):
    return s.table("lin_sockets").filter("source = 'scan'").dropDuplicates(["image", "offset"]).select("image", *_SOCKET)


@operator("linux.vmcoreinfo.VMCoreInfo")
def vmcoreinfo(s):
    """Notes as keys and values; symbol addresses and the kernel offset are written in hex upstream and so here."""
    d = s.table("lin_notes").select("image", "offset", F.explode(F.split("note", "\n")).alias("_l")).filter(F.contains("_l", F.lit("=")))
    key, value = F.split_part("_l", F.lit("="), F.lit(1)), F.split_part("_l", F.lit("="), F.lit(2))
    is_hex = key.startswith("SYMBOL(") | (key == "KERNELOFFSET")
    return d.select("image", "offset", key.alias("key"), F.when(is_hex, F.concat(F.lit("0x"), F.lower(F.regexp_replace(value, "^0x", "")))).otherwise(value).alias("value"))


@operator("linux.vmaregexscan.VmaRegExScan")
def vmaregexscan(s, pattern=b".", pid=None, maxsize=128):
    d = only(s.table("lin_vmas").filter("is_user AND head IS NOT NULL"), "pid", pid)
    from .generic import text_hits

    return text_hits(d, ["image", "pid", "process"], "start", "head", pattern, maxsize)


for _n in ("check_afinfo.Check_afinfo", "check_creds.Check_creds", "check_idt.Check_idt", "check_modules.Check_modules", "check_syscall.Check_syscall", "hidden_modules.Hidden_modules", "keyboard_notifiers.Keyboard_notifiers", "malfind.Malfind", "modxview.Modxview", "netfilter.Netfilter"):
    alias(f"linux.{_n}", f"linux.malware.{_n}")
alias("linux.tty_check.tty_check", "linux.malware.tty_check.Tty_Check")
