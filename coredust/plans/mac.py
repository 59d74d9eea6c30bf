"""macOS operators over object tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relational
from .session import Session, only, operator, resolve, schemas

schemas(
    mac_tasks="source string, ord long, offset long, name string, pid long, ppid long, uid long, gid long, start_time timestamp, argc int, arguments array<string>",
    mac_modules="ord long, offset long, base long, size long, name string",
    mac_maps="pid long, process string, start long, end long, protection string, name string, head binary",
    mac_files="pid long, fd int, path string",
    mac_vnodes="address long, parent long, name string",
    mac_history="pid long, process string, ord long, command_time timestamp, command string",
    mac_handlers="kind string, ord long, name string, member string, idx int, table_name string, table_address long, address long, idata long, socket long, owner long, deadline long, entry_time long, param0 long, param1 long",
    mac_sysctls="node long, parent long, name string, number int, perms string, handler long, kind string, value string",
    mac_interfaces="interface string, mac string, flags int, addresses array<string>",
    mac_kevents="pid long, process string, ident long, filter int, flags int",
    mac_mounts="ord long, device string, mount_point string, type string",
    mac_sockets="offset long, pid long, process string, family int, proto string, local_ip string, local_port int, remote_ip string, remote_port int, state string, path string",
    mac_buffers="msg_bufx int, buffer string",
    mac_watchers="name string, pid long, events array<int>",
)


def _tasks(s: Session, source: str) -> DataFrame:
    d = s.table("mac_tasks").filter(F.col("source") == source).withColumn("_k", F.concat_ws("@", "image", F.col("offset").cast("string")))
    return relational.first_seen(d, "_k", ["ord"]).drop("_k")


@operator("mac.pslist.PsList")
def pslist(s, pslist_method="tasks", pid=None):
    """``tasks``, ``allproc``, ``process_group``, ``sessions`` or ``pid_hash_table``."""
    return only(_tasks(s, pslist_method), "pid", pid).select("image", "offset", "name", "pid", "uid", "gid", "start_time", "ppid", "ord")


@operator("mac.pstree.PsTree")
def pstree(s):
    d = _tasks(s, "tasks")
    return d.join(relational.tree_paths(d, "pid", "ppid", ["image"]), ["image", "pid"]).select("image", "pid", "ppid", F.col("name").alias("comm"), "depth", F.col("path").alias("tree_path"))


@operator("mac.psaux.Psaux")
def psaux(s, pid=None):
    return only(_tasks(s, "tasks"), "pid", pid).filter("argc BETWEEN 1 AND 1024").select("image", "pid", F.col("name").alias("process"), "argc", F.array_join("arguments", " ").alias("arguments"))


@operator("mac.bash.Bash")
def bash(s, pid=None):
    return only(s.table("mac_history").filter("process IN ('bash', 'sh', 'dash')"), "pid", pid)


@operator("mac.lsmod.Lsmod")
def lsmod(s):
    return s.table("mac_modules").filter("ord < 1024").dropDuplicates(["image", "offset"]).select("image", "offset", "name", "size", "ord")


@operator("mac.lsof.Lsof")
def lsof(s, pid=None):
    return only(s.table("mac_files").filter("path <> ''"), "pid", pid).select("image", "pid", F.col("fd").alias("file_descriptor"), F.col("path").alias("file_path"))


@operator("mac.list_files.List_Files")
def list_files(s):
    """Full paths of vnodes, from the names along their parents."""
    v = s.table("mac_vnodes")
    tree = relational.tree_paths(v, "address", "parent", ["image"], "name")
    return tree.select("image", "address", F.concat(F.lit("/"), F.regexp_replace("names", "^/+", "")).alias("file_path"))


@operator("mac.malfind.Malfind")
def malfind(s, pid=None):
    """Regions that are readable, writable and executable, or executable without a file (upstream shows the others)."""
    d = only(s.table("mac_maps"), "pid", pid).filter("protection = 'rwx' OR (protection = 'r-x' AND coalesce(name, '') = '')")
    return d.select("image", "pid", "process", "start", "end", "protection", F.substring("head", 1, 64).alias("hexdump"))


@operator("mac.proc_maps.Maps")
def proc_maps(s, pid=None, address=None):
    d = only(s.table("mac_maps"), "pid", pid)
    d = d if address is None else d.filter((F.col("start") <= address) & (F.col("end") > address))
    return d.select("image", "pid", "process", "start", "end", "protection", F.col("name").alias("map_name"))


def _resolved(s: Session, kind: str) -> DataFrame:
    return resolve(s, s.table("mac_handlers").filter((F.col("kind") == kind) & (F.col("address") != 0)), "address", "mac_modules")


def _table_rows(d: DataFrame) -> DataFrame:
    return d.select("image", "table_address", "table_name", F.col("idx").alias("index"), F.col("address").alias("handler"), "module", "symbol")


@operator("mac.check_syscall.Check_syscall")
def check_syscall(s):
    return _table_rows(_resolved(s, "syscall"))


@operator("mac.check_trap_table.Check_trap_table")
def check_trap_table(s):
    return _table_rows(_resolved(s, "trap"))


@operator("mac.check_sysctl.Check_sysctl")
def check_sysctl(s):
    """The sysctl tree with resolved handlers; sorting by ``post_order`` lists children before their parent."""
    d = s.table("mac_sysctls")
    d = d.join(relational.tree_paths(d, "node", "parent", ["image"]), ["image", "node"]).withColumn("post_order", F.concat("path", F.lit("~")))
    return resolve(s, d, "handler", "mac_modules").select("image", "name", "number", "perms", "handler", "value", "module", "symbol", "depth", "post_order")


@operator("mac.kauth_scopes.Kauth_scopes")
def kauth_scopes(s):
    n = s.table("mac_handlers").filter("kind = 'kauth_listener' AND address <> 0").groupBy("image", "owner").agg(F.count(F.lit(1)).alias("listeners"))
    return _resolved(s, "kauth_scope").join(n, ["image", "owner"], "left").select("image", "name", "idata", F.coalesce("listeners", F.lit(0)).alias("listeners"), F.col("address").alias("callback"), "module", "symbol")


@operator("mac.kauth_listeners.Kauth_listeners")
def kauth_listeners(s):
    return _resolved(s, "kauth_listener").select("image", "name", "idata", F.col("address").alias("callback"), "module", "symbol")


@operator("mac.socket_filters.Socket_filters")
def socket_filters(s):
    return _resolved(s, "socket_filter").select("image", F.col("owner").alias("filter"), "name", "member", "socket", F.col("address").alias("handler"), "module", "symbol")


@operator("mac.timers.Timers")
def timers(s):
    return _resolved(s, "timer").select("image", F.col("address").alias("function"), "param0", "param1", "deadline", F.coalesce("entry_time", F.lit(-1)).alias("entry_time"), "module", "symbol")


@operator("mac.trustedbsd.Trustedbsd")
def trustedbsd(s):
    return _resolved(s, "policy").select("image", "member", F.col("name").alias("policy_name"), F.col("address").alias("handler"), "module", "symbol")


#: Kernel event filters by number. Fixed values.
FILTERS = {-1: "EVFILT_READ", -2: "EVFILT_WRITE", -3: "EVFILT_AIO", -4: "EVFILT_VNODE", -5: "EVFILT_PROC", -6: "EVFILT_SIGNAL", -7: "EVFILT_TIMER", -8: "EVFILT_MACHPORT", -9: "EVFILT_FS", -10: "EVFILT_USER", -12: "EVFILT_VM"}


@operator("mac.kevents.Kevents")
def kevents(s, pid=None):
    names = F.create_map(*(F.lit(x) for kv in FILTERS.items() for x in kv))
    d = only(s.table("mac_kevents"), "pid", pid).withColumn("_f", names[F.col("filter")]).filter("_f IS NOT NULL")
    return d.select("image", "pid", "process", "ident", F.col("_f").alias("filter"), F.hex("flags").alias("context"))


#: File system event kinds by number. Fixed values.
EVENTS = ("CREATE_FILE", "DELETE", "STAT_CHANGED", "RENAME", "CONTENT_MODIFIED", "EXCHANGE", "FINDER_INFO_CHANGED", "CREATE_DIR", "CHOWN")


@operator("mac.vfsevents.VFSevents")
def vfsevents(s):
    names = F.array(*(F.lit(n) for n in EVENTS))
    return s.table("mac_watchers").select("image", "name", "pid", F.array_join(F.transform("events", lambda e: F.get(names, e)), ",").alias("events"))


@operator("mac.ifconfig.Ifconfig")
def ifconfig(s):
    return s.table("mac_interfaces").select("image", "interface", F.explode_outer("addresses").alias("ip_address"), "mac", (F.col("flags").bitwiseAND(F.lit(0x100)) != 0).alias("promiscuous"))


@operator("mac.mount.Mount")
def mount(s):
    return s.table("mac_mounts").select("image", "device", "mount_point", "type", "ord")


@operator("mac.netstat.Netstat")
def netstat(s, pid=None):
    d = only(s.table("mac_sockets"), "pid", pid).filter("family IN (1, 2, 30)")
    unix = F.col("family") == 1
    return d.select("image", "offset", F.when(unix, "UNIX").otherwise(F.col("proto")).alias("proto"), F.when(unix, F.col("path")).otherwise(F.col("local_ip")).alias("local_ip"), *(F.when(~unix, F.col(c)).alias(c) for c in ("local_port", "remote_ip", "remote_port", "state")), F.concat_ws("/", "process", F.col("pid").cast("string")).alias("process"))


@operator("mac.dmesg.Dmesg")
def dmesg(s):
    """The ring buffer from its write position on, in lines."""
    b = F.col("buffer")
    turned = F.concat(F.substring(b, F.col("msg_bufx") + 1, F.length(b)), F.substring(b, F.lit(1), F.col("msg_bufx")))
    lines = F.split(F.replace(turned, F.lit("\0"), F.lit("")), "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
    return s.table("mac_buffers").select("image", F.posexplode(lines).alias("ord", "line")).filter("line <> ''")
