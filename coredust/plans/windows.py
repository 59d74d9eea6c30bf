"""Windows operators over object tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import relational
from .session import Session, alias, containing, only, operator, resolve, schemas

schemas(
    win_processes="source string, ord long, offset long, physical long, pid long, ppid long, name string, threads long, handles long, session_id long, wow64 boolean, create_time timestamp, exit_time timestamp, audit string, cmd string, path string, peb_path string, peb_cmd_max int, peb_cmd_len int, peb_path_max int, peb_path_len int, peb_base long, section_base long, job struct<offset:long,session_id:long,total:long,active:long,terminated:long>",
    win_threads="source string, ord long, offset long, pid long, process string, tid long, state int, suspend_count int, start long, win32_start long, dr array<long>, dr7 long, create_time timestamp, exit_time timestamp, cross_flags long",
    win_vads="pid long, process string, offset long, start long, end long, tag string, protection string, commit_charge long, private_memory int, parent long, left long, right long, file string, file_object long, delete_pending int, delete_on_close int, head binary, dirty_pages long, zero_pages boolean",
    win_ldr="pid long, process string, ord long, base long, size long, name string, path string, load_count int, load_time timestamp, in_load boolean, in_init boolean, in_mem boolean",
    win_modules="source string, ord long, offset long, base long, size long, name string, path string",
    win_unloaded="ord long, name string, start long, end long, time timestamp",
    win_drivers="offset long, start long, size long, service_key string, driver_name string, name string, irps array<long>, devices array<struct<offset:long,name:string,type:string,attached:array<struct<offset:long,driver:string,device:string,type:string>>>>",
    win_handles="pid long, process string, offset long, handle_value long, type string, granted_access long, name string",
    win_envars="pid long, process string, block long, env map<string,string>",
    win_sids="pid long, process string, ord long, sid string",
    win_sid_names="sid string, name string, kind string",
    win_privileges="pid long, process string, value int, attributes long",
    win_services="source string, ord long, offset long, pid long, start string, state string, type string, name string, display string, binary string",
    win_service_keys="name string, image_path string, dll string",
    win_sockets="source string, offset long, proto string, family int, local_addr string, local_port int, foreign_addr string, foreign_port int, state string, pid long, owner string, created timestamp, dual_stack boolean",
    win_files="offset long, name string, cache string, result string",
    win_mutants="offset long, name string",
    win_symlinks="offset long, create_time timestamp, from_name string, to_name string",
    win_callbacks="source_no int, ord long, type string, callback long, detail string",
    win_ssdt="table int, entries array<long>",
    win_timers="offset long, type int, due_time string, period long, signaled boolean, routine long",
    win_bigpools="va long, tag string, pool_type string, bytes long, key long",
    win_pool_hits="tag string, offset long, layer string, name string",
    win_kpcrs="ord long, offset long, prcb long",
    win_stubs="pid long, function string, bytes binary",
    win_imports="pid long, name string, library string, stamp long, function string, rva long, base long",
    win_desktops="source string, offset long, station string, session_id long, desktop string, process string, pid long",
    win_windows="offset long, station string, session_id long, desktop string, title string, procedure long, process string, pid long",
    win_stations="source string, offset long, name string, session_id long",
    win_consoles="kind string, pid long, process string, info long, fields array<struct<property:string,address:long,data:string>>",
    win_hives="source string, ord long, offset long, path string, get_cell_routine long, user_name string",
    win_keys="hive_offset long, hive_name string, cell long, parent long, name string, last_write timestamp, volatile boolean, value_names array<string>, value_types array<string>, value_data array<string>, class_name string, value_raw array<binary>",
    win_pages="pid long, virt long, phys long, size long, class string, large boolean",
    win_regions="ord long, region string, start long, end long",
    win_facts="ord long, variable string, value string",
    win_mft="ord long, offset long, record_type string, record_no long, links int, mft_type string, permissions string, attribute string, created timestamp, modified timestamp, updated timestamp, accessed timestamp, filename string, stream string, resident boolean, data binary",
    win_versions="pid long, process string, base long, name string, major int, minor int, product int, build int",
    win_shimcache="ord long, modified timestamp, updated timestamp, exec_flag boolean, file_size long, path string",
    win_amcache="ord long, family string, path string, company string, modified timestamp, modified2 timestamp, installed timestamp, compiled timestamp, sha1 string, service string, product string, version string",
    win_etw="pid long, process string, dll string, function string, offset long, opcode binary",
    win_pe_symbols="scope string, module string, symbol string, address long",
    win_crypto="pid long, process string, system int, initialize long, decrypt long, dll_base long, dll_size long",
    symbols="address long, name string, size long",
)

PROCESS = ("pid", "ppid", "name", "offset", "threads", "handles", "session_id", "wow64", "create_time", "exit_time")


def _listed(s: Session, source: str = "pslist") -> DataFrame:
    """Processes of one enumeration, each address once (lists are walked in both directions)."""
    place = F.coalesce("offset", "physical").cast("string")  # a carved process has no virtual address
    return relational.first_seen(s.table("win_processes").filter(F.col("source") == source).withColumn("_k", F.concat_ws("@", "image", place)), "_k", ["ord"]).drop("_k")


def _place(physical: bool):
    shown = {"name": F.col("name").alias("image_file_name"), "offset": F.col("physical").alias("offset") if physical else F.col("offset")}
    return [shown.get(c, F.col(c)) for c in PROCESS]


@operator("windows.pslist.PsList")
def pslist(s, pid=None, physical=False):
    return only(_listed(s), "pid", pid).select("image", *_place(physical), "ord")


@operator("windows.psscan.PsScan")
def psscan(s, pid=None, physical=True):
    return only(_listed(s, "psscan"), "pid", pid).select("image", *_place(physical), "ord")


@operator("windows.pstree.PsTree")
def pstree(s, pid=None, physical=False):
    """Depth first by parent pid; with ``pid`` the processes asked for and all their ancestors."""
    p = _listed(s)
    paths = relational.tree_paths(p, "pid", "ppid", ["image"])
    if pid is not None:
        paths = paths.join(relational.with_ancestors(paths, "pid", only(p, "pid", pid), ["image"]).select("image", "pid"), ["image", "pid"], "left_semi")
    return p.join(paths.withColumnRenamed("path", "tree_path"), ["image", "pid"]).select("image", *_place(physical), "audit", "cmd", "path", "depth", "tree_path")


@operator("windows.malware.psxview.PsXView")
def psxview(s):
    """Which enumerations report a process, by physical address where one is known."""
    sources = ("pslist", "psscan", "thrdscan", "csrss")
    p = s.table("win_processes").filter(F.col("source").isin(*sources))
    return p.groupBy("image", F.coalesce("physical", "offset").alias("offset")).agg(F.min_by("name", "ord").alias("name"), F.min_by("pid", "ord").alias("pid"), *(F.bool_or(F.col("source") == n).alias(n) for n in sources), F.max("exit_time").cast("string").alias("exit_time"))


@operator("windows.cmdline.CmdLine")
def cmdline(s, pid=None):
    args, why = scalars.absent(F.col("cmd"), [(scalars.UNREADABLE, F.coalesce(F.col("cmd"), F.lit("")) == "")])
    return only(_listed(s), "pid", pid).select("image", "pid", F.col("name").alias("process"), args.alias("args"), why.alias("absent"))


@operator("windows.envars.Envars")
def envars(s, pid=None):
    return only(s.table("win_envars"), "pid", pid).select("image", "pid", "process", "block", F.explode("env").alias("variable", "value"))


@operator("windows.sessions.Sessions")
def sessions(s, pid=None):
    """Grouped by session id in the order in which sessions first occur."""
    p = only(_listed(s), "pid", pid)
    env = s.table("win_envars").select("image", "pid", F.nullif(F.concat_ws("/", F.element_at("env", "USERDOMAIN"), F.element_at("env", "USERNAME")), F.lit("")).alias("user_name"), F.element_at("env", "SESSIONNAME").alias("session_type"))
    return p.join(env, ["image", "pid"], "left").select(
        "image", "session_id", "session_type", "pid", F.col("name").alias("process"), "user_name", "create_time", F.min("ord").over(Window.partitionBy("image", "session_id")).alias("group_ord"), "ord",
    )


@operator("windows.joblinks.JobLinks")
def joblinks(s):
    p = _listed(s)
    head = p.filter("job IS NOT NULL")
    cols = lambda d, zero, name: d.select("image", F.col("name"), "pid", "ppid", F.col("session_id").alias("sess"), F.col("job.session_id").alias("job_sess"), "wow64", *((F.lit(0).cast("long") if zero else F.col(f"job.{c}")).alias(a) for c, a in (("total", "total"), ("active", "active"), ("terminated", "term"))), F.lit(name).alias("job_link"), F.col("path").alias("process"), F.lit(int(zero)).alias("depth"))
    return cols(head, False, "Yes").unionByName(cols(head, True, "Yes"))


@operator("windows.malware.pebmasquerade.PebMasquerade")
def pebmasquerade(s, pid=None):
    same = lambda a, b: F.lower(scalars.basename(F.col(a), "\\")) == F.lower(scalars.basename(F.col(b), "\\"))
    path_bad = ~F.coalesce(same("audit", "peb_path"), F.lit(True)) | (F.col("peb_path_max") < F.col("peb_path_len"))
    return only(_listed(s), "pid", pid).select("image", "pid", F.col("name").alias("eprocess_name"), F.col("audit").alias("audit_name"), "peb_path", F.coalesce(path_bad, F.lit(False)).alias("path_spoofed"), F.coalesce(F.col("peb_cmd_max") < F.col("peb_cmd_len"), F.lit(False)).alias("cmdline_spoofed"))


# --- modules, drivers, hooks --------------------------------------------------------------------------------------

_MODULE = ["image", "offset", "base", "size", "name", "path", "ord"]


def _modules(s, source, base, name):
    d = only(s.table("win_modules").filter(F.col("source") == source), "base", base)
    return (d if name is None else d.filter(F.contains(F.col("name"), F.lit(name)))).select(*_MODULE)


@operator("windows.modules.Modules")
def modules(s, base=None, name=None):
    return _modules(s, "list", base, name)


@operator("windows.modscan.ModScan")
def modscan(s, base=None, name=None):
    return _modules(s, "scan", base, name)


def _loaded(s: Session) -> str:
    s.tables["_win_loaded"] = s.table("win_modules").filter("source = 'list'").select("image", "name", "base", "size", "ord")
    return "_win_loaded"


def _kernel_start(s):
    return s.table("win_modules").filter("source = 'list'").groupBy("image").agg(F.min_by("base", "ord").alias("kernel_start"))


def _above(c, strict=False):
    """Whether an address lies at or after the kernel's start; both are unsigned values held in longs."""
    a, k = (F.col(x).bitwiseXOR(F.lit(-(1 << 63))) for x in (c, "kernel_start"))
    return a > k if strict else a >= k


@operator("windows.unloadedmodules.UnloadedModules")
def unloaded(s):
    d = s.table("win_unloaded").join(_kernel_start(s), "image").filter("ord < 1024 AND time IS NOT NULL AND start % 4096 = 0 AND end % 4096 = 0").filter(_above("start") & _above("end"))
    return d.select("image", "name", "start", "end", "time")


@operator("windows.driverscan.DriverScan")
def driverscan(s):
    return s.table("win_drivers").join(_kernel_start(s), "image").filter((F.col("start") == 0) | _above("start", strict=True)).select("image", "offset", "start", "size", "service_key", "driver_name", "name")


#: Order of the major function codes. Fixed values.
IRP_NAMES = ("IRP_MJ_CREATE", "IRP_MJ_CREATE_NAMED_PIPE", "IRP_MJ_CLOSE", "IRP_MJ_READ", "IRP_MJ_WRITE", "IRP_MJ_QUERY_INFORMATION", "IRP_MJ_SET_INFORMATION", "IRP_MJ_QUERY_EA", "IRP_MJ_SET_EA", "IRP_MJ_FLUSH_BUFFERS", "IRP_MJ_QUERY_VOLUME_INFORMATION", "IRP_MJ_SET_VOLUME_INFORMATION", "IRP_MJ_DIRECTORY_CONTROL", "IRP_MJ_FILE_SYSTEM_CONTROL", "IRP_MJ_DEVICE_CONTROL", "IRP_MJ_INTERNAL_DEVICE_CONTROL", "IRP_MJ_SHUTDOWN", "IRP_MJ_LOCK_CONTROL", "IRP_MJ_CLEANUP", "IRP_MJ_CREATE_MAILSLOT", "IRP_MJ_QUERY_SECURITY", "IRP_MJ_SET_SECURITY", "IRP_MJ_POWER", "IRP_MJ_SYSTEM_CONTROL", "IRP_MJ_DEVICE_CHANGE", "IRP_MJ_QUERY_QUOTA", "IRP_MJ_SET_QUOTA", "IRP_MJ_PNP")


@operator("windows.driverirp.DriverIrp")
def driverirp(s):
    d = s.table("win_drivers").select("image", "offset", "driver_name", F.posexplode("irps").alias("_i", "address")).join(_kernel_start(s), "image").filter(_above("address"))
    d = d.withColumn("irp", F.element_at(F.array(*(F.lit(n) for n in IRP_NAMES)), F.col("_i") + 1))
    return resolve(s, d, "address", _loaded(s), inclusive=True).select("image", "offset", "driver_name", "irp", "address", "module", "symbol")


#: Drivers that start outside every module on a clean system. Fixed values.
KNOWN_DRIVERS = ("ACPI_HAL", "PnpManager", "RAW", "WMIxWDM", "Win32k", "Fs_Rec")


@operator("windows.malware.drivermodule.DriverModule")
def drivermodule(s):
    d = s.table("win_drivers").filter("coalesce(driver_name, service_key, name) IS NOT NULL").join(_kernel_start(s), "image").filter((F.col("start") == 0) | _above("start"))
    d = resolve(s, d, "start", _loaded(s)).filter("module IS NULL")
    return d.select("image", "offset", F.coalesce(F.regexp_replace("driver_name", r"^\\Driver\\", "").isin(*KNOWN_DRIVERS), F.lit(False)).alias("known_exception"), "driver_name", "service_key", F.col("name").alias("alternative_name"))


@operator("windows.devicetree.DeviceTree")
def devicetree(s):
    """Drivers at depth 0, their devices at 1, attached devices from 2 on; ``path`` orders the tree."""
    d = s.table("win_drivers")
    key = lambda *c: F.concat_ws("/", *(F.lpad(F.hex(x) if not isinstance(x, int) else F.lit(str(x)), 16, "0") for x in c))
    null = F.lit(None).cast("string")
    top = d.select("image", "offset", F.lit("DRV").alias("type"), "driver_name", null.alias("device_name"), null.alias("attached_driver"), null.alias("device_type"), F.lit(0).alias("depth"), key(F.col("offset")).alias("path"))
    dev = d.select("image", "driver_name", F.col("offset").alias("_d"), F.explode("devices").alias("v"))
    mid = dev.select("image", F.col("v.offset").alias("offset"), F.lit("DEV").alias("type"), "driver_name", F.col("v.name").alias("device_name"), null.alias("attached_driver"), F.col("v.type").alias("device_type"), F.lit(1).alias("depth"), key(F.col("_d"), F.col("v.offset")).alias("path"))
    att = dev.select("image", "driver_name", "_d", F.col("v.offset").alias("_v"), F.posexplode("v.attached").alias("_i", "a"))
    low = att.select("image", F.col("a.offset").alias("offset"), F.lit("ATT").alias("type"), "driver_name", F.col("a.device").alias("device_name"), F.col("a.driver").alias("attached_driver"), F.col("a.type").alias("device_type"), (F.col("_i") + 2).alias("depth"), F.concat_ws("/", key(F.col("_d"), F.col("_v")), F.lpad(F.col("_i").cast("string"), 6, "0")).alias("path"))
    return top.unionByName(mid).unionByName(low)


@operator("windows.ssdt.SSDT")
def ssdt(s):
    d = s.table("win_ssdt").select("image", F.posexplode("entries").alias("_i", "address")).withColumnRenamed("_i", "index")
    return resolve(s, d, "address", _loaded(s), inclusive=True).select("image", "index", "address", "module", "symbol")


@operator("windows.callbacks.Callbacks")
def callbacks(s):
    d = resolve(s, s.table("win_callbacks"), "callback", _loaded(s), inclusive=True)
    return d.select("image", "type", "callback", "module", "symbol", "detail", "source_no", "ord")


@operator("windows.timers.Timers")
def timers(s):
    d = s.table("win_timers").filter("type IN (8, 9) AND routine <> 0")
    return resolve(s, d, "routine", _loaded(s), inclusive=True).select("image", "offset", "due_time", "period", F.when(F.col("signaled"), "Yes").otherwise("-").alias("signaled"), "routine", "module", "symbol")


@operator("windows.registry.getcellroutine.GetCellRoutine")
def getcellroutine(s):
    kernel = s.table("win_modules").filter("source = 'list'").groupBy("image").agg(F.min_by("name", "ord").alias("kernel"))
    d = resolve(s, s.table("win_hives").filter("source = 'list'"), "get_cell_routine", _loaded(s), inclusive=True).join(kernel, "image", "left")
    return d.filter("module IS NULL OR lower(module) <> lower(kernel)").select("image", F.col("offset").alias("hive_offset"), F.col("path").alias("hive_name"), "module", F.col("get_cell_routine").alias("handler"))


# --- memory of processes ------------------------------------------------------------------------------------------


@operator("windows.vadinfo.VadInfo")
def vadinfo(s, pid=None, address=None):
    d = only(s.table("win_vads"), "pid", pid)
    d = d if address is None else d.filter((F.col("start") <= address) & (F.col("end") >= address))
    return d.select("image", "pid", "process", "offset", "start", "end", "tag", "protection", "commit_charge", "private_memory", "parent", "file")


@operator("windows.vadwalk.VadWalk")
def vadwalk(s, pid=None):
    return only(s.table("win_vads"), "pid", pid).select("image", "pid", "process", "offset", F.col("parent").bitwiseAND(F.lit(~3)).alias("parent"), "left", "right", "start", "end", "tag")


@operator("windows.malware.malfind.Malfind")
def malfind(s, pid=None):
    """Private executable and writable regions, or executable ones with dirty pages, that are not all zero."""
    p = F.col("protection")
    write_exec = p.contains("EXECUTE") & p.contains("WRITE")
    dirty = p.contains("EXECUTE") & (F.coalesce(F.col("dirty_pages"), F.lit(0)) > 0)
    d = only(s.table("win_vads"), "pid", pid).filter((write_exec | dirty) & ((F.col("private_memory") == 1) & (F.col("tag") == "VadS") | (F.col("private_memory") == 0) & (p != "PAGE_EXECUTE_WRITECOPY")) & ~F.coalesce("zero_pages", F.lit(False)))
    notes = F.when(F.substring("head", 1, 2) == F.lit(b"MZ"), "MZ header").when(F.substring("head", 1, 3) == F.lit(b"\x55\x8b\xec"), "Function prologue")
    return d.select("image", "pid", "process", "start", "end", "tag", "protection", "commit_charge", "private_memory", notes.alias("notes"), F.substring("head", 1, 64).alias("hexdump"))


@operator("windows.malware.ldrmodules.LdrModules")
def ldrmodules(s, pid=None):
    mz = only(s.table("win_vads"), "pid", pid).filter(F.substring("head", 1, 2) == F.lit(b"MZ")).select("image", "pid", "process", F.col("start").alias("base"), F.col("file").alias("mapped_path"))
    ldr = s.table("win_ldr").groupBy("image", "pid", "base").agg(*(F.bool_or(c).alias(c) for c in ("in_load", "in_init", "in_mem")))
    d = mz.join(ldr, ["image", "pid", "base"], "left")
    return d.select("image", "pid", "process", "base", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("in_load", "in_init", "in_mem")), "mapped_path")


@operator("windows.dlllist.DllList")
def dlllist(s, pid=None, base=None, name=None, ignore_case=False):
    d = only(only(s.table("win_ldr").filter("in_load"), "pid", pid), "base", base)
    d = d if name is None else d.filter(F.col("name").rlike(("(?i)" if ignore_case else "") + name))
    return d.select("image", "pid", "process", "base", "size", "name", "path", "load_count", "load_time", "ord")


@operator("windows.malware.hollowprocesses.HollowProcesses")
def hollowprocesses(s, pid=None):
    """Processes whose image base, main region or region protections do not fit a normal start."""
    p = only(_listed(s), "pid", pid)
    v = s.table("win_vads")
    n = v.groupBy("image", "pid").agg(F.count(F.lit(1)).alias("n_vads")).join(s.table("win_ldr").groupBy("image", "pid").agg(F.count(F.lit(1)).alias("n_dlls")), ["image", "pid"])
    p = p.join(n, ["image", "pid"]).filter("n_vads >= 5 AND n_dlls >= 3").select("image", "pid", F.col("name").alias("process"), "peb_base", "section_base")
    exe = v.select("image", "pid", F.col("start").alias("peb_base"), F.col("protection").alias("exe_protection"), F.lit(True).alias("has_vad"))
    main = p.join(exe, ["image", "pid", "peb_base"], "left")
    note = lambda d, test, text: d.filter(test).select("image", "pid", "process", text.alias("notes"))
    dlls = p.drop("process").join(v.filter(F.lower("file").endswith(".dll")), ["image", "pid"])
    usual = ["PAGE_EXECUTE_WRITECOPY"]
    return (
        note(main, "peb_base <> section_base", F.format_string("The ImageBaseAddress reported from the PEB (%s) does not match the section (%s)", F.hex("peb_base"), F.hex("section_base")))
        .unionByName(note(main, "has_vad IS NULL", F.format_string("The region of the image base (%s) is missing", F.hex("peb_base"))))
        .unionByName(note(main, F.col("has_vad") & ~F.col("exe_protection").isin(usual), F.format_string("Unexpected protection (%s) of the main executable", "exe_protection")))
        .unionByName(note(dlls, ~F.col("protection").isin(usual), F.format_string("Unexpected protection (%s) of %s", "protection", "file")))
    )


@operator("windows.malware.processghosting.ProcessGhosting")
def processghosting(s):
    name = F.lower(F.coalesce("file", F.lit("")))
    main = _listed(s).select("image", "pid", F.col("peb_base").alias("start")).withColumn("is_main", F.lit(True))
    d = s.table("win_vads").join(main, ["image", "pid", "start"], "left")
    odd = (F.col("is_main") & (F.col("file_object").isNull() | (F.col("file_object") == 0) | (F.col("delete_pending") == 1))) | ((F.col("delete_on_close") == 1) & (name.endswith(".exe") | name.endswith(".dll")))
    return d.filter(odd).select("image", "pid", "process", F.col("start").alias("base"), "file_object", "delete_pending", "delete_on_close", F.col("file").alias("path"))


@operator("windows.memmap.Memmap")
def memmap(s, pid=None):
    """Mapped runs of each process, coalesced where both address spaces go on, with their offsets in a dump."""
    w = Window.partitionBy("image", "pid").orderBy("virt")
    d = only(s.table("win_pages").filter("class = 'valid'"), "pid", pid)
    d = d.withColumn("_new", F.when((F.lag(F.col("virt") + F.col("size")).over(w) == F.col("virt")) & (F.lag(F.col("phys") + F.col("size")).over(w) == F.col("phys")), 0).otherwise(1))
    d = d.withColumn("_run", F.sum("_new").over(w)).groupBy("image", "pid", "_run").agg(F.min("virt").alias("virtual"), F.min_by("phys", "virt").alias("physical"), F.sum("size").alias("size")).drop("_run")
    return relational.running_offset(d, ["image", "pid"], ["virtual"], "size")


@operator("windows.statistics.Statistics")
def statistics(s):
    """Pages of the kernel space by class. Valid pages are counted (upstream always shows none)."""
    c, big = F.col("class"), F.col("large")
    n = lambda test, name: F.count_if(test).alias(name)
    return s.table("win_pages").groupBy("image").agg(n(c == "valid", "valid_all"), n((c == "valid") & big, "valid_large"), n(c == "swapped", "swapped_all"), n((c == "swapped") & big, "swapped_large"), n(c == "invalid", "invalid_all"), n((c == "invalid") & big, "invalid_large"), n(c == "other", "other_invalid_all"))


@operator("windows.iat.IAT")
def iat(s, pid=None):
    d = only(s.table("win_imports"), "pid", pid)
    return d.select("image", "pid", "name", "library", (F.col("stamp") != 0).alias("bound"), "function", (F.col("base") + F.col("rva")).alias("address"))


@operator("windows.pe_symbols.PESymbols")
def pe_symbols(s, source="kernel", module=None, symbols=None, addresses=None):
    d = s.table("win_pe_symbols").filter(F.col("scope") == source)
    d = d if module is None else d.filter(F.lower("module") == module.lower())
    if symbols is not None or addresses is not None:
        d = d.filter(F.col("symbol").isin(*(symbols or [""])) | F.col("address").isin(*(addresses or [-1])))
    return d.select("image", "module", "symbol", "address")


@operator("windows.verinfo.VerInfo")
def verinfo(s, extensive=False):
    d = s.table("win_versions")
    return d.select("image", "pid", "process", "base", "name", "major", "minor", "product", "build")


@operator("windows.virtmap.VirtMap")
def virtmap(s):
    return s.table("win_regions").select("image", "region", "start", "end", "ord")


@operator("windows.malware.unhooked_system_calls.UnhookedSystemCalls")
def unhooked(s):
    """Versions of a system call stub that fewer processes share than the most common one."""
    d = s.table("win_stubs").withColumn("bytes", F.substring("bytes", 1, 32)).groupBy("image", "function", "bytes").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("pid")).alias("pids"))
    w = Window.partitionBy("image", "function")
    d = d.withColumns({"_r": F.row_number().over(w.orderBy(F.desc("n"), "bytes")), "total": F.sum("n").over(w)})
    return d.filter("_r > 1").groupBy("image", "function").agg(F.array_join(F.sort_array(F.flatten(F.collect_list("pids"))).cast("array<string>"), ", ").alias("distinct_implementations"), F.max("total").alias("total_implementations"))


@operator("windows.etwpatch.EtwPatch")
def etwpatch(s, pid=None):
    """ETW functions that start with a return or a jump."""
    first = F.hex(F.substring("opcode", 1, 1))
    name = F.when(first.isin("C2", "C3"), "RET").when(first.isin("E9", "EB", "FF"), "JMP")
    return only(s.table("win_etw"), "pid", pid).withColumn("_op", name).filter("_op IS NOT NULL").select("image", "pid", "process", "dll", "function", "offset", F.col("_op").alias("opcode"))


@operator("windows.malware.skeleton_key_check.Skeleton_Key_Check")
def skeleton_key(s):
    inside = lambda c: F.col(c).between(F.col("dll_base"), F.col("dll_base") + F.col("dll_size"))
    d = s.table("win_crypto").filter("lower(process) = 'lsass.exe'")
    return d.select("image", "pid", "process", (~(inside("initialize") & inside("decrypt"))).alias("skeleton_key_found"), F.col("initialize").alias("rc4_initialize"), F.col("decrypt").alias("rc4_decrypt"))


# --- threads ------------------------------------------------------------------------------------------------------


def _threads(s: Session, source: str) -> DataFrame:
    d = s.table("win_threads").filter(F.col("source") == source)
    v = s.table("win_vads")
    d = containing(d, "start", v, ["image", "pid"], "start", "end", ["file"]).withColumnRenamed("file", "start_path")
    return containing(d, "win32_start", v, ["image", "pid"], "start", "end", ["file"]).withColumnRenamed("file", "win32_start_path")


_THREAD = ["image", "offset", "pid", "tid", "start", "start_path", "win32_start", "win32_start_path", "create_time", "exit_time"]


@operator("windows.thrdscan.ThrdScan")
def thrdscan(s):
    return _threads(s, "scan").select(*_THREAD)


@operator("windows.threads.Threads")
def threads(s):
    return _threads(s, "list").select(*_THREAD)


@operator("windows.orphan_kernel_threads.Threads")
def orphan_threads(s):
    system = s.table("win_processes").filter("pid = 4 OR ppid = 4").select("image", "pid").distinct()
    d = s.table("win_threads").filter("source = 'scan' AND exit_time IS NULL").join(system, ["image", "pid"], "left_semi").join(_kernel_start(s), "image").filter(_above("start"))
    d = resolve(s, d, "start", _loaded(s)).filter("module IS NULL")
    null = F.lit(None).cast("string")
    return d.withColumns({"start_path": null, "win32_start_path": null}).select(*_THREAD)


@operator("windows.debugregisters.DebugRegisters")
def debugregisters(s):
    """Threads with an armed debug register that points into a mapped file."""
    d = s.table("win_threads").filter("source = 'list' AND dr7 <> 0").withColumn("_a", F.explode("dr"))
    d = containing(d, "_a", s.table("win_vads").select("image", "pid", F.col("start").alias("_s"), F.col("end").alias("_e"), "file"), ["image", "pid"], "_s", "_e", ["file"]).filter("file IS NOT NULL")
    return d.groupBy("image", "process", "pid", "tid", "state", "dr7").agg(F.array_join(F.sort_array(F.collect_set("file")), ", ").alias("files"))


@operator("windows.suspended_threads.SuspendedThreads")
def suspended_threads(s):
    d = _threads(s, "list").filter("suspend_count <> 0 AND state <> 4").filter(~F.lower(F.coalesce("start_path", F.lit(""))).endswith("workfoldersshell.dll"))
    sym = s.table("symbols").groupBy("image", "address").agg(F.min("name").alias("n"))
    at = lambda c: sym.select("image", F.col("address").alias(c), F.col("n").alias(f"{c}_symbol"))
    d = d.join(at("start"), ["image", "start"], "left").join(at("win32_start"), ["image", "win32_start"], "left")
    return d.select("image", "process", "pid", "tid", "start_path", "start_symbol", "start", "win32_start_path", "win32_start_symbol", "win32_start")


@operator("windows.malware.suspicious_threads.SuspiciousThreads")
def suspicious_threads(s, pid=None):
    """Start addresses outside every region, in unbacked regions, or in regions with unusual protection."""
    base = only(s.table("win_threads").filter("source = 'list'"), "pid", pid)
    long = base.select("image", "process", "pid", "tid", F.explode(F.array(F.struct(F.lit("start").alias("context"), F.col("start").alias("address")), F.struct(F.lit("win32_start").alias("context"), F.col("win32_start").alias("address")))).alias("x")).select("*", "x.*").drop("x").filter("address <> 0")
    v = s.table("win_vads").select("image", "pid", F.col("start").alias("_s"), F.col("end").alias("_e"), "file", "protection")
    d = containing(long, "address", v, ["image", "pid"], "_s", "_e", ["file", "protection"])
    none = F.col("protection").isNull()
    notes = F.array(F.when(none, "No region holds the address"), F.when(~none & F.col("file").isNull(), "The region is not backed by a file"), F.when(~none & ~F.col("protection").isin("PAGE_EXECUTE_WRITECOPY", "PAGE_EXECUTE_READ"), "Unusual protection"))
    d = d.withColumn("note", F.explode(F.filter(notes, lambda n: n.isNotNull())))
    return d.dropDuplicates(["image", "pid", "address", "note"]).select("image", "process", "pid", "tid", "context", "address", F.col("file").alias("vad_path"), "note")


# --- tokens and services ------------------------------------------------------------------------------------------


@operator("windows.getsids.GetSIDs")
def getsids(s, pid=None):
    """Names by well-known SID, then service, then user, then pattern."""
    d = only(s.table("win_sids"), "pid", pid)
    rank = F.when(F.col("kind") == "well-known", 0).when(F.col("kind") == "service", 1).otherwise(2)
    names = s.table("win_sid_names").groupBy("image", "sid").agg(F.min_by("name", rank).alias("name"))
    pattern = F.when(F.col("sid").rlike(r"^S-1-5-5-\d+-\d+$"), "Logon Session").when(F.col("sid").rlike(r"^S-1-5-21-[\d-]+-500$"), "Administrator").when(F.col("sid").rlike(r"^S-1-5-21-[\d-]+-501$"), "Guest").when(F.col("sid").rlike(r"^S-1-5-21-[\d-]+-513$"), "Domain Users")
    return d.join(names, ["image", "sid"], "left").select("image", "pid", "process", F.coalesce("sid", F.lit("Token unreadable")).alias("sid"), F.coalesce("name", pattern).alias("name"), "ord")


#: Privilege values. Fixed values.
PRIVILEGES = {2: "SeCreateTokenPrivilege", 3: "SeAssignPrimaryTokenPrivilege", 4: "SeLockMemoryPrivilege", 5: "SeIncreaseQuotaPrivilege", 6: "SeMachineAccountPrivilege", 7: "SeTcbPrivilege", 8: "SeSecurityPrivilege", 9: "SeTakeOwnershipPrivilege", 10: "SeLoadDriverPrivilege", 11: "SeSystemProfilePrivilege", 12: "SeSystemtimePrivilege", 13: "SeProfileSingleProcessPrivilege", 14: "SeIncreaseBasePriorityPrivilege", 15: "SeCreatePagefilePrivilege", 16: "SeCreatePermanentPrivilege", 17: "SeBackupPrivilege", 18: "SeRestorePrivilege", 19: "SeShutdownPrivilege", 20: "SeDebugPrivilege", 21: "SeAuditPrivilege", 22: "SeSystemEnvironmentPrivilege", 23: "SeChangeNotifyPrivilege", 24: "SeRemoteShutdownPrivilege", 25: "SeUndockPrivilege", 26: "SeSyncAgentPrivilege", 27: "SeEnableDelegationPrivilege", 28: "SeManageVolumePrivilege", 29: "SeImpersonatePrivilege", 30: "SeCreateGlobalPrivilege", 31: "SeTrustedCredManAccessPrivilege", 32: "SeRelabelPrivilege", 33: "SeIncreaseWorkingSetPrivilege", 34: "SeTimeZonePrivilege", 35: "SeCreateSymbolicLinkPrivilege"}


@operator("windows.privileges.Privs")
def privileges(s, pid=None):
    names = F.create_map(*(F.lit(x) for kv in PRIVILEGES.items() for x in kv))
    bit = lambda n: F.getbit("attributes", F.lit(n)) == 1
    d = only(s.table("win_privileges"), "pid", pid).withColumn("privilege", names[F.col("value")]).filter("privilege IS NOT NULL")
    return d.select("image", "pid", "process", "value", "privilege", F.array_join(F.array_compact(F.array(F.when(bit(0), "Present"), F.when(bit(1), "Enabled"), F.when(bit(2), "Default"))), ",").alias("attributes"))


_SERVICE = ["image", "offset", "ord", "pid", "start", "state", "type", "name", "display", "binary"]


def _services(s: Session, source: str) -> DataFrame:
    d = s.table("win_services").filter(F.col("source") == source)
    keys = s.table("win_service_keys").groupBy("image", "name").agg(F.max("image_path").alias("binary_registry"), F.max("dll").alias("dll"))
    return d.join(keys, ["image", "name"], "left").select(*_SERVICE, "binary_registry", "dll")


@operator("windows.svcscan.SvcScan")
def svcscan(s):
    return _services(s, "scan").dropDuplicates(["image", "offset"])


@operator("windows.svclist.SvcList")
def svclist(s):
    return _services(s, "list")


@operator("windows.malware.svcdiff.SvcDiff")
def svcdiff(s):
    return svcscan(s).join(s.table("win_services").filter("source = 'list'").select("image", "name").distinct(), ["image", "name"], "left_anti").select(*_SERVICE, "binary_registry", "dll")


@operator("windows.getservicesids.GetServiceSIDs")
def getservicesids(s):
    wide = F.encode(F.upper("name"), "UTF-16LE")
    return s.table("win_service_keys").select("image", scalars.service_sid(wide).alias("sid"), F.col("name").alias("service")).distinct()


# --- objects ------------------------------------------------------------------------------------------------------


@operator("windows.handles.Handles")
def handles(s, pid=None, offset=None):
    return only(only(s.table("win_handles"), "pid", pid), "offset", offset)


@operator("windows.filescan.FileScan")
def filescan(s):
    return s.table("win_files").filter("name IS NOT NULL").select("image", "offset", "name")


@operator("windows.dumpfiles.DumpFiles")
def dumpfiles(s, filter=None, ignore_case=False):
    d = s.table("win_files").filter("cache IS NOT NULL")
    d = d if filter is None else d.filter(F.col("name").rlike(("(?i)" if ignore_case else "") + filter))
    return d.dropDuplicates(["image", "offset", "cache"]).select("image", "cache", F.col("offset").alias("file_object"), F.col("name").alias("file_name"), "result")


@operator("windows.mutantscan.MutantScan")
def mutantscan(s):
    return s.table("win_mutants").withColumn("absent", F.when(F.col("name").isNull(), scalars.NOT_APPLICABLE))


@operator("windows.symlinkscan.SymlinkScan")
def symlinkscan(s):
    return s.table("win_symlinks").dropna(subset=["from_name", "to_name"])


@operator("windows.bigpools.BigPools")
def bigpools(s, tags=None, show_free=False):
    d = only(s.table("win_bigpools").filter("key > 0"), "tag", tags)
    free = F.col("va").bitwiseAND(F.lit(1)) == 1
    d = d if show_free else d.filter(~free)
    return d.select("image", F.col("va").bitwiseAND(F.lit(~1)).alias("allocation"), "tag", "pool_type", F.col("bytes").alias("number_of_bytes"), F.when(free, "Free").otherwise("Allocated").alias("status"))


@operator("windows.poolscanner.PoolScanner")
def poolscanner(s):
    return s.table("win_pool_hits")


@operator("windows.kpcrs.KPCRs")
def kpcrs(s):
    return s.table("win_kpcrs").select("image", "offset", "prcb", "ord")


@operator("windows.info.Info")
def info(s):
    return s.table("win_facts")


def _desktops(s, source):
    return s.table("win_desktops").filter(F.col("source") == source).drop("source")


@operator("windows.deskscan.DeskScan")
def deskscan(s):
    return _desktops(s, "scan")


@operator("windows.desktops.Desktops")
def desktops(s):
    return _desktops(s, "list")


@operator("windows.windowstations.WindowStations")
def windowstations(s):
    known = s.table("win_processes").select("image", "session_id").distinct()
    return s.table("win_stations").join(known, ["image", "session_id"], "left_semi").dropDuplicates(["image", "offset"]).select("image", "offset", "name", "session_id")


@operator("windows.windows.Windows")
def windows(s):
    return s.table("win_windows").filter("process IS NOT NULL AND (procedure = 0 OR procedure > 4096)")


def _consoles(s, kind):
    return s.table("win_consoles").filter(F.col("kind") == kind).select("image", "pid", "process", "info", F.inline("fields"))


@operator("windows.consoles.Consoles")
def consoles(s):
    return _consoles(s, "console")


@operator("windows.cmdscan.CmdScan")
def cmdscan(s):
    return _consoles(s, "history")


# --- network ------------------------------------------------------------------------------------------------------


def _sockets(s: Session, source: str, include_corrupt: bool) -> DataFrame:
    """TCP and UDP rows; a dual-stack listener gives one row for each family."""
    d = s.table("win_sockets").filter(F.col("source") == source)
    d = d if include_corrupt else d.filter("local_port BETWEEN 0 AND 65535 AND (pid IS NULL OR pid BETWEEN 0 AND 65535000)")
    v4, v6 = (F.struct(F.concat("proto", F.lit(v)).alias("proto"), F.coalesce("local_addr", F.lit(any_)).alias("local_addr")) for v, any_ in (("v4", "0.0.0.0"), ("v6", "::")))
    rows = F.when(F.col("dual_stack"), F.array(v4, v6)).when(F.col("family") == 23, F.array(v6)).otherwise(F.array(v4))
    return d.withColumn("_x", F.explode(rows)).select("image", "offset", "_x.proto", "_x.local_addr", "local_port", "foreign_addr", "foreign_port", "state", "pid", "owner", "created")


@operator("windows.netscan.NetScan")
def netscan(s, include_corrupt=False):
    return _sockets(s, "scan", include_corrupt)


@operator("windows.netstat.NetStat")
def netstat(s, include_corrupt=False):
    return _sockets(s, "list", include_corrupt)


# --- registry and file system -------------------------------------------------------------------------------------


@operator("windows.registry.hivelist.HiveList")
def hivelist(s, filter=None):
    d = s.table("win_hives").filter("source = 'list'")
    return (d if filter is None else d.filter(F.contains(F.lower("path"), F.lit(filter.lower())))).select("image", "offset", F.col("path").alias("file_full_path"), "ord")


@operator("windows.registry.hivescan.HiveScan")
def hivescan(s):
    pools = s.table("win_bigpools").filter("tag = 'CM10'").select("image", F.col("va").alias("offset"))
    scanned = s.table("win_hives").filter("source = 'scan'").select("image", "offset")
    return pools.unionByName(scanned.join(pools.select("image").distinct(), "image", "left_anti"))


def _key_paths(s: Session) -> DataFrame:
    """Keys with their full path; keys on cycles have no root and fall away."""
    k = s.table("win_keys")
    tree = relational.tree_paths(k, "cell", "parent", ["image", "hive_offset"], "name", "\\")
    return k.join(tree.select("image", "hive_offset", "cell", "depth", F.col("names").alias("key")), ["image", "hive_offset", "cell"])


@operator("windows.registry.printkey.PrintKey")
def printkey(s, key=None, recurse=False, offset=None):
    """Subkeys and values of a key; with ``recurse`` of everything below it."""
    k = only(_key_paths(s), "hive_offset", offset)
    if key is not None:
        at, below = F.col("key").endswith("\\" + key), F.contains(F.col("key"), F.lit("\\" + key + "\\"))
        k = k.filter(at | below) if recurse else k.filter(at | F.col("key").rlike(r"\\\Q" + key + r"\E\\[^\\]+$"))
    keys = k.select("image", "last_write", "hive_offset", F.lit("Key").alias("type"), "key", "name", F.lit(None).cast("string").alias("data"), "volatile", "depth")
    v = k.select("image", "last_write", "hive_offset", F.col("key"), "volatile", "depth", F.explode(F.arrays_zip("value_names", "value_types", "value_data")).alias("v"))
    return keys.unionByName(v.select("image", "last_write", "hive_offset", F.col("v.value_types").alias("type"), "key", F.col("v.value_names").alias("name"), F.col("v.value_data").alias("data"), "volatile", "depth"))


@operator("windows.registry.userassist.UserAssist")
def userassist(s):
    d = printkey(s).filter(F.col("key").rlike(r"\\UserAssist\\[^\\]+\\Count$") & (F.col("type") != "Key"))
    raw = F.unhex("data")
    return d.select("image", "hive_offset", "key", "last_write", "type", scalars.rot13(F.col("name")).alias("name"), scalars.uint(raw, 0, 4).alias("id"), scalars.uint(raw, 4, 4).alias("run_count"), scalars.uint(raw, 8, 4).alias("focus_count"), scalars.uint(raw, 12, 4).alias("focus_ms"), scalars.filetime(scalars.uint(raw, 60, 8)).alias("last_updated"))


@operator("windows.registry.certificates.Certificates")
def certificates(s):
    d = printkey(s).filter(F.col("key").rlike(r"(?i)\\SystemCertificates\\") & (F.col("name") == "Blob"))
    parts = F.split("key", r"\\")
    return d.select("image", F.col("key").alias("path"), F.element_at(parts, -3).alias("section"), F.element_at(parts, -1).alias("certificate_id"), "data")


@operator("windows.registry.amcache.Amcache")
def amcache(s):
    return s.table("win_amcache")


@operator("windows.shimcachemem.ShimcacheMem")
def shimcachemem(s):
    return s.table("win_shimcache")


@operator("windows.mftscan.MFTScan")
def mftscan(s):
    d = s.table("win_mft").filter("attribute IN ('STANDARD_INFORMATION', 'FILE_NAME')")
    return d.select("image", "offset", "record_type", "record_no", "links", "mft_type", "permissions", "attribute", "created", "modified", "updated", "accessed", "filename").dropDuplicates(["image", "offset", "attribute", "filename"])


@operator("windows.mftscan.ADS")
def mft_streams(s):
    return s.table("win_mft").filter("attribute = 'DATA' AND stream IS NOT NULL").select("image", "offset", "record_type", "record_no", "mft_type", "filename", F.col("stream").alias("ads_filename"), F.col("data").alias("hexdump"))


@operator("windows.mftscan.ResidentData")
def mft_resident(s):
    return s.table("win_mft").filter("attribute = 'DATA' AND stream IS NULL AND resident").select("image", "offset", "record_type", "record_no", "mft_type", "filename", F.col("data").alias("hexdump"))


for _old, _new in {
    "amcache.Amcache": "registry.amcache.Amcache", "drivermodule.DriverModule": "malware.drivermodule.DriverModule", "hollowprocesses.HollowProcesses": "malware.hollowprocesses.HollowProcesses",
    "ldrmodules.LdrModules": "malware.ldrmodules.LdrModules", "malfind.Malfind": "malware.malfind.Malfind", "processghosting.ProcessGhosting": "malware.processghosting.ProcessGhosting", "psxview.PsXView": "malware.psxview.PsXView",
    "skeleton_key_check.Skeleton_Key_Check": "malware.skeleton_key_check.Skeleton_Key_Check", "suspicious_threads.SuspiciousThreads": "malware.suspicious_threads.SuspiciousThreads", "svcdiff.SvcDiff": "malware.svcdiff.SvcDiff",
    "unhooked_system_calls.unhooked_system_calls": "malware.unhooked_system_calls.UnhookedSystemCalls",
}.items():
    alias(f"windows.{_old}", f"windows.{_new}")


# --- system calls outside the system's own libraries --------------------------------------------------------------

schemas(
    win_pe_files="pid long, process string, base long, kernel boolean, bytes binary",
    win_tasks="ord long, task_name string, principal_id string, display_name string, enabled boolean, created timestamp, last_run timestamp, last_success timestamp, triggers array<struct<type:string,description:string>>, actions array<struct<type:string,action:string,arguments:string,context:string,directory:string>>, key_name string",
)

#: x64 stubs: ``mov r10, rcx`` and ``mov eax, number`` in either order, then within 24 bytes a system call or a jump to
#: one (relative, through memory, or through a register). Fixed values.
STUB = rb"(?:\x4c\x8b\xd1|\x49\x89\xca)(?:.{0,8})\xb8(..)\x00\x00|\xb8(..)\x00\x00(?:.{0,8})(?:\x4c\x8b\xd1|\x49\x89\xca)"
DIRECT, INDIRECT = rb"(?:" + STUB + rb").{0,24}\x0f\x05", rb"(?:" + STUB + rb")(?:(?!\x0f\x05).){0,24}(?:\xe9|\xff\x25|\xff[\xe0-\xe7]|\x41\xff[\xe0-\xe7])"
SYSTEM_LIBRARIES = ("ntdll.dll", "win32u.dll")


def _stubs(s: Session, pattern: bytes) -> DataFrame:
    """Code that sets up a system call by itself in executable regions of other files. Judged by byte patterns."""
    from .generic import text_hits

    name = F.lower(F.coalesce(scalars.basename(F.col("file"), "\\"), F.lit("")))
    code = s.table("win_vads").filter(F.col("protection").contains("EXECUTE") & ~name.isin(*SYSTEM_LIBRARIES))
    span = F.concat_ws("-", F.hex("start"), F.hex("end"))
    hits = text_hits(code.withColumn("range", span), ["image", "process", "pid", "range"], "start", "head", pattern, 64)
    return hits.select("image", "process", "pid", "range", F.col("offset").alias("address"), F.col("hex").alias("code"))


@operator("windows.malware.direct_system_calls.DirectSystemCalls")
def direct_system_calls(s):
    return _stubs(s, DIRECT)


@operator("windows.malware.indirect_system_calls.IndirectSystemCalls")
def indirect_system_calls(s):
    return _stubs(s, INDIRECT)


@operator("windows.pedump.PEDump")
def pedump(s, base=None, pid=None, kernel_module=False):
    """Executable images at a base, of processes or of the kernel, with their bytes; write them with any file sink."""
    d = only(s.table("win_pe_files").filter(F.coalesce("kernel", F.lit(False)) == F.lit(kernel_module)), "base", base)
    return only(d, "pid", pid).dropDuplicates(["image", "pid", "base"]).drop("kernel")


@operator("windows.registry.scheduled_tasks.ScheduledTasks")
def scheduled_tasks(s):
    """A row for each trigger and action of a task; a task without either keeps one row."""
    d = s.table("win_tasks").withColumn("_t", F.explode_outer("triggers")).withColumn("_a", F.explode_outer("actions"))
    return d.select(
        "image", "task_name", "principal_id", "display_name", "enabled", F.col("created").alias("creation_time"), F.col("last_run").alias("last_run_time"), F.col("last_success").alias("last_successful_run_time"), F.col("_t.type").alias("trigger_type"), F.col("_t.description").alias("trigger_description"),
        F.col("_a.type").alias("action_type"), F.col("_a.action").alias("action"), F.col("_a.arguments").alias("action_arguments"), F.col("_a.context").alias("action_context"), F.col("_a.directory").alias("working_directory"), "key_name",
    )


alias("windows.direct_system_calls.DirectSystemCalls", "windows.malware.direct_system_calls.DirectSystemCalls")
alias("windows.indirect_system_calls.IndirectSystemCalls", "windows.malware.indirect_system_calls.IndirectSystemCalls")
alias("windows.scheduled_tasks.ScheduledTasks", "windows.registry.scheduled_tasks.ScheduledTasks")

from . import secrets  # noqa: E402, F401  (it registers operators over the keys above)
