"""Queries that run named operators over object tables made from the driver's tables, each with its equivalent in SQL.

The rows stand for kernel objects of three images; what is checked is the operator's own rule. Remainders of keys stand
for attributes (an image, a kernel thread, a flag); every row of the tables takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import extract, generic, linux, mac, windows  # noqa: F401  (they register operators)
from .catalog import query
from .session import Session


def _session(t, **tables: DataFrame) -> Session:
    return Session(t.spark, {k: extract.as_table(d, k) for k, d in tables.items()})


def _image(key: str):
    return F.concat(F.lit("i"), (F.col(key) % 3).cast("string")).alias("image")


def _l(x):
    return F.lit(x)


def _c(x: str, name: str):
    return F.expr(x).alias(name)


# --- processes ----------------------------------------------------------------------------------------------------


def _orders_as_processes(t) -> DataFrame:
    """Each order once by its number and once more, later on the list, under another name."""
    o = t.orders
    cols = [_image("o_orderkey"), _l("pslist").alias("source"), _c("o_orderkey", "offset"), _c("o_orderkey", "pid"), _c("o_orderkey div 2", "ppid"), _c("CAST(o_orderdate AS timestamp)", "create_time")]
    first = o.select(*cols, _c("o_orderkey", "ord"), _c("o_orderpriority", "name"), _c("CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus ELSE '' END", "cmd"))
    return first.unionByName(o.select(*cols, _c("o_orderkey + 1000000000", "ord"), _l("again").alias("name"), _l("again").alias("cmd")))


@query("SELECT 'i' || o_orderkey % 3 AS image, o_orderkey AS pid, o_orderkey // 2 AS ppid, o_orderpriority AS image_file_name, o_orderkey AS \"offset\", o_orderdate AS create_time FROM orders")
def forensic_win_pslist(t):
    return _session(t, win_processes=_orders_as_processes(t)).run("windows.pslist.PsList").select("image", "pid", "ppid", "image_file_name", "offset", F.col("create_time").cast("timestamp_ntz").alias("create_time"))


@query("SELECT 'i' || o_orderkey % 3 AS image, o_orderkey AS pid, o_orderpriority AS process, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS args, CASE WHEN o_orderkey % 4 = 0 THEN 'unreadable' END AS absent FROM orders")
def forensic_win_cmdline(t):
    return _session(t, win_processes=_orders_as_processes(t)).run("windows.cmdline.CmdLine")


@query("""
WITH p AS (SELECT o_orderkey AS k, 1 AS s FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT l_orderkey, 2 FROM lineitem WHERE l_quantity > 30
  UNION ALL SELECT o_orderkey, 3 FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_orderkey, 4 FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT 'i' || k % 3 AS image, k AS "offset", bool_or(s = 1) AS pslist, bool_or(s = 2) AS psscan, bool_or(s = 3) AS thrdscan, bool_or(s = 4) AS csrss FROM p GROUP BY k""")
def forensic_win_psxview(t):
    part = lambda d, key, source: d.select(_image(key), _l(source).alias("source"), F.col(key).alias("offset"), _l(0).cast("long").alias("ord"), F.col(key).alias("pid"))
    o = t.orders
    rows = part(o.filter("o_orderstatus <> 'P'"), "o_orderkey", "pslist").unionByName(part(t.lineitem.filter("l_quantity > 30"), "l_orderkey", "psscan"))
    rows = rows.unionByName(part(o.filter("o_totalprice > 200000"), "o_orderkey", "thrdscan")).unionByName(part(o.filter("o_orderpriority = '1-URGENT'"), "o_orderkey", "csrss"))
    return _session(t, win_processes=rows).run("windows.malware.psxview.PsXView").select("image", "offset", "pslist", "psscan", "thrdscan", "csrss")


@query("""
WITH c AS (SELECT *, 'i' || c_custkey % 3 AS image, CASE WHEN c_custkey % 7 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS tid, c_nationkey % 5 = 0 AS is_kernel FROM customer)
SELECT image, c_custkey AS pid, tid, CASE WHEN is_kernel THEN '[' || c_mktsegment || ']' WHEN tid <> c_custkey THEN '{' || c_mktsegment || '}' ELSE c_mktsegment END AS comm FROM c""")
def forensic_lin_pslist(t):
    return _session(t, lin_tasks=_customers_as_tasks(t)).run("linux.pslist.PsList", threads=True, decorate_comm=True).select("image", "pid", "tid", "comm")


def _customers_as_tasks(t) -> DataFrame:
    return t.customer.select(
        _image("c_custkey"), _l("list").alias("source"), _c("c_custkey", "ord"), _c("c_custkey", "offset"), _c("c_custkey", "pid"), _c("IF(c_custkey % 7 = 0, c_custkey + 1000000, c_custkey)", "tid"), _c("c_mktsegment", "comm"),
        _c("c_nationkey % 5 = 0", "is_kernel"), _c("CAST(c_nationkey AS long)", "cred"), _c("c_custkey * 2654435761 % 2199023255552", "cap_effective"), _l(40).alias("cap_last"),
    )


@query("""
SELECT 'i' || c_custkey % 3 AS image, CAST(c_nationkey AS BIGINT) AS cred, string_agg(CAST(c_custkey AS VARCHAR), ', ' ORDER BY c_custkey) AS pids
FROM customer WHERE c_nationkey <> 0 AND c_custkey % 7 <> 0 GROUP BY 1, 2 HAVING count(*) >= 2""")
def forensic_lin_check_creds(t):
    return _session(t, lin_tasks=_customers_as_tasks(t)).run("linux.malware.check_creds.Check_creds")


_CAPS = "[" + ", ".join(f"CASE WHEN (v >> {i}) & 1 = 1 THEN 'cap_{n}' END" for i, n in enumerate(linux.CAPABILITIES)) + "]"


@query(f"""
SELECT 'i' || c_custkey % 3 AS image, c_custkey AS pid, CASE WHEN v = 0 THEN '' WHEN v = (1::BIGINT << 41) - 1 THEN 'all' ELSE array_to_string(list_filter({_CAPS}, lambda x: x IS NOT NULL), ', ') END AS cap_effective
FROM (SELECT c_custkey, c_custkey * 2654435761 % 2199023255552 AS v FROM customer)""")
def forensic_lin_capabilities(t):
    return _session(t, lin_tasks=_customers_as_tasks(t)).run("linux.capabilities.Capabilities").select("image", "pid", "cap_effective")


@query(r"""
WITH e AS (SELECT 'i' || event_id % 3 AS image, event_id, [['KIND', event_type], ['USER', 'u=' || user_id]] AS kv FROM events WHERE event_id % 5 <> 0),
x AS (SELECT image, event_id, unnest(kv) AS p, unnest([0, 1]) AS ord FROM e)
SELECT image, event_id AS pid, p[1] AS key, p[2] AS value, ord FROM x""")
def forensic_lin_envars(t):
    """Entries after one without an equals sign are left out; kernel threads have none."""
    text = F.concat_ws("\0", F.concat(_l("KIND="), "event_type"), F.concat(_l("USER=u="), F.col("user_id").cast("string")), _l("end"), _l("LATE=1"))
    tasks = t.events.select(_image("event_id"), _l("list").alias("source"), _c("event_id", "ord"), _c("event_id", "offset"), _c("event_id", "pid"), _c("event_id", "tid"), _c("event_id % 5 = 0", "is_kernel"), text.cast("binary").alias("env"))
    return _session(t, lin_tasks=tasks).run("linux.envars.Envars").select("image", "pid", "key", "value", "ord")


# --- modules, handlers --------------------------------------------------------------------------------------------

_MODULES = "m AS (SELECT 'i' || p_partkey % 3 AS image, p_partkey AS ord, p_name AS name, p_partkey * 8192 AS base, p_partkey * 8192 + p_size * 400 AS fin FROM part)"


def _parts_as_modules(t, source: str) -> DataFrame:
    return t.part.select(_image("p_partkey"), _l(source).alias("source"), _c("p_partkey", "ord"), _c("p_partkey", "offset"), _c("p_name", "name"), _c("p_partkey * 8192", "base"), _c("CAST(p_size AS long) * 400", "size"))


def _suppliers_as_symbols(t) -> DataFrame:
    return t.supplier.select(_image("s_suppkey"), _c("s_suppkey * 1000", "address"), _c("s_name", "name"))


@query(f"""
WITH {_MODULES}, c AS (SELECT 'i' || o_orderkey % 3 AS image, o_orderkey * 1000 AS callback, o_orderpriority AS type, o_orderkey AS ord FROM orders)
SELECT c.image, c.ord, c.type, c.callback, (SELECT arg_min(name, m.ord) FROM m WHERE m.image = c.image AND c.callback BETWEEN base AND fin) AS module,
       (SELECT min(s_name) FROM supplier WHERE 'i' || s_suppkey % 3 = c.image AND s_suppkey * 1000 = c.callback) AS symbol FROM c""")
def forensic_win_callbacks(t):
    calls = t.orders.select(_image("o_orderkey"), _c("o_orderkey", "ord"), _c("o_orderpriority", "type"), _c("o_orderkey * 1000", "callback"))
    s = _session(t, win_callbacks=calls, win_modules=_parts_as_modules(t, "list"), symbols=_suppliers_as_symbols(t))
    return s.run("windows.callbacks.Callbacks").select("image", "ord", "type", "callback", "module", "symbol")


@query(f"""
WITH {_MODULES}, h AS (SELECT 'i' || o_orderkey % 3 AS image, o_orderkey * 900 AS handler, o_orderpriority AS hook, o_custkey AS net_ns FROM orders WHERE o_orderstatus = 'F'),
r AS (SELECT h.*, (SELECT arg_min(name, m.ord) FROM m WHERE m.image = h.image AND h.handler >= base AND h.handler < fin) AS module FROM h)
SELECT image, net_ns, hook, handler, module, module IS NULL AS is_hooked FROM r""")
def forensic_lin_netfilter(t):
    hooks = t.orders.filter("o_orderstatus = 'F'").select(_image("o_orderkey"), _l("netfilter").alias("kind"), _c("o_orderkey * 900", "address"), _c("o_orderpriority", "hook"), _c("o_custkey", "net_ns"))
    s = _session(t, lin_handlers=hooks, lin_modules=_parts_as_modules(t, "list"), symbols=_suppliers_as_symbols(t))
    return s.run("linux.malware.netfilter.Netfilter").select("image", "net_ns", "hook", "handler", "module", "is_hooked")


_VIEWS = """
v AS (SELECT 'i' || p_partkey % 3 AS image, p_partkey AS k, 1 AS s FROM part WHERE p_size > 25 UNION ALL SELECT 'i' || l_partkey % 3, l_partkey, 2 FROM lineitem WHERE l_quantity > 49
  UNION ALL SELECT 'i' || p_partkey % 3, p_partkey, 3 FROM part WHERE p_size < 30)"""


def _module_views(t) -> DataFrame:
    part = lambda d, key, source: d.select(_image(key), _l(source).alias("source"), F.col(key).alias("ord"), F.col(key).alias("offset"), F.concat(_l("m"), F.col(key).cast("string")).alias("name"))
    return part(t.part.filter("p_size > 25"), "p_partkey", "list").unionByName(part(t.lineitem.filter("l_quantity > 49"), "l_partkey", "sysfs")).unionByName(part(t.part.filter("p_size < 30"), "p_partkey", "scan"))


@query(f"WITH {_VIEWS} SELECT image, k AS \"offset\", 'm' || k AS name, bool_or(s = 1) AS in_procfs, bool_or(s = 2) AS in_sysfs, bool_or(s = 3) AS in_scan FROM v GROUP BY image, k")
def forensic_lin_modxview(t):
    return _session(t, lin_modules=_module_views(t)).run("linux.malware.modxview.Modxview").select("image", "offset", "name", "in_procfs", "in_sysfs", "in_scan")


@query(f"WITH {_VIEWS} SELECT image, 'm' || k AS module_name FROM v WHERE s = 3 AND k NOT IN (SELECT k FROM v WHERE s < 3)")
def forensic_lin_hidden_modules(t):
    return _session(t, lin_modules=_module_views(t)).run("linux.malware.hidden_modules.Hidden_modules").select("image", "module_name")


@query(f"WITH {_VIEWS} SELECT image, 'm' || k AS module_name FROM v WHERE s = 2 AND k NOT IN (SELECT k FROM v WHERE s = 1)")
def forensic_lin_check_modules(t):
    return _session(t, lin_modules=_module_views(t)).run("linux.malware.check_modules.Check_modules").select("image", "module_name")


@query("""
WITH s AS (SELECT 'i' || o_orderkey % 3 AS image, o_orderkey AS k, 'svc' || o_orderkey % 5000 AS name FROM orders)
SELECT image, k AS "offset", name FROM s WHERE (image, name) NOT IN (SELECT 'i' || c_custkey % 3, 'svc' || c_custkey FROM customer)""")
def forensic_win_svcdiff(t):
    scan = t.orders.select(_image("o_orderkey"), _l("scan").alias("source"), _c("o_orderkey", "offset"), _c("concat('svc', o_orderkey % 5000)", "name"))
    listed = t.customer.select(_image("c_custkey"), _l("list").alias("source"), _c("c_custkey", "offset"), _c("concat('svc', c_custkey)", "name"))
    return _session(t, win_services=scan.unionByName(listed)).run("windows.malware.svcdiff.SvcDiff").select("image", "offset", "name")


@query("""
WITH n AS (SELECT 'i' || p_partkey % 3 AS image, p_brand AS function, p_name AS bytes, count(*) AS n, list(p_partkey) AS pids FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS k, sum(n) OVER (PARTITION BY image, function) AS total FROM n WINDOW w AS (PARTITION BY image, function ORDER BY n DESC, bytes))
SELECT image, function, array_to_string(list_sort(flatten(list(pids))), ', ') AS distinct_implementations, CAST(max(total) AS BIGINT) AS total_implementations FROM r WHERE k > 1 GROUP BY image, function""")
def forensic_win_unhooked(t):
    stubs = t.part.select(_image("p_partkey"), _c("p_partkey", "pid"), _c("p_brand", "function"), _c("CAST(p_name AS binary)", "bytes"))
    return _session(t, win_stubs=stubs).run("windows.malware.unhooked_system_calls.UnhookedSystemCalls")


# --- memory -------------------------------------------------------------------------------------------------------

_AREAS = """
a AS (SELECT 'i' || l_orderkey % 3 AS image, l_suppkey AS pid, l_orderkey * 65536 + l_linenumber * 4096 AS start,
        CASE l_returnflag WHEN 'A' THEN 'PAGE_EXECUTE_READWRITE' WHEN 'R' THEN 'PAGE_EXECUTE_WRITECOPY' ELSE 'PAGE_READWRITE' END AS protection,
        CASE WHEN l_linestatus = 'F' THEN 'VadS' ELSE 'Vad ' END AS tag, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS private_memory, l_linenumber - 3 AS dirty, l_partkey % 3 AS head FROM lineitem)"""


def _lines_as_areas(t) -> DataFrame:
    return t.lineitem.select(
        _image("l_orderkey"), _c("l_suppkey", "pid"), _l("p").alias("process"), _c("l_orderkey * 65536 + l_linenumber * 4096", "start"), _c("l_orderkey * 65536 + l_linenumber * 4096 + 4095", "end"),
        _c("CASE l_returnflag WHEN 'A' THEN 'PAGE_EXECUTE_READWRITE' WHEN 'R' THEN 'PAGE_EXECUTE_WRITECOPY' ELSE 'PAGE_READWRITE' END", "protection"), _c("IF(l_linestatus = 'F', 'VadS', 'Vad ')", "tag"), _c("IF(l_linestatus = 'F', 1, 0)", "private_memory"),
        _c("CAST(l_linenumber - 3 AS long)", "dirty_pages"), _c("CASE l_partkey % 3 WHEN 0 THEN X'4D5A9000' WHEN 1 THEN X'558BEC90' ELSE X'90909090' END", "head"), _c("concat('f', l_partkey)", "file"),
    )


@query(f"""
WITH {_AREAS} SELECT image, pid, start, tag, protection, CASE head WHEN 0 THEN 'MZ header' WHEN 1 THEN 'Function prologue' END AS notes FROM a
WHERE protection LIKE '%EXECUTE%' AND (protection LIKE '%WRITE%' OR dirty > 0) AND (tag = 'VadS' OR protection <> 'PAGE_EXECUTE_WRITECOPY')""")
def forensic_win_malfind(t):
    return _session(t, win_vads=_lines_as_areas(t)).run("windows.malware.malfind.Malfind").select("image", "pid", "start", "tag", "protection", "notes")


@query("""
WITH v AS (SELECT 'i' || l_orderkey % 3 AS image, l_suppkey AS pid, l_orderkey * 65536 + l_linenumber * 4096 AS base, 'f' || l_partkey AS mapped_path FROM lineitem WHERE l_partkey % 3 = 0),
d AS (SELECT 'i' || l_orderkey % 3 AS image, l_suppkey AS pid, l_orderkey * 65536 + l_linenumber * 4096 AS base, bool_or(l_linestatus = 'F') AS a, bool_or(l_returnflag = 'A') AS b, bool_or(l_tax > 0.04) AS c FROM lineitem WHERE l_quantity > 25 GROUP BY ALL)
SELECT v.*, coalesce(a, FALSE) AS in_load, coalesce(b, FALSE) AS in_init, coalesce(c, FALSE) AS in_mem FROM v LEFT JOIN d USING (image, pid, base)""")
def forensic_win_ldrmodules(t):
    ldr = t.lineitem.filter("l_quantity > 25").select(_image("l_orderkey"), _c("l_suppkey", "pid"), _c("l_orderkey * 65536 + l_linenumber * 4096", "base"), _c("l_linestatus = 'F'", "in_load"), _c("l_returnflag = 'A'", "in_init"), _c("l_tax > 0.04", "in_mem"))
    return _session(t, win_vads=_lines_as_areas(t), win_ldr=ldr).run("windows.malware.ldrmodules.LdrModules").select("image", "pid", "base", "mapped_path", "in_load", "in_init", "in_mem")


@query("""
WITH v AS (SELECT 'i' || event_id % 3 AS image, user_id % 50 AS pid, event_id * 1000 AS lo, event_id * 1000 + 499 AS hi, event_type AS file FROM events),
h AS (SELECT 'i' || event_id % 3 AS image, user_id % 50 AS pid, event_id AS tid, event_id * 1000 + event_id % 1000 AS start, event_id * 1000 + 300000 AS win32_start FROM events)
SELECT h.image, h.pid, h.tid, h.start, CASE WHEN h.start <= a.hi THEN a.file END AS start_path, h.win32_start, CASE WHEN h.win32_start <= b.hi THEN b.file END AS win32_start_path
FROM h ASOF LEFT JOIN v a ON h.image = a.image AND h.pid = a.pid AND h.start >= a.lo ASOF LEFT JOIN v b ON h.image = b.image AND h.pid = b.pid AND h.win32_start >= b.lo""")
def forensic_win_threads(t):
    e = t.events
    areas = e.select(_image("event_id"), _c("user_id % 50", "pid"), _c("event_id * 1000", "start"), _c("event_id * 1000 + 499", "end"), _c("event_type", "file"))
    threads = e.select(_image("event_id"), _l("list").alias("source"), _c("user_id % 50", "pid"), _c("event_id", "tid"), _c("event_id * 1000 + event_id % 1000", "start"), _c("event_id * 1000 + 300000", "win32_start"))
    return _session(t, win_vads=areas, win_threads=threads).run("windows.threads.Threads").select("image", "pid", "tid", "start", "start_path", "win32_start", "win32_start_path")


@query("""
WITH p AS (SELECT DISTINCT 'i' || l_suppkey % 3 AS image, l_suppkey AS pid, l_partkey * 4096 AS virt, (l_partkey + l_partkey // 7) * 4096 AS phys FROM lineitem),
n AS (SELECT *, CASE WHEN lag(virt) OVER w + 4096 = virt AND lag(phys) OVER w + 4096 = phys THEN 0 ELSE 1 END AS fresh FROM p WINDOW w AS (PARTITION BY image, pid ORDER BY virt)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY image, pid ORDER BY virt) AS run FROM n),
g AS (SELECT image, pid, min(virt) AS virtual, min(phys) AS physical, CAST(count(*) * 4096 AS BIGINT) AS size FROM r GROUP BY image, pid, run)
SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY image, pid ORDER BY virtual ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS file_offset FROM g""")
def forensic_win_memmap(t):
    pages = t.lineitem.select(_image("l_suppkey"), _c("l_suppkey", "pid"), _c("l_partkey * 4096", "virt"), _c("(l_partkey + l_partkey div 7) * 4096", "phys")).distinct()
    return _session(t, win_pages=pages.withColumns({"size": _l(4096), "class": _l("valid"), "large": _l(False)})).run("windows.memmap.Memmap")


@query("""
WITH b AS (SELECT 'i' || o_orderkey % 3 AS image, o_orderkey AS va, substr(o_orderpriority, 3, 4) AS tag, o_custkey % 5 AS k, o_orderkey * 16 AS n FROM orders)
SELECT image, va & ~1 AS allocation, tag, n AS number_of_bytes, CASE WHEN va & 1 = 1 THEN 'Free' ELSE 'Allocated' END AS status FROM b WHERE k > 0""")
def forensic_win_bigpools(t):
    pools = t.orders.select(_image("o_orderkey"), _c("o_orderkey", "va"), _c("substr(o_orderpriority, 3, 4)", "tag"), _c("o_custkey % 5", "key"), _c("o_orderkey * 16", "bytes"))
    return _session(t, win_bigpools=pools).run("windows.bigpools.BigPools", show_free=True).select("image", "allocation", "tag", "number_of_bytes", "status")


_NAMES = ", ".join(f"({k}, '{n}')" for k, n in windows.PRIVILEGES.items())


@query(f"""
SELECT 'i' || p_partkey % 3 AS image, p_partkey AS pid, p_size AS value, n AS privilege,
       array_to_string(list_filter([CASE WHEN p_partkey & 1 > 0 THEN 'Present' END, CASE WHEN p_partkey & 2 > 0 THEN 'Enabled' END, CASE WHEN p_partkey & 4 > 0 THEN 'Default' END], lambda x: x IS NOT NULL), ',') AS attributes
FROM part JOIN (VALUES {_NAMES}) names(k, n) ON k = p_size""")
def forensic_win_privileges(t):
    rows = t.part.select(_image("p_partkey"), _c("p_partkey", "pid"), _c("p_size", "value"), _c("p_partkey", "attributes"))
    return _session(t, win_privileges=rows).run("windows.privileges.Privs").drop("process")


@query("""
WITH e AS (SELECT 'i' || event_id % 3 AS image, event_id, user_id, event_type, event_id % 70000 AS port, CASE WHEN user_id % 2 = 0 THEN 'TCP' ELSE 'UDP' END AS proto, event_id % 4 = 0 AS dual, event_id % 3 = 0 AS six FROM events)
SELECT image, event_id AS "offset", proto || 'v4' AS proto, '0.0.0.0' AS local_addr, port AS local_port, user_id AS pid FROM e WHERE (dual OR NOT six) AND port <= 65535
UNION ALL SELECT image, event_id, proto || 'v6', '::', port, user_id FROM e WHERE (dual OR six) AND port <= 65535""")
def forensic_win_netscan(t):
    rows = t.events.select(_image("event_id"), _l("scan").alias("source"), _c("event_id", "offset"), _c("IF(user_id % 2 = 0, 'TCP', 'UDP')", "proto"), _c("IF(event_id % 3 = 0, 23, 2)", "family"), _c("CAST(event_id % 70000 AS int)", "local_port"), _c("user_id", "pid"), _c("event_id % 4 = 0", "dual_stack"))
    return _session(t, win_sockets=rows).run("windows.netscan.NetScan").select("image", "offset", "proto", "local_addr", F.col("local_port").cast("long").alias("local_port"), "pid")


@query("""
SELECT image, mnt_ns, mount_id, path FROM (SELECT 'i' || o_custkey % 3 AS image, o_custkey AS mnt_ns, CAST(o_orderkey % 5 AS INT) AS mount_id, 'p' || o_orderkey AS path,
  row_number() OVER (PARTITION BY o_custkey, o_orderkey % 5 ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1""")
def forensic_lin_mountinfo(t):
    rows = t.orders.select(_image("o_custkey"), _c("o_custkey", "mnt_ns"), _c("o_orderkey", "pid"), _c("o_orderkey", "ord"), _c("CAST(o_orderkey % 5 AS int)", "mount_id"), _c("concat('p', o_orderkey)", "path"))
    return _session(t, lin_mounts=rows).run("linux.mountinfo.MountInfo").select("image", "mnt_ns", "mount_id", "path")


# --- names, events, scans -----------------------------------------------------------------------------------------


@query("""
WITH RECURSIVE f AS (SELECT o_orderkey AS k, '/' AS file_path FROM orders WHERE o_orderkey = 0
  UNION ALL SELECT o.o_orderkey, CASE WHEN f.file_path = '/' THEN '' ELSE f.file_path END || '/n' || o.o_orderkey FROM orders o JOIN f ON o.o_orderkey // 2 = f.k AND o.o_orderkey > 0)
SELECT 'i0' AS image, k AS address, file_path FROM f""")
def forensic_mac_list_files(t):
    rows = t.orders.select(_l("i0").alias("image"), _c("o_orderkey", "address"), _c("IF(o_orderkey > 0, o_orderkey div 2, NULL)", "parent"), _c("IF(o_orderkey > 0, concat('n', o_orderkey), '')", "name"))
    return _session(t, mac_vnodes=rows).run("mac.list_files.List_Files")


_FILTERS = ", ".join(f"({k}, '{n}')" for k, n in mac.FILTERS.items())


@query(f"""
SELECT 'i' || event_id % 3 AS image, user_id AS pid, event_id AS ident, n AS filter, upper(printf('%x', event_id % 4096)) AS context
FROM events JOIN (VALUES {_FILTERS}) names(k, n) ON k = -(event_id % 14)""")
def forensic_mac_kevents(t):
    rows = t.events.select(_image("event_id"), _c("user_id", "pid"), _c("event_id", "ident"), _c("CAST(-(event_id % 14) AS int)", "filter"), _c("CAST(event_id % 4096 AS int)", "flags"))
    return _session(t, mac_kevents=rows).run("mac.kevents.Kevents").drop("process")


@query("""
WITH h AS (SELECT 'i' || event_id % 3 AS image, user_id, event_type, ts FROM events)
SELECT 'linux.bash.Bash' AS plugin, user_id || ' (bash): "' || event_type || '"' AS description, min(ts) AS created_date FROM h GROUP BY 1, 2
UNION ALL SELECT 'windows.pslist.PsList', 'Process: ' || o_orderkey || ' ' || o_orderpriority || ' (' || o_orderkey || ')', o_orderdate FROM orders""")
def forensic_timeliner(t):
    history = t.events.select(_image("event_id"), _c("user_id", "pid"), _l("bash").alias("process"), _c("event_id", "ord"), _c("CAST(ts AS timestamp)", "command_time"), _c("event_type", "command"))
    s = _session(t, win_processes=_orders_as_processes(t), lin_history=history)
    return s.run("timeliner.Timeliner", plugins=["linux.bash.Bash", "windows.pslist.PsList"]).select("plugin", "description", F.col("created_date").cast("timestamp_ntz").alias("created_date"))


def _texts_as_chunks(t) -> DataFrame:
    return t.documents.select(F.col("doc_id").cast("string").alias("image"), _l("primary").alias("layer"), _l(0).cast("long").alias("start"), F.col("text").cast("binary").alias("bytes"))


@query("""
SELECT CAST(doc_id AS VARCHAR) AS image, CAST(count(*) AS BIGINT) AS n_hits, CAST(sum(length(w)) AS BIGINT) AS n_bytes FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+ion')) AS w FROM documents) GROUP BY 1""")
def forensic_regexscan(t):
    hits = _session(t, chunks=_texts_as_chunks(t)).run("regexscan.RegExScan", pattern=rb"[a-z]+ion", maxsize=4096)
    return hits.groupBy("image").agg(F.count(F.lit(1)).alias("n_hits"), F.sum(F.length("hex")).cast("long").alias("n_bytes"))


_HITS = ", ".join(f"CAST((strlen(text) - strlen(replace(text, '{s}', ''))) // {len(s)} AS BIGINT) AS {n}" for n, s in (("a", "and "), ("b", "###"), ("c", " der ")))


@query(f"""
WITH h AS (SELECT CAST(doc_id AS VARCHAR) AS image, {_HITS} FROM documents), k AS (SELECT * FROM h WHERE (a > 0 OR b > 0) AND c = 0)
SELECT image, 'odd' AS rule, '$a' AS component, a AS n_hits FROM k WHERE a > 0 UNION ALL SELECT image, 'odd', '$b', b FROM k WHERE b > 0""")
def forensic_yarascan(t):
    rule = 'rule odd { strings: $a = "and " $b = "###" $c = " der " condition: ($a or $b) and not $c }'
    hits = _session(t, chunks=_texts_as_chunks(t)).run("yarascan.YaraScan", rules=rule)
    return hits.groupBy("image", "rule", "component").agg(F.count(F.lit(1)).alias("n_hits"))


@query("""
WITH s AS (SELECT 'i' || p_partkey % 3 AS image, p_name AS string, p_partkey * 1500 AS physical, p_partkey * 1500 // 4096 AS page FROM part),
o AS (SELECT 'i' || c_custkey % 3 AS image, c_custkey % 900 AS page, c_mktsegment AS owner, c_custkey * 4096 AS virt FROM customer)
SELECT s.image, string, physical, coalesce(string_agg(DISTINCT owner || ':' || printf('%x', virt + physical % 4096), ', ' ORDER BY owner || ':' || printf('%x', virt + physical % 4096)), '') AS result
FROM s LEFT JOIN o USING (image, page) GROUP BY ALL""")
def forensic_strings(t):
    lines = t.part.select(_image("p_partkey"), F.concat_ws(" ", (F.col("p_partkey") * 1500).cast("string"), "p_name").alias("line"))
    owners = t.customer.select(_image("c_custkey"), _c("c_custkey % 900", "page"), _c("c_mktsegment", "owner"), _c("c_custkey * 4096", "virt"))
    return _session(t, strings_lines=lines, phys_owner=owners).run("windows.strings.Strings")
