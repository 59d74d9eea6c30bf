"""The forensic operators over object tables: all run on an empty session, and checks with rows for their rules."""

from datetime import datetime

import pytest

from coredust.plans import generic, linux, mac, windows  # noqa: F401
from coredust.plans.session import ALIASES, OPERATORS, SCHEMAS, Session


@pytest.fixture(scope="module")
def empty(spark):
    return Session(spark, {})


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_runs_on_nothing(empty, name):
    out = OPERATORS[name](empty)
    assert out.columns
    assert name == "frameworkinfo.FrameworkInfo" or out.count() == 0


def test_aliases_point_to_operators():
    assert set(ALIASES.values()) <= set(OPERATORS)


def table(spark, kind, rows):
    schema = spark.createDataFrame([], SCHEMAS[kind]).schema
    return spark.createDataFrame([tuple(({"image": "i"} | r).get(f.name) for f in schema) for r in rows], schema)


def session(spark, **tables):
    return Session(spark, {k: table(spark, k, v) for k, v in tables.items()})


PROCS = [
    {"source": "pslist", "ord": 0, "offset": 10, "pid": 4, "ppid": 0, "name": "System"}, {"source": "pslist", "ord": 1, "offset": 20, "pid": 8, "ppid": 4, "name": "smss.exe", "cmd": "smss"},
    {"source": "pslist", "ord": 2, "offset": 20, "pid": 8, "ppid": 4, "name": "again"}, {"source": "pslist", "ord": 3, "offset": 30, "pid": 9, "ppid": 8, "name": "csrss.exe", "exit_time": datetime(2020, 1, 2)},
    {"source": "psscan", "ord": 0, "offset": 20, "pid": 8, "ppid": 4, "name": "smss.exe"}, {"source": "psscan", "ord": 1, "offset": 99, "pid": 66, "ppid": 8, "name": "hidden.exe"}, {"source": "csrss", "ord": 0, "offset": 30, "pid": 9, "name": "csrss.exe"},
]


def test_windows_processes(spark):
    s = session(spark, win_processes=PROCS)
    assert [(r.pid, r.image_file_name) for r in s.run("windows.pslist.PsList").orderBy("ord").collect()] == [(4, "System"), (8, "smss.exe"), (9, "csrss.exe")]
    assert [r.pid for r in s.run("windows.pslist.PsList", pid=[9]).collect()] == [9]
    assert [(r.pid, r.depth) for r in s.run("windows.pstree.PsTree").orderBy("tree_path").collect()] == [(4, 0), (8, 1), (9, 2)]
    assert sorted(r.pid for r in s.run("windows.pstree.PsTree", pid=8).collect()) == [4, 8]
    x = {r.offset: (r.pslist, r.psscan, r.thrdscan, r.csrss) for r in s.run("windows.psxview.PsXView").collect()}
    assert x == {10: (True, False, False, False), 20: (True, True, False, False), 30: (True, False, False, True), 99: (False, True, False, False)}
    assert {r.pid: r.absent for r in s.run("windows.cmdline.CmdLine").collect()} == {4: "unreadable", 8: None, 9: "unreadable"}
    t = {r.description: (r.modified_date, r.created_date) for r in s.run("timeliner.Timeliner").collect()}
    assert t == {"Process: 9 csrss.exe (30)": (datetime(2020, 1, 2), None)}


MODULES = [{"source": "list", "ord": 0, "offset": 1, "base": -4096 * 100, "size": 4096 * 50, "name": "ntoskrnl.exe"}, {"source": "list", "ord": 1, "offset": 2, "base": -4096 * 40, "size": 4096, "name": "disk.sys"}]


def test_windows_addresses(spark):
    k = MODULES[0]["base"]
    s = session(
        spark, win_modules=MODULES, symbols=[{"address": k + 16, "name": "NtClose"}, {"address": k + 16, "name": "AClose"}],
        win_ssdt=[{"table": 0, "entries": [k + 16, MODULES[1]["base"], -5]}],
        win_drivers=[{"offset": 7, "start": -4096, "size": 1, "driver_name": r"\Driver\evil", "irps": [k + 16, -8, 3]}, {"offset": 8, "start": MODULES[1]["base"], "driver_name": "x", "irps": []}, {"offset": 9, "start": 0, "driver_name": r"\Driver\RAW", "irps": []}],
        win_unloaded=[{"ord": 0, "name": "gone.sys", "start": k + 4096, "end": k + 8192, "time": datetime(2021, 1, 1)}, {"ord": 1, "name": "odd.sys", "start": k + 1, "end": k + 8192, "time": datetime(2021, 1, 1)}],
    )
    assert [(r["index"], r.module, r.symbol) for r in s.run("windows.ssdt.SSDT").orderBy("index").collect()] == [(0, "ntoskrnl.exe", "AClose"), (1, "disk.sys", None), (2, None, None)]
    assert {(r.offset, r.known_exception) for r in s.run("windows.drivermodule.DriverModule").collect()} == {(7, False), (9, True)}
    assert [(r.irp, r.module) for r in s.run("windows.driverirp.DriverIrp").orderBy("address").collect()] == [("IRP_MJ_CREATE", "ntoskrnl.exe"), ("IRP_MJ_CREATE_NAMED_PIPE", None)]
    assert [r.name for r in s.run("windows.unloadedmodules.UnloadedModules").collect()] == ["gone.sys"]


def test_windows_regions(spark):
    vads = [
        {"pid": 1, "process": "a", "start": 0, "end": 4095, "tag": "VadS", "protection": "PAGE_EXECUTE_READWRITE", "private_memory": 1, "head": b"MZ\x90"}, {"pid": 1, "process": "a", "start": 8192, "end": 12287, "tag": "Vad ", "protection": "PAGE_EXECUTE_WRITECOPY", "private_memory": 0, "head": b"MZ", "file": r"\a.dll"},
        {"pid": 2, "process": "b", "start": 0, "end": 1 << 40, "tag": "VadS", "protection": "PAGE_READWRITE", "private_memory": 1},
    ]
    s = session(
        spark, win_vads=vads, win_ldr=[{"pid": 1, "base": 8192, "in_load": True, "in_init": False, "in_mem": True, "name": "a.dll"}],
        win_threads=[{"source": "list", "pid": 1, "tid": 5, "start": 8200, "win32_start": 100}, {"source": "list", "pid": 1, "tid": 6, "start": 20000, "win32_start": 0, "suspend_count": 1, "state": 5}, {"source": "list", "pid": 2, "tid": 7, "start": 1 << 39, "win32_start": 0, "dr": [8200, 0, 0, 0], "dr7": 1}],
        win_pages=[{"pid": 1, "virt": v, "phys": p, "size": 4096, "class": "valid", "large": False} for v, p in ((0, 0), (4096, 4096), (8192, 50000), (20480, 54096))],
    )
    assert [(r.pid, r.notes) for r in s.run("windows.malfind.Malfind").collect()] == [(1, "MZ header")]
    assert {(r.base, r.in_load, r.in_init, r.in_mem) for r in s.run("windows.ldrmodules.LdrModules").collect()} == {(0, False, False, False), (8192, True, False, True)}
    notes = {(r.tid, r.context, r.note) for r in s.run("windows.suspicious_threads.SuspiciousThreads").collect()}
    assert notes == {(5, "win32_start", "The region is not backed by a file"), (5, "win32_start", "Unusual protection"), (6, "start", "No region holds the address"), (7, "start", "The region is not backed by a file"), (7, "start", "Unusual protection")}
    assert {(r.tid, r.start_path) for r in s.run("windows.threads.Threads").collect()} == {(5, r"\a.dll"), (6, None), (7, None)}
    assert [r.tid for r in s.run("windows.suspended_threads.SuspendedThreads").collect()] == [6]
    assert [(r.virtual, r.physical, r.size, r.file_offset) for r in s.run("windows.memmap.Memmap").orderBy("virtual").collect()] == [(0, 0, 8192, 0), (8192, 50000, 4096, 8192), (20480, 54096, 4096, 12288)]
    assert s.run("windows.vadinfo.VadInfo", address=9000, pid=1).count() == 1


def test_windows_services_tokens_network(spark):
    s = session(
        spark, win_services=[{"source": "scan", "offset": 1, "name": "a"}, {"source": "scan", "offset": 1, "name": "a"}, {"source": "scan", "offset": 2, "name": "rogue"}, {"source": "list", "offset": 1, "name": "a"}],
        win_service_keys=[{"name": "TrustedInstaller", "image_path": "x"}], win_privileges=[{"pid": 1, "value": 20, "attributes": 3}, {"pid": 1, "value": 99, "attributes": 1}],
        win_sockets=[{"source": "scan", "offset": 1, "proto": "TCP", "family": 23, "local_port": 80, "pid": 4, "dual_stack": True}, {"source": "scan", "offset": 2, "proto": "UDP", "family": 2, "local_port": 70000, "pid": 4, "dual_stack": False}],
        win_stubs=[{"pid": p, "function": "NtOpen", "bytes": b"A" * 40 if p < 5 else b"J" * 40} for p in range(1, 7)],
    )
    assert [r.name for r in s.run("windows.svcdiff.SvcDiff").collect()] == ["rogue"]
    assert [r.sid for r in s.run("windows.getservicesids.GetServiceSIDs").collect()] == ["S-1-5-80-956008885-3418522649-1831038044-1853292631-2271478464"]
    assert [(r.privilege, r.attributes) for r in s.run("windows.privileges.Privs").collect()] == [("SeDebugPrivilege", "Present,Enabled")]
    assert {(r.proto, r.local_addr) for r in s.run("windows.netscan.NetScan").collect()} == {("TCPv4", "0.0.0.0"), ("TCPv6", "::")}
    assert [(r.distinct_implementations, r.total_implementations) for r in s.run("windows.unhooked_system_calls.unhooked_system_calls").collect()] == [("5, 6", 6)]


def test_registry(spark):
    keys = [{"hive_offset": 1, "cell": c, "parent": p, "name": n} | v for c, p, n, v in (
        (1, None, "ROOT", {}), (2, 1, "UserAssist", {}), (3, 2, "{G}", {}), (4, 3, "Count", {"value_names": ["HRZR_EHAPCY"], "value_types": ["REG_BINARY"], "value_data": ["01000000" + "05000000" + "02000000" + "E8030000" + "00" * 44 + "0080D5DE" + "B19D01" + "01" + "00" * 4]}), (9, 8, "loop", {}), (8, 9, "loop", {}),
    )]
    s = session(spark, win_keys=keys)
    assert sorted(r.key for r in s.run("windows.registry.printkey.PrintKey").filter("type = 'Key'").collect()) == ["ROOT", r"ROOT\UserAssist", r"ROOT\UserAssist\{G}", r"ROOT\UserAssist\{G}\Count"]
    assert [r.key for r in s.run("windows.registry.printkey.PrintKey", key="{G}", recurse=True).filter("type <> 'Key'").collect()] == [r"ROOT\UserAssist\{G}\Count"]
    u = s.run("windows.registry.userassist.UserAssist").collect()[0]
    assert (u.name, u.run_count, u.focus_count, u.focus_ms) == ("UEME_RUNCPL", 5, 2, 1000)


def test_linux(spark):
    k = -(1 << 30)
    tasks = [{"source": "list", "ord": i, "offset": i, "pid": p, "tid": t, "ppid": pp, "comm": c, "is_kernel": kern, "cred": cr, "args": a, "env": e, "exe": x, "cap_effective": cap, "cap_last": 40} for i, (p, t, pp, c, kern, cr, a, e, x, cap) in enumerate([
        (0, 0, 0, "swapper", True, 1, None, None, None, 0), (1, 1, 0, "init", False, 2, b"/sbin/init\0-x\0", b"A=1\0B=x=y\0junk\0C=3\0", "/sbin/init", (1 << 41) - 1), (5, 5, 1, "bash", False, 2, b"-bash\0", b"", "/tmp/evil (deleted)", 1), (5, 6, 1, "worker", False, 3, None, None, None, 0),
    ])]
    s = session(
        spark, lin_tasks=tasks, symbols=[{"address": k + 64, "name": "sys_read"}], lin_modules=[{"source": "kernel", "ord": 0, "offset": 0, "base": k, "size": 1 << 20, "name": "kernel"}, {"source": "list", "ord": 1, "offset": 5, "base": k + (1 << 24), "size": 4096, "name": "ok", "params": {"a": "1"}}, {"source": "scan", "ord": 0, "offset": 9, "base": 0, "name": "rootkit"}, {"source": "sysfs", "ord": 0, "offset": 5, "name": "ok"}, {"source": "sysfs", "ord": 1, "offset": 8, "name": "sys_only"}],
        lin_handlers=[{"kind": "syscall", "name": "64bit", "idx": 0, "address": k + 64}, {"kind": "syscall", "name": "64bit", "idx": 1, "address": k + 65}, {"kind": "afinfo", "name": "tcp", "member": "show", "address": k + 64}, {"kind": "afinfo", "name": "udp", "member": "show", "address": k + 70}, {"kind": "netfilter", "proto": "IPV4", "hook": "IN", "address": 77}],
        lin_vmas=[{"pid": 1, "is_user": True, "start": 0, "end": 10, "flags": "rwxp", "head": b"\x7fELF12345secret-77"}, {"pid": 1, "is_user": True, "start": 4096, "end": 8192, "flags": "r--p", "path": "/x", "head": b"nothing"}],
    )
    assert [(r.pid, r.comm) for r in s.run("linux.pslist.PsList", threads=True, decorate_comm=True).orderBy("ord").collect()] == [(0, "[swapper]"), (1, "init"), (5, "bash"), (5, "{worker}")]
    assert [(r.tid, r.depth) for r in s.run("linux.pstree.PsTree", threads=True).orderBy("tree_path").collect()] == [(0, 0), (1, 1), (5, 2), (6, 3)]
    assert {(r.key, r.value) for r in s.run("linux.envars.Envars").collect()} == {("A", "1"), ("B", "x=y")}
    assert {r.pid: r.args for r in s.run("linux.psaux.PsAux").collect()} == {0: "[swapper]", 1: "/sbin/init -x", 5: "-bash"}
    assert [(r.cred, r.pids) for r in s.run("linux.check_creds.Check_creds").collect()] == [(2, "1, 5")]
    assert {r.tid: r.cap_effective for r in s.run("linux.capabilities.Capabilities").collect()} == {0: "", 1: "all", 5: "cap_chown", 6: ""}
    spoof = {r.pid: (r.cmdline_spoofed, r.comm_spoofed, r.exe_deleted) for r in s.run("linux.malware.process_spoofing.ProcessSpoofing").collect()}
    assert spoof == {1: (False, False, False), 5: (True, True, True)}
    assert [r.module_name for r in s.run("linux.hidden_modules.Hidden_modules").collect()] == ["rootkit"]
    assert [r.module_name for r in s.run("linux.check_modules.Check_modules").collect()] == ["sys_only"]
    assert {(r.offset, r.in_procfs, r.in_sysfs, r.in_scan) for r in s.run("linux.modxview.Modxview").collect()} == {(5, True, True, False), (8, False, True, False), (9, False, False, True)}
    assert {(r["index"], r.symbol) for r in s.run("linux.check_syscall.Check_syscall").collect()} == {(0, "sys_read"), (1, "UNKNOWN")}
    assert [r.symbol_name for r in s.run("linux.check_afinfo.Check_afinfo").collect()] == ["udp"]
    assert [r.is_hooked for r in s.run("linux.netfilter.Netfilter").collect()] == [True]
    assert [r.start for r in s.run("linux.malfind.Malfind").collect()] == [0] == [r.start for r in s.run("linux.elfs.Elfs").collect()]
    assert [(r.offset, r.text) for r in s.run("linux.vmaregexscan.VmaRegExScan", pattern=rb"secret-\d+").collect()] == [(9, "secret-77")]
    rule = 'rule a { strings: $a = "SECRET" nocase $b = { 7f 45 ?? 46 } condition: all of them and #a == 1 }'
    assert {(r.component, r.offset, bytes(r.value)) for r in s.run("linux.vmayarascan.VmaYaraScan", rules=rule).collect()} == {("$a", 9, b"secret"), ("$b", 0, b"\x7fELF")}


def test_linux_symbols_files_notes(spark):
    s = session(
        spark, lin_kallsyms=[{"source": "core", "address": 100, "name": "a", "size": 10, "type": "T"}, {"source": "core", "address": 200, "name": "b", "size": 50, "type": "t"}], lin_tasks=[{"source": "list", "ord": 0, "offset": 1, "pid": 1, "tid": 1, "stack": [105, 0, 150, 249], "stack_base": 1000}],
        lin_inodes=[{"inode": 1, "path": "/a", "file_type": "REG", "size": 5000, "device": "tmpfs"}], lin_inode_pages=[{"inode": 1, "idx": 1, "dump_safe": True, "bytes": b"B" * 4096}],
        lin_notes=[{"offset": 1, "note": "OSRELEASE=6.8\nSYMBOL(init)=ffff\nKERNELOFFSET=1a\nbad"}], lin_mounts=[{"mnt_ns": 1, "pid": p, "ord": p, "mount_id": 7} for p in (1, 2)],
    )
    assert [(r.position, r.address, r.name) for r in s.run("linux.pscallstack.PsCallStack").orderBy("position").collect()] == [(0, 1000, "a"), (3, 1024, "b")]
    assert bytes(s.run("linux.pagecache.RecoverFs").collect()[0].content) == b"\0" * 4096 + b"B" * 904
    assert {r.key: r.value for r in s.run("linux.vmcoreinfo.VMCoreInfo").collect()} == {"OSRELEASE": "6.8", "SYMBOL(init)": "0xffff", "KERNELOFFSET": "0x1a"}
    assert s.run("linux.mountinfo.MountInfo").count() == 1 and s.run("linux.mountinfo.MountInfo", pids=[2]).count() == 1


def test_mac(spark):
    s = session(
        spark, mac_vnodes=[{"address": 1, "name": ""}, {"address": 2, "parent": 1, "name": "etc"}, {"address": 3, "parent": 2, "name": "hosts"}, {"address": 8, "parent": 9, "name": "x"}, {"address": 9, "parent": 8, "name": "y"}],
        mac_buffers=[{"msg_bufx": 6, "buffer": "d\nlastfirst\nsecon"}], mac_sockets=[{"family": 1, "path": "/s", "process": "p", "pid": 3}, {"family": 2, "proto": "TCP", "local_ip": "1.1.1.1", "process": "q", "pid": 4}, {"family": 99, "process": "r", "pid": 5}],
        mac_interfaces=[{"interface": "en0", "flags": 0x100, "addresses": ["::1", "10.0.0.1"]}], mac_handlers=[{"kind": "kauth_scope", "name": "s", "owner": 1, "address": 5}, {"kind": "kauth_listener", "owner": 1, "address": 6}, {"kind": "kauth_listener", "owner": 1, "address": 0}],
        mac_kevents=[{"pid": 1, "filter": -1, "flags": 1, "ident": 2}, {"pid": 1, "filter": 55}], mac_maps=[{"pid": 1, "start": 0, "end": 1, "protection": "rwx"}, {"pid": 1, "start": 1, "end": 2, "protection": "r--"}],
    )
    assert {r.address: r.file_path for r in s.run("mac.list_files.List_Files").collect()} == {1: "/", 2: "/etc", 3: "/etc/hosts"}
    assert [r.line for r in s.run("mac.dmesg.Dmesg").orderBy("ord").collect()] == ["first", "second", "last"]
    assert {(r.proto, r.local_ip, r.process) for r in s.run("mac.netstat.Netstat").collect()} == {("UNIX", "/s", "p/3"), ("TCP", "1.1.1.1", "q/4")}
    assert s.run("mac.ifconfig.Ifconfig").filter("promiscuous").count() == 2
    assert [r.listeners for r in s.run("mac.kauth_scopes.Kauth_scopes").collect()] == [1]
    assert [r.filter for r in s.run("mac.kevents.Kevents").collect()] == ["EVFILT_READ"] and s.run("mac.malfind.Malfind").count() == 1


def test_generic_scans(spark):
    import struct

    data = bytearray(b"\0" * 8192)
    data[100:140] = b"Linux version 6.8.0-test (gcc) \n\0".ljust(40, b"\0")
    data[512:524] = struct.pack("<I", 7) + b"pass wd\0"
    data[1024:1030] = b"\xfa\x33\xc0\x8e\xd0\xbc"
    data[1024 + 446 : 1024 + 462] = struct.pack("<BBBBBBBBII", 0x80, 0, 0, 0, 7, 0, 0, 0, 2048, 999)
    data[1024 + 510 : 1024 + 512] = b"\x55\xaa"
    s = session(spark, chunks=[{"layer": "primary", "start": 0, "bytes": bytes(data)}], strings_lines=[{"line": "4100 hello"}, {"line": "9 bye"}], phys_owner=[{"page": 1, "owner": "p1", "virt": 0x5000}, {"page": 1, "owner": "p0", "virt": 0x6000}])
    assert [(r.offset, r.banner.strip()) for r in s.run("banners.Banners").collect()] == [(100, "Linux version 6.8.0-test (gcc)")]
    assert [(r.offset, r.length, r.password) for r in s.run("windows.truecrypt.Passphrase").collect()] == [(512, 7, "pass wd")]
    m = s.run("windows.mbrscan.MBRScan").orderBy("partition").collect()
    assert [(r.offset, r.partition, r.bootable, r.starting_lba) for r in m][:2] == [(1024, 0, None, None), (1024, 1, True, 2048)] and len(m) == 5
    assert {r.string: r.result for r in s.run("windows.strings.Strings").collect()} == {"hello": "p0:6004, p1:5004", "bye": ""}
    assert s.run("frameworkinfo.FrameworkInfo").count() == len(OPERATORS) + len(ALIASES)
    hits = s.run("yarascan.YaraScan", rules='rule r { strings: $v = "version" $n = "absent" condition: any of them and not $n }').collect()
    assert [(r.offset, r.component) for r in hits] == [(106, "$v")]


def test_system_call_stubs(spark):
    direct = b"\x90\x4c\x8b\xd1\xb8\x18\x00\x00\x00\x0f\x05\xc3" + b"\x90" * 40
    indirect = b"\x4c\x8b\xd1\xb8\x18\x00\x00\x00\x41\xff\xe3" + b"\x90" * 40
    area = lambda pid, head, file=None: {"pid": pid, "process": "p", "start": 4096 * pid, "end": 4096 * pid + 4095, "protection": "PAGE_EXECUTE_READ", "head": head, "file": file}
    s = session(spark, win_vads=[area(1, direct), area(2, indirect), area(3, direct, r"\Windows\System32\ntdll.dll")])
    assert [(r.pid, r.address) for r in s.run("windows.direct_system_calls.DirectSystemCalls").collect()] == [(1, 4097)]
    assert [(r.pid, r.address) for r in s.run("windows.indirect_system_calls.IndirectSystemCalls").collect()] == [(2, 8192)]


def test_peb_masquerade(spark):
    p = lambda pid, audit, peb, most, now: {"source": "pslist", "ord": pid, "offset": pid, "pid": pid, "name": "x", "audit": audit, "peb_path": peb, "peb_cmd_max": most, "peb_cmd_len": now}
    s = session(spark, win_processes=[p(1, r"\Device\x\a.exe", r"C:\A.EXE", 5, 4), p(2, r"\Device\x\a.exe", r"C:\svchost.exe", 5, 9)])
    assert {r.pid: (r.path_spoofed, r.cmdline_spoofed) for r in s.run("windows.malware.pebmasquerade.PebMasquerade").collect()} == {1: (False, False), 2: (True, True)}


def test_scheduled_tasks(spark):
    s = session(spark, win_tasks=[{"task_name": "t", "triggers": [("Logon", "any user")], "actions": [("Exec", "a.exe", "-x", None, None), ("Exec", "b.exe", None, None, None)]}, {"task_name": "bare"}])
    assert sorted((r.task_name, r.trigger_type, r.action) for r in s.run("windows.registry.scheduled_tasks.ScheduledTasks").collect() if r.action) == [("t", "Logon", "a.exe"), ("t", "Logon", "b.exe")]


def test_owners_of_long_and_short_passages(spark):
    from coredust.operators import scan

    texts = [(1, "xx alpha beta gamma delta epsilon yy"), (2, "zalpha beta gamma delta epsilonz"), (3, "alpha  beta gamma delta epsilon"), (4, "a needle here"), (5, ""), (6, None)]
    parts = [(10, "alpha beta gamma delta epsilon"), (11, "needle"), (12, "dle h"), (13, ""), (14, "quite absent here now then"), (15, "ta")]
    d, p = spark.createDataFrame(texts, "doc long, text string"), spark.createDataFrame(parts, "item long, passage string")
    got = sorted((r.item, r.doc) for r in scan.owners(p, "passage", d, "text", "doc").collect())
    assert got == sorted((i, k) for i, x in parts if x for k, t in texts if t and x in t)


def test_trees_of_several_images(spark):
    """Equal ids in two images are two trees, for every operator that builds one."""
    two = lambda rows: [r | {"image": i} for i in "ij" for r in rows]
    s = session(
        spark, win_processes=two([{"source": "pslist", "ord": i, "offset": i, "pid": p, "ppid": pp, "name": "x"} for i, (p, pp) in enumerate(((4, 0), (8, 4)))]),
        lin_tasks=two([{"source": "list", "ord": i, "offset": i, "pid": p, "tid": p, "ppid": pp, "comm": "x"} for i, (p, pp) in enumerate(((1, 0), (5, 1)))]),
        lin_resources=two([{"node": -(1 << 46) + n, "parent": p, "name": "r", "start": 0, "end": 1} for n, p in ((0, None), (1, -(1 << 46)))]),
        mac_tasks=two([{"source": "tasks", "ord": i, "offset": i, "pid": p, "ppid": pp, "name": "x"} for i, (p, pp) in enumerate(((0, 0), (3, 0)))]),
        mac_vnodes=two([{"address": -(1 << 40), "name": ""}, {"address": -(1 << 40) + 1, "parent": -(1 << 40), "name": "etc"}]),
        mac_sysctls=two([{"node": 10**15 + n, "parent": p, "name": "s", "handler": 1} for n, p in ((1, None), (2, 10**15 + 1))]),
        win_keys=two([{"hive_offset": 1, "cell": c, "parent": p, "name": n} for c, p, n in ((1, None, "ROOT"), (2, 1, "SAM"))]),
    )
    for name in ("windows.pstree.PsTree", "linux.pstree.PsTree", "linux.iomem.IOMem", "mac.pstree.PsTree", "mac.check_sysctl.Check_sysctl"):
        rows = s.run(name).collect()
        assert sorted((r.image, r.depth) for r in rows) == [("i", 0), ("i", 1), ("j", 0), ("j", 1)], name
    assert sorted((r.image, r.file_path) for r in s.run("mac.list_files.List_Files").collect()) == [("i", "/"), ("i", "/etc"), ("j", "/"), ("j", "/etc")]
    assert sorted((r.image, r.key) for r in s.run("windows.registry.printkey.PrintKey").collect()) == [("i", "ROOT"), ("i", r"ROOT\SAM"), ("j", "ROOT"), ("j", r"ROOT\SAM")]
    assert sorted((r.image, r.pid) for r in s.run("windows.pstree.PsTree", pid=8).collect()) == [("i", 4), ("i", 8), ("j", 4), ("j", 8)]


def test_deep_and_wide_trees_and_cycles(spark):
    from coredust.operators import relational

    far = 10**15
    rows = [(far + i, far + i - 1 if i else None) for i in range(200)] + [(-5, -5), (-4, -5), (1, 2), (2, 1), (3, 1), (7, 99), (-4, None)]
    got = {r.id: (r.depth, r.path, r.names) for r in relational.tree_paths(spark.createDataFrame(rows, "id long, up long").selectExpr("*", "CAST(id AS STRING) AS name"), "id", "up", label="name", sep=">").collect()}
    assert set(got) == {far + i for i in range(200)} | {-5, -4, 7}
    assert all(got[far + i][0] == i and got[far + i][1].count("/") == i for i in range(200)) and got[far + 2][2] == f"{far}>{far + 1}>{far + 2}"
    assert got[-4] == (0, "F" * 15 + "C", "-4")  # of the rows that repeat an id the one with the least parent counts


def test_ranges_of_any_length(spark):
    import random

    from coredust.operators import relational

    rng = random.Random(4)
    big = (1 << 63) - 1
    ranges = [(i, lo, lo + rng.choice([0, 1, 100, 5000, 1 << 30, 1 << 50])) for i in range(60) for lo in [rng.randrange(-(1 << 47), 1 << 47)]] + [(100, -(1 << 47), big), (101, 5, 4), (102, -10, 10)]
    points = [(rng.choice(ranges)[1] + rng.randrange(-3, 6000),) for _ in range(300)] + [(0,), (None,), (big,), (-(1 << 63),)]
    p, r = spark.createDataFrame(points, "at long"), spark.createDataFrame(ranges, "id long, lo long, hi long")
    keep = lambda a, hi_too: sorted(i for i, lo, hi in ranges if a is not None and lo <= a and (a <= hi if hi_too else a < hi))
    both = relational.lookup_all(p, "at", r, "lo", "hi", 4096)
    assert sorted((x.at, x.id) for x in both.collect()) == sorted((a, i) for (a,) in points for i in keep(a, True))
    first = relational.lookup_first(p.distinct(), "at", r, "lo", "hi", "id", "id", 4096)
    assert {x.at: x.id for x in first.collect()} == {a: min(keep(a, False), default=None) for (a,) in points}
    assert {x.at for x in relational.outside_ranges(p, "at", r, "lo", "hi", 4096).collect()} == {a for (a,) in points if not keep(a, False)}


def test_a_forged_module_size(spark):
    k = -(1 << 46)
    s = session(spark, win_modules=[{"source": "list", "ord": 0, "offset": 1, "base": k, "size": (1 << 63) - 1, "name": "forged.sys"}, {"source": "list", "ord": 1, "offset": 2, "base": k + 4096, "size": 4096, "name": "disk.sys"}], win_ssdt=[{"table": 0, "entries": [k + 5000, 7, k - 1]}])
    assert [(r["index"], r.module) for r in s.run("windows.ssdt.SSDT").orderBy("index").collect()] == [(0, "forged.sys"), (1, "forged.sys"), (2, None)]


PATTERNS = {"run": rb"[a-z]+", "pair": rb"[a-z][0-9]|z+", "lazy": rb"q.*?x", "none": rb"(?=zz)", "long": rb"a{7,}"}


@pytest.mark.parametrize("chunk", [3, 10, 17, 64, 100_000])
def test_regular_expressions_do_not_depend_on_chunks(spark, chunk):
    """Greedy, lazy, empty and long matches over texts with long runs, against one pass over each text."""
    import random
    import re

    from coredust.operators import scan

    rng, maxsize = random.Random(2), 23
    texts = {1: b"abcdefghijklmnopqrstuvwxyz", 2: b"", 3: b"a" * 150 + b"1" + b"z" * 70, 4: bytes(rng.choice(b"aaaqxz01 ") for _ in range(400)), 5: b"-" * 90, 6: b"aaaaaaa" * 30}
    d = spark.createDataFrame(list(texts.items()), "k long, data binary")
    got = scan.regex_scan(scan.chunked(d, "k", "data", chunk, maxsize), ["k"], PATTERNS, maxsize, chunk)
    want = set()
    for k, raw in texts.items():
        for n, p in PATTERNS.items():
            at = 0
            while at <= len(raw):
                hit = next(((i, m.end()) for i in range(at, len(raw)) if (m := re.compile(p, re.DOTALL).match(raw, i, min(len(raw), i + maxsize)))), None)
                if hit is None:
                    break
                want.add((k, n, hit[0], raw[hit[0] : hit[1]]))
                at = max(hit[1], hit[0] + 1)
    assert {(r.k, r.pattern, r.offset, bytes(r.hex)) for r in got.collect()} == want


def test_quantiles_with_infinities_and_nan(spark):
    from coredust.operators import timeline

    inf = float("inf")
    values = [-inf, -inf, -1.7e308, -1.0, 0.0, 5e-324, 1.0, 1.7e308, inf]
    d = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    assert [timeline.nth_value(d, "v", k, bins=4) for k in range(9)] == values and timeline.nth_value(d, "v", 9) is None
    assert timeline.nth_value(spark.createDataFrame([(inf,), (float("nan"),)], "v double"), "v", 0) == inf
    assert timeline.nth_value(d.filter("v < 0 AND v > -2"), "v", 0) == -1.0
    some = spark.createDataFrame([(float(i),) for i in range(1000)] + [(1e9,), (float("nan"),), (None,)], "v double")
    assert tuple(timeline.focus(some, "v").first()) == (5.0, 995.0, True)


def test_equal_places_and_ranges_are_paired_in_bundles(spark, monkeypatch):
    from coredust.operators import relational

    joined, held = [], relational._held
    monkeypatch.setattr(relational, "_held", lambda *a: joined.append(held(*a)) or joined[-1])
    monkeypatch.setattr(relational, "BUNDLE", 30)
    points = [(i, float(i % 2)) for i in range(80)] + [(99, None)]
    ranges = [(i, 0.0, 1.0 - i % 2) for i in range(70)]
    got = relational.lookup_all(spark.createDataFrame(points, "id long, at double"), "at", spark.createDataFrame(ranges, "r long, lo double, hi double"), "lo", "hi", 4)
    assert got.columns == ["id", "at", "r", "lo", "hi"]
    assert sorted((x.id, x.r) for x in got.collect()) == sorted((i, r) for i, at in points for r, lo, hi in ranges if at is not None and lo <= at <= hi)
    # Two bundles of 40 points each, two bundles of 35 ranges each: 0 lies in both kinds of ranges, 1 in one of them.
    assert joined[0].count() == 2 * 2 + 2 * 2 + 2 * 2


def _odd_places(rng):
    inf, nan = float("inf"), float("nan")
    ranges = [(i, rng.choice("ab"), lo, lo + rng.choice([0.0, 0.5, 3.0, 400.0])) for i in range(400) for lo in [rng.randrange(-500, 500) / 2]]
    ranges += [(-1, "a", 3.0, 3.0), (900, "a", -inf, -200.0), (901, "b", 200.0, inf), (902, "b", 240.0, nan), (903, "b", 4.0, 1.0), (904, "a", None, 9.0), (None, "a", -inf, inf)]
    points = [(rng.choice("abc"), rng.randrange(-1400, 1400) / 4) for _ in range(900)] + [("a", None), ("b", nan), ("b", inf), ("a", -inf)]
    return points, ranges


def _least(points, ranges, inclusive, by):
    key = lambda x: (x != x, 0.0 if x != x else x)
    ok = lambda a, lo, hi: None not in (a, lo, hi) and key(lo) <= key(a) and (key(a) < key(hi) or inclusive and key(a) == key(hi))
    return [(b, str(a), min((i for i, o, lo, hi in ranges if i is not None and (o == b or not by) and ok(a, lo, hi)), default=None)) for b, a in points]


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("by", [[], ["b"]])
def test_first_range_without_pairs(spark, monkeypatch, by, inclusive):
    import random

    from coredust.operators import relational

    monkeypatch.setattr(relational, "_held", None)  # the pairs of points and ranges are never made
    monkeypatch.setattr(relational, "PART_ROWS", 20)
    points, ranges = _odd_places(random.Random(7))
    p, r = spark.createDataFrame(points, "b string, at double"), spark.createDataFrame(ranges, "id long, b string, lo double, hi double")
    got = relational.lookup_first(p, "at", r if by else r.drop("b"), "lo", "hi", "id", "id", 4, by, inclusive)
    order = lambda xs: sorted(xs, key=str)
    assert order((x.b, str(x["at"]), x.id) for x in got.collect()) == order(_least(points, ranges, inclusive, by))


def test_outside_without_pairs(spark, monkeypatch):
    import random

    from coredust.operators import relational

    monkeypatch.setattr(relational, "_held", None)  # the pairs of points and ranges are never made
    monkeypatch.setattr(relational, "PART_ROWS", 20)
    points, ranges = _odd_places(random.Random(8))
    ranges = [(0, *x[1:]) for x in ranges if x[0] is not None and x[0] % 9 == 0 or x[0] in (902, 903, 904)]
    p, r = spark.createDataFrame(points, "b string, at double"), spark.createDataFrame(ranges, "id long, b string, lo double, hi double")
    got = relational.outside_ranges(p, "at", r, "lo", "hi", 4)
    want = [(b, a) for b, a, i in _least(points, ranges, False, False) if i is None]
    assert 50 < len(want) < 850
    assert sorted((x.b, str(x["at"])) for x in got.collect()) == sorted(want)


def test_pairs_leave_in_runs_and_repeats(spark, tmp_path):
    import random

    from coredust.operators import relational

    rng = random.Random(5)
    points = [(rng.randrange(1 << 60), 1000 + rng.random() * 600) for _ in range(1500)]
    ranges = [(rng.randrange(1 << 60), lo, lo + 400 + rng.random() * 500) for lo in (900 + rng.random() * 200 for _ in range(1200))]
    got = relational.lookup_all(spark.createDataFrame(points, "id long, at double"), "at", spark.createDataFrame(ranges, "r long, lo double, hi double"), "lo", "hi", 1000)
    got.write.parquet(out := str(tmp_path / "pairs"))
    rows = spark.read.parquet(out)
    assert sorted(map(tuple, rows.select("id", "r").collect())) == sorted((i, r) for i, at in points for r, lo, hi in ranges if lo <= at <= hi)
    # Places and ranges all differ: their values alone are kept, and less than a byte a pair.
    size = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert size < rows.count()


def test_crowded_buckets_are_dealt_out(spark, monkeypatch):
    from coredust.operators import relational

    monkeypatch.setattr(relational, "BLOCK", 4)
    monkeypatch.setattr(relational, "SEGMENT", 2)
    points = [(i, 100.0 + i % 37) for i in range(120)] + [(500, None), (501, 1e6)]
    ranges = [(i, 90.0 + i % 23, 90.0 + i % 23 + i % 41) for i in range(150)]
    got = relational.lookup_all(spark.createDataFrame(points, "id long, at double"), "at", spark.createDataFrame(ranges, "r long, lo double, hi double"), "lo", "hi", 64)
    assert sorted((x.id, x.r) for x in got.collect()) == sorted((i, r) for i, at in points for r, lo, hi in ranges if at is not None and lo <= at <= hi)
