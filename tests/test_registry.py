"""Registry hives from bytes to rows, ciphers against published vectors, and the dumps of stored secrets."""

import hashlib
import hmac
import json
import struct

import pytest

from coredust.functions import ciphers
from coredust.plans import extract, secrets
from coredust.plans.session import Session
from coredust.sources import hive

H = bytes.fromhex


@pytest.mark.parametrize(("key", "plain", "cipher"), [
    ("133457799BBCDFF1", "0123456789ABCDEF", "85E813540F0AB405"), ("7CA110454A1A6E57", "01A1D6D039776742", "690F5B0D9A26939B"), ("0131D9619DC1376E", "5CD54CA83DEF57DA", "7A389D10354BD271"),
    ("07A1133E4A0B2686", "0248D43806F67172", "868EBB51CAB4599A"), ("018310DC409B26D6", "1D9D5C5018F728C2", "5F4C038ED12B2E41"),
])
def test_des(key, plain, cipher):
    assert ciphers.des(H(key), H(plain), False) == H(cipher) and ciphers.des(H(key), H(cipher)) == H(plain)


def test_aes_and_rc4():
    plain = H("00112233445566778899aabbccddeeff")
    assert ciphers.aes_decrypt(bytes(range(16)), H("69c4e0d86a7b0430d8cdb78070b4c55a")) == plain
    assert ciphers.aes_decrypt(bytes(range(24)), H("dda97ca4864cdfe06eaf70a0ec0d7191")) == plain
    assert ciphers.aes_decrypt(bytes(range(32)), H("8ea2b7ca516745bfeafc49904b496089")) == plain
    key, iv = H("2b7e151628aed2a6abf7158809cf4f3c"), bytes(range(16))
    both = H("7649abac8119b246cee98e9b12e9197d5086cb9b507219ee95db113a917678b2")
    assert ciphers.aes_decrypt(key, both, iv) == H("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51")
    assert ciphers.rc4(b"Key", b"Plaintext") == H("bbf316e8d940af0ad3") and ciphers.rc4(b"Wiki", b"pedia") == H("1021bf0420")


class Hive:
    """Builds a hive file: cells behind a base block, with every kind of subkey list and value."""

    def __init__(self):
        self.bins = bytearray(32)

    def cell(self, content):
        at = len(self.bins)
        raw = struct.pack("<i", -(len(content) + 4)) + content
        self.bins += raw + b"\0" * (-len(raw) % 8)
        return at

    def value(self, name, kind, raw):
        if len(raw) <= 4:
            size, at = len(raw) | 1 << 31, struct.unpack("<I", raw.ljust(4, b"\0"))[0]
        elif len(raw) > hive.SEGMENT:
            parts = [self.cell(raw[i : i + hive.SEGMENT] + b"\0" * 4) for i in range(0, len(raw), hive.SEGMENT)]
            size, at = len(raw), self.cell(b"db" + struct.pack("<HI", len(parts), self.cell(struct.pack(f"<{len(parts)}I", *parts))))
        else:
            size, at = len(raw), self.cell(raw)
        return self.cell(b"vk" + struct.pack("<HIIIHH", len(name), size, at, kind, 1, 0) + name.encode("latin-1"))

    def key(self, name, children=(), values=(), class_=None, list_="lf", wide=False):
        """A key after its children, whose cells are given."""
        cells = list(children)
        if list_ == "ri":
            halves = [cells[:1], cells[1:]]
            lists = [self.cell(b"li" + struct.pack("<H", len(h)) + struct.pack(f"<{len(h)}I", *h)) for h in halves]
            subs = self.cell(b"ri" + struct.pack("<H", 2) + struct.pack("<2I", *lists))
        elif list_ == "li":
            subs = self.cell(b"li" + struct.pack("<H", len(cells)) + struct.pack(f"<{len(cells)}I", *cells))
        else:
            subs = self.cell(list_.encode() + struct.pack("<H", len(cells)) + b"".join(struct.pack("<II", c, 0) for c in cells))
        vals = [self.value(*v) for v in values]
        value_list = self.cell(struct.pack(f"<{len(vals)}I", *vals)) if vals else 0xFFFFFFFF
        class_raw = class_.encode("utf-16-le") if class_ else b""
        class_at = self.cell(class_raw) if class_ else 0xFFFFFFFF
        raw = name.encode("utf-16-le" if wide else "latin-1")
        head = b"nk" + struct.pack("<HQII", 0 if wide else 0x20, 132_000_000_000_000_000, 0, 0) + struct.pack("<IIIIII", len(cells), 0, subs, 0xFFFFFFFF, len(vals), value_list)
        return self.cell(head + struct.pack("<II", 0xFFFFFFFF, class_at) + b"\0" * 20 + struct.pack("<HH", len(raw), len(class_raw)) + raw)

    def file(self, root):
        return (b"regf" + b"\0" * 32 + struct.pack("<I", root)).ljust(4096, b"\0") + bytes(self.bins)


def sample():
    h = Hive()
    leaf = [h.key(n, list_="lh") for n in ("a", "b", "c")]
    u = lambda s: s.encode("utf-16-le") + b"\0\0"
    values = [("", 1, u("plain")), ("n", 4, struct.pack("<I", 77)), ("m", 7, u("x\0y")), ("big", 3, bytes(range(256)) * 200), ("q", 11, struct.pack("<Q", 1 << 40)), ("odd", 99, b"\x01"), ("none", 0, b"")]
    mid = h.key("Mid", leaf, values, "Class", "ri")
    wide = h.key("Ŵide", (), [], None, "lf", True)
    loop = h.key("Loop", [mid], list_="li")  # reached twice, told once
    return h, h.file(h.key("ROOT", [mid, wide, loop], list_="lf"))


def check(rows):
    by = {k["name"]: k for k in rows}
    assert set(by) == {"ROOT", "Mid", "Ŵide", "Loop", "a", "b", "c"} and by["Mid"]["class"] == "Class"
    v = {n: (t, hive.shown(t, raw)) for n, t, raw in by["Mid"]["values"]}
    assert v == {"": ("REG_SZ", "plain"), "n": ("REG_DWORD", "77"), "m": ("REG_MULTI_SZ", "x,y"), "big": ("REG_BINARY", (bytes(range(256)) * 200).hex().upper()), "q": ("REG_QWORD", str(1 << 40)), "odd": ("REG_99", "01"), "none": ("REG_NONE", "")}


def test_hive_file():
    h, data = sample()
    check(list(hive.keys(*hive.file_reader(data))))
    for cut in (5000, 4096 + 100, len(data) - 40):  # a truncated hive gives what can be read
        assert len(list(hive.keys(*hive.file_reader(data[:cut])))) <= 7
    assert list(hive.keys(lambda i, n: (_ for _ in ()).throw(LookupError()), 32)) == []


def test_hive_in_memory(tmp_path):
    from tests.test_windows_image import KERNEL, LAYOUT, Builder
    from coredust.sources.image import Memory
    from coredust.sources.layout import Layout, Space

    _, data = sample()
    b, layout = Builder(), json.loads(json.dumps(LAYOUT))
    add = {
        "_HBASE_BLOCK": (40, {"RootCell": (36, {"kind": "base", "name": "u4"})}), "_DUAL": (16, {"Map": (0, {"kind": "pointer"})}), "_HMAP_ENTRY": (8, {"BlockAddress": (0, {"kind": "pointer"})}),
        "_HHIVE": (64, {"GetCellRoutine": (0, {"kind": "pointer"}), "BaseBlock": (8, {"kind": "pointer"}), "Storage": (16, {"kind": "array", "count": 2, "subtype": {"kind": "struct", "name": "_DUAL"}})}),
        "_CMHIVE": (128, {"Hive": (0, {"kind": "struct", "name": "_HHIVE"}), "HiveList": (64, {"kind": "pointer"}), "FileFullPath": (80, {"kind": "struct", "name": "_UNICODE_STRING"})}),
    }
    layout["user_types"] |= {n: {"size": s, "fields": {f: {"offset": o, "type": t} for f, (o, t) in fs.items()}} for n, (s, fs) in add.items()}
    layout["symbols"]["CmpHiveListHead"] = {"address": KERNEL + 0x8400}
    top, block, directory, table = b.room(128), b.room(40), b.room(8192, 4096), b.room(4096, 4096)
    b.put(top, 0x1234, KERNEL + block, KERNEL + directory, 0)
    struct.pack_into("<I", b.m, block + 36, struct.unpack_from("<I", data, 36)[0])
    b.put(directory, KERNEL + table)
    bins = data[4096:]
    where = [b.room(4096, 4096) for _ in range(0, len(bins), 4096)]
    for i in range(len(where)):  # blocks of one bin follow each other, as cells may cross them
        b.m[where[i] : where[i] + 4096] = bins[4096 * i : 4096 * i + 4096].ljust(4096, b"\0")
        b.put(table + 8 * i, KERNEL + where[i])
    b.text(top + 80, r"\REGISTRY\MACHINE\TEST")
    b.ring(0x8400, [top + 64])
    (tmp_path / "h.bin").write_bytes(bytes(b.m))
    space = Space(Memory(str(tmp_path / "h.bin")), Layout(layout), 0x1000)
    check(list(hive.keys(*hive.memory_reader(space, KERNEL + top))))
    assert [(r["path"], r["get_cell_routine"]) for r in extract.windows_hives(space)] == [(r"\REGISTRY\MACHINE\TEST", 0x1234)]
    assert {r["hive_name"] for r in extract.windows_keys(space)} == {r"\REGISTRY\MACHINE\TEST"}


BOOT = bytes(range(0x40, 0x50))


def system_hive():
    """A SYSTEM hive whose boot key is BOOT."""
    scrambled = [0] * 16
    for to, i in enumerate(secrets.BOOT_ORDER):
        scrambled[i] = BOOT[to]
    text = bytes(scrambled).hex()
    h = Hive()
    lsa = h.key("Lsa", [h.key(n, class_=text[8 * i : 8 * i + 8]) for i, n in enumerate(("JD", "Skew1", "GBG", "Data"))])
    return h.file(h.key("ROOT", [h.key("ControlSet002", [h.key("Control", [lsa])]), h.key("Select", (), [("Current", 4, b"\2\0\0\0")])]))


def sam_hive(newer, rid=500, nt=bytes(range(16))):
    """One user with an NT hash and no LM hash."""
    f = bytearray(0xA8)
    f[0] = 3 if newer else 2
    f[0x70:0xA8] = bytes((7 * i) & 255 for i in range(0x38))
    key = secrets.account_key(secrets.Keys({r"sam\domains\account": (None, {"F": bytes(f)})}), BOOT)
    one, two = secrets._rid_keys(rid)
    hidden = ciphers.des(one, nt[:8], False) + ciphers.des(two, nt[8:], False)
    if newer:
        salt = bytes(range(100, 116))
        # CBC of one block run backwards: the block before it that makes the wanted plain text.
        stored = bytes(16)
        salt = bytes(a ^ b for a, b in zip(ciphers.aes_decrypt(key[:16], stored), hidden, strict=True))
        entry = struct.pack("<HHI", 1, 2, 0) + salt + stored + b"\0" * 16
    else:
        entry = struct.pack("<HH", 1, 1) + ciphers.rc4(hashlib.md5(key[:16] + struct.pack("<I", rid) + secrets.NT_TEXT).digest(), hidden)
    name = "Admin".encode("utf-16-le")
    v = bytearray(0xCC)
    struct.pack_into("<II", v, 0x0C, 0, len(name))
    struct.pack_into("<II", v, 0x9C, 64, 4)
    struct.pack_into("<II", v, 0xA8, 64, len(entry))
    v += name.ljust(64, b"\0") + entry
    h = Hive()
    users = h.key("Users", [h.key(f"{rid:08X}", (), [("V", 3, bytes(v))]), h.key("Names")])
    return h.file(h.key("ROOT", [h.key("SAM", [h.key("Domains", [h.key("Account", [users], [("F", 3, bytes(f))])])])]))


def old_secret(plain, key):
    """DES blocks under a rolling key, with the length in front; and the twelve bytes before them."""
    data, out, at = struct.pack("<II", len(plain), 1) + plain + b"\0" * (-len(plain) % 8), b"", 0
    for i in range(0, len(data), 8):
        out += ciphers.des(ciphers.spread_key(key[at : at + 7]), data[i : i + 8], False)
        at += 7
        if len(key) - at < 7:
            at = len(key) - at
    return b"\0" * 12 + out


def security_hive():
    """An older system: a key by RC4, two secrets by DES, a cached logon by RC4."""
    key, salt, machine, challenge = bytes(range(200, 216)), bytes(range(16)), bytes(range(64)), bytes(range(50, 66))
    md5 = hashlib.md5(BOOT + salt * 1000).digest()
    policy = b"\0" * 12 + ciphers.rc4(md5, b"\0" * 16 + key + b"\0" * 16) + salt
    names = [x.encode("utf-16-le") for x in ("bob", "CORP", "corp.local")]
    plain = bytes(range(16)) + b"\0" * 56 + b"".join(n + b"\0" * (len(n) % 4) for n in names)
    entry = struct.pack("<HH", len(names[0]), len(names[1])).ljust(60, b"\0") + struct.pack("<H", len(names[2])) + b"\0\0" + challenge + b"\0" * 16 + ciphers.rc4(hmac.new(machine, challenge, hashlib.md5).digest(), plain)
    h = Hive()
    one = lambda n, raw: h.key(n, [h.key("CurrVal", (), [("", 3, raw)]), h.key("OldVal")])
    policy = h.key("Policy", [h.key("PolSecretEncryptionKey", (), [("", 3, policy)]), h.key("Secrets", [one("DefaultPassword", old_secret(b"s\0e\0c\0", key)), one("NL$KM", old_secret(machine, key))])])
    return h.file(h.key("ROOT", [policy, h.key("Cache", (), [("NL$1", 3, entry), ("NL$2", 3, b"\0" * 200), ("NL$Control", 3, b"\0" * 200)])]))


def test_dumps(spark):
    files = [("old", "SYSTEM", 1, system_hive()), ("old", "SAM", 2, sam_hive(False)), ("old", "SECURITY", 3, security_hive()), ("new", "SYSTEM", 1, system_hive()), ("new", "SAM", 2, sam_hive(True, 1001)), ("bare", "SYSTEM", 1, system_hive()), ("none", "SAM", 2, sam_hive(True))]
    d = spark.createDataFrame(files, "image string, path string, hive_offset long, content binary")
    s = Session(spark, {"win_keys": extract.hive_files(spark, d)})
    assert sorted(map(tuple, s.run("windows.hashdump.Hashdump").collect())) == [("new", "Admin", 1001, secrets.NO_LM, bytes(range(16)).hex()), ("old", "Admin", 500, secrets.NO_LM, bytes(range(16)).hex())]
    assert sorted((r.image, r.key, bytes(r.secret)) for r in s.run("windows.lsadump.Lsadump").collect()) == [("old", "DefaultPassword", b"s\0e\0c\0"), ("old", "NL$KM", bytes(range(64)))]
    assert [(r.image, r.username, r.domain, r.domain_name, bytes(r.hash)) for r in s.run("windows.cachedump.Cachedump").collect()] == [("old", "bob", "CORP", "corp.local", bytes(range(16)))]
    keys = s.run("windows.registry.printkey.PrintKey", key="Select").filter("image = 'old'").collect()
    assert sorted((r.type, r.name, r.data) for r in keys) == [("Key", "Select", None), ("REG_DWORD", "Current", "2")]


def test_secrets_of_newer_systems():
    """Blocks stand by themselves, so any stored bytes have a plain text; it is taken apart as the format says."""
    policy = bytes((3 * i) & 255 for i in range(60 + 112))
    keys = {f"controlset001\\control\\lsa\\{n}": (t, {}) for n, t in zip(("jd", "skew1", "gbg", "data"), ("00112233", "44556677", "8899aabb", "ccddeeff"), strict=True)}
    boot = secrets.boot_key(keys)
    assert boot == bytes(H("00112233445566778899aabbccddeeff")[i] for i in secrets.BOOT_ORDER)
    key, newer = secrets.lsa_key({r"policy\poleklist": (None, {"": policy})}, boot)
    want = hashlib.sha256(boot + policy[28:60] * 1000).digest()
    assert newer and key == ciphers.aes_decrypt(want, policy[60:])[68:100] and len(key) == 32
    none = secrets.Keys()
    assert secrets.secrets_of(none) == ({}, False) and not list(secrets.hash_rows(none)) and not list(secrets.cache_rows(none))
