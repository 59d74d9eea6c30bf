"""Windows operators that recover stored secrets from registry keys: account hashes, LSA secrets, cached credentials.

Only the few keys that hold them are gathered, image by image: a handful for the system and one a user or secret.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ciphers import aes_decrypt, des, rc4, spread_key
from .session import Session, alias, operator
from .windows import _key_paths



class Keys(dict[str, tuple[str | None, dict[str, bytes]]]):
    """Path below the hive's root, in lower case -> class and values; ``written`` has the paths as they are."""

    written: dict[str, str] = {}


#: Order of the boot key's bytes, and the texts that go into the key of the account hashes. Fixed values.
BOOT_ORDER = (8, 5, 4, 2, 11, 9, 13, 3, 0, 6, 1, 12, 14, 10, 15, 7)
QWERTY, DIGITS = b"!@#$%^&*()qwertyUIOPAzxcvbnmQQQQQQQQQQQQ)(*@&%\0", b"0123456789012345678901234567890123456789\0"
LM_TEXT, NT_TEXT = b"LMPASSWORD\0", b"NTPASSWORD\0"
#: Hashes of no password. Fixed values.
NO_LM, NO_NT = "aad3b435b51404eeaad3b435b51404ee", "31d6cfe0d16ae931b73c59d7e0c089c0"

NEEDED = r"(?i)^[^\\]+\\(Select|ControlSet\d+\\Control\\Lsa\\(JD|Skew1|GBG|Data)|SAM\\Domains\\Account|SAM\\Domains\\Account\\Users\\[0-9a-f]{8}|Policy\\(PolEKList|PolSecretEncryptionKey)|Policy\\Secrets\\[^\\]+\\CurrVal|Cache)$"


def boot_key(keys: Keys) -> bytes | None:
    """The classes of four keys of the current control set, put in order."""
    select = keys.get("select", (None, {}))[1].get("Current", b"\1\0\0\0")
    path = f"controlset{struct.unpack('<I', select[:4].ljust(4, bytes(1)))[0]:03d}\\control\\lsa\\"
    text = "".join(keys.get(path + name, (None, {}))[0] or "" for name in ("jd", "skew1", "gbg", "data"))
    if not re.fullmatch(r"[0-9a-fA-F]{32}", text):
        return None
    raw = bytes.fromhex(text)
    return bytes(raw[i] for i in BOOT_ORDER)


def account_key(keys: Keys, boot: bytes) -> bytes | None:
    """The key of the account hashes, from the domain's F value; its first byte says by which cipher."""
    data = keys.get(r"sam\domains\account", (None, {}))[1].get("F", b"")
    if len(data) < 0xA8:
        return None
    if data[0] == 2:
        return rc4(hashlib.md5(data[0x70:0x80] + QWERTY + boot + DIGITS).digest(), data[0x80:0xA0])
    return aes_decrypt(boot, data[0x88:0xA8], data[0x78:0x88]) if data[0] == 3 else None


def _rid_keys(rid: int) -> tuple[bytes, bytes]:
    s = struct.pack("<I", rid)
    return spread_key(s + s[:3]), spread_key(s[3:] + s + s[:2])


def _one_hash(v: bytes, field: int, rid: int, key: bytes, text: bytes) -> str | None:
    """A hash that a user's V value holds: obfuscated by RC4 or AES, then by the user's number."""
    offset, size = struct.unpack_from("<II", v, field)
    entry = v[offset + 0xCC :][:size]
    if len(entry) < 20:
        return None
    if entry[2] == 1:
        hidden = rc4(hashlib.md5(key[:16] + struct.pack("<I", rid) + text).digest(), entry[4:20])
    elif len(entry) >= 40:
        hidden = aes_decrypt(key[:16], entry[24:40], entry[8:24])
    else:
        return None
    first, second = _rid_keys(rid)
    return (des(first, hidden[:8]) + des(second, hidden[8:16])).hex()


def hash_rows(keys: Keys) -> Iterator[dict]:
    boot = boot_key(keys)
    key = account_key(keys, boot) if boot else None
    for path, (_, values) in sorted(keys.items()) if key else ():
        m = re.fullmatch(r"sam\\domains\\account\\users\\([0-9a-f]{8})", path)
        v = values.get("V", b"") if m else b""
        if len(v) >= 0xCC:
            rid = int(m[1], 16)
            at, size = struct.unpack_from("<II", v, 0x0C)
            yield {"user": v[at + 0xCC :][:size].decode("utf-16-le", "replace"), "rid": rid, "lmhash": _one_hash(v, 0x9C, rid, key, LM_TEXT) or NO_LM, "nthash": _one_hash(v, 0xA8, rid, key, NT_TEXT) or NO_NT}


def _stretched(secret: bytes, key: bytes) -> bytes:
    """A secret of newer systems: its key comes from a thousand rounds of its salt, each block stands by itself."""
    sha = hashlib.sha256(key)
    for _ in range(1000):
        sha.update(secret[28:60])
    return aes_decrypt(sha.digest(), secret[60:])


def _rolled(secret: bytes, key: bytes) -> bytes:
    """A secret of older systems: blocks by DES, under seven bytes of the key at a time, around and around."""
    out, at = b"", 0
    for i in range(0, len(secret) - len(secret) % 8, 8):
        out += des(spread_key(key[at : at + 7]), secret[i : i + 8])
        at += 7
        if len(key) - at < 7:
            at = len(key) - at
    return out[8 : 8 + struct.unpack_from("<I", out)[0]] if len(out) >= 8 else b""


def lsa_key(keys: Keys, boot: bytes) -> tuple[bytes, bool] | None:
    """The key of the secrets, and whether it is that of a newer system."""
    new = keys.get(r"policy\poleklist", (None, {}))[1].get("", b"")
    if len(new) > 60:
        return _stretched(new, boot)[68:100], True
    old = keys.get(r"policy\polsecretencryptionkey", (None, {}))[1].get("", b"")
    if len(old) < 76:
        return None
    md5 = hashlib.md5(boot)
    for _ in range(1000):
        md5.update(old[60:76])
    return rc4(md5.digest(), old[12:60])[16:32], False


def secrets_of(keys: Keys) -> tuple[dict[str, bytes], bool]:
    """Every LSA secret that holds something, and whether the system is a newer one."""
    boot = boot_key(keys)
    found = lsa_key(keys, boot) if boot else None
    if not found:
        return {}, False
    key, newer = found
    out = {}
    for path, (_, values) in sorted(keys.items()):
        m = re.fullmatch(r"policy\\secrets\\([^\\]+)\\currval", path)
        raw = values.get("", b"") if m else b""
        name = keys.written.get(path, path).split("\\")[-2] if m else ""
        if len(raw) > 60 and newer:
            plain = _stretched(raw, key)
            out[name] = plain[16 : 16 + struct.unpack_from("<I", plain)[0]]
        elif len(raw) > 12 and not newer:
            out[name] = _rolled(raw[12:], key)
    return out, newer


def lsa_rows(keys: Keys) -> Iterator[dict]:
    for name, secret in secrets_of(keys)[0].items():
        yield {"key": name, "secret": secret, "hex": secret}


def cache_rows(keys: Keys) -> Iterator[dict]:
    """Cached domain logons: names and the verifier of each."""
    secrets, newer = secrets_of(keys)
    machine = next((v for n, v in secrets.items() if n.upper() == "NL$KM"), b"")
    for name, raw in sorted(keys.get("cache", (None, {}))[1].items()) if machine else ():
        if not name.upper().startswith("NL$") or name.upper() == "NL$CONTROL" or len(raw) <= 96:
            continue
        user, domain = struct.unpack_from("<HH", raw)
        full = struct.unpack_from("<H", raw, 60)[0]
        if not user:
            continue
        salt = raw[64:80]
        plain = aes_decrypt(machine[16:32], raw[96:], salt) if newer else rc4(hmac.new(machine, salt, hashlib.md5).digest(), raw[96:])
        at, texts = 72, []
        for size in (user, domain, full):  # each begins on four bytes
            texts.append(plain[at : at + size].decode("utf-16-le", "replace"))
            at += size + size % 4
        yield {"username": texts[0], "domain": texts[1], "domain_name": texts[2], "hash": plain[:16]}


def _dumped(s: Session, rows: Callable[[Keys], Iterator[dict]], columns: str) -> DataFrame:
    """What ``rows`` makes of the needed keys of each image."""
    found = _key_paths(s).filter(F.col("key").rlike(NEEDED)).select("image", F.regexp_replace("key", r"^[^\\]+\\", "").alias("path"), "class_name", "value_names", "value_raw")
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        keys = Keys()
        keys.written = {r.path.lower(): r.path for r in batch.itertuples()}
        for r in batch.itertuples():
            called, raw = (x if x is not None else () for x in (r.value_names, r.value_raw))
            keys[r.path.lower()] = (r.class_name, dict(zip(called, (bytes(v or b"") for v in raw), strict=False)))
        return pd.DataFrame([{"image": batch.image.iloc[0]} | r for r in rows(keys)], columns=["image", *names])

    return found.groupBy("image").applyInPandas(run, f"image string, {columns}")


@operator("windows.registry.hashdump.Hashdump")
def hashdump(s):
    return _dumped(s, hash_rows, "user string, rid long, lmhash string, nthash string")


@operator("windows.registry.lsadump.Lsadump")
def lsadump(s):
    return _dumped(s, lsa_rows, "key string, secret binary, hex binary")


@operator("windows.registry.cachedump.Cachedump")
def cachedump(s):
    return _dumped(s, cache_rows, "username string, domain string, domain_name string, hash binary")


for _n in ("hashdump.Hashdump", "lsadump.Lsadump", "cachedump.Cachedump"):
    alias(f"windows.{_n}", f"windows.registry.{_n}")
