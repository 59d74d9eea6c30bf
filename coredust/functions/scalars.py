"""Scalar functions over bytes and text: struct fields, absence, names, identifiers, triage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Why a cell is absent.
UNREADABLE, UNPARSABLE, NOT_AVAILABLE, NOT_APPLICABLE = "unreadable", "unparsable", "not_available", "not_applicable"


def _hex_le(raw: Column, offset: int | Column, size: int) -> Column:
    """Hex digits, most significant first, of ``size`` little-endian bytes; null beyond the end."""
    digits = F.hex(raw)
    at = offset if isinstance(offset, Column) else F.lit(offset)
    parts = [F.substring(digits, (at + i) * 2 + 1, F.lit(2)) for i in reversed(range(size))]
    return F.when(F.length(raw) >= at + size, F.concat(*parts))


def uint(raw: Column, offset: int | Column, size: int) -> Column:
    """An unsigned little-endian integer of up to eight bytes, as a long (eight bytes wrap to negative)."""
    text = _hex_le(raw, offset, size)
    if size < 8:
        return F.conv(text, 16, 10).cast("long")
    high, low = F.conv(F.substring(text, 1, 8), 16, 10).cast("long"), F.conv(F.substring(text, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def sint(raw: Column, offset: int | Column, size: int) -> Column:
    """A signed little-endian integer."""
    v = uint(raw, offset, size)
    return v if size == 8 else F.when(v >= 1 << (8 * size - 1), v - (1 << (8 * size))).otherwise(v)


def cstring(raw: Column, offset: int, size: int) -> Column:
    """A zero-terminated UTF-8 string of at most ``size`` bytes."""
    field = F.substring(raw, offset + 1, size).cast("string")
    return F.split_part(field, F.lit("\0"), F.lit(1))


def bits(value: Column, start: int, end: int) -> Column:
    """Bits ``start`` up to but not including ``end``."""
    return F.shiftrightunsigned(value.cast("long").bitwiseAND(F.lit((1 << end) - 1 if end < 63 else -1)), start)


def pack(fields: Sequence[tuple[str, Column]]) -> Column:
    """Bytes of the fields in order: ``u4``/``i8``/``u2`` little-endian integers, ``s16`` zero-padded text."""
    out = []
    for kind, value in fields:
        n = int(kind[1:])
        if kind[0] == "s":
            out.append(F.rpad(F.hex(value.cast("binary")), 2 * n, "0"))
        else:
            digits = F.lpad(F.hex(value.cast("long")), 16, "0")
            out.append(F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(n))))
    return F.unhex(F.concat(*out))


def absent(value: Column, reasons: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """(value or null, reason or null): the first reason that holds makes the cell absent."""
    why = F.lit(None).cast("string")
    for name, test in reversed(reasons):
        why = F.when(test, name).otherwise(why)
    return F.when(why.isNull(), value), why


def basename(path: Column, sep: str = "/") -> Column:
    return F.substring_index(path, sep, -1)


def filetime(value: Column) -> Column:
    """A Windows FILETIME as a UTC timestamp: whole seconds, null for 0 and for years outside 1..9999."""
    seconds = F.floor(value / 10_000_000) - 11_644_473_600
    return F.when((value != 0) & (seconds > -62_135_596_800) & (seconds < 253_402_300_800), F.timestamp_seconds(seconds))


def unix_time(value: Column) -> Column:
    """Unix seconds as a UTC timestamp; null for values that are not positive."""
    return F.when((value > 0) & (value < 253_402_300_800), F.timestamp_seconds(value))


def ipv4(raw: Column, offset: int = 0) -> Column:
    return F.concat_ws(".", *(uint(raw, offset + i, 1).cast("string") for i in range(4)))


def canonical(address: Column, width: int = 48) -> Column:
    """Sign-extend a virtual address of ``width`` bits."""
    low = address.bitwiseAND(F.lit((1 << width) - 1))
    return F.when(F.getbit(address, F.lit(width - 1)) == 1, low.bitwiseOR(F.lit(-(1 << width)))).otherwise(low)


def rot13(text: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    turned = lambda s: s[13:] + s[:13]
    return F.translate(text, upper + lower, turned(upper) + turned(lower))


def service_sid(name: Column) -> Column:
    """The SID of a Windows service: the SHA-1 of its upper-case name as five little-endian integers."""
    raw = F.unhex(F.sha1(name))
    return F.concat_ws("-", F.lit("S-1-5-80"), *(uint(raw, 4 * i, 4).cast("string") for i in range(5)))


def triage(df: DataFrame, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """A row for each (row, rule that holds) with the rule's title and severity."""
    hits = F.array(*(F.when(test, F.struct(F.lit(title).alias("title"), F.lit(severity).alias("severity"))) for title, severity, test in rules))
    return df.withColumn("_hit", F.explode(F.filter(hits, lambda h: h.isNotNull()))).select("*", "_hit.title", "_hit.severity").drop("_hit")
