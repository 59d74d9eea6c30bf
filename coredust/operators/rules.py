"""A subset of YARA: text, hex and regular-expression strings, counts and boolean conditions, over binary columns.

Supported: ``nocase``, ``wide``, ``ascii``, ``fullword``; ``$a``, ``#a`` with comparisons, ``any of them``, ``all of
them``, ``n of them``, ``n of ($a*)``, ``and``, ``or``, ``not`` and parentheses. No modules, imports or ``for`` loops.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

_RULE = re.compile(r"rule\s+(\w+)[^{]*\{(.*?)condition\s*:(.*?)\n?\}\s*(?=rule\s|\Z|import\s|//|/\*)", re.DOTALL)
_STRING = re.compile(r"\$(\w*)\s*=\s*(\"(?:\\.|[^\"\\])*\"|\{[^}]*\}|/(?:\\.|[^/\\])+/[is]*)([^\n$]*)")
_TOKEN = re.compile(r"\s*(==|!=|<=|>=|<|>|\(|\)|,|#\w+|\$\w*\*?|\d+|\w+)")
MAX_VALUE = 512


@dataclass
class Rule:
    name: str
    strings: dict[str, re.Pattern]
    condition: list[str]


def _literal(text: str) -> bytes:
    return re.sub(rb"\\(x[0-9a-fA-F]{2}|.)", lambda m: bytes([int(m[1][1:], 16)]) if m[1][:1] == b"x" and len(m[1]) == 3 else {b"n": b"\n", b"t": b"\t", b"r": b"\r"}.get(m[1], m[1]), text.encode("utf-8"))


def _hex(text: str) -> bytes:
    out = b""
    for tok in re.findall(r"\[[^\]]*\]|\(|\)|\||[0-9a-fA-F?]{2}", text):
        if tok[0] == "[":
            lo, _, hi = tok[1:-1].partition("-")
            out += b".{%s,%s}" % (lo.strip().encode(), (hi.strip() if "-" in tok else lo.strip()).encode())
        elif tok == "(":
            out += b"(?:"
        elif tok in (")", "|"):
            out += tok.encode()
        elif tok == "??":
            out += b"."
        elif "?" in tok:
            values = [int(tok.replace("?", f"{n:x}"), 16) for n in range(16)]
            out += b"[" + b"".join(b"\\x%02x" % v for v in values) + b"]"
        else:
            out += b"\\x" + tok.lower().encode()
    return out


def _pattern(value: str, modifiers: set[str]) -> re.Pattern:
    flags = re.DOTALL if value[0] != "/" else 0
    if value[0] == '"':
        plain = _literal(value[1:-1])
        forms = [plain] if "wide" not in modifiers or "ascii" in modifiers else []
        forms += [b"".join(bytes([c, 0]) for c in plain)] if "wide" in modifiers else []
        body = b"|".join(map(re.escape, forms))
        body = rb"(?<![0-9A-Za-z])(?:" + body + rb")(?![0-9A-Za-z])" if "fullword" in modifiers else body
    elif value[0] == "{":
        body = _hex(value[1:-1])
    else:
        end = value.rindex("/")
        body = value[1:end].encode("utf-8")
        flags |= (re.IGNORECASE if "i" in value[end:] else 0) | (re.DOTALL if "s" in value[end:] else 0)
    return re.compile(body, flags | (re.IGNORECASE if "nocase" in modifiers else 0))


def compile_rules(text: str) -> list[Rule]:
    found = []
    for name, head, condition in _RULE.findall(text + "\n"):
        if "strings:" in head.replace(" :", ":"):
            head = head.split("strings", 1)[1]
        strings = {"$" + n: _pattern(v, set(m.split())) for n, v, m in _STRING.findall(head)}
        tokens = _TOKEN.findall(condition)
        rule = Rule(name, strings, tokens)
        holds(rule, {n: 0 for n in strings})  # a condition that cannot be read fails now, not on an executor
        found.append(rule)
    return found


def holds(rule: Rule, counts: dict[str, int]) -> bool:
    """Whether a rule's condition is met, by recursive descent over its tokens."""
    toks, at = rule.condition, 0

    def peek() -> str:
        return toks[at] if at < len(toks) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return toks[at - 1]

    def either() -> bool:
        value = both()
        while peek() == "or":
            take()
            value = both() or value
        return value

    def both() -> bool:
        value = single()
        while peek() == "and":
            take()
            value = single() and value
        return value

    def group() -> list[str]:
        if peek() == "them":
            take()
            return list(counts)
        names: list[str] = []
        take()
        while peek() != ")":
            tok = take()
            if tok != ",":
                names += [n for n in counts if n.startswith(tok[:-1])] if tok.endswith("*") else [tok]
        take()
        return names

    def single() -> bool:
        tok = take()
        if tok == "not":
            return not single()
        if tok == "(":
            value = either()
            take()
            return value
        if tok in ("true", "false"):
            return tok == "true"
        if tok in ("any", "all") or tok.isdigit():
            take()  # of
            hits = [counts[n] > 0 for n in group()]
            return sum(hits) >= (1 if tok == "any" else len(hits) if tok == "all" else int(tok))
        if tok[0] == "#":
            op, n = take(), int(take())
            have = counts["$" + tok[1:]]
            return {"==": have == n, "!=": have != n, "<": have < n, "<=": have <= n, ">": have > n, ">=": have >= n}[op]
        if tok[0] == "$":
            return counts[tok] > 0
        raise ValueError(f"rule {rule.name}: {tok!r} is not supported in a condition")

    value = either()
    if at != len(toks):
        raise ValueError(f"rule {rule.name}: {peek()!r} is not supported in a condition")
    return value


def scan_rules(df: DataFrame, keep: Sequence[str], start: str, data: str, text: str) -> DataFrame:
    """(keep, offset, rule, component, value): a row for each string hit of each rule that holds for a row's bytes."""
    compiled = compile_rules(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at, rule, part, value = [], [], [], [], []
            for i in range(b.num_rows):
                raw, base = b.column(len(keep) + 1)[i].as_py() or b"", b.column(len(keep))[i].as_py()
                for r in compiled:
                    hits = {n: [(m.start(), m.group()[:MAX_VALUE]) for m in p.finditer(raw)] for n, p in r.strings.items()}
                    if holds(r, {n: len(h) for n, h in hits.items()}):
                        for n, h in hits.items():
                            for o, v in h:
                                rows.append(i)
                                at.append(base + o)
                                rule.append(r.name)
                                part.append(n)
                                value.append(v)
            ix = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(ix) for k in range(len(keep))), pa.array(at, pa.int64()), pa.array(rule, pa.string()), pa.array(part, pa.string()), pa.array(value, pa.binary())], names=[*keep, "offset", "rule", "component", "value"])

    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, start, data).mapInArrow(run, f"{fields}, offset long, rule string, component string, value binary")
