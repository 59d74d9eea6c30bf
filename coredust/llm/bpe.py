"""BPE encoding and decoding with a public word-end vocabulary (tokenizers JSON), without the tokenizers library.

A word's parts are held as a contiguous array of boundaries with the rank of every adjacent pair beside it. The smallest
rank is found by scanning, its boundary is deleted and the two neighbouring ranks are refreshed. That suits short words;
words of more than ``HEAP_BYTES`` bytes use the same merges in the same order from a heap over linked parts, so a word of
any length costs n log n. Words recur, so each worker keeps a bounded table of encoded words.

Text is normalised as the vocabulary file says: added tokens are split off, then NFC, white space runs to one space,
lower case by code point (no final-sigma rule), then words by the file's pattern. The file has no decoder, so decoding
joins the token strings with spaces.

Which characters are letters or digits, what is lower case, and which marks composition knows is taken from Python's
Unicode tables and the fixed differences to those that the library was built with, so ids are equal for every code point.

Edge cases: a null or empty text, or one of white space only, has no tokens; lone surrogates cannot occur in Spark
strings; repeated rows are encoded like any other; an empty table gives an empty result; extra columns are ignored by
``encode`` (pass ``keep`` to carry some).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

HEAP_BYTES = 64
#: Encoded words that a worker keeps; beyond that the table starts anew, which changes no result.
TABLE_WORDS = 200_000
NO_RANK = 1 << 60
#: How the tables of the tokenizers library differ from those of Unicode 15.1 (Python 3.13). Letters and
#: digits that are new in its categories.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_DIGITS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: First and last new capital, and the first one's small letter.
NEW_LOWER = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B),
    (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
#: Marks (and the second half of a pair) that its composition, by older tables, neither orders nor joins.
LOOSE_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC),
    (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0),
    (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE),
    (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable Latin-1, else the next from U+0100."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _members(ranges: Iterable[tuple[int, int]]) -> set[int]:
    return {c for a, b in ranges for c in range(a, b + 1)}


def _class(members: Iterable[int]) -> str:
    """The inside of a character class."""
    runs: list[list[int]] = []
    for c in sorted(members):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


class Characters:
    """Letters and digits as the library sees them, and where the regex module's own tables say otherwise."""

    def __init__(self) -> None:
        every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        text = "".join(map(chr, every))
        kinds = [unicodedata.category(ch)[0] for ch in text]
        letters = {c for c, k in zip(every, kinds, strict=True) if k == "L"} | _members(NEW_LETTERS)
        digits = {c for c, k in zip(every, kinds, strict=True) if k == "N"} | _members(NEW_DIGITS)
        by_regex = lambda p: {ord(ch) for m in regex.finditer(p, text) for ch in m[0]}
        self.letters, self.digits = _class(letters), _class(digits)
        lower = {c: small + c - first for first, last, small in NEW_LOWER for c in range(first, last + 1)}
        self.lower = lower
        odd = (letters ^ by_regex(r"\p{L}+")) | (digits ^ by_regex(r"\p{N}+"))
        #: No character that needs the slower way.
        self.odd = re.compile(f"[{_class(odd | _members(LOOSE_MARKS) | set(lower))}]")
        self.loose = re.compile(f"([{_class(_members(LOOSE_MARKS))}])")

    def normal(self, text: str) -> str:
        """NFC and lower case with the library's tables: a mark that they do not know parts what is before and after it."""
        parts = self.loose.split(text)
        return "".join(p if i % 2 else unicodedata.normalize("NFC", p) for i, p in enumerate(parts)).translate(self.lower)


@cache
def characters() -> Characters:
    return Characters()


class WordBpe:
    """A vocabulary and its merges. ``encode`` and ``decode`` are exact inverses of each other up to normalisation."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.strings = {i: s for s, i in self.vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings |= {i: s for s, i in self.added.items()}
        self.splitter = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        rule = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(rule)
        self.chars = characters()
        self.exact = regex.compile(rule.replace(r"\p{L}", self.chars.letters).replace(r"\p{N}", self.chars.digits))
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: (left id, right id) in one integer -> (rank, merged id)
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            self.merges[self.vocab[a] << 32 | self.vocab[b]] = (rank, self.vocab[a + b])
        letters = byte_letters()
        self.first = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.end] for c in letters]
        self.table: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of one word of the pattern."""
        raw = word.encode("utf-8")
        ids = [self.first[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        return tuple(self._by_heap(ids) if len(ids) > HEAP_BYTES else self._by_scan(ids))

    def _by_scan(self, ids: list[int]) -> list[int]:
        merges, none = self.merges, (NO_RANK, 0)
        ranks = [merges.get(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            i = ranks.index(best)
            # The boundary between parts i and i+1 goes; the ranks on either side change.
            ids[i] = best[1]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = merges.get(ids[i - 1] << 32 | ids[i], none)
            if i < len(ranks):
                ranks[i] = merges.get(ids[i] << 32 | ids[i + 1], none)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        """The same merges, lowest rank first and leftmost on ties, for long words."""
        merges, n = self.merges, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # a part of it has been merged meanwhile
            ids[i], ids[j] = merges[a << 32 | b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get(ids[i] << 32 | ids[k]):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (m := merges.get(ids[h] << 32 | ids[i])):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def _plain(self, text: str, out: list[int]) -> None:
        # White space splits words whatever its length, so collapsing it first would change nothing.
        pattern = self.pattern
        if not text.isascii():
            if self.chars.odd.search(text):
                text, pattern = self.chars.normal(text), self.exact
            else:
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")
        table = self.table
        for w in pattern.findall(text.lower()):
            ids = table.get(w)
            if ids is None:
                if len(table) >= TABLE_WORDS:
                    table.clear()
                ids = self.word(w)
                if len(w) <= HEAP_BYTES:
                    table[w] = ids
            out += ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            if self.splitter is None or not any(t in text for t in self.added):
                self._plain(text, out)
            else:
                for i, part in enumerate(self.splitter.split(text)):
                    if i % 2:
                        out.append(self.added[part])
                    elif part:
                        self._plain(part, out)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The token strings joined by spaces; unknown ids fall out, as in the library."""
        get = self.strings.get
        return " ".join([s for i in ids if (s := get(i)) is not None])


@cache
def load(path: str) -> WordBpe:
    """One vocabulary a worker and path."""
    return WordBpe(path)


def encode(docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``ids`` (array<int>) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            ids = pa.array([bpe.encode(t.as_py()) for t in b.column(0)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], ids], names=[*keep, "ids"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("text", *keep).mapInArrow(run, f"{fields}, ids array<int>")


def decode(rows: DataFrame, path: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``text`` of rows with ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            texts = pa.array([bpe.decode(x.as_py() or ()) for x in b.column(0)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], texts], names=[*keep, "text"])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select("ids", *keep).mapInArrow(run, f"{fields}, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode what was encoded, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            n, first, second = [], [], []
            for t in b.column(1):
                ids = bpe.encode(t.as_py())
                n.append(len(ids))
                first.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                second.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
