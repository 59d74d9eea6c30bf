import hashlib
import random
import unicodedata

import numpy as np
import pytest
from tokenizers import Tokenizer

from coredust.llm import bpe
from coredust.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def both():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return bpe.WordBpe(tokenizer_path()), t


ODD = ["", "  ", "ΑΣ ΣΑΣ ΟΔΟΣ.", "İstanbul ı", "a\x1cb\x85c\xa0d​e f　g", "<|startoftext|>x<|endoftext|>  y <|STARTOFTEXT|>", "it's IT'S we'll I'd 've", "é é Å", "１２３ Ⅳ ½ 10000", "a" * 5000, "ab" * 70 + " " + "the" * 40, "😀👩‍👩‍👧 🇫🇷", "ǅ ß ẞ ﬁ", "\x00\x01 �", "नमस्ते", "한국어", "<|startoftext|", "!?." * 300, "don''t 'S"]


def test_same_as_library(both):
    own, lib = both
    rng = random.Random(5)
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x500), 32, 9, 10])) for _ in range(rng.randrange(1, 80))) for _ in range(500)]
    for s in texts:
        ids = own.encode(s)
        assert ids == lib.encode(s, add_special_tokens=False).ids, s
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False), s


def test_every_code_point_as_in_library(both):
    """Each code point between letters, after a combining mark and before one, and next to its own kind."""
    own, lib = both
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 8192):
        part = points[lo : lo + 8192]
        texts = [f"a{chr(c)}B" for c in part] + [f"q{m}{chr(c)}{m}" for c in part if unicodedata.category(chr(c))[0] in "MC" for m in "\u0316\u0301"]
        texts += [f"1{chr(c)}{chr(d)}!" for c, d in zip(part, part[1:], strict=False)]
        assert [own.encode(t) for t in texts] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_every_canonical_pair_as_in_library(both):
    own, lib = both
    for c in range(0xA0, 0x30000):
        parts = unicodedata.decomposition(chr(c))
        if parts and "<" not in parts:
            for text in ("".join(chr(int(x, 16)) for x in parts.split()), unicodedata.normalize("NFD", chr(c)) + "\u0323"):
                assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids, hex(c)


def test_heap_and_scan_agree(both):
    own, _ = both
    rng = random.Random(6)
    for _ in range(300):
        raw = "".join(rng.choice("thernaiosé") for _ in range(rng.randrange(1, 90))).encode()
        ids = [own.first[b] for b in raw]
        ids[-1] = own.last[raw[-1]]
        assert own._by_heap(list(ids)) == own._by_scan(list(ids))


def test_table_limit_changes_nothing(both, monkeypatch):
    own, _ = both
    want = own.encode("the quick brown fox the lazy dog")
    monkeypatch.setattr(bpe, "TABLE_WORDS", 2)
    own.table.clear()
    assert own.encode("the quick brown fox the lazy dog") == want


def test_frames(spark, both):
    _, lib = both
    rows = [(i, s) for i, s in enumerate(ODD)] + [(99, None), (None, "x y"), (1, "  ")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS ids", "1 AS n_tokens")
    got = sorted(map(tuple, bpe.round_trip_digests(d, tokenizer_path()).collect()), key=str)
    want = []
    for i, s in rows:
        ids = lib.encode(s or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    coded = bpe.encode(d, tokenizer_path())
    assert {r.doc_id: r.text for r in bpe.decode(coded, tokenizer_path()).collect()}[6] == lib.decode(lib.encode(ODD[6], add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.round_trip_digests(d.limit(0), tokenizer_path()).count() == 0
