import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from coredust.llm import simhash


def slow_fingerprint(text, k=3):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab É\n\t\x0b\x1c\xa0Z ", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def near(values, budget=2):
    v = np.array(sorted(values), np.uint64)
    return {(int(v[i]), int(v[j])) for i in range(len(v)) for j in range(i + 1, len(v)) if bin(int(v[i]) ^ int(v[j])).count("1") <= budget}


def clustered(rng, n):
    """Fingerprints in tight groups: within two bits of few centres, and chains of single bits."""
    out = set()
    while len(out) < n:
        c = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(n // 4):
            out.add(c)
            c ^= (1 << int(rng.integers(0, 64))) | (1 << int(rng.integers(0, 64)))
    return sorted(out)[:n]


@pytest.mark.parametrize("budget", [0, 1, 2, 4])
def test_trie_pairs(budget):
    rng = np.random.default_rng(budget)
    v = np.unique(np.array(clustered(rng, 300) + [0, 1, 3, (1 << 64) - 1], np.uint64))
    found = list(simhash.trie_pairs(v, np.array([[0, len(v), 0, len(v), 0, 63, 0]]), budget))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    assert len(i) == len({*zip(i.tolist(), j.tolist(), strict=True)})
    assert {(int(v[a]), int(v[b])) for a, b in zip(i, j, strict=True)} == near(v, budget)


@pytest.mark.parametrize("rows", [100_000, 6])
def test_links_also_when_divided(spark, rows):
    v = clustered(np.random.default_rng(9), 400)
    d = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in v], "fp long")
    got = {tuple(sorted((r.u % (1 << 64), r.v % (1 << 64)))) for r in simhash.links(d, subtrie_rows=rows).collect()}
    assert got == near(v)


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def edited(rng, words, vocabulary, share):
    """A copy of a list of words with about that share of them replaced, dropped or added."""
    out = []
    for w in words:
        x = rng.random() / share if share else 1
        out += [w] if x >= 1 else [[], [str(rng.choice(vocabulary))], [w, str(rng.choice(vocabulary))]][int(x * 3)]
    return out


@pytest.mark.parametrize("rows", [100_000, 8])
def test_near_links_against_brute_force(spark, rows):
    """Exact five-word similarity of all pairs of 2,000 texts; only pairs at the sketch's own error from 0.8 may differ."""
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = []
    while len(texts) < 2000:
        base = rng.choice(vocabulary, int(rng.choice([6, 12, 40, 150, 600]))).tolist()
        texts += [" ".join(edited(rng, base, vocabulary, s)) for s in (0, 0.003, 0.006, 0.01, 0.015, 0.02, 0.03, 0.1)]
    texts = list(dict.fromkeys(texts))
    sets = [shingles(t) for t in texts]
    near, holding = {}, {}
    for i, s in enumerate(sets):
        for x in s:
            holding.setdefault(x, []).append(i)
    for members in holding.values():
        for i in members:
            for j in members:
                if i < j and (i, j) not in near:
                    near[i, j] = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = simhash.fingerprints(d, near=True).cache()
    name = {r.id: r.doc_id for r in t.select("id", "doc_id").collect()}
    forest = [(name[r.u], name[r.v]) for r in simhash.near_links(t.drop("doc_id"), subtrie_rows=rows).collect()]
    t.unpersist()
    whole = range(len(texts))
    got, sure, may = classes(forest, whole), classes([p for p, x in near.items() if x >= 0.85], whole), classes([p for p, x in near.items() if x >= 0.75], whole)
    wanted = [p for p, x in near.items() if x >= 0.8]
    assert len(wanted) > 600 and sum(got[i] == got[j] for i, j in wanted) >= 0.98 * len(wanted)
    missed = [p for p, x in near.items() if x >= 0.85 and got[p[0]] != got[p[1]]]
    assert len(missed) <= 0.002 * len(wanted), [(near[p], p) for p in missed]
    assert all(may[i] == may[got[i]] for i in whole) and len(set(sure.values())) >= len(set(got.values())) - len(missed)


def test_large_group_of_near_copies_costs_its_size(spark):
    """Each of 3,000 near copies differs from the others; all are linked, and node pairs of linked texts are not entered."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    texts = [" ".join([*base[:i % 115], f"x{i}", *base[i % 115 + 1 :]]) for i in range(3000)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = simhash.cluster(d, budget=simhash.NEAR_BUDGET, similarity=simhash.SIMILARITY)
    assert out.filter("component_id = 0").count() == 3000
    v = np.unique(rng.integers(0, 1 << 8, 3000).astype(np.uint64))
    groups = simhash.Groups(len(v))
    groups.link(np.zeros(len(v) - 1, int), np.arange(1, len(v)))
    assert not list(simhash.trie_pairs(v, np.array([[0, len(v), 0, len(v), 0, 63, 0]]), 16, groups=groups))


def test_near_copies_by_similarity(spark):
    """Copies with a few words changed are found, texts that share a third of their words are not."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, group = [], {}
    for g in range(40):
        base = rng.choice(vocabulary, 400).tolist()
        for c in range(3):
            text = list(base)
            for at in rng.choice(400, 2 * c, replace=False):
                text[at] = "changed"
            rows.append((10 * g + c, " ".join(text)))
            group[10 * g + c] = 10 * g
        rows.append((10 * g + 9, " ".join(base[:140] + rng.choice(vocabulary, 260).tolist())))
        group[10 * g + 9] = 10 * g + 9
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = simhash.cluster(d, budget=simhash.NEAR_BUDGET, similarity=simhash.SIMILARITY)
    got = {r.doc_id: r.component_id for r in out.collect()}
    assert sum(got[i] == group[i] for i in group) >= 0.98 * len(group)
    assert all(got[i] in (group[i], i) for i in group)


def classes(pairs, nodes):
    up = {n: n for n in nodes}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r.node: r.label for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == classes(edges, {x for e in edges for x in e if e != (7, 7)} | set(range(41)))


ROWS = [(5, "a b c d e f g h"), (3, "A  B c\nd e f g h"), (9, "quite another text of words"), (4, None), (8, ""), (2, "\x0b \t"), (5, "a b c d e f g h"), (None, "a b c d e f g h"), (11, "w " * 50_000)]


def test_cluster_and_keep(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS label", "3 AS first")
    out = sorted(map(tuple, simhash.cluster(d).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    fps = {f"{slow_fingerprint(t):016x}" for _, t in ROWS}
    assert {r[1] for r in out} == fps
    assert {r[0]: r[2] for r in out if r[0] in (3, 4, 5, 8, 2, None)} == {5: 3, 3: 3, None: 3, 4: 2, 8: 2, 2: 2}
    kept = simhash.keep_first(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 9, 11]
    assert simhash.cluster(d.limit(0)).count() == 0


def test_keep_first_by_row_not_by_doc_id(spark):
    """Distinct texts with a null or repeated doc_id stay, one for each component; none is a copy of a row that stays."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdefghijklmnop"), 40)) for _ in range(12)]
    rows = [(None, t) for t in texts[:6]] + [(None, texts[0]), (None, texts[6]), (1, texts[6])]
    rows += [(7, t) for t in texts[7:10]] + [(7, texts[7]), (8, texts[8]), (6, texts[9]), (9, texts[10])]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, t) for t in texts[:6]] + [(1, texts[6]), (7, texts[7]), (7, texts[8]), (6, texts[9]), (9, texts[10])]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


def test_cluster_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(list("abcdefghij"), 40)) for _ in range(20)]
    rows = [(i, base[i % 20] + (" x" if i % 3 else "")) for i in range(120)]
    got = {r.doc_id: r.component_id for r in simhash.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fp = {i: slow_fingerprint(t) for i, t in rows}
    pairs = [(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 2]
    assert got == classes(pairs, fp)
