import math
import re
from collections import Counter

import numpy as np
import pytest

from coredust.llm import quality_rules as qr
from coredust.llm import url_filter as uf
from coredust.llm.queries import RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_stats(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


ODD = [None, "", " \t\n", "a b c d e a b c d e", "x " * 30, "one\none\n\n \none two", "é#*$%&|<> ü", "a b c d e f g a b c d e z a b c d e", "\x1c\x85 w", "q " * 4, "long " * 30_000]


def test_statistics(spark):
    rng = np.random.default_rng(0)
    texts = ODD + [" ".join(rng.choice(list("abc"), rng.integers(1, 60))) + "\n" + "|" * int(rng.integers(0, 3)) for _ in range(60)]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in qr.text_statistics(d).collect()}
    assert got == {i: slow_stats(t) for i, t in enumerate(texts)}


def slow_mcd(everything, use):
    """The same estimate with numpy, for one group: distances of all rows from an estimate over those in use."""
    x = everything[use]
    floor = np.array(list(qr.FLOORS.values()))
    hist = lambda v, q: (math.floor(np.sort(v)[math.ceil(len(v) * q) - 1] / qr.BIN) + 0.5) * qr.BIN
    m = np.array([hist(x[:, i], 0.5) for i in range(x.shape[1])])
    sd = np.maximum([(hist(x[:, i], 0.75) - hist(x[:, i], 0.25)) / 1.349 for i in range(x.shape[1])], floor)

    def step(m, c, share):
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        b = np.floor(np.log1p(d) / qr.DISTANCE_BIN)
        k = x[b <= np.sort(b)[math.ceil(len(x) * share) - 1]]
        return k.mean(0), np.cov(k.T, bias=True) + np.diag(floor**2)

    start, ends = (m, np.diag(sd**2)), []
    for at in (start, *(step(*start, share) for share in qr.STARTS)):
        for _ in range(qr.STEPS):
            at = step(*at, qr.SUPPORT)
        ends.append(at)
    m, c = min(ends, key=lambda at: round(np.linalg.slogdet(at[1])[1] / 2, 9))
    return np.einsum("ij,jk,ik->i", everything - m, np.linalg.inv(c), everything - m)


def test_judge_against_numpy(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(260):
        text = " ".join(rng.choice(vocabulary, rng.integers(40, 300)))
        if i % 20 == 0:
            text = text.replace("w", "|#|%$") + "\nsame\nsame\nsame" * 20
        rows.append((i, text, None if i < 130 else "fr", "s", 0))
    d = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS n_words", "2 AS d2", "3 AS kept")
    out = {r.doc_id: r for r in qr.judge(d.drop("n_words", "d2", "kept")).collect()}
    for group in (range(130), range(130, 260)):
        s = np.array([slow_stats(rows[i][1]) for i in group], float)
        x = np.column_stack([np.log1p(s[:, 0]), np.log1p(s[:, 1] / s[:, 0]), *(np.log1p(100 * s[:, k] / s[:, 0]) for k in (2, 3, 4))])
        assert np.allclose([out[i].d2 for i in group], slow_mcd(x, (s[:, 0] >= 10) & (100 * s[:, 4] <= 20 * s[:, 0])), rtol=1e-6)
    assert all(out[i].kept == (i % 20 != 0) for i in range(260))
    kept = qr.keep_good(d)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i in range(260) if i % 20}


def test_small_groups_nulls_and_empty(spark):
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(ODD)] + [(0, "a b c d e f g h i j k", "en", "s", 0)] * 2, DOCS)
    out = qr.judge(d).collect()
    assert len(out) == len(ODD) + 2 and sum(r.kept for r in out) == 2
    assert qr.judge(d.limit(0)).count() == 0 and qr.keep_good(d.limit(0)).count() == 0


def test_small_groups_are_judged_by_their_language_or_the_table(spark):
    """Sources of a few rows, in a language with many rows or in one with few, and a null one: none is left unjudged."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    groups = [("en", "big")] * 90 + [("en", f"s{i % 4}") for i in range(40)] + [("fi", "s"), ("fi", None), (None, None)] * 6
    rows = []
    for i, (lang, source) in enumerate(groups):
        text = " ".join(rng.choice(vocabulary, rng.integers(40, 300)))
        rows.append((i, text.replace("w", "|#|%$") + "\nsame\nsame\nsame" * 20 if i % 10 == 0 or i in (143, 146) else text, lang, source, 0))
    out = {r.doc_id: r for r in qr.judge(spark.createDataFrame(rows, DOCS)).collect()}
    s = np.array([slow_stats(r[1]) for r in rows], float)
    x = np.column_stack([np.log1p(s[:, 0]), np.log1p(s[:, 1] / s[:, 0]), *(np.log1p(100 * s[:, k] / s[:, 0]) for k in (2, 3, 4))])
    fits = (s[:, 0] >= 10) & (100 * s[:, 4] <= 20 * s[:, 0])
    big, en = np.arange(len(rows)) < 90, np.arange(len(rows)) < 130
    want = np.where(big, slow_mcd(x, fits & big), np.where(en, slow_mcd(x, fits & en), slow_mcd(x, fits)))
    assert np.allclose([out[i].d2 for i in range(len(rows))], want, rtol=1e-6)
    assert all(out[i].kept == (rows[i][1].count("|") == 0) for i in range(len(rows)))


URLS = {
    1: "https://WWW.Example.com/en/7x?q=/a", 2: "http://a.example.com/en/8", 3: "https://b.example.net/de/81#x", 4: "ftp://example.net/de/9", 5: "x://org/es/", 6: "http://notcom/en/", 7: None, 8: "no scheme",
    9: "https://casino-win.example.org/fr/1", 10: "https://library.example.org/fr/1", 11: "http://com", 12: "a://b://c.com/en/", 13: "http://ÉX.com/en/É",
}


def test_urls(spark):
    d = spark.createDataFrame(list(URLS.items()) + [(9, URLS[9])], "page_id long, url string").selectExpr("*", "'h' AS host", "1 AS rule")
    out = {r.page_id: r for r in uf.filter_urls(d, RULES).collect()}
    assert (out[1].host, out[1].path, out[1].rule, out[1].verdict) == ("www.example.com", "/en/7x", "example.com/en/7", "allow")
    assert (out[2].rule, out[2].verdict) == ("com/en/", "block")
    assert (out[3].path, out[3].rule, out[3].verdict) == ("/de/81", "example.net/de/8", "block")
    assert (out[4].rule, out[4].verdict) == ("net/de/", "allow")
    assert (out[5].host, out[5].rule) == ("org", "org/es/")
    assert out[6].rule is None and (out[7].host, out[7].path) == ("", "") == (out[8].host, out[8].path)
    assert out[9].verdict == "block" and out[10].verdict == "allow"
    assert (out[11].path, out[11].rule) == ("", None) and (out[12].host, out[12].path) == ("b:", "//c.com/en/")
    assert out[13].host == "Éx.com"
    assert uf.filter_urls(d.limit(0), RULES).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    return uf.train(spark)


def test_training_against_numpy(spark, model):
    from pyspark.sql import functions as F

    table = uf.labelled_urls()
    d = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(table)], "i int, u string")
    grams = [r.g for r in d.select("i", uf.hashed_ngrams(F.col("u")).alias("g")).orderBy("i").collect()]
    x = np.zeros((len(table), uf.DIMS))
    for i, g in enumerate(grams):
        x[i, g] = 1 / math.sqrt(len(g))
    y, w, b = np.array([v for _, v in table]), np.zeros(uf.DIMS), 0.0
    for _ in range(uf.EPOCHS):
        e = y - 1 / (1 + np.exp(-(b + x @ w)))
        w, b = w * (1 - uf.RATE * uf.L2) + uf.RATE * (e @ x), b + uf.RATE * e.mean()
    assert np.allclose(model[1], w, atol=1e-6) and model[0] == pytest.approx(b, abs=1e-6)
    assert (((b + x @ w) > 0) == y).mean() > 0.97


def accuracy(spark, trained, asked):
    from pyspark.sql import functions as F

    model = uf.train(spark, trained)
    d = spark.createDataFrame([("http://" + u, y) for u, y in asked], "url string, y int")
    got = d.select("y", uf.probability(uf.host_of(F.col("url")), uf.path_of(F.col("url")), model).alias("p")).collect()
    return sum((r.p >= 0.5) == (r.y == 1) for r in got) / len(got)


def test_accuracy_on_what_was_held_out(spark):
    """Hosts with the table's words in other layouts are judged well; words that are not in it only better than by chance."""
    rows = lambda keep, layouts: [(lay.format(w), y) for ws, y in ((uf.UNWANTED, 1), (uf.WANTED, 0)) for i, w in enumerate(ws) if keep(i) for lay in layouts]
    assert accuracy(spark, uf.labelled_urls(), rows(lambda i: True, ("shop.{}.example.org/en/44", "{}-world.net/de/", "the-{}.example.com/a/b.html"))) > 0.95
    assert accuracy(spark, rows(lambda i: i % 5 != 2, uf.LAYOUTS), rows(lambda i: i % 5 == 2, uf.LAYOUTS)) > 0.6


def test_very_long_url(spark, model):
    d = spark.createDataFrame([(1, "http://h/" + "a/" * 100_000), (2, "")], "page_id long, url string")
    assert uf.filter_urls(d, RULES, model).count() == 2
