import math
import zlib

import numpy as np

from coredust.llm import lm_score as lm
from coredust.llm import quality_net as qn


def sample(n=400):
    rng = np.random.default_rng(0)
    good, bad = ["the", "river", "of", "light", "and", "stone", "were"], ["WIN!!", "|", "$$$", "CASH", "NOW!!"]
    return [(i, " ".join(rng.choice(bad if i % 4 == 0 else good, rng.integers(1, 200))), int(i % 4 != 0)) for i in range(n)]


def test_net_against_plain_loops():
    rng = np.random.default_rng(1)
    net = qn.Net(rng.normal(size=(qn.WIDTH, 256, qn.FILTERS)).astype(np.float32), rng.normal(size=qn.FILTERS).astype(np.float32), rng.normal(size=qn.FILTERS), rng.normal(size=qn.FILTERS), 0.1)
    for text in ["", "a", "é" * 300, "abc " * 700]:
        x = text.encode() + b"\0" * qn.WIDTH
        n = len(x) - qn.WIDTH + 1
        r = np.array([sum(net.filters[k][x[i + k]] for k in range(qn.WIDTH)) for i in range(n)])
        strips = [r[a : a + qn.STRIP].max(0) for a in range(0, n, qn.STRIP)]
        chunks = [np.maximum(a, b) for a, b in zip(strips, strips[1:], strict=False)] or strips
        v = np.maximum(np.array(chunks) + net.bias, 0)
        z = v.mean(0) @ net.mean_w + v.max(0) @ net.max_w + 0.1
        assert math.isclose(net.score(text), 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-4)


def test_net_gradients_against_finite_differences():
    rng = np.random.default_rng(6)
    texts = [rng.integers(97, 105, n).astype(np.uint8).tobytes() for n in (0, 1, 5, 255, 256, 257, 700, 1500)]
    y = np.array([1, 0, 1, 0, 1, 0, 1, 0], np.float64)
    p = {k: x.astype(np.float64) + rng.normal(0, 0.2, x.shape) for k, x in qn.start(0.4).items()}
    loss, g = qn.gradients(p, texts, y)
    net = qn.Net(p["filters"], p["bias"], p["mean_w"], p["max_w"], float(p["out"][0]))
    chance = np.array([net.score(t.decode()) for t in texts])
    assert math.isclose(loss, -np.mean(y * np.log(chance) + (1 - y) * np.log(1 - chance)), rel_tol=1e-5)
    step = {"filters": 1e-3}
    for k, x in p.items():
        flat, slope, e = x.reshape(-1), g[k].reshape(-1), step.get(k, 1e-4)
        for i in [*np.argsort(-np.abs(slope))[:5].tolist(), int(rng.integers(0, len(flat)))]:
            old = flat[i]
            flat[i] = old + e
            up = qn.gradients(p, texts, y)[0]
            flat[i] = old - e
            down = qn.gradients(p, texts, y)[0]
            flat[i] = old
            assert math.isclose((up - down) / (2 * e), slope[i], rel_tol=0.02, abs_tol=2e-5), (k, i)


def test_training_bytes_are_bounded(spark):
    rows = [(i, "abc " * (10 if i % 2 else 1000), i % 2) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    seen = []
    fit, qn.fit = qn.fit, lambda texts, labels: seen.append([len(t) for t in texts])
    try:
        qn.train(docs, labels)
        qn.train(docs, labels, max_bytes=9000)
        qn.train(docs, labels, max_bytes=3000)
        qn.train(docs, labels, max_docs=7)
    finally:
        qn.fit = fit
    every, some, short, few = seen
    assert len(every) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(40)) and len(few) == 7
    assert sum(some) <= 9000 and set(short) == {40} and sum(short) <= 3000


def test_held_out_accuracy_and_columns(spark):
    rows = sample()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS _cd_score", "2 AS held_out")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in qn.classify(docs, labels).collect()}
    assert len(out) == len(rows)
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(held) == sorted(i for i, r in out.items() if r.held_out)
    assert np.mean([out[i].predicted == rows[i][2] for i in held]) > 0.95
    kept = qn.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.predicted}


def test_net_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (2, ""), (3, "y " * 100_000)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    out = qn.classify(docs, none).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 and r.held_out is not None for r in out)
    assert qn.classify(docs.limit(0), none.limit(0)).count() == 0


def slow_log_prob(net, context, y):
    h = np.tanh(sum(net.tables[k][c] for k, c in enumerate(context)) + net.hidden)
    z, u = h @ net.top + net.top_bias, h @ net.low[y // lm.WIDE] + net.low_bias[y // lm.WIDE]
    return z[y // lm.WIDE] - math.log(np.exp(z).sum()) + u[y % lm.WIDE] - math.log(np.exp(u).sum())


def slow_score(net, ids):
    around = lambda i: [ids[j] if 0 <= j < len(ids) else lm.PAD for j in (i + k for k in range(-lm.RADIUS, lm.RADIUS + 1) if k)]
    return sum(slow_log_prob(net, around(i), int(y)) for i, y in enumerate(ids))


def test_lm_score_against_plain_loops():
    net = lm.Net.start(np.arange(lm.VOCAB))
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, lm.VOCAB, n).astype(np.uint16) for n in (0, 1, 2, 5, 0, 700)]
    got = lm.scores(lm.Net.from_flat(net.flat()), texts)
    assert np.allclose(got, [slow_score(net, t) for t in texts], rtol=1e-4, atol=1e-6)
    every = net.log_probs(np.full((lm.VOCAB, 2 * lm.RADIUS), 7, np.uint16), np.arange(lm.VOCAB, dtype=np.uint16))
    assert np.isclose(np.exp(every).sum(), 1, atol=1e-4)


def test_lm_gradients_against_finite_differences(monkeypatch):
    """With a rate of one and no division the step is the gradient of the mean of -ln P."""
    rng = np.random.default_rng(5)
    net = lm.Net.start(rng.integers(1, 50, lm.VOCAB))
    net = lm.Net(*(x.astype(np.float64) + rng.normal(0, 0.1, x.shape) for x in net.parts()))
    context, target = rng.integers(0, 6, (40, 2 * lm.RADIUS)).astype(np.uint16), rng.integers(0, 200, 40).astype(np.uint16)
    loss = lambda: -sum(slow_log_prob(net, c, int(y)) for c, y in zip(context, target, strict=True)) / len(target)
    monkeypatch.setattr(lm, "RATE", 1.0)
    monkeypatch.setattr(lm.np, "sqrt", lambda x: 1.0)
    before = [x.copy() for x in net.parts()]
    net.step(context, target, lm.Net(*(np.zeros_like(x) for x in before)))
    steps = [old - new for old, new in zip(before, net.parts(), strict=True)]
    monkeypatch.undo()
    net = lm.Net(*before)
    for part, step in zip(net.parts(), steps, strict=True):
        flat, g = part.reshape(-1), step.reshape(-1)
        for i in [*np.argsort(-np.abs(g))[:6].tolist(), *rng.integers(0, len(flat), 3).tolist()]:
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert math.isclose((up - down) / 2e-5, g[i], rel_tol=1e-3, abs_tol=1e-7)


def test_lm_every_position_trains_once():
    texts = [np.arange(n, dtype=np.uint16) % 50 for n in (0, 3, 1, 2, 0, 7001)]
    n = [lm.train_local(lm.Net.start(np.ones(lm.VOCAB)), iter(texts), r, lm.ROUNDS) for r in range(lm.ROUNDS)]
    assert sum(n) == 7007 and max(n) - min(n) <= 1


def test_lm_spelling(spark):
    rows = [(1, "common " * 400 + "aab aab ab zq")] + [(2 + i, " ".join(f"common w{j}" for j in range(lm.VOCAB))) for i in range(3)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    v = lm.vocabulary_of(lm.word_counts(d))
    assert v.ids[b"common"] == 0 and len(v.ids) == lm.VOCAB - lm.BUCKETS and b"zq" not in v.ids
    assert v.counts.sum() == sum(len(t.split()) for _, t in rows) and math.isclose(sum(np.exp(v.before[ord("b")])), 1, rel_tol=1e-9)
    group = [b for b in range(256) if b % lm.BUCKETS == ord("b") % lm.BUCKETS]
    assert math.isclose(sum(math.exp(v.last[b]) for b in group), 1, rel_tol=1e-9)
    assert math.isclose(v.spelled(b"ab"), v.last[ord("b")] + v.before[ord("b")][ord("a")] + v.before[ord("a")][lm.START])
    assert v.spelled(b"aab") > v.spelled(b"qqb")
    codes = lm.Codes(v)
    ids, spelled = codes.of("common aab zq aab")
    assert ids.tolist() == [0, lm.bucket(b"aab"), lm.bucket(b"zq"), lm.bucket(b"aab")] and math.isclose(spelled, 2 * v.spelled(b"aab") + v.spelled(b"zq"))


def test_lm_codes_start_anew_and_hold_long_texts(monkeypatch):
    monkeypatch.setattr(lm, "TABLE_WORDS", 4)
    last, before = lm.spelling(np.zeros((256, 257)), np.zeros(256))
    codes = lm.Codes(lm.Vocabulary({b"x": 0}, np.ones(lm.VOCAB), last, before))
    for text in ("x a b c", " ".join(f"r{i}" for i in range(50)), "x a", "", None):
        ids, spelled = codes.of(text)
        w = lm.words(text)
        assert ids.tolist() == [0 if y == b"x" else lm.bucket(y) for y in w] and math.isclose(spelled, sum(codes.vocabulary.spelled(y) for y in w if y != b"x"))


def test_lm_learns_order(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join("one two three four five six seven eight".split()[k % 8] for k in range(rng.integers(0, 8), 400))) for i in range(200)]
    shuffled = [(1000 + i, " ".join(rng.permutation(t.split()))) for i, (_, t) in enumerate(rows[:20])]
    d = spark.createDataFrame(rows + shuffled + [(5000, None), (5001, ""), (None, "one two"), (5002, "three four " * 100_000)], "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS score")
    out = {r.doc_id: r for r in lm.score(d).collect()}
    assert len(out) == 224 and out[5000].score == 0 and out[5000].mean_score is None and out[None].n_tokens == 2
    ordered, mixed = (np.mean([out[i].mean_score for i in ix]) for ix in (range(20), range(1000, 1020)))
    assert ordered > mixed + 0.5 and ordered > math.log(1 / 8) + 0.5
    assert lm.score(d.limit(0)).count() == 0
