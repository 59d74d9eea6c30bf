"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of ``WIDTH`` bytes slide over the whole UTF-8 text. A filter is a table of weights by (offset, byte), so
a convolution is ``WIDTH`` table look-ups and sums. Responses are max-pooled over chunks of two strips; each chunk shares
a strip with the next, so chunks overlap by half and cover the document. The mean and the maximum over a document's
chunks feed one logistic unit, which gives the probability.

Training uses a bounded sample of labelled rows: those with the smallest hash of doc_id, at most ``TRAIN_DOCS`` of them
and ``TRAIN_BYTES`` of text in all (a row that goes beyond that is left out). Whole texts are trained on and scored. Only
the text is an input.

Edge cases: a null or empty text is one chunk of padding and gets a score like any other; labels that are null are left
out; with no labelled rows, or only one class, every score is the smoothed share of label 1; repeated rows get equal
scores; a null doc_id counts as the empty key; an empty table gives an empty result; extra columns are ignored by
``score`` (``keep`` carries some).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS, WIDTH, STRIP = 32, 6, 256
TRAIN_DOCS, TRAIN_BYTES = 3000, 64 << 20
EPOCHS, BATCH, RATE, DECAY, SEED = 8, 64, 0.02, 1e-3, 7
THRESHOLD = 0.3
#: Bytes whose responses are held at once.
BLOCK = 64 * STRIP


@dataclass
class Net:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    mean_w: np.ndarray
    max_w: np.ndarray
    out: float

    def strips(self, data: bytes) -> np.ndarray:
        """The largest response of every filter in every strip of ``STRIP`` bytes, before the bias."""
        x = np.frombuffer(data + b"\0" * WIDTH, np.uint8)
        n = len(x) - WIDTH + 1
        rows = []
        for lo in range(0, n, BLOCK):
            hi = min(n, lo + BLOCK)
            r = self.filters[0].take(x[lo:hi], axis=0)
            for k in range(1, WIDTH):
                r += self.filters[k].take(x[lo + k : hi + k], axis=0)
            rows.append(np.maximum.reduceat(r, np.arange(0, hi - lo, STRIP), axis=0))
        return np.concatenate(rows)

    def chunks(self, data: bytes) -> np.ndarray:
        s = self.strips(data)
        pooled = np.maximum(s[:-1], s[1:]) if len(s) > 1 else s
        return np.maximum(pooled + self.bias, 0)

    def score(self, text: str | None) -> float:
        v = self.chunks((text or "").encode("utf-8"))
        z = float(v.mean(0) @ self.mean_w + v.max(0) @ self.max_w) + self.out
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def constant(share: float) -> Net:
    """A net that gives every text the same score."""
    zero = np.zeros(FILTERS, np.float32)
    return Net(np.zeros((WIDTH, 256, FILTERS), np.float32), zero, zero, zero, float(np.log(share / (1 - share))))


def _strip_rows(data: bytes) -> np.ndarray:
    """A row for every strip: its bytes and the ``WIDTH`` after it."""
    x = np.frombuffer(data + b"\0" * (WIDTH + STRIP + WIDTH), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(x, STRIP + WIDTH)[: len(data) + 1 : STRIP]


def _peaks(filters: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest response of every filter in every strip, and where; strips have ``sizes`` places."""
    best, where = (np.empty((len(rows), FILTERS), kind) for kind in (np.float32, np.int64))
    for lo in range(0, len(rows), BLOCK // STRIP):
        x = rows[lo : lo + BLOCK // STRIP]
        r = filters[0].take(x[:, :STRIP], axis=0)
        for k in range(1, WIDTH):
            r += filters[k].take(x[:, k : k + STRIP], axis=0)
        r[np.arange(STRIP) >= sizes[lo : lo + len(x), None]] = -np.inf
        at = r.argmax(1)
        where[lo : lo + len(x)], best[lo : lo + len(x)] = at, np.take_along_axis(r, at[:, None, :], 1)[:, 0, :]
    return best, where


def gradients(p: dict[str, np.ndarray], texts: Sequence[bytes], y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean logistic loss of a batch and its gradient; only the winning place of each filter and chunk gets one."""
    each = [_strip_rows(t) for t in texts]
    rows = np.concatenate(each)
    sizes = np.concatenate([np.minimum(STRIP, len(t) + 1 - np.arange(0, len(t) + 1, STRIP)) for t in texts])
    best, where = _peaks(p["filters"], rows, sizes)
    # A chunk is a strip and the next one of its text, or the only strip; it takes the greater response.
    count = np.array([len(e) for e in each])
    first = np.cumsum(count) - count
    chunks = np.maximum(count - 1, 1)
    of = np.repeat(np.arange(len(texts)), chunks)
    start = np.cumsum(chunks) - chunks
    left = np.arange(len(of)) - start[of] + first[of]
    right = np.where(count[of] > 1, left + 1, left)
    strip = np.where(best[left] >= best[right], left[:, None], right[:, None])
    v = np.maximum(np.take_along_axis(best, strip, 0) + p["bias"], 0)
    mean, peak = np.add.reduceat(v, start, axis=0) / chunks[:, None], np.maximum.reduceat(v, start, axis=0)
    z = mean @ p["mean_w"] + peak @ p["max_w"] + p["out"][0]
    loss = float(np.mean(np.logaddexp(0, z) - y * z))
    dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
    dv = (dz[:, None] * p["mean_w"] / chunks[:, None])[of]
    # The first chunk that reaches a text's peak gets its gradient.
    at_peak = v == peak[of]
    seen = np.cumsum(at_peak, axis=0)
    before = (seen - at_peak)[start]
    dv = np.where(at_peak & (seen - before[of] == 1), dv + (dz[:, None] * p["max_w"])[of], dv) * (v > 0)
    g = {"bias": dv.sum(0), "mean_w": dz @ mean, "max_w": dz @ peak, "out": np.array([dz.sum()])}
    place, f_ix = np.take_along_axis(where, strip, 0), np.arange(FILTERS)
    g["filters"] = np.stack([np.bincount((rows[strip, place + k].astype(np.int64) * FILTERS + f_ix).ravel(), dv.ravel(), 256 * FILTERS).reshape(256, FILTERS) for k in range(WIDTH)])
    return loss, g


def start(share: float) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    p = {"filters": rng.normal(0, 0.1, (WIDTH, 256, FILTERS)), "bias": np.zeros(FILTERS), "mean_w": rng.normal(0, 0.1, FILTERS), "max_w": rng.normal(0, 0.1, FILTERS), "out": np.array([np.log(share / (1 - share))])}
    return {k: x.astype(np.float32) for k, x in p.items()}


def fit(texts: Sequence[bytes], labels: Sequence[int]) -> Net:
    """Adam on the logistic loss over whole texts, with weights drawn towards zero."""
    y = np.asarray(labels, np.float32)
    share = (float(y.sum()) + 1) / (len(y) + 2)
    if len(y) == 0 or y.min() == y.max():
        return constant(share)
    rng, p = np.random.default_rng(SEED), start(share)
    m, s, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for b in range(0, len(y), BATCH):
            ix = order[b : b + BATCH]
            _, g = gradients(p, [texts[i] for i in ix], y[ix])
            t += 1
            for k in ("filters", "mean_w", "max_w"):
                g[k] = g[k] + DECAY * p[k]
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - RATE / (1 + epoch) ** 0.5 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Net(p["filters"], p["bias"], p["mean_w"], p["max_w"], float(p["out"][0]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, max_bytes: int = TRAIN_BYTES) -> Net:
    """Fit on at most ``max_docs`` labelled rows and ``max_bytes`` of text that are not held out."""
    known = labels.select(F.col("doc_id").alias("_id"), "quality").filter(F.col("quality").isNotNull() & ~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    # At most max_docs ids and labels: that bound makes the broadcast safe at any scale.
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", raw.alias("raw")).join(F.broadcast(known), F.col("doc_id") == F.col("_id")).filter(F.length("raw") <= max_bytes)
    # One row a doc_id, however often it is repeated; then at most max_docs rows, taken while their bytes last.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.col("quality").cast("int").alias("quality"), "raw")).alias("x"))
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = rows.withColumn("sum", F.sum(F.length("x.raw").cast("long")).over(order)).filter(F.col("sum") <= max_bytes)
    got = rows.select("doc_id", "x.*").toArrow().to_pylist()
    got.sort(key=lambda r: str(r["doc_id"]))
    return fit([r["raw"] for r in got], [r["quality"] for r in got])


def score(docs: DataFrame, net: Net, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``score`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = pa.array([net.score(t.as_py()) for t in b.column(0)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], s], names=[f"c{i}" for i in range(len(keep))] + ["score"])

    fields = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    out = docs.select("text", *keep).mapInArrow(run, f"{fields}score double")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "score")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are predicted good."""
    names = docs.columns
    out = score(docs, train(docs, labels), keep=names)
    # All of keep comes first, the score last, whatever the columns are called.
    return out.toDF(*(f"_cd_{i}" for i in range(len(names))), "_cd_score").filter(F.col("_cd_score") >= threshold).select(*(F.col(f"_cd_{i}").alias(c) for i, c in enumerate(names)))
