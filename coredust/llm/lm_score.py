"""Language-model scores by masked pseudo-likelihood, with a bidirectional window network in numpy.

Every token is predicted from the ``RADIUS`` tokens on either side of it; a document's score is the sum of the natural
logarithms of those conditional probabilities. Tokens are lower-cased words. The ``VOCAB - BUCKETS`` most frequent words
of the corpus are predicted as such: first a class of ``WIDE`` words that are next to each other by frequency, then the
word within its class, both from the window. Any other word is predicted as one of ``BUCKETS`` buckets by its last byte,
and then spelled from its end: every byte, and the start at last, from the byte after it. The spelling is counted over
all such words of the corpus, so a word that looks like none of them scores lower than one of common pieces.

All documents take part. Words and spelling are counted over the whole corpus. The network is trained in ``ROUNDS``
rounds, in which every position of every document is used once (those whose index leaves the round's number as the
remainder): each partition trains a copy and the copies are averaged by the number of positions. Copies are summed as
integers in two steps, chunk by chunk of the parameters, so no task and not the driver holds more than one network at a
time, and the order of the sums makes no difference. The averaged network does depend on which documents share a
partition; over the same files with the same settings reruns give the same one.

Edge cases: a null or empty text has no tokens and score 0, with a null mean; texts shorter than a window are padded;
repeated rows get equal scores; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

CLASSES, WIDE = 64, 64
VOCAB, BUCKETS = CLASSES * WIDE, 32
PAD = VOCAB
RADIUS, HIDDEN = 2, 16
ROUNDS, BATCH, RATE, SEED = 2, 4096, 0.1, 3
#: Positions whose windows are held at once, and that are scored at once; scale of summed parameters; chunks of the parameters, and in how many parts each is summed first.
BLOCK, PIECE, SCALE, CHUNKS, PARTS = 1 << 16, 1 << 12, 1 << 14, 16, 16
#: Distinct words that a task counts before it hands its partial counts on, and codes of words that it keeps.
COUNTER_WORDS, TABLE_WORDS = 500_000, 300_000
#: The symbol before the first byte of a word.
START = 256


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def bucket(word: bytes) -> int:
    return VOCAB - BUCKETS + word[-1] % BUCKETS


# --- network ---------------------------------------------------------------------------------------------------------


@dataclass
class Net:
    """Window tables (a row per place and context id), hidden bias, and the weights and biases of classes and words."""

    tables: np.ndarray  # 2*RADIUS x (VOCAB+1) x HIDDEN
    hidden: np.ndarray
    top: np.ndarray  # HIDDEN x CLASSES
    top_bias: np.ndarray
    low: np.ndarray  # CLASSES x HIDDEN x WIDE
    low_bias: np.ndarray  # CLASSES x WIDE

    SHAPES = ((2 * RADIUS, VOCAB + 1, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (CLASSES, HIDDEN, WIDE), (CLASSES, WIDE))

    @staticmethod
    def start(counts: np.ndarray) -> "Net":
        """Small random weights, and the corpus's own frequencies as biases."""
        rng = np.random.default_rng(SEED)
        n = (counts + 1.0).reshape(CLASSES, WIDE)
        first = [rng.normal(0, 0.1, s) if len(s) > 1 else np.zeros(s) for s in Net.SHAPES]
        first[3], first[5] = np.log(n.sum(1) / n.sum()), np.log(n / n.sum(1, keepdims=True))
        return Net(*(x.astype(np.float32) for x in first))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.tables, self.hidden, self.top, self.top_bias, self.low, self.low_bias

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    @staticmethod
    def from_flat(x: np.ndarray) -> "Net":
        cuts = np.cumsum([int(np.prod(s)) for s in Net.SHAPES])[:-1]
        return Net(*(p.reshape(s).astype(np.float32) for p, s in zip(np.split(x, cuts), Net.SHAPES, strict=True)))

    def hide(self, context: np.ndarray) -> np.ndarray:
        h = self.tables[0].take(context[:, 0], axis=0)
        for k in range(1, 2 * RADIUS):
            h += self.tables[k].take(context[:, k], axis=0)
        return np.tanh(h + self.hidden)

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """ln P(target | context) for every row."""
        order, cuts = by_class(target)
        h, y = self.hide(context[order]), target[order].astype(np.intp)
        out = np.empty(len(y), np.float32)
        first = _log_softmax_at(h @ self.top + self.top_bias, y // WIDE, _bound(self.top, self.top_bias))
        out[order] = first + _log_softmax_at(self._words(h, cuts), y % WIDE, _bound(self.low, self.low_bias))
        return out

    def _words(self, h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """What is said for each word of a row's own class; rows are sorted by class."""
        z = self.low_bias.repeat(np.diff(cuts), 0)
        for c in np.flatnonzero(np.diff(cuts)).tolist():
            rows = slice(cuts[c], cuts[c + 1])
            z[rows] += h[rows] @ self.low[c]
        return z

    def step(self, context: np.ndarray, target: np.ndarray, square: "Net") -> None:
        """One Adagrad step on a minibatch; changes the net and the sums of squares in place."""
        order, cuts = by_class(target)
        c, y, n = context[order], target[order].astype(np.intp), len(target)
        h = self.hide(c)
        p, q = _softmax(h @ self.top + self.top_bias, _bound(self.top, self.top_bias)), _softmax(self._words(h, cuts), _bound(self.low, self.low_bias))
        rows = np.arange(n)
        p[rows, y // WIDE] -= 1
        q[rows, y % WIDE] -= 1
        p /= n
        q /= n
        dh = p @ self.top.T
        low, low_bias = np.zeros_like(self.low), np.zeros_like(self.low_bias)
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            rows = slice(cuts[k], cuts[k + 1])
            dh[rows] += q[rows] @ self.low[k].T
            np.matmul(h[rows].T, q[rows], out=low[k])
            q[rows].sum(0, out=low_bias[k])
        dh *= 1 - h * h
        _adagrad(self.low, low, square.low)
        _adagrad(self.low_bias, low_bias, square.low_bias)
        _adagrad(self.top, h.T @ p, square.top)
        _adagrad(self.top_bias, p.sum(0), square.top_bias)
        _adagrad(self.hidden, dh.sum(0), square.hidden)
        for k in range(2 * RADIUS):
            by = np.argsort(c[:, k], kind="stable")
            ids = c[by, k]
            first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            g, seen = np.add.reduceat(dh[by], first, axis=0), ids[first]
            s = square.tables[k][seen] + g * g
            square.tables[k][seen] = s
            self.tables[k][seen] -= RATE * g / np.sqrt(s)


def _adagrad(w: np.ndarray, g: np.ndarray, s: np.ndarray) -> None:
    s += g * g
    w -= RATE * g / np.sqrt(s)


#: Up to this, exp neither overflows nor loses all of a row in single precision.
SAFE = 60.0


def _bound(w: np.ndarray, bias: np.ndarray) -> float:
    """What no |h @ w + bias| exceeds, as every |h| is at most one."""
    return float((np.abs(w).sum(-2) + np.abs(bias)).max())


def _exp(z: np.ndarray, bound: float) -> np.ndarray:
    """exp(z) in place; rows are shifted by their maximum where the bound says that they may have to be."""
    if bound > SAFE:
        z -= z.max(1, keepdims=True)
    return np.exp(z, out=z)


def _softmax(z: np.ndarray, bound: float) -> np.ndarray:
    _exp(z, bound)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def _log_softmax_at(z: np.ndarray, at: np.ndarray, bound: float) -> np.ndarray:
    rows = np.arange(len(z))
    if bound > SAFE:
        z -= z.max(1, keepdims=True)
    hit = z[rows, at]
    return hit - np.log(_exp(z, 0.0) @ np.ones(z.shape[1], z.dtype))


def by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in order of their target's class, and where each class begins among them."""
    c = (target // WIDE).astype(np.uint8)
    return np.argsort(c, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(c, minlength=CLASSES))))


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context ids (left to right, without the middle), targets and places of all tokens; outside a text is PAD."""
    gap = np.full(RADIUS, PAD, np.uint16)
    line = np.concatenate([gap, *(x for t in texts for x in (t, gap))])
    at = np.flatnonzero(line != PAD)
    return np.stack([line[at + k] for k in range(-RADIUS, RADIUS + 1) if k], 1), line[at], at


def _blocks(texts: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Texts in lists of about BLOCK tokens."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= BLOCK:
            yield held
            held, n = [], 0
    if held:
        yield held


# --- counts and codes ------------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents: counted per task first, then summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])
        for b in batches:
            for t in b.column(0):
                c.update(words(t.as_py()))
                if len(c) > COUNTER_WORDS:
                    yield emit()
                    c.clear()
        yield emit()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The words with ids of their own, how often every id occurs, and what rare words are spelled like."""

    ids: dict[bytes, int]
    counts: np.ndarray
    last: list[float]  # ln P(last byte | bucket) by byte
    before: list[list[float]]  # by byte after, then byte or START: ln P

    def spelled(self, word: bytes) -> float:
        """ln P(word | its bucket): its last byte, then each byte and the start from the byte after it."""
        total, left = self.last[word[-1]], START
        for byte in word:
            total += self.before[byte][left]
            left = byte
        return total


def spelling(pairs: np.ndarray, last: np.ndarray) -> tuple[list[float], list[list[float]]]:
    """The logarithms of smoothed shares, from counts of (byte after, byte) and of last bytes."""
    before = np.log((pairs + 0.5) / (pairs + 0.5).sum(1, keepdims=True))
    n, group = last + 0.5, np.arange(256) % BUCKETS
    return np.log(n / np.bincount(group, n)[group]).tolist(), before.tolist()


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    counts = materialize(counts, "lm-words")
    own = counts.orderBy(F.desc("n"), "word").limit(VOCAB - BUCKETS).collect()
    ids = {bytes(r["word"]): i for i, r in enumerate(own)}
    known = frozenset(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The counts of a task: (byte after, byte), with 256 as the byte after for a last byte."""
        found = np.zeros((257, 257), np.int64)
        for b in batches:
            rare = [(w, n) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if w not in known]
            if rare:
                size = np.array([len(w) for w, _ in rare])
                line = np.frombuffer(b"".join(w for w, _ in rare), np.uint8).astype(np.intp)
                n = np.array([n for _, n in rare])
                ends = np.cumsum(size)
                left, right = np.concatenate(([START], line[:-1])), line
                left[ends[:-1]] = START  # the first byte of every word
                found += np.bincount(right * 257 + left, np.repeat(n, size), 257 * 257).astype(np.int64).reshape(257, 257)
                found[256] += np.bincount(line[ends - 1], n, 257).astype(np.int64)
        after, byte = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(after, pa.int32()), pa.array(byte, pa.int32()), pa.array(found[after, byte])], names=["after", "byte", "n"])

    # At most 257 * 257 rows.
    pairs = np.zeros((257, 257))
    for r in counts.mapInArrow(run, "after int, byte int, n long").groupBy("after", "byte").agg(F.sum("n").alias("n")).collect():
        pairs[r["after"], r["byte"]] = r["n"]
    last, before = spelling(pairs[:256], pairs[256, :256])
    per = np.zeros(VOCAB)
    per[: len(own)] = [r["n"] for r in own]
    per[VOCAB - BUCKETS :] = np.bincount(np.arange(256) % BUCKETS, pairs[256, :256])
    return Vocabulary(ids, per, last, before)


class Codes(dict):
    """Word -> place in ``ids`` and ``spelled``; rare words are added as they come, the bounded table starts anew if full."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.update(self.vocabulary.ids)
        n = len(self)
        self.size = n
        self.ids, self.spelled = np.zeros(n + TABLE_WORDS, np.uint16), np.zeros(n + TABLE_WORDS)
        self.ids[:n] = np.arange(n)

    def __missing__(self, word: bytes) -> int:
        if self.size == len(self.ids):  # a text with more rare words than the table holds
            grown = len(self.ids)
            self.ids, self.spelled = np.append(self.ids, np.zeros(grown, np.uint16)), np.append(self.spelled, np.zeros(grown))
        i = self[word] = self.size
        self.ids[i], self.spelled[i] = bucket(word), self.vocabulary.spelled(word)
        self.size += 1
        return i

    def of(self, text: str | None) -> tuple[np.ndarray, float]:
        """The ids of a text and what its rare words add by their spelling."""
        w = words(text)
        if self.size + min(len(w), TABLE_WORDS) > len(self.vocabulary.ids) + TABLE_WORDS:
            self.reset()
        at = np.fromiter(map(self.__getitem__, w), np.intp, len(w))
        return self.ids[at], float(self.spelled[at].sum())


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids, spelled): two bytes a token, and the logarithm of the rare words' spelling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(vocabulary)
        for b in batches:
            ids, spelled = zip(*(codes.of(t.as_py()) for t in b.column(1)), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary()), pa.array(spelled, pa.float64())], names=["doc_id", "ids", "spelled"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, spelled double")


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py() or b"", "<u2") for x in column]


# --- training and scoring --------------------------------------------------------------------------------------------


def train_local(net: Net, texts: Iterator[np.ndarray], round_: int, rounds: int) -> int:
    """Train ``net`` in place on the round's positions of all texts, and say how many they were."""
    square = Net(*(np.full_like(x, 1e-2) for x in net.parts()))
    rng = np.random.default_rng(SEED)
    total = seen = 0
    for held in _blocks(texts):
        context, target, _ = windows(held)
        mine = np.arange((round_ - seen) % rounds, len(target), rounds)
        seen += len(target)
        mine = rng.permutation(mine)
        for at in range(0, len(mine), BATCH):
            net.step(context[mine[at : at + BATCH]], target[mine[at : at + BATCH]], square)
        total += len(mine)
    return total


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (c, part, w, n) to one row a chunk c and part, added up as they come."""
    held: dict[tuple[int, int], list] = {}
    for b in batches:
        for c, part, w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
            x = held.setdefault((c, part), [0, 0])
            x[0], x[1] = x[0] + np.frombuffer(w.as_buffer(), np.int64), x[1] + n
    for (c, part), (w, n) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([part], pa.int32()), pa.array([w.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["c", "part", "w", "n"])


def train(ids: DataFrame, counts: np.ndarray, rounds: int = ROUNDS) -> Net:
    """Average the copies that all partitions train, ``rounds`` times."""
    net, kind = Net.start(counts), "c int, part int, w binary, n long"
    for r in range(rounds):
        flat = net.flat()

        def run(batches: Iterator[pa.RecordBatch], flat=flat, r=r) -> Iterator[pa.RecordBatch]:
            mine = Net.from_flat(flat)
            n = train_local(mine, (x for b in batches for x in _ids(b.column(0))), r, rounds)
            if n:
                part = int(n % 1000003) % PARTS  # any spread will do
                for c, w in enumerate(np.array_split(np.round(mine.flat().astype(np.float64) * SCALE).astype(np.int64) * n, CHUNKS)):
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([part], pa.int32()), pa.array([w.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["c", "part", "w", "n"])

        each = ids.select("ids").mapInArrow(run, kind)
        some = each.repartition("c", "part").mapInArrow(_summed, kind).withColumn("part", F.lit(0))
        rows = some.repartition("c").mapInArrow(_summed, kind).orderBy("c").collect()
        if rows:  # one network
            net = Net.from_flat(np.concatenate([np.frombuffer(x["w"], np.int64) / (x["n"] * SCALE) for x in rows]))
    return net


def scores(net: Net, texts: list[np.ndarray]) -> np.ndarray:
    """The sum of ln P of every text's tokens."""
    out = np.zeros(len(texts))
    size = np.array([len(t) for t in texts], np.int64)
    if not size.sum():
        return out
    context, target, _ = windows(texts)
    logs = np.concatenate([net.log_probs(context[at : at + PIECE], target[at : at + PIECE]) for at in range(0, len(target), PIECE)])
    full = size > 0
    out[full] = np.add.reduceat(logs.astype(np.float64), (np.cumsum(size) - size)[full])
    return out


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, score, mean_score of every whole text, by a network trained on all of ``docs``."""
    vocabulary = vocabulary_of(word_counts(docs))
    ids = materialize(encoded(docs, vocabulary), "lm-ids")
    return score_ids(ids, train(ids, vocabulary.counts))


def score_ids(ids: DataFrame, net: Net) -> DataFrame:
    flat = net.flat()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Net.from_flat(flat)
        for b in batches:
            texts = _ids(b.column(1))
            total = np.concatenate([np.zeros(0), *(scores(own, held) for held in _blocks(iter(texts)))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(total + b.column(2).to_numpy(zero_copy_only=False))], names=["doc_id", "n_tokens", "score"])

    kind = ids.schema["doc_id"].dataType.simpleString()
    out = ids.select("doc_id", "ids", "spelled").mapInArrow(run, f"doc_id {kind}, n_tokens long, score double")
    return out.withColumn("mean_score", F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens")))
