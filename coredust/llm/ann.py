"""Approximate nearest neighbours by largest inner product, with score-aware anisotropic quantisation.

Vectors are product-quantised: pairs of dimensions, sixteen centres each (four bits). The loss weighs the part of the
residual parallel to the vector more than the rest, as only that part biases large inner products; codes are chosen by
coordinate descent and centres by the matching weighted least squares. Two codes share a byte. A query's products with
all centres make its tables; scanning sums one table entry a byte. The best ``RERANK`` of a partition are scored with the
exact inner product in double precision; the least of their ``k`` best scores is a floor. A scanned score is off by at
most the query's norm times the row's quantisation error, so every row whose bound reaches the floor is scored as well:
no true neighbour is cut, and the result depends neither on the partitions nor on ``RERANK``.

The codebook is fitted on at most ``TRAIN_ROWS`` vectors (those with the smallest hash of vec_id); every vector is
indexed. Queries come in blocks of about ``QUERY_BLOCK``, each scanned against all rows; a block is what is broadcast, so
its size is bounded however many queries there are.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; shorter vectors than
the longest count as if zeros followed, which leaves every inner product over the common length as it is; rows that repeat a vec_id are candidates each, none is a neighbour of a query with that id, and the query is the
least of their vectors; equal scores go
to the smaller vec_id; with fewer candidates than asked for, all are returned; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

K = 20
CENTRES, SUB = 16, 2
TRAIN_ROWS = 20_000
#: Cosine from which inner products matter; it sets the weight of the parallel residual.
THRESHOLD = 0.2
ROUNDS, SWEEPS = 6, 2
#: Candidates of each partition that are scored exactly for a floor, and rows that a partition of the index holds at most, about.
RERANK = 160
PARTITION_ROWS = 250_000
QUERY_BLOCK = 2048
#: Share of the product of norms by which single precision may blur a scanned score, and rows scored exactly at once.
BLUR, PIECE = 1e-5, 1 << 14
SEED = 11


def parallel_weight(dim: int, threshold: float = THRESHOLD) -> float:
    """How many times more the parallel residual counts than the orthogonal one, at least once."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


@dataclass
class Codebook:
    centres: np.ndarray  # subspaces x CENTRES x SUB
    eta: float

    def _padded(self, x: np.ndarray) -> np.ndarray:
        m = self.centres.shape[0]
        out = np.zeros((len(x), m * SUB), np.float32)
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), m, SUB)

    def assign(self, vectors: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
        """Codes (rows x subspaces) by coordinate descent on the anisotropic loss."""
        x = self._padded(vectors)
        unit = x / np.maximum(np.linalg.norm(x.reshape(len(x), -1), axis=1), 1e-30)[:, None, None]
        m = len(self.centres)
        codes = np.stack([((x[:, s, None, :] - self.centres[s]) ** 2).sum(-1).argmin(1) for s in range(m)], 1)
        par = np.stack([((x[:, s] - self.centres[s][codes[:, s]]) * unit[:, s]).sum(1) for s in range(m)], 1)
        total = par.sum(1)
        for _ in range(sweeps):
            for s in range(m):
                r = x[:, s, None, :] - self.centres[s]
                p = (r * unit[:, s, None, :]).sum(-1)
                loss = (r**2).sum(-1) + (self.eta - 1) * ((total - par[:, s])[:, None] + p) ** 2
                codes[:, s] = loss.argmin(1)
                new = np.take_along_axis(p, codes[:, s, None], 1)[:, 0]
                total += new - par[:, s]
                par[:, s] = new
        return codes.astype(np.uint8)

    def packed(self, vectors: np.ndarray) -> np.ndarray:
        codes = self.assign(vectors)
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return codes[:, ::2] << 4 | codes[:, 1::2]

    def tables(self, query: np.ndarray) -> np.ndarray:
        """For each byte of a code, 256 sums of products of the query with the two centres."""
        q = self._padded(query[None, :])[0]
        t = np.einsum("msd,md->ms", self.centres, q)
        if len(t) % 2:
            t = np.pad(t, ((0, 1), (0, 0)))
        return (t[::2, :, None] + t[1::2, None, :]).reshape(len(t) // 2, 256).astype(np.float32)


def fit(sample: np.ndarray) -> Codebook:
    """Alternate anisotropic codes and weighted least-squares centres over a sample of vectors."""
    rng = np.random.default_rng(SEED)
    n, dim = sample.shape
    m = -(-dim // SUB)
    book = Codebook(np.zeros((m, CENTRES, SUB), np.float32), parallel_weight(dim))
    x = book._padded(sample)
    unit = x / np.maximum(np.linalg.norm(x.reshape(n, -1), axis=1), 1e-30)[:, None, None]
    for s in range(m):
        book.centres[s] = x[rng.choice(n, CENTRES, replace=n < CENTRES), s]
    for _ in range(ROUNDS):
        codes = book.assign(sample)
        residual = x - np.stack([book.centres[s][codes[:, s]] for s in range(m)], 1)
        par = (residual * unit).sum(2)
        total = par.sum(1)
        for s in range(m):
            other = total - par[:, s]
            for c in range(CENTRES):
                mine = codes[:, s] == c
                if not mine.any():
                    continue
                u, v = unit[mine, s].astype(np.float64), x[mine, s].astype(np.float64)
                left = mine.sum() * np.eye(SUB) + (book.eta - 1) * u.T @ u
                right = v.sum(0) + (book.eta - 1) * (u * (other[mine] + (v * u).sum(1))[:, None]).sum(0)
                book.centres[s, c] = np.linalg.solve(left, right)
            new = ((x[:, s] - book.centres[s][codes[:, s]]) * unit[:, s]).sum(1)
            total += new - par[:, s]
            par[:, s] = new
    return book


def usable(vector: Column) -> Column:
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array, dtype=np.float32) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def build_index(vectors: DataFrame) -> tuple[DataFrame, Codebook | None]:
    """(vec_id, embedding, code) of every usable vector, and the codebook (None if there is no vector)."""
    rows = vectors.select("vec_id", "embedding").filter(usable(F.col("embedding")))
    size = F.size("embedding")
    n, least, d = rows.agg(F.count(F.lit(1)), F.min(size), F.max(size)).first()
    if not n:
        return rows.withColumn("code", F.lit(b"")), None
    if least < d:
        zero = F.lit(0).cast(rows.schema["embedding"].dataType.elementType)
        rows = rows.withColumn("embedding", F.concat("embedding", F.array_repeat(zero, F.lit(d) - size)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRAIN_ROWS).select("embedding").toArrow().column(0).combine_chunks()
    book = fit(_matrix(sample))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                code = pa.array([c.tobytes() for c in book.packed(_matrix(b.column(1)))], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns, code], names=["vec_id", "embedding", "code"])

    id_kind, kind = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "embedding"))
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // PARTITION_ROWS))
    return materialize(rows.repartition(parts).mapInArrow(encode, f"vec_id {id_kind}, embedding {kind}, code binary"), "ann-index"), book


def _errors(book: Codebook, exact: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """By how much a scanned score of a query of norm one can be off, for every row: the norm of its residual, and blur."""
    m = len(book.centres)
    codes = np.stack((packed >> 4, packed & 15), 2).reshape(len(packed), -1)[:, :m]
    out = np.empty(len(exact))
    for at in range(0, len(exact), PIECE):
        x, c = exact[at : at + PIECE], codes[at : at + PIECE]
        rec = book.centres[np.arange(m), c].reshape(len(c), -1).astype(np.float64)
        padded = np.pad(x, ((0, 0), (0, rec.shape[1] - x.shape[1])))
        blur = BLUR * (np.linalg.norm(x, axis=1) + np.sqrt((rec**2).reshape(len(c), m, SUB).sum(2)).sum(1))
        out[at : at + PIECE] = np.linalg.norm(padded - rec, axis=1) + blur
    return out


def _scan(batches: Iterator[pa.RecordBatch], book: Codebook, ids: np.ndarray, queries: np.ndarray, k: int, rerank: int) -> Iterator[pa.RecordBatch]:
    """The exact ``k`` best of one partition for every query of a block; ``rerank`` candidates set the floor."""
    table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if table is None:
        return
    table = table.sort_by("vec_id")  # equal scores: the smaller vec_id first
    vec_id = table.column("vec_id").to_numpy()
    exact = _matrix(table.column("embedding").combine_chunks(), np.float64)
    code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(table), -1)
    where = code.astype(np.intp) + np.arange(code.shape[1]) * 256
    error, rerank = _errors(book, exact, code), max(rerank, k)

    def scored(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        pieces = [(exact[rows[at : at + PIECE]] * query).sum(1) for at in range(0, len(rows), PIECE)]
        return np.concatenate([np.zeros(0), *pieces])

    for qi in range(len(ids)):
        near = book.tables(queries[qi].astype(np.float32)).ravel().take(where).sum(1)
        near[vec_id == ids[qi]] = -np.inf
        pick = np.arange(len(near))
        if len(near) > rerank:
            first = np.argpartition(near, len(near) - rerank)[len(near) - rerank :]
            first = first[near[first] > -np.inf]
            if len(first) >= k:
                floor = np.partition(scored(first, queries[qi]), len(first) - k)[len(first) - k]
                pick = np.flatnonzero(near + np.linalg.norm(queries[qi]) * error >= floor)
        pick = pick[near[pick] > -np.inf]
        score = scored(pick, queries[qi])
        best = np.lexsort((vec_id[pick], -score))[:k]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), ids[qi])), pa.array(vec_id[pick][best]), pa.array(score[best])], names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, is_query: Column, k: int = K, rerank: int = RERANK, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every usable row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    index, book = build_index(vectors.filter(F.col("vec_id").isNotNull()))
    asked = index.filter(is_query).select("vec_id", "embedding")
    n = asked.select("vec_id").distinct().count() if book is not None else 0
    blocks = -(-n // block)
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for b in range(blocks):
        # About ``block`` queries by hash; the count above bounds what is sent.
        mine = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy("vec_id").toArrow()
        ids, qs = mine.column(0).to_numpy(), _matrix(mine.column(1).combine_chunks(), np.float64)
        sent = spark.sparkContext.broadcast((book, ids, qs))
        part = index.mapInArrow(lambda it, sent=sent: _scan(it, *sent.value, k, rerank), "query_id long, vec_id long, score double")
        found = found.unionByName(materialize(part, "ann-found") if blocks > 1 else part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
