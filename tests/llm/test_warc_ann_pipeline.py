import gzip

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from coredust.llm import ann, queries, warc
from coredust.llm._common import new_path

PAGES = "page_id long, url string, html string"
ROWS = [(3, "http://a/", "<p>é</p>"), (1, "http://b/", "<p>é</p>"), (2, None, ""), (9, "http://c/\r\nX: y", None), (7, "http://d/", "x" * 300_000), (8, "http://e/", "HTTP/1.1 200 OK\r\n\r\nno"), (1, "http://b/", "<p>é</p>")]


def test_round_trip(spark):
    path = new_path(spark, "w")
    d = spark.createDataFrame(ROWS, PAGES).selectExpr("*", "1 AS payload", "2 AS record_type")
    warc.write_pages(d, path)
    out = {(r.page_id, r.record_type): r for r in warc.read_pages(spark, path).collect()}
    assert sorted(out) == [(1, "response"), (2, "response"), (3, "revisit"), (7, "response"), (8, "response"), (9, "revisit")]
    html = {i: (h or "").encode() for i, _, h in ROWS}
    assert all(r.payload_bytes == len(html[i]) and r.payload_digest == warc.digest(html[i]) for (i, _), r in out.items())
    assert out[3, "revisit"].refers_to == 1 and out[9, "revisit"].refers_to == 2 and out[7, "response"].refers_to is None
    assert warc.read_warc(spark, path).filter("target_uri LIKE 'http://d%'").count() == 1
    assert warc.read_warc(spark, path).filter(F.col("record_type").isin("revisit", "warcinfo")).count() == 2


def test_files_are_plain_gzip_and_skip_lengths_are_optional(spark, tmp_path):
    rec = [warc.record("response", f"<urn:x-page:{i}>", f"http://h/{i}", None, b"p" * (i * 5000), warc.digest(b"p" * (i * 5000))) for i in range(5)]
    assert gzip.decompress(b"".join(map(warc.member, rec))) == b"".join(rec)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in rec))
    (tmp_path / "b.warc").write_bytes(b"".join(rec))
    (tmp_path / "_hidden.warc.gz").write_bytes(b"junk")
    out = warc.read_warc(spark, str(tmp_path)).select("record_id", F.length("payload").alias("n"), (F.col("actual_digest") == F.col("payload_digest")).alias("same")).collect()
    assert sorted((r.record_id, r.n) for r in out) == sorted((f"<urn:x-page:{i}>", i * 5000) for i in range(5) for _ in "ab") and all(r.same for r in out)


class Names:
    def __init__(self, *names):
        self.names = names


def read_all(path, names, tests=()):
    reader = warc.WarcReader(str(path), Names(*names), 1 << 20)
    reader.tests = list(tests)
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


def foreign():
    """Records with header names in other cases, odd blocks, and payloads from none to megabytes."""
    rng = np.random.default_rng(1)
    bodies = [b"", b"x", rng.bytes(5000), b"z" * 3_000_000, rng.bytes(1_200_000), b"\r\n\r\n", b"last"]
    out = []
    for i, body in enumerate(bodies):
        block = body if i % 3 == 0 else b"HTTP/1.0 200 OK\r\ncontent-length: %d\r\nX: y\r\n\r\n" % len(body) + body
        head = f"WARC/1.0\r\nwarc-type: {'request' if i == 4 else 'response'}\r\nWARC-RECORD-ID: <urn:{i}>\r\ncontent-LENGTH: {len(block)}\r\nFolded: a\r\n  b\r\n\r\n"
        out.append((head.encode() + block + b"\r\n\r\n", body))
    return out


@pytest.mark.parametrize("kind", ["plain", "one member", "a member a record", "own members", "members that cut records", "padded"])
def test_foreign_archives(tmp_path, kind):
    rec = foreign()
    every = b"".join(r for r, _ in rec)
    cuts = [every[a : a + 700_001] for a in range(0, len(every), 700_001)]
    data = {"plain": every, "one member": gzip.compress(every), "a member a record": b"".join(gzip.compress(r) for r, _ in rec), "own members": b"".join(warc.member(r) for r, _ in rec), "members that cut records": b"".join(map(gzip.compress, cuts)), "padded": gzip.compress(every) + b"\0" * 5000}[kind]
    (tmp_path / ("a.warc" if kind == "plain" else "a.warc.gz")).write_bytes(data)
    got = read_all(tmp_path, ["record_type", "record_id", "payload", "http_length", "headers"])
    assert [(r["record_id"], r["payload"]) for r in got] == [(f"<urn:{i}>", body) for i, (_, body) in enumerate(rec)]
    assert [r["http_length"] for r in got] == [None if i % 3 == 0 else len(body) for i, (_, body) in enumerate(rec)] and ("Folded", "a b") in got[0]["headers"]
    light = read_all(tmp_path, ["record_id"], [("WARC-Type", "in", ("request",))])
    assert [r["record_id"] for r in light] == ["<urn:4>"]
    for limit in (0, 10, len(data) // 2, len(data) - 3):
        (tmp_path / ("a.warc" if kind == "plain" else "a.warc.gz")).write_bytes(data[:limit])
        cut = read_all(tmp_path, ["record_id", "payload"])
        assert cut[:-1] == [{"record_id": r["record_id"], "payload": r["payload"]} for r in got][: max(0, len(cut) - 1)]


def test_a_rejected_large_payload_is_neither_kept_nor_copied_over_and_over(tmp_path):
    import time
    import tracemalloc

    body = np.random.default_rng(0).bytes(24 << 20)
    rec = [warc.record(t, f"<urn:{t}>", "u", None, b"" if t == "revisit" else body, "D") for t in ("response", "revisit")]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(rec[0], 1) + gzip.compress(rec[1]))
    began = time.perf_counter()
    tracemalloc.start()
    got = read_all(tmp_path, ["record_id"], [("WARC-Type", "in", ("revisit",))])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["record_id"] for r in got] == ["<urn:revisit>"] and peak < 8 << 20 and time.perf_counter() - began < 5


def test_rejected_records_are_not_decoded(tmp_path):
    good, bad = warc.record("response", "<urn:a>", "u", None, np.random.default_rng(0).bytes(90_000), "D"), warc.record("revisit", "<urn:b>", "u", "<urn:a>", b"", "D")
    damaged = bytearray(warc.member(good))
    damaged[-2000:-8] = b"\0" * 1992  # its payload cannot be decoded
    (tmp_path / "a.warc.gz").write_bytes(bytes(damaged) + warc.member(bad))
    names = [c.split()[0] for c in warc.WarcDataSource({}).schema().split(", ")]
    assert [r["record_id"] for r in read_all(tmp_path, names, [("WARC-Type", "in", ("revisit",))])] == ["<urn:b>"]


def test_empty_archive(spark):
    path = new_path(spark, "w")
    warc.write_pages(spark.createDataFrame([], PAGES), path)
    assert warc.read_pages(spark, path).count() == 0


def brute(vectors, k=20):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], np.float64)
    return {int(q): ids[[j for j in np.lexsort((ids, -(x @ x[n]))) if ids[j] != q][:k]].tolist() for n, q in enumerate(ids) if q % 20 == 0}


def test_recall_scores_and_blocks(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 24))
    v = [(i, (centres[i % 30] + 0.7 * rng.normal(size=24)).astype(np.float32).tolist()) for i in range(3000)]
    d = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    want = brute([(i, np.float32(x)) for i, x in v])
    for block in (2048, 40):
        out = ann.search(d, F.col("vec_id") % 20 == 0, rerank=60, block=block).toPandas()
        assert len(out) == 150 * 20
        hits = sum(len(set(g.vec_id) & set(want[q])) for q, g in out.groupby("query_id"))
        assert hits / len(out) > 0.9
        x = {i: np.float64(np.float32(e)) for i, e in v}
        assert all(abs(float(x[r.query_id] @ x[r.vec_id]) - r.score) < 1e-9 for r in out.head(500).itertuples())
        assert all((g.sort_values("rank").score.diff().dropna() <= 0).all() and sorted(g["rank"]) == list(range(1, 21)) for _, g in out.groupby("query_id"))


@pytest.mark.parametrize("parts", [1, 7])
def test_no_neighbour_is_cut_whatever_the_partitions(parts):
    """Groups of near copies far larger than the candidates that set the floor, in one partition or several."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 25))
    x = (centres[np.arange(6000) % 4] + 0.05 * rng.normal(size=(6000, 25))).astype(np.float32)
    ids, want = np.arange(6000), brute(list(enumerate(x.astype(np.float64))))
    book, asked = ann.fit(x[:2000]), np.arange(0, 6000, 300)
    found = {int(q): [] for q in asked}
    for p in range(parts):
        mine = ids[ids % parts == p]
        code = pa.array([c.tobytes() for c in book.packed(x[mine])], pa.binary())
        batch = pa.RecordBatch.from_arrays([pa.array(mine), pa.array(x[mine].tolist(), pa.list_(pa.float32())), code], names=["vec_id", "embedding", "code"])
        for out in ann._scan(iter([batch]), book, asked, x[asked].astype(np.float64), 20, 20):
            found[out.column(0)[0].as_py()] += [(-s, v) for v, s in zip(out.column(1).to_pylist(), out.column(2).to_pylist(), strict=True)]
    assert {q: [v for _, v in sorted(r)[:20]] for q, r in found.items()} == {q: want[q] for q in found}


def test_unusable_vectors_ties_and_few(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 2.0]), (20, [1.0, 0.0, 2.0]), (5, [1.0, 0.0, 2.0]), (5, [1.0, 0.0, 2.0]), (6, None), (7, [0.0, 0.0, 0.0]), (8, [nan, 1.0, 1.0]), (9, [inf, 1.0, 1.0]), (10, [None, 1.0, 1.0]), (11, [1.0]), (40, []), (None, [1.0, 1.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS code", "2 AS score")
    out = ann.search(d, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in out] == [(0, 1, 5, 5.0), (0, 2, 5, 5.0), (0, 3, 20, 5.0), (0, 4, 11, 1.0), (20, 1, 0, 5.0), (20, 2, 5, 5.0), (20, 3, 5, 5.0), (20, 4, 11, 1.0)]
    assert ann.search(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_vectors_of_several_lengths_and_a_repeated_query(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=5 + i % 3).astype(np.float32).tolist()) for i in range(400)] + [(20, [9.0, 1.0, 0.0]), (20, [9.0, 0.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = ann.search(d, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    pad = [(i, np.float64([*v, 0, 0, 0, 0][:7])) for i, v in rows]
    for q in range(0, 400, 20):
        mine = min(list(v) for i, v in pad if i == q)  # the least of a repeated id's vectors asks
        want = sorted((-float(np.dot(mine, v)), i) for i, v in pad if i != q)[:20]
        got = [r for r in out if r.query_id == q]
        assert [r.vec_id for r in got] == [i for _, i in want] and np.allclose([-r.score for r in got], [s for s, _ in want])


def test_anisotropic_codes_lower_the_parallel_error():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def parallel(eta):
        book = ann.Codebook(np.random.default_rng(2).normal(0, 0.25, (8, 16, 2)).astype(np.float32), eta)
        codes = book.assign(x)
        rec = np.stack([book.centres[s][codes[:, s]] for s in range(8)], 1).reshape(len(x), -1)
        return float((((x - rec) * x).sum(1) ** 2).mean())

    assert parallel(20.0) < 0.5 * parallel(1.0)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    d = str(tmp_path_factory.mktemp("sf"))
    words = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("an", "or", "is", "et", "um")]
    rows, labels = [], []
    for i in range(400):
        bad = i % 8 == 0
        text = " ".join(rng.choice(["WIN!!", "CASH!!", "|", "$$", "NOW!!"] if bad else words, 60))
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(not bad), 0))
    rows += [(1000 + i, rows[i + 1][1], "en", "s1", 0) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    return d


def test_pipeline(spark, folder):
    """Stage by stage against what was planted, then the whole."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "simhash_near_dedup", "mixing", "bpe"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, folder)
        assert after.columns == docs.columns and after.count() > 0, name
        if name == "quality_classifier":
            clean = {i for i in range(400) if i % 8}
            got = {r.doc_id for r in after.collect()}
            assert len(clean - got) <= 8 and len({i for i in got if i < 400} - clean) <= 2
        if name == "simhash_near_dedup":
            got = [r.doc_id for r in after.collect()]
            assert len(got) == len(set(got)) and not any(i >= 1000 and i - 999 in got for i in got)
        before = after
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == before.count()


def test_all_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(queries.queries()) | {"pipeline"} <= names and set(__spark_entry__.oracle_sql()) <= names


ODD = [(1, None, None, None, None), (None, "a b c d e f g h i j k l", "en", "s", 1), (2, "", "en", None, 0), (2, "one two three four five six seven eight nine ten eleven", None, "s", 2), (2, "one two three four five six seven eight nine ten eleven", None, "s", 2), (3, "word " * 40_000, "fr", "t", 3)]


def test_stages_with_odd_rows_and_none(spark, folder):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame(ODD, schema).selectExpr("*", "'x' AS size", "1 AS kept", "2 AS score", "3 AS fp", "4 AS _bucket", "5 AS passes")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            rows = out.collect()
            assert out.columns == (docs.columns if name != "bpe" else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]), name
            assert rows or docs is not odd, name
            if name == "simhash_near_dedup" and docs is odd:
                # the null text and the empty one are one group, as are the repeated rows of doc_id 2
                assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "3", "None"]
