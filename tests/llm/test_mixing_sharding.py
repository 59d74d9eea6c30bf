import zlib

import duckdb
import pytest

from coredust.llm import mixing, queries, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)


ODD = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (None, "one two", None), (4, "w " * 5000, "y"), (5, "é ü", "z"), (6, "\x0b\x1c", "z"), (7, "p q", "x")]


def test_mix_matches_sql(spark):
    got = mixing.plan_mix(docs(spark, ODD)).toPandas()
    con = duckdb.connect()
    documents = docs(spark, ODD).toPandas()  # noqa: F841
    con.register("documents", documents)
    con.execute("CREATE OR REPLACE TEMP VIEW d2 AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM documents")
    want = con.execute(queries.OP9_SQL.replace("FROM documents", "FROM d2")).df()
    key = lambda d: sorted((str(r.doc_id).replace(".0", "").replace("<NA>", "nan"), int(r["size"]), int(r.source_size), round(r.target, 6), int(r.taken)) for _, r in d.iterrows())
    assert key(got) == key(want)


def test_targets_stop_at_three_times_a_source(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 90), (None, 5)], "source string, source_size long")
    got = {r.source: r for r in mixing.source_targets(sizes).collect()}
    assert got["a"].target == 30.0 and got[None].target == 15.0
    assert sum(r.target for r in got.values()) == pytest.approx(1105)
    # b (weight 2) and c (weight 1) share the rest; c is capped too
    assert got["c"].target == pytest.approx(min(270, (1105 - 45) / 3))


def test_taken_is_near_target_and_bounded(spark):
    rows = [(i, "w " * (1 + i % 37), f"s{i % 5}") for i in range(3000)]
    out = mixing.plan_mix(docs(spark, rows)).toPandas()
    assert (out.taken <= 3 * out["size"]).all()
    for (_, target), g in out.groupby(["source_size", "target"]):
        assert abs(g.taken.sum() - target) <= 37
    assert out.equals(out) and sorted(out.taken) == sorted(mixing.plan_mix(docs(spark, rows).repartition(7)).toPandas().taken)


def test_mix_rows_are_ordered_and_repeat(spark):
    rows = [(i, "w " * 10, "a" if i < 30 else "b") for i in range(300)]
    plan = mixing.plan_mix(docs(spark, rows)).toPandas()
    out = mixing.mix(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    assert out.count() * 10 == plan.taken.sum()


def test_plan_comes_in_the_order_of_the_curriculum(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_WORDS", 1000)
    d = docs(spark, [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(3000)] + [(9000, "", "a"), (9001, None, "b")])
    plan = mixing.plan_mix(d).collect()
    at = [r.first_position for r in plan]
    used = [a for a in at if a is not None]
    assert len(at) == 3002 and 0 < len(used) < 3000 and at == sorted(used) + [None] * (len(at) - len(used))
    first = list(dict.fromkeys(r.doc_id for r in mixing.mix(d).collect()))
    assert first == [r.doc_id for r in plan if r.first_position is not None]


def test_shares_follow_the_schedule_and_parts_hold_equal_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_WORDS", 6000)
    d = docs(spark, [(i, "w " * 5, "abc"[i % 3]) for i in range(12000)])
    out = mixing.mix(d)
    parts = [n for n in out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(parts) == 10 and max(parts) <= 1.02 * min(parts)
    # Caps: none of the three is beyond 3 times its source, so targets are 5, 2 and 1 eighths.
    order, n = [r.source for r in out.collect()], 0
    for k in range(10):
        lo, hi = k / 10, (k + 1) / 10
        grown = [w / 8 * ((hi + a * (hi * hi - hi)) - (lo + a * (lo * lo - lo))) for w, a in zip(mixing.WEIGHTS, mixing.TILTS, strict=True)]
        step = order[n : n + round(12000 * sum(grown))]
        n += len(step)
        for s, g in zip("abc", grown, strict=True):
            assert abs(step.count(s) / len(step) - g / sum(grown)) < 0.01


def test_empty_tables(spark):
    none = docs(spark, ODD).limit(0)
    assert mixing.plan_mix(none).count() == 0 and mixing.mix(none).count() == 0
    assert sharding.shard_documents(none, 16).count() == 0


def test_clashing_columns(spark):
    d = docs(spark, ODD).selectExpr("*", "1 AS size", "2 AS target", "3 AS shard", "4 AS _bucket")
    assert mixing.plan_mix(d).count() == len(ODD)
    assert mixing.mix(d).columns == d.columns
    assert sharding.shard_documents(d, 4).count() == len(ODD)


def test_shards_follow_the_law(spark):
    rows = [(i, f"t{i % 50}", "s") for i in range(4000)]
    out = sharding.shard_documents(docs(spark, rows), 16).toPandas()
    moved = out[out["shard"] != out.grown_shard]
    assert set(moved.grown_shard) == {16} and 100 < len(moved) < 400
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g))) and 150 < len(g) < 350
    assert all(zlib.crc32(f"t{i % 50}".encode()) == c for i, c in zip(out.doc_id, out.text_crc32, strict=True))


def test_weights_confine_movement(spark):
    from pyspark.sql import functions as F

    leaf = lambda i, w=1.0: sharding.Node(f"s{i}", w, shard=i)
    tree = lambda w: sharding.Node("root", 4, (sharding.Node("a", 2.0, (leaf(0, w), leaf(1))), sharding.Node("b", 2.0, (leaf(2), leaf(3)))))
    d = spark.range(5000).select(sharding.shard_of(F.col("id"), tree(1.0)).alias("x"), sharding.shard_of(F.col("id"), tree(3.0)).alias("y"))
    moved = {(r.x, r.y) for r in d.filter("x <> y").collect()}
    assert moved == {(1, 0)}
    share = d.groupBy("y").count().toPandas().set_index("y")["count"]
    assert abs(share[0] / share[1] - 3) < 0.5


def test_odd_rows_shard(spark):
    out = sharding.shard_documents(docs(spark, ODD), 3).toPandas()
    null = out[(out["size"] == 1)]
    assert len(null) == 2 and set(null.text_crc32) == {0} and len(out) == len(ODD)


def xxhash_of(spark, ids, names):
    """Spark's own hash of (key, name): the only part that the brute-force draw does not compute by itself."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(i,) for i in ids], "k long")
    return {(r.k, n): r[f"h{j}"] % (1 << 64) for r in d.select("k", *(F.xxhash64("k", F.lit(n)).alias(f"h{j}") for j, n in enumerate(names))).collect() for j, n in enumerate(names)}


def slow_shard(hashes, key, shards):
    """Region, rack and shard of a key, by a draw for each child at each level."""
    import math

    draw = lambda name, weight: -math.log(((hashes[key, name] >> 11) + 0.5) / 2**53) / weight
    regions = [(f"r{r}", 4.0) for r in range(4)] + [(f"g{i}", 1.0) for i in range(16, shards)]
    for salt in [""] + [f"#{a}" for a in range(1, 16)]:
        region = min(regions, key=lambda x: draw(x[0] + salt, x[1]))[0]
        if region[0] == "g":
            return int(region[1:])
        r = int(region[1:])
        k = min(range(2), key=lambda k: draw(f"r{r}k{k}{salt}", 2.0))
        found = min((4 * r + 2 * k, 4 * r + 2 * k + 1), key=lambda i: draw(f"s{i}{salt}", 1.0))
        if found < shards:
            return found
    return min(range(shards), key=lambda i: draw(f"s{i}#flat", 1.0))


@pytest.mark.parametrize("shards", [1, 5, 15, 16, 17, 20])
def test_draws_against_brute_force(spark, shards):
    from pyspark.sql import functions as F

    ids = list(range(400)) + [-7, None]
    names = [f"r{r}{s}" for r in range(4) for s in ["", *(f"#{a}" for a in range(1, 16))]] + [f"r{r}k{k}{s}" for r in range(4) for k in range(2) for s in ["", *(f"#{a}" for a in range(1, 16))]]
    names += [f"s{i}{s}" for i in range(16) for s in ["", *(f"#{a}" for a in range(1, 16)), "#flat"]] + [f"g{i}" for i in range(16, 22)]
    hashes = xxhash_of(spark, ids, names)
    d = spark.createDataFrame([(i,) for i in ids], "k long")
    got = {r.k: (r.x, r.y) for r in d.select("k", sharding.placed(F.col("k"), shards).alias("x"), sharding.placed(F.col("k"), shards + 1).alias("y")).collect()}
    assert {k: x for k, (x, _) in got.items()} == {k: slow_shard(hashes, k, shards) for k in ids}
    assert all(y in (x, shards) for x, y in got.values())


def test_repeated_rows_get_slots_of_their_own(spark):
    rows = [(1, "same", "s")] * 700 + [(None, f"t{i}", "s") for i in range(300)] + [(None, None, "s")] * 5
    out = sharding.shard_documents(docs(spark, rows), 16).toPandas()
    assert len(out) == 1005 and all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
