"""Every registered query with SQL against DuckDB, over the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from coredust.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark conversations".split()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


def norm(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    cur = duck.execute(catalog.oracle_sql()[name])
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == sorted(df.columns)
    order = [theirs.index(c) for c in df.columns]
    want = sorted(repr(tuple(norm(r[i]) for i in order)) for r in cur.fetchall())
    assert sorted(repr(tuple(norm(v) for v in r)) for r in df.collect()) == want


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_nth_value_is_exact(spark):
    import random

    from coredust.operators import timeline

    rng = random.Random(3)
    values = [rng.choice([rng.random(), rng.random() * 1e9, 5.0, -rng.random() * 1e-9]) for _ in range(500)]
    d = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for k in (0, 1, 250, 499):
        assert timeline.nth_value(d, "v", k, bins=16) == sorted(values)[k]
    assert timeline.nth_value(d.limit(0), "v", 0) is None and timeline.focus(d.limit(0), "v").count() == 1
