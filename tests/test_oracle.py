"""Every query with SQL of its own, compared row by row on the smallest tables."""

import math
from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, small, name):
    df = entry.queries()[name](spark, small)
    order = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    rel = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == order
    at = [names.index(c) for c in order]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert ours == theirs


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
