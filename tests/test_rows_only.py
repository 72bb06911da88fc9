"""Queries without SQL: run and checked for shape and basic properties."""

import pytest

import __spark_entry__ as entry

ONLY = sorted(set(entry.queries()) - set(entry.oracle_sql()))
BY_PROPERTY = {"stream_extend", "order_search", "backtest_table"}


@pytest.mark.parametrize("name", [n for n in ONLY if n not in BY_PROPERTY])
def test_runs(spark, small, name):
    df = entry.queries()[name](spark, small)
    assert df.count() > 0
    assert len(df.columns) == len(set(df.columns))


def test_entry(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 41 and df.count() > 0


def test_search_scores_every_candidate(spark, small):
    from roadflow.models.fit import candidates

    rows = entry.queries()["order_search"](spark, small).collect()
    assert len(rows) == 2 * len(candidates(True))
    assert all(r["MAE"] >= 0 for r in rows)


def test_backtest_covers_each_origin(spark, small):
    rows = entry.queries()["backtest_table"](spark, small).groupBy("DeviceId", "origin").count().collect()
    assert rows and all(r["count"] == 12 for r in rows)
