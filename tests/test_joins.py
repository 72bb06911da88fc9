"""As-of joins on irregular series against brute force; key relations checked by the join itself."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from roadflow.operators import joins as J


def frame(spark, rows, key, stamp, *more):
    """Rows (key, seconds, ...); seconds may be fractional, negative or null."""
    typed = spark.createDataFrame(rows, ", ".join([f"{key} string", "s double", *more]))
    return typed.withColumn(stamp, F.expr("timestamp_micros(cast(1704067200000000 + s * 1000000 as long))").cast("timestamp_ntz"))


def brute(asked, series, direction, within=None):
    out = {}
    for no, (key, at) in enumerate(asked):
        seen = [(s, v) for k, s, v in series if k is not None and k == key and s is not None and at is not None]
        if direction == "before":
            seen = [x for x in seen if x[0] <= at]
        if direction == "after":
            seen = [x for x in seen if x[0] >= at]
        if within is not None:
            seen = [x for x in seen if abs(x[0] - at) <= within]
        # Nearest; of equally near ones the later; of one stamp the largest value, null being the smallest.
        best = min(seen, key=lambda x: (abs(x[0] - at), -x[0], -(x[1] if x[1] is not None else -1e9)), default=(None, None))
        out[no] = best
    return out


@pytest.mark.parametrize("direction,within", [("nearest", None), ("before", None), ("after", None), ("nearest", "10 minutes")])
def test_asof_against_brute_force(spark, direction, within):
    dice = random.Random(5)
    series = [(dice.choice("aaab"), dice.randrange(0, 400_000, 300) / 2, float(dice.randrange(50))) for _ in range(250)]
    series += [("a", 600.0, 1.0), ("a", 600.0, 7.0), ("a", 600.0, None), ("late", 90_000.25, 3.0), (None, 60.0, 9.0), ("a", None, 8.0)]
    asked = [(dice.choice("aaabc"), dice.randrange(-20_000, 240_000, 75) * 1.0) for _ in range(300)]
    asked += [("a", 600.0), ("a", 600.0), ("late", -1e6), ("late", 1e6), ("late", 90_000.25), (None, 60.0), ("a", None)]
    left = frame(spark, [(k, s, n) for n, (k, s) in enumerate(asked)], "DeviceId", "at", "no long").drop("s")
    right = frame(spark, series, "DeviceId", "BucketTime", "v double")
    got = J.asof(left, right, direction=direction, within=within)
    assert got.columns == [*left.columns, "BucketTime", "s", "v"]
    rows = got.collect()
    want = brute(asked, series, direction, 600 if within else None)
    assert len(rows) == len(asked)
    assert {r["no"]: (r["s"], r["v"]) for r in rows} == want


def test_asof_of_nothing(spark):
    left = frame(spark, [("a", 1.0, 1)], "DeviceId", "at", "no long").drop("s")
    right = frame(spark, [("a", 1.0, 2.0)], "DeviceId", "BucketTime", "v double").drop("s")
    assert [tuple(r)[-2:] for r in J.asof(left, right.limit(0)).collect()] == [(None, None)]
    assert J.asof(left.limit(0), right).count() == 0
    assert J.asof(left, right.select("DeviceId", "BucketTime")).first()["BucketTime"] is not None
    with pytest.raises(ValueError, match="both sides"):
        J.asof(left, right.withColumn("no", F.lit(1)))
    with pytest.raises(ValueError, match="direction"):
        J.asof(left, right, direction="sideways")


def sides(spark):
    left = spark.createDataFrame([("x", 1), ("y", 2), (None, 3), (None, 4)], "k string, a int")
    right = spark.createDataFrame([("x", 5), ("z", 6), (None, 7), (None, 8)], "k string, b int")
    return left, right


def test_unique_keys_pass_and_are_counted(spark):
    left, right = sides(spark)
    counts = Observation("join")
    got = J.with_match(left, right, ["k"], "full", "one_to_one", counts).collect()
    assert sorted((r["a"] or 0, r["b"] or 0, r["match"]) for r in got) == [
        (0, 6, "right_only"), (0, 7, "right_only"), (0, 8, "right_only"), (1, 5, "both"), (2, 0, "left_only"),
        (3, 0, "left_only"), (4, 0, "left_only")]
    assert counts.get == {"rows": 7, "both": 1, "left_only": 3, "right_only": 3}


@pytest.mark.parametrize("relation,left_twice,right_twice", [
    ("one_to_one", True, True), ("one_to_many", True, False), ("many_to_one", False, True), ("many_to_many", False, False)])
def test_a_repeated_key_ends_the_job(spark, relation, left_twice, right_twice):
    left, right = sides(spark)
    again = lambda df, fails, join: _ends(join(df.unionByName(df)), fails)
    again(left, left_twice, lambda df: J.with_match(df, right, ["k"], "left", relation))
    again(right, right_twice, lambda df: J.with_match(left, df, ["k"], "left", relation))


def _ends(joined, fails):
    if not fails:
        assert joined.count() > 0
        return
    with pytest.raises(Exception, match="more than once"):
        joined.collect()


def test_the_check_adds_no_scan_and_no_shuffle(spark, small):
    def exchanges(relation):
        orders = spark.read.parquet(f"{small}/orders.parquet").select("o_orderkey", "o_custkey")
        totals = orders.hint("merge").withColumnRenamed("o_custkey", "other")
        plan = J.with_match(orders, totals, ["o_orderkey"], relation=relation)._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange hashpartitioning"), plan.count("FileScan"), plan.count("Sort [")

    assert exchanges("one_to_one") == exchanges("many_to_many") == (2, 2, 2)
