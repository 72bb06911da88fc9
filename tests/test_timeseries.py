"""Series operators against pandas on random and hand-made series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from roadflow.operators import timeseries as T
from roadflow.operators.quantiles import exact_quantiles

from .conftest import stamps


def gappy(rng, n, share):
    x = np.round(rng.normal(50, 9, n), 2)
    x[rng.random(n) < share] = np.nan
    return x


def frame(series: dict[str, np.ndarray]) -> pd.DataFrame:
    return pd.concat(
        [pd.DataFrame({"DeviceId": k, "Lane": 1, "BucketTime": stamps(len(v)), "x": v}) for k, v in series.items()]
    )


def to_spark(spark, pdf):
    rows = [(d, int(l), t.to_pydatetime(), None if np.isnan(x) else float(x)) for d, l, t, x in
            pdf[["DeviceId", "Lane", "BucketTime", "x"]].itertuples(index=False)]
    return spark.createDataFrame(rows, "DeviceId string, Lane int, BucketTime timestamp_ntz, x double")


def back(df, col="x"):
    return df.orderBy("DeviceId", "BucketTime").toPandas()[col].to_numpy(dtype=float)


def series_set():
    rng = np.random.default_rng(5)
    out = {f"r{i}": gappy(rng, 120, s) for i, s in enumerate((0.2, 0.6, 0.9, 0.97))}
    for gap in (11, 12, 13, 23, 24, 25, 30):
        out[f"g{gap}"] = np.r_[1.0, [np.nan] * gap, 5.0]
    out["edges"] = np.r_[[np.nan] * 14, 2.0, 3.0, [np.nan] * 14]
    out["empty"] = np.full(20, np.nan)
    out["single"] = np.array([4.0])
    return out


@pytest.fixture(scope="module")
def pdf():
    return frame(series_set())


@pytest.mark.parametrize("limit", [12, None, 3])
def test_interpolate_as_pandas(spark, pdf, limit):
    want = pdf.groupby("DeviceId")["x"].transform(
        lambda s: s.interpolate(method="linear", limit=limit, limit_direction="both")
    )
    want = pdf.assign(x=want).sort_values(["DeviceId", "BucketTime"])["x"].to_numpy()
    got = back(T.interpolate(to_spark(spark, pdf), ["x"], ["DeviceId", "Lane"], "5 minutes", limit))
    np.testing.assert_allclose(got, want, rtol=1e-12)


def test_open_cells_after_limit_twelve(spark, pdf):
    got = T.interpolate(to_spark(spark, pdf), ["x"], ["DeviceId", "Lane"], "5 minutes", 12)
    left = {r[0]: r[1] for r in got.groupBy("DeviceId").agg(F.count_if(F.col("x").isNull())).collect()}
    assert [left[f"g{g}"] for g in (11, 12, 13, 23, 24, 25, 30)] == [0, 0, 0, 0, 0, 1, 6]
    assert left["edges"] == 4 and left["empty"] == 20 and left["single"] == 0


def test_max_gap_keeps_long_gaps_open(spark, pdf):
    got = T.interpolate(to_spark(spark, pdf), ["x"], ["DeviceId", "Lane"], "5 minutes", 12, max_gap=12)
    left = {r[0]: r[1] for r in got.groupBy("DeviceId").agg(F.count_if(F.col("x").isNull())).collect()}
    assert [left[f"g{g}"] for g in (11, 12, 13, 24)] == [0, 0, 13, 24]


def test_densify_equals_windows_on_the_grid(spark, pdf):
    seen = to_spark(spark, pdf).filter(F.col("x").isNotNull())
    off_grid = seen.limit(1).withColumn("BucketTime", F.col("BucketTime") + F.expr("INTERVAL 2 MINUTES"))
    both = seen.withColumn("Lane", F.when(F.col("DeviceId") == "r1", 2).otherwise(F.col("Lane")))
    grid = T.dense_grid(both)
    cells = grid.join(both, ["DeviceId", "Lane", "BucketTime"], "left")
    a = T.interpolate(cells, ["x"], ["DeviceId", "Lane"], "5 minutes", 12)
    b = T.densify(both.unionByName(off_grid.withColumn("Lane", F.lit(1))), ["x"], "5 minutes", 12)
    key = ["DeviceId", "Lane", "BucketTime", "x"]
    assert a.select(key).exceptAll(b.select(key)).count() == 0
    assert b.select(key).exceptAll(a.select(key)).count() == 0
    assert b.filter("_known").count() == both.count()


@pytest.mark.parametrize("limit, max_gap", [(12, None), (3, None), (0, None), (None, None), (12, 12), (None, 12)])
def test_densify_of_several_groups_equals_windows(spark, pdf, limit, max_gap):
    """Columns that are null together and one that is null in other rows, with values no line can be drawn from."""
    named = to_spark(spark, pdf).filter(F.col("x").isNotNull())
    end = F.when((F.col("DeviceId") == "g24") & (F.col("x") == 5), float("inf")).otherwise(F.col("x"))
    seen = named.select("DeviceId", "Lane", "BucketTime", end.alias("x"), (-F.col("x") / 3).alias("y"),
                        F.when(F.floor("x") % 3 != 0, F.col("x") * 7).alias("z"))
    cols, keys = ["x", "y", "z"], ["DeviceId", "Lane"]
    grid = T.dense_grid(seen).join(seen, [*keys, "BucketTime"], "left")
    a = T.interpolate(grid, cols, keys, "5 minutes", limit, max_gap)
    b = T.densify(seen, cols, "5 minutes", limit, max_gap, together=[["x", "y"]])
    a, b = [df.select(*keys, "BucketTime", *cols).toPandas().sort_values([*keys, "BucketTime"], ignore_index=True) for df in (a, b)]
    pd.testing.assert_frame_equal(a, b, check_exact=True)
    assert 0 < seen.filter("z IS NULL").count() < seen.count()


def test_grid_size(spark, pdf):
    df = to_spark(spark, pdf)
    assert T.dense_grid(df).count() == len(series_set()) * 1 * 120
    few = df.filter("DeviceId in ('single', 'g11')").withColumn("Lane", F.when(F.col("DeviceId") == "single", 2).otherwise(1))
    assert T.dense_grid(few).count() == 2 * 2 * 13
    assert T.dense_grid(few, observed_pairs_only=True).count() == 2 * 13


def test_fill_as_pandas(spark, pdf):
    want = pdf.groupby("DeviceId")["x"].transform(lambda s: s.bfill().ffill()).fillna(0)
    want = pdf.assign(x=want).sort_values(["DeviceId", "BucketTime"])["x"].to_numpy()
    np.testing.assert_array_equal(back(T.bfill_ffill(to_spark(spark, pdf), ["x"], ["DeviceId"])), want)


def test_rolling_as_pandas(spark, pdf):
    full = pdf.assign(x=pdf["x"].fillna(7.0))
    got = T.rolling(to_spark(spark, full), ["x"], ["DeviceId"])
    for name, n in (("15m", 3), ("30m", 6)):
        roll = full.groupby("DeviceId")["x"].rolling(n, min_periods=1)
        for stat, want in (("mean", roll.mean()), ("std", roll.std().fillna(0))):
            want = want.reset_index(level=0)
            want = full.assign(v=0.0).sort_values(["DeviceId", "BucketTime"], kind="stable").assign(v=want["x"].to_numpy())["v"]
            np.testing.assert_allclose(back(got, f"x_roll_{stat}_{name}"), want.to_numpy(), atol=1e-6)


def test_asfreq_and_resample(spark):
    pdf = frame({"a": np.array([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0])})
    df = to_spark(spark, pdf).filter("x not in (2, 3, 5)")
    assert back(T.asfreq(df, "5 minutes")).tolist()[::3] == [1.0, 4.0, 7.0]
    ten = T.resample_mean(df, ["x"], ["DeviceId"], "10 minutes")
    np.testing.assert_array_equal(back(ten), [1.0, 4.0, 6.0, 7.0])


def test_asfreq_rejects_a_repeated_stamp_off_the_grid(spark):
    rows = [("d", "2024-01-01 00:00:00"), ("d", "2024-01-01 00:07:00"), ("d", "2024-01-01 00:10:00")]
    df = spark.createDataFrame(rows, "DeviceId string, t string").selectExpr("DeviceId", "cast(t AS timestamp_ntz) BucketTime", "1.0 v")
    assert T.asfreq(df, "5 minutes").count() == 3
    with pytest.raises(Exception, match="twice"):
        T.asfreq(df.unionByName(df.where("minute(BucketTime) = 7")), "5 minutes").collect()


def test_asfreq_rejects_a_stamp_twice(spark):
    df = to_spark(spark, frame({"a": np.array([1.0, 2.0])}))
    with pytest.raises(PySparkException, match="twice"):
        T.asfreq(df.unionByName(df.limit(1))).collect()


def test_split_shrinks_with_the_series(spark):
    pdf = frame({"a": np.arange(100.0)})
    got = T.split_tail(to_spark(spark, pdf), ["DeviceId"], 12, 12, 500).groupBy("split").count().collect()
    assert dict(got) == {"test": 12, "val": 12, "train": 76}
    cut = T.split_tail(to_spark(spark, pdf), ["DeviceId"], 12, 12, 62).groupBy("split").count().collect()
    assert dict(cut) == {"test": 12, "val": 12, "train": 62, None: 14}


def test_momentum_guards(spark):
    pdf = frame({"a": np.array([10.0, 0.0, 5.0, 5.5])})
    got = T.momentum(to_spark(spark, pdf), "x", ["DeviceId"])
    assert back(got, "change_pct").tolist() == pytest.approx([0.0, -100.0, 0.0, 10.0])
    assert back(got, "accel_pct").tolist() == pytest.approx([0.0, -100.0, 100.0, 10.0])


@pytest.mark.parametrize("accuracy", [20, 200, 10_000])
def test_exact_quantiles_with_a_hot_group(spark, accuracy):
    rng = np.random.default_rng(3)
    parts = {
        "hot": np.r_[rng.exponential(3, 4000), np.full(2000, 1.25)], "flat": np.full(50, 2.0),
        "tiny": np.array([1.0, 4.0]), "one": np.array([9.0]), "six": np.arange(6.0), "neg": rng.normal(0, 1, 777),
    }
    rows = [(k, float(x)) for k, v in parts.items() for x in v]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = exact_quantiles(df, ["v"], [0.0, 0.25, 0.5, 0.9, 1.0], ["k"], accuracy).collect()
    assert len(got) == 5 * len(parts)
    for r in got:
        assert r["value"] == pytest.approx(np.quantile(parts[r["k"]], r["prob"]), abs=1e-12), (r["k"], r["prob"])
