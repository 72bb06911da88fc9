"""Hand-made edge cases of the cleaning, aggregation and apportionment rules."""

import datetime as dt
import math

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from roadflow.functions import calendar as Cal
from roadflow.functions import columns as C
from roadflow.functions.apportion import largest_remainder
from roadflow.models import evaluate as E
from roadflow.operators import aggregates as A
from roadflow.operators import clean as K
from roadflow.operators import dedup as D
from roadflow.operators import joins as J
from roadflow.operators import sampling as P
from roadflow.schemas import COUNT_COLS


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_text_keys(spark):
    raw = [(" a ",), ("A",), ("",), ("nan",), ("None",), (None,)]
    got = [r[0] for r in one(spark, raw, "k string", C.normalize_key("k"))]
    assert got == ["A", "A", None, None, None, None]


@pytest.mark.parametrize(
    "lanes, want",
    [(["1", "2", None], ["1", "2", None]), (["1", "x ", None], ["1", "X", None]), (["1.0", " 3"], ["1", "3"])],
)
def test_lane_decision_covers_the_column(spark, lanes, want):
    df = spark.createDataFrame([(x,) for x in lanes], "Lane string")
    assert sorted([r[0] for r in K.normalize_lane(df).collect()], key=str) == sorted(want, key=str)


def test_times(spark):
    raw = ["2024-05-01 10:07:59", "2024-05-01T10:07:30+07:00", "2024-05-01T03:07:30Z", "bad", None,
           "2024-05-01T05:07:00+0200", "2024-05-01"]
    got = [r[0] for r in one(spark, [(x,) for x in raw], "t string", Cal.parse_bucket_time("t"))]
    at = dt.datetime(2024, 5, 1, 10, 7)
    assert got == [at, at, at, None, None, at, dt.datetime(2024, 5, 1)]


def test_half_even_category(spark):
    raw = [(0.5,), (1.5,), (2.5,), (3.5,), (6.0,), (7.4,), (None,)]
    got = [r[0] for r in one(spark, raw, "c double", C.vehicle_category("c"))]
    assert got == ["OtherVehicle", "Motorcycle", "Motorcycle", "OtherVehicle", "Truck", "Bus", "OtherVehicle"]


def test_junk_numbers_become_null(spark):
    got = [r[0] for r in one(spark, [("1.5",), ("x",), ("",), ("NaN",), (None,)], "v string", C.to_number("v"))]
    assert got == [1.5, None, None, None, None]


def test_weighted_average_fallbacks(spark):
    rows = [
        ("w", 10.0, 1.0), ("w", 20.0, 3.0), ("w", None, 5.0),
        ("zero", 10.0, 0.0), ("zero", 30.0, None), ("neg", 4.0, -2.0), ("none", None, 2.0),
    ]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    got = dict(df.groupBy("k").agg(A.weighted_average("v", "w").alias("a")).collect())
    assert got == {"w": 17.5, "zero": 20.0, "neg": 4.0, "none": None}


def test_population_std(spark):
    rows = [("one", 5.0), ("two", 1.0), ("two", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "DeviceId string, Speed double").selectExpr(
        "*", "1D TravelTimeSec", "1D Confidence", "'Car' VehicleCategory"
    )
    got = {r["DeviceId"]: r["SpeedStd"] for r in A.vehicle_by_key(df, ["DeviceId"]).collect()}
    assert got == {"one": 0.0, "two": 1.0, "none": None}


def test_hot_keys_agree_with_the_plain_path(spark):
    df = spark.range(5000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('k', id % 50)) DeviceId", "double(pmod(hash(id), 997)) / 7 Speed",
        "double(id % 11) TravelTimeSec", "double(id % 5) Confidence", "'Car' VehicleCategory",
    )
    hot = A.hot_groups(df, ["DeviceId"], 500)
    assert [r[0] for r in hot.collect()] == ["hot"]
    sort = lambda x: sorted(map(tuple, x.collect()))
    a, b = sort(A.vehicle_by_key(df, ["DeviceId"])), sort(A.vehicle_by_key(df, ["DeviceId"], hot))
    for x, y in zip(a, b, strict=True):
        assert x[0] == y[0] and x[1:] == pytest.approx(y[1:])


def test_median_impute(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (4.0, None)], "a double, b double")
    assert sorted(map(tuple, A.median_impute(df, ["a", "b"]).collect())) == [(1.0, 0.0), (2.5, 0.0), (4.0, 0.0)]


def apportion(spark, n, car, truck, bus, moto):
    row = spark.createDataFrame(
        [(n, car, truck, bus, moto)],
        "NumVehicles double, CarRatio double, TruckRatio double, BusRatio double, MotorcycleRatio double",
    )
    r = largest_remainder(row).first()
    return [r[c] for c in COUNT_COLS]


@pytest.mark.parametrize(
    "args, want",
    [
        ((7.0, 0.354, 0.646, 0.0, 0.0), [2, 5, 0, 0, 0]),
        ((3.0, 0.2, 0.2, 0.2, 0.2), [1, 1, 1, 0, 0]),
        ((0.0, 0.9, 0.0, 0.1, 0.0), [0, 0, 0, 0, 0]),
        ((10.0, 0.33, 0.33, 0.33, 0.01), [4, 3, 3, 0, 0]),
        ((2.5, 1.0, 0.0, 0.0, 0.0), [2, 0, 0, 0, 0]),
        ((3.5, 0.0, 0.0, 0.0, 0.0), [0, 0, 0, 0, 4]),
    ],
)
def test_largest_remainder(spark, args, want):
    assert apportion(spark, *args) == want


def test_ratios_above_one_still_sum_up(spark):
    assert sum(apportion(spark, 9.0, 0.8, 0.7, 0.0, 0.1)) == 9


def test_duplicates(spark):
    rows = [("1", "b", 2), ("1", "a", 1), ("1", "a", 1), (None, "x", 1), (None, "x", 1), (None, "y", 1)]
    df = spark.createDataFrame(rows, "Id string, v string, o int")
    kept = sorted(map(tuple, D.dedup_id(df, "Id", ["o"]).collect()), key=str)
    assert kept == sorted([("1", "a", 1), (None, "x", 1), (None, "x", 1), (None, "y", 1)], key=str)
    assert D.dedup_rows(df, "Id", ["o"]).count() == 3
    assert D.dedup_counts(df).first().asDict() == {
        "rows_raw": 6, "exact_duplicates_removed": 2, "duplicate_ids_removed": 1, "rows_after_raw_dedup": 3,
    }


def test_dedup_ignores_row_order_and_repeats(spark):
    df = spark.range(500).selectExpr("string(id % 40) Id", "string(id % 7) v", "int(id) o")
    once = sorted(map(tuple, D.dedup_id(df, "Id", ["o"]).collect()))
    again = sorted(map(tuple, D.dedup_id(D.dedup_id(df.orderBy(F.rand(1)), "Id", ["o"]), "Id", ["o"]).collect()))
    assert once == again


def test_assert_unique_raises(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises((PySparkException, Py4JJavaError), match="not unique"):
        D.assert_unique(df, ["k"]).collect()


def test_holidays(spark):
    days = ["2023-04-30", "2026-02-14", "2026-02-22", "2025-02-14", "2026-02-23", "2024-01-01", "2026-08-29",
            "2026-09-01", "2025-09-01", "2025-09-02"]
    got = [r[0] for r in one(spark, [(x,) for x in days], "d string", Cal.is_holiday(F.col("d").cast("timestamp_ntz")))]
    assert got == [1, 1, 1, 0, 0, 1, 1, 1, 0, 1]


@pytest.mark.parametrize(
    "pairs, r2, dash",
    [
        ([(0.0, 1.0), (2.0, 2.0)], 0.5, 0.5),
        ([(3.0, 3.0), (3.0, 3.0)], 1.0, 0.0),
        ([(3.0, 2.0), (3.0, 3.0)], 0.0, 0.0),
        ([(5.0, 4.0)], 0.0, 0.0),
    ],
)
def test_metric_rules(spark, pairs, r2, dash):
    df = spark.createDataFrame([("d", a, p) for a, p in pairs], "DeviceId string, actual double, predicted double")
    got = E.forecast_metrics(df, ["DeviceId"]).first()
    assert got["R2"] == pytest.approx(r2)
    assert E.forecast_metrics(df, ["DeviceId"], dashboard_rule=True).first()["R2"] == pytest.approx(dash)
    positive = [abs(a - p) / a for a, p in pairs if a > 0]
    assert got["MAPE"] == pytest.approx(100 * sum(positive) / len(positive) if positive else 0.0)


def test_mape_without_positive_actuals(spark):
    df = spark.createDataFrame([("d", 0.0, 2.0)], "DeviceId string, actual double, predicted double")
    got = E.forecast_metrics(df, ["DeviceId"]).first()
    assert got["MAPE"] == 0.0 and got["MAE"] == 2.0


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(3000).withColumn("v", F.col("id") % 10)
    a = {r[0] for r in P.sample_n(df, 700).collect()}
    b = {r[0] for r in P.sample_n(df.repartition(3), 700).collect()}
    assert len(a) == 700 and a == b
    assert P.sample_n(df, 5000).count() == 3000


def test_asof_tie_takes_the_later_row(spark):
    series = spark.createDataFrame([("d", 0, 1.0), ("d", 300, 2.0), ("d", 600, 3.0)], "DeviceId string, s long, v double")
    series = series.select("DeviceId", F.timestamp_seconds("s").cast("timestamp_ntz").alias("BucketTime"), "v")
    asked = spark.createDataFrame([("d", x) for x in (-500, 149, 150, 450, 9999)], "DeviceId string, s long")
    asked = asked.select("DeviceId", "s", F.timestamp_seconds("s").cast("timestamp_ntz").alias("at"))
    got = {r["s"]: r["v"] for r in J.asof_nearest(asked, series, "5 minutes").collect()}
    assert got == {-500: 1.0, 149: 1.0, 150: 2.0, 450: 3.0, 9999: 3.0}


def test_no_devices_with_metrics_means_all(spark):
    devices = spark.createDataFrame([("a",), ("b",)], "DeviceId string")
    metrics = spark.createDataFrame([("a", "AvgSpeed")], "DeviceId string, TargetCol string")
    names = lambda t: sorted(r[0] for r in J.devices_for_target(devices, metrics, t).collect())
    assert names("AvgSpeed") == ["a"] and names("NumVehicles") == ["a", "b"]


def test_order_text(spark):
    got = one(spark, [("(2, 0, 1)",), ("[1, 0, 0, 12]",)], "o string", C.order_text_to_struct("o"))
    assert [r[0] for r in got] == [[2, 0, 1], [1, 0, 0, 12]]


def test_nan_is_null(spark):
    got = one(spark, [(math.nan,), (1.0,)], "v double", C.to_number("v"))
    assert [r[0] for r in got] == [None, 1.0]


def test_exact_ranks_of_hot_and_small_groups(spark, monkeypatch):
    from roadflow.operators import quantiles as Q

    monkeypatch.setattr(Q, "RUN", 7)
    rows = [("hot", float((k * k) % 613) if k % 3 else 1.5) for k in range(4000)] + [("one", -0.5), ("none", None), (None, 1.0)]
    rows += [("same", 2.0)] * 30
    df = spark.createDataFrame(rows, "g string, v double")
    got = sorted((r["g"], r["rank"], r["v"], r["n"]) for r in Q.exact_ranks(df, ["g"], "v").collect())
    want = []
    for g in ("hot", "one", "same"):
        values = sorted(v for k, v in rows if k == g)
        want += [(g, k, v, len(values)) for k, v in enumerate(values, 1)]
    assert got == sorted(want)
    assert Q.exact_ranks(df.limit(0), ["g"], "v").count() == 0
