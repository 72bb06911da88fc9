"""Seasonal models, windows and lag counts of a series' own length, backtests at any origin, stored models."""

import datetime as dt
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadflow.models import evaluate as E
from roadflow.models import fit as M
from roadflow.models import forecast as P
from roadflow.models import moments
from roadflow.models import solve as S
from roadflow.models import store
from roadflow.plans import training
from roadflow.schemas import TRAFFIC_METRICS, WEATHER_COLS
from roadflow.session import scratch_path, stage

T0 = dt.datetime(2024, 1, 1)


def series_of(spark, values, skip=()):
    """A device per entry with random regressors; stamps in ``skip`` are left out."""
    rng = np.random.default_rng(4)
    cols = [c for c in TRAFFIC_METRICS + WEATHER_COLS if c != "NumVehicles"]
    rows = [(k, T0 + dt.timedelta(minutes=5 * i), float(v), *map(float, rng.normal(10, 2, len(cols))))
            for k, y in values.items() for i, v in enumerate(y) if (k, i) not in skip]
    return spark.createDataFrame(rows, "DeviceId string, BucketTime timestamp_ntz, NumVehicles double, " + ", ".join(f"{c} double" for c in cols))


def seasonal(n, phi=0.5, theta=0.4, s=60):
    """(1 - phi B^s)(1 - B^s) y = (1 + theta B^s) e"""
    e, y = np.random.default_rng(1).normal(0, 1, n), np.full(n, 100.0)
    for t in range(2 * s, n):
        y[t] = y[t - s] + phi * (y[t - s] - y[t - 2 * s]) + e[t] + theta * e[t - s]
    return y


def ar(n, seed=3):
    e, y = np.random.default_rng(seed).normal(0, 1, n), np.full(n, 20.0)
    for t in range(1, n):
        y[t] = 5 + 0.75 * y[t - 1] + e[t]
    return y


def test_seasonal_model_is_recovered(spark):
    rows = training.design(series_of(spark, {"s": seasonal(4000)}), "NumVehicles")
    orders = spark.createDataFrame([("s", 0, 0, 1, 1, 1, 60, 0)], "DeviceId string, p int, q int, sp int, sd int, sq int, s int, d int")
    models, full = M.fit_models(rows, "NumVehicles", orders, window=(13, M.EVERYTHING))
    m = models.first()
    assert (m["sp"], m["sd"], m["sq"], m["s"], m["d"]) == (1, 1, 1, 60, 0)
    w, theta = np.asarray(m["w"]), np.asarray(m["theta"])
    assert w[59] == pytest.approx(1.5, abs=0.1) and w[119] == pytest.approx(-0.5, abs=0.1)
    assert theta[59] == pytest.approx(0.4, abs=0.12) and m["sigma2"] == pytest.approx(1.0, abs=0.15)
    assert np.count_nonzero(w) == 2 and np.count_nonzero(theta) == 1
    # The forecast is the recursion over the season.
    got = P.forecast_requests(P.holdout_requests(full, models, "NumVehicles", 12)).orderBy("step").toPandas()
    asked = P.holdout_requests(full, models, "NumVehicles", 12).first()
    y, e = asked["y_tail"], asked["e_tail"]
    want = [asked["const"] + float(np.dot(x, asked["beta"])) + w[59] * y[59 - h] + w[119] * y[119 - h] + theta[59] * e[59 - h]
            for h, x in enumerate(asked["x"])]
    np.testing.assert_allclose(got["predicted"], np.maximum(want, 0), rtol=1e-9)


def test_search_lists_all_candidates_and_short_series(spark):
    rows = training.design(series_of(spark, {"long": seasonal(1500), "short": ar(150), "tiny": ar(100)}), "NumVehicles")
    scored = M.order_search(rows, "NumVehicles", {"search": (1000, 120, True)}, 12).toPandas()
    keys = ["p", "d", "q", "sp", "sd", "sq", "s"]
    long = scored[scored.DeviceId == "long"]
    listed = set(map(tuple, long[keys].to_numpy().tolist()))
    assert {(*o, *z) for o, z in M.candidates(True)} == listed and len(long) == len(M.ORDERS) + 5 * len(M.SEASONALS + M.HOURLY)
    short = scored[scored.DeviceId == "short"]
    assert len(short) > 1 and short.MAE.notna().all() and set(short.s) == {0}
    assert scored[scored.DeviceId == "tiny"].MAE.isna().all()
    best = {r["DeviceId"]: r for r in M.best_order(M.order_search(rows, "NumVehicles", {"search": (1000, 120, True)}, 12)).collect()}
    assert best["long"]["s"] == 60 and set(best) == {"long", "short", "tiny"}


def test_training_windows_shrink_with_the_series(spark):
    sizes = {"a": 2000, "b": 1132, "c": 700, "d": 150, "e": 100}
    rows = spark.createDataFrame([(k, n) for k, n in sizes.items()], "DeviceId string, rn int")
    got = {r["DeviceId"]: (r["low_0"], r["high_0"]) for r in M.search_ranges(rows, {"t": (1000, 120, True)}, 12).collect()}
    assert got == {"a": (133, 1132), "b": (133, 1132), "c": (133, 700), "d": (133, 150), "e": (133, 100)}


def test_tiers_in_one_pass_equal_each_alone(spark):
    rows = stage(training.design(series_of(spark, {"x": ar(900), "y": ar(300, 9)}), "NumVehicles"), "rows")
    tiers = {"one": (500, 12, False), "two": (200, 24, False)}
    keys = ["DeviceId", "window", "p", "d", "q", "sp", "s"]
    both = M.order_search(rows, "NumVehicles", tiers, 12).toPandas().set_index(keys).sort_index()
    for name, tier in tiers.items():
        alone = M.order_search(rows, "NumVehicles", {name: tier}, 12).toPandas().set_index(keys).sort_index()
        np.testing.assert_allclose(both.loc[alone.index, "MAE"], alone["MAE"], rtol=1e-7)


def test_lag_count_follows_the_series(spark):
    n = 30 * 288
    y = np.cumsum(np.random.default_rng(6).normal(0, 1, n)) * 0.1 + ar(n)
    rows = spark.createDataFrame([("m", T0 + dt.timedelta(minutes=5 * i), n - i, float(v)) for i, v in enumerate(y)],
                                 "DeviceId string, BucketTime timestamp_ntz, rn int, y double")
    assert S.lag_count(n) == 37
    ranges = M.fixed_ranges(rows, {"all": (1, M.EVERYTHING)})
    got = moments.lag_moments(rows, ranges, ["all"], lambda i: F.lit(40), 40).first()["grams"][0]
    gram, k = np.asarray(got["gram"]).reshape(42, 42), got["n"]
    p = S.dickey_fuller(gram, k, S.Layout(0, 40, ()), 0, 37)
    # Plain least squares on the same rows.
    at = np.arange(40, n)
    diff = lambda lag: y[at - lag] - y[at - lag - 1]
    best = None
    for lags in range(38):
        x = np.column_stack([np.ones(len(at)), y[at - 1], *[diff(j) for j in range(1, lags + 1)]])
        coef, *_ = np.linalg.lstsq(x, diff(0), rcond=None)
        sse = float(np.square(diff(0) - x @ coef).sum())
        aic = len(at) * math.log(sse / len(at)) + 2 * (lags + 2)
        if best is None or aic < best[0]:
            se = math.sqrt(sse / (len(at) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
            best = (aic, coef[1] / se)
    assert k == len(at) and p == pytest.approx(S.dickey_fuller_p(best[1]), abs=1e-5)


def test_backtests_start_anywhere(spark):
    gaps = {("g", i) for i in (*range(200, 230), 400)}
    values = {"g": ar(600), "h": ar(8, 5), "i": ar(1)}
    series = series_of(spark, values, gaps)
    rows = training.design(series, "NumVehicles")
    models, full = M.fit_models(rows, "NumVehicles", order=(1, 0, 0))
    full = stage(full, "full")
    minutes = [-900, 0, 3, 5 * 215, 5 * 400, 5 * 300 + 2, 5 * 599, 10**6]
    asked = spark.createDataFrame([(k, T0 + dt.timedelta(minutes=m)) for k in values for m in minutes],
                                  "DeviceId string, origin timestamp_ntz")
    requests = stage(P.backtest_requests(full, models, asked, "NumVehicles", 12), "requests")
    got = requests.toPandas()
    assert len(got[got.DeviceId == "g"]) == len(minutes) == len(got[got.DeviceId == "h"]) and not len(got[got.DeviceId == "i"])
    assert set(got[got.DeviceId == "g"].x.map(len)) == {12} and set(got[got.DeviceId == "h"].x.map(len)) == {7}
    start = {int((r.origin - T0).total_seconds() // 60): (r.start - T0).total_seconds() / 300 for r in got[got.DeviceId == "g"].itertuples()}
    assert start == {-900: 0, 0: 0, 3: 0, 5 * 215: 199, 5 * 400: 399, 5 * 300 + 2: 300, 5 * 599: 587, 10**6: 587}
    one = got[(got.DeviceId == "g") & (got.origin == T0 + dt.timedelta(minutes=5 * 300 + 2))].iloc[0]
    np.testing.assert_allclose(one.y_tail[:3], ar(600)[[300, 299, 298]])
    scores = P.origin_scores(P.with_actuals(P.forecast_requests(requests), full)).toPandas()
    assert len(scores) == 2 * len(minutes) and scores.MAE.notna().all()


def test_a_request_at_the_end_equals_the_holdout(spark):
    rows = training.design(series_of(spark, {"x": ar(700)}), "NumVehicles")
    models, full = M.fit_models(rows, "NumVehicles", order=(2, 0, 1), window=(13, M.EVERYTHING))
    last = P.holdout_requests(full, models, "NumVehicles", 12)
    origin = full.where("rn = 13").select("DeviceId", F.col("BucketTime").alias("origin"))
    back = P.backtest_requests(full, models, origin, "NumVehicles", 12)
    a, b = (P.forecast_requests(r).orderBy("step").toPandas() for r in (last, back))
    np.testing.assert_allclose(a["predicted"], b["predicted"], rtol=1e-9)


def test_stored_models_forecast_like_fitted_ones(spark):
    rows = training.design(series_of(spark, {"x": ar(500), "y": ar(400, 7)}), "NumVehicles")
    models, full = M.fit_models(rows, "NumVehicles", order=(1, 0, 1), window=(13, M.EVERYTHING))
    models, folder = stage(models, "models"), scratch_path(spark, "store")
    first = store.save(models, folder, "NumVehicles")
    ahead = lambda m: P.forecast_requests(P.holdout_requests(full, m, "NumVehicles", 12)).orderBy("DeviceId", "step").toPandas()
    loaded = store.load(spark, folder, "NumVehicles")
    assert ahead(loaded).equals(ahead(models)) and sorted(loaded.columns) == sorted(models.columns)
    second = store.save(models.where("DeviceId = 'x'"), folder, "NumVehicles")
    assert store.current(spark, folder, "NumVehicles") == second > first
    assert store.load(spark, folder, "NumVehicles").count() == 1 and store.load(spark, folder, "NumVehicles", first).count() == 2
    # A version whose pointer was never written is not seen.
    models.write.parquet(f"{folder}/NumVehicles/99999999999999999999-lost")
    assert store.current(spark, folder, "NumVehicles") == second
    assert {r["models"] for r in store.versions(spark, folder, "NumVehicles").collect()} == {1, 2}
    with pytest.raises(ValueError):
        store.save(models, folder, "../x")


def test_manual_orders_are_honoured(spark):
    devices = spark.createDataFrame([("a",), ("b",)], "DeviceId string")
    manual = spark.createDataFrame([("a", 1, 1, 0, 1, 1, 1, 60)], "DeviceId string, p int, d int, q int, sp int, sd int, sq int, s int")
    auto = spark.createDataFrame([("a", 3, 0, 0, 0), ("b", 3, 0, 0, 0)], "DeviceId string, p int, q int, sp int, s int")
    got = {r["DeviceId"]: r.asDict() for r in E.order_source(devices, manual, None, auto).collect()}
    assert got["a"] == {"DeviceId": "a", "p": 1, "d": 1, "q": 0, "sp": 1, "sd": 1, "sq": 1, "s": 60, "ConfigSource": "manual"}
    assert got["b"]["p"] == 3 and got["b"]["d"] is None and got["b"]["ConfigSource"] == "auto"


def test_normal_quantile_of_columns(spark):
    from statistics import NormalDist

    p = [1e-300, 1e-20, 1e-9, 1e-3, 0.02, 0.075, 0.3, 0.5, 0.7, 0.925, 0.98, 0.9999999]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in p], "p double").transform(E.normal_quantile, "p", "z").select("z").collect()]
    np.testing.assert_allclose(got, [NormalDist().inv_cdf(v) for v in p], rtol=1e-12, atol=1e-14)


def test_origins_are_not_broadcast(spark):
    """Staged rows weigh little as files: neither they nor as many origins may go through the driver."""
    rows = training.design(series_of(spark, {"x": ar(400), "y": ar(300, 7)}), "NumVehicles")
    models, full = M.fit_models(rows, "NumVehicles", order=(1, 0, 0))
    full, models = stage(full, "full"), stage(models, "models")
    origins = full.select("DeviceId", F.col("BucketTime").alias("origin"))
    for got in (P.repeated_last(full, origins, 12), P.backtest_requests(full, models, origins, "NumVehicles", 12)):
        plan = got._jdf.queryExecution().executedPlan().toString()
        # One row a device may be broadcast, rows and origins may not.
        assert re.search(r"SortMergeJoin \[DeviceId#\d+, rn#", plan) and not re.search(r"BroadcastHashJoin \[[^\]]*rn#", plan)
    requests = stage(P.backtest_requests(full, models, origins, "NumVehicles", 12), "requests")
    ahead = P.forecast_requests(requests, actual=True)
    looked_up = P.with_actuals(P.forecast_requests(requests), full)
    key = ["DeviceId", "origin", "step"]
    a, b = (t.orderBy(*key).toPandas() for t in (ahead, looked_up))
    assert len(a) == len(b) == 700 * 12
    np.testing.assert_array_equal(a["actual"], b["actual"])


def test_many_forecasts_equal_one(spark):
    rng = np.random.default_rng(5)
    models = {"w": rng.normal(0, 0.1, (6, 30)), "theta": rng.normal(0, 0.1, (6, 8)), "sigma2": rng.uniform(1, 2, 6)}
    xb, y, e = rng.normal(5, 1, (6, 24)), rng.normal(5, 1, (6, 30)), rng.normal(0, 1, (6, 8))
    guess, spread = S.recurse_all(models, xb, y, e), S.error_spreads(models, 24)
    for i in range(6):
        one = {k: v[i] for k, v in models.items()}
        np.testing.assert_allclose(guess[i], S.recurse(one, xb[i], y[i], e[i]), rtol=1e-12)
        np.testing.assert_allclose(spread[i], S.error_spread(one, 24), rtol=1e-12)


def test_python_batches_are_bounded_in_bytes(spark):
    def weigh(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["size"])

    wide = spark.range(0, 3000, 1, 1).select(F.array_repeat(F.lit(1.5), 4000).alias("x"))
    sizes = [r["size"] for r in wide.mapInArrow(weigh, "size long").collect()]
    assert max(sizes) < 20 * 2**20 and sum(sizes) >= 3000 * 4000 * 8
