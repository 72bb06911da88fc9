"""Model jobs on simulated series: recovery, agreement with plain least squares, diagnostics."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadflow.models import evaluate as E
from roadflow.models import fit as M
from roadflow.models import forecast as P
from roadflow.models import solve as S
from roadflow.plans import training
from roadflow.plans.features import model_features, regressor_names
from roadflow.schemas import TRAFFIC_METRICS, WEATHER_COLS

N = 900


def simulate():
    rng = np.random.default_rng(11)
    e = rng.normal(0, 1, (4, N))
    ar, ma, season, walk = (np.zeros(N) for _ in range(4))
    for t in range(N):
        ar[t] = 20 + 0.6 * ((ar[t - 1] if t else 20) - 20) + e[0, t]
        ma[t] = 20 + e[1, t] + 0.7 * (e[1, t - 1] if t else 0)
        season[t] = 20 + 0.8 * ((season[t - 12] if t > 11 else 20) - 20) + e[2, t]
        walk[t] = (walk[t - 1] if t else 100) + e[3, t]
    return {"ar": ar, "ma": ma, "season": season, "walk": walk + 100}


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(2)
    t0 = dt.datetime(2024, 1, 1)
    cols = [c for c in TRAFFIC_METRICS + WEATHER_COLS if c != "NumVehicles"]
    rows = [
        (k, t0 + dt.timedelta(minutes=5 * i), float(v), *[float(x) for x in rng.normal(10, 2, len(cols))])
        for k, y in simulate().items() for i, v in enumerate(y)
    ]
    schema = "DeviceId string, BucketTime timestamp_ntz, NumVehicles double, " + ", ".join(f"{c} double" for c in cols)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def rows(series):
    return training.design(series, "NumVehicles")


def test_difference_orders(rows):
    got = {r["DeviceId"]: r for r in M.stationarity(rows, "NumVehicles").collect()}
    assert got["ar"]["d"] == 0 and got["ma"]["d"] == 0
    assert got["walk"]["d"] == 1 and got["walk"]["adf_p_before"] > 0.05 > got["walk"]["adf_p_after"]


def test_dickey_fuller_surface():
    assert S.dickey_fuller_p(-2.86) == pytest.approx(0.05, abs=0.002)
    assert S.dickey_fuller_p(-3.43) == pytest.approx(0.01, abs=0.001)
    assert S.dickey_fuller_p(0.0) == pytest.approx(0.9585, abs=0.002)
    assert S.dickey_fuller_p(5) == 1.0 and S.dickey_fuller_p(-30) == 0.0


def test_recovers_autoregression(rows):
    models, _ = M.fit_models(rows, "NumVehicles", order=(1, 0, 0))
    ar = models.filter("DeviceId = 'ar'").first()
    assert ar["w"][0] == pytest.approx(0.6, abs=0.08)
    assert ar["sigma2"] == pytest.approx(1.0, abs=0.15)
    assert ar["pvalue"][ar["terms"].index("ar1") + 1 + len(regressor_names("NumVehicles"))] < 1e-6


def test_recovers_shocks_and_season(rows):
    models, _ = M.fit_models(rows, "NumVehicles", order=(0, 0, 1))
    assert models.filter("DeviceId = 'ma'").first()["theta"][0] == pytest.approx(0.7, abs=0.12)
    models, _ = M.fit_models(rows, "NumVehicles", order=(1, 0, 0), seasonal=(1, 0, 0, 12))
    assert models.filter("DeviceId = 'season'").first()["w"][11] == pytest.approx(0.8, abs=0.08)


def test_walk_forecast_follows_differences(rows):
    models, _ = M.fit_models(rows, "NumVehicles", order=(1, 0, 0))
    w = models.filter("DeviceId = 'walk'").first()
    assert w["d"] == 1 and sum(w["w"]) == pytest.approx(1.0, abs=1e-9)


def test_moments_equal_plain_least_squares(rows):
    names = regressor_names("NumVehicles")
    models, full = M.fit_models(rows, "NumVehicles", order=(2, 0, 0))
    got = models.filter("DeviceId = 'ar'").first()
    pdf = full.filter("DeviceId = 'ar' AND e2 IS NOT NULL").toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf[names].to_numpy(float), pdf[["y1", "y2"]].to_numpy(float)])
    want, *_ = np.linalg.lstsq(x, pdf["y"].to_numpy(float), rcond=None)
    fit = x @ np.asarray(got["coef"])
    np.testing.assert_allclose(fit, x @ want, atol=1e-6)
    assert got["n"] == len(pdf)


def test_search_prefers_the_season(rows):
    best = M.best_order(M.order_search(rows, "NumVehicles", {"s": (700, 120, True)}, 12))
    assert {r["DeviceId"]: r["sp"] for r in best.collect()}["season"] >= 1


def test_forecast_is_the_recursion(rows):
    models, full = M.fit_models(rows, "NumVehicles", order=(1, 0, 0), window=(13, M.EVERYTHING), name="train")
    asked = P.holdout_requests(full, models, "NumVehicles", 12)
    got = P.forecast_requests(asked).filter("DeviceId = 'ar'").orderBy("step").toPandas()
    r = asked.filter("DeviceId = 'ar'").first()
    y, want = r["y_tail"][0], []
    for x in r["x"]:
        y = r["const"] + float(np.dot(x, r["beta"])) + r["w"][0] * y
        want.append(max(y, 0.0))
    np.testing.assert_allclose(got["predicted"], want, rtol=1e-9)
    assert (got["lower"] <= got["predicted"]).all() and (got["predicted"] <= got["upper"]).all()
    assert (np.diff(got["upper"] - got["predicted"]) >= -1e-9).all()


def test_interval_covers(rows):
    models, full = M.fit_models(rows, "NumVehicles", order=(1, 0, 0))
    origins = full.filter("rn % 20 = 0 AND rn > 40 AND DeviceId = 'ar'").select("DeviceId", F.col("BucketTime").alias("origin"))
    out = P.with_actuals(P.forecast_requests(
        P.backtest_requests(full, models, origins, "NumVehicles", 12, "5 minutes")), full).toPandas()
    inside = ((out["actual"] >= out["lower"]) & (out["actual"] <= out["upper"])).mean()
    assert 0.88 < inside <= 1.0
    assert out.groupby("origin").size().eq(12).all()


def test_fitted_values_leave_white_noise(rows):
    models, full = M.fit_models(rows, "NumVehicles", order=(1, 0, 0))
    res = P.fitted_values(full, models, "NumVehicles").filter("DeviceId = 'ar'")
    assert E.ljung_box(res).first()["lb_pvalue"] > 0.01
    naive = full.filter("DeviceId = 'ar'").select("DeviceId", "BucketTime", (F.col("y") - 20).alias("residual"))
    assert E.ljung_box(naive).first()["lb_pvalue"] < 1e-6


def test_training_beats_the_mean(series):
    run = training.train(series, "NumVehicles", order=(1, 0, 0))
    rows = {r["DeviceId"]: r for r in run.metrics.collect()}
    assert set(rows) == {"ar", "ma", "season", "walk"}
    assert rows["walk"]["MAE"] < 5 and rows["walk"]["Order"] == "(1, 1, 0)"
    assert all(r["Forecast_60min"] is not None and r["ConfigSource"] == "default" for r in rows.values())


def test_both_targets_with_their_own_orders(spark, series):
    config = spark.createDataFrame(
        [("walk", {"NumVehicles_order": "(2, 0, 0)", "AvgSpeed_order": "no order"})], "DeviceId string, settings map<string,string>")
    runs = training.train_targets(series, config=config, tiers={"search": (200, 24, False)})
    volume, speed = ({r["DeviceId"]: r for r in runs[t].metrics.collect()} for t in training.TARGETS)
    assert set(volume) == set(speed) == {"ar", "ma", "season", "walk"}
    assert {d: r["ConfigSource"] for d, r in volume.items()} == {"ar": "auto", "ma": "auto", "season": "auto", "walk": "manual"}
    assert volume["walk"]["Order"] == "(2, 0, 0)" and {r["ConfigSource"] for r in speed.values()} == {"auto"}
    assert {r["TargetCol"] for r in speed.values()} == {"AvgSpeed"} and all(r["MAE"] is not None for r in (*volume.values(), *speed.values()))


def test_default_order_is_not_searched(series, monkeypatch):
    monkeypatch.setattr(M, "order_search", lambda *a: pytest.fail("searched"))
    run = training.train_targets(series, default={"p": 1, "d": 0, "q": 1}, targets=("NumVehicles",))["NumVehicles"]
    assert {(r["Order"], r["ConfigSource"]) for r in run.metrics.collect()} == {("(1, 0, 1)", "default")}


def test_chi2_tail():
    assert S.chi2_tail(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert S.chi2_tail(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert S.chi2_tail(7.815, 3) == pytest.approx(0.05, abs=1e-4)
    assert S.chi2_tail(19.675, 11) == pytest.approx(0.05, abs=1e-4)


def test_qq_points_are_symmetric(spark):
    df = spark.range(101).selectExpr("'d' DeviceId", "double(id - 50) residual")
    out = E.qq_points(df).orderBy("rank").toPandas()
    np.testing.assert_allclose(out["theoretical"], -out["theoretical"][::-1].to_numpy(), atol=1e-9)


def _series_of(spark, sizes):
    """A device per size: an autoregression with the measures the design needs."""
    import numpy as np

    from roadflow.schemas import TRAFFIC_METRICS, WEATHER_COLS

    rng, rows = np.random.default_rng(8), []
    for size in sizes:
        y = 20.0
        for t in range(size):
            y = 5 + 0.75 * y + rng.normal()
            rows.append((f"N{size}", t, float(y), *[float(rng.normal()) for _ in range(10)]))
    names = ["NumVehicles", *[c for c in TRAFFIC_METRICS if c != "NumVehicles"], *WEATHER_COLS]
    df = spark.createDataFrame(rows, "DeviceId string, t int, " + ", ".join(f"{c} double" for c in names))
    return df.selectExpr("DeviceId", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, t) BucketTime", *names)


def test_no_device_vanishes(spark):
    from roadflow.models import fit as M
    from roadflow.plans import training
    from roadflow.session import stage

    sizes = [1, 5, 30, 90, 200, 700]
    series = stage(_series_of(spark, sizes), "sizes")
    names = {f"N{n}" for n in sizes}
    rows = stage(training.design(series, "NumVehicles"), "design")
    models, _ = M.fit_models(rows, "NumVehicles", order=(2, 0, 1), window=(13, M.EVERYTHING), name="train")
    status = {r["DeviceId"]: r["status"] for r in models.collect()}
    assert set(status) == names and status["N1"] == status["N5"] == "fallback" and status["N700"] == status["N90"] == "fitted"
    run = training.train(series, "NumVehicles", "1 hour", order=(2, 0, 0))
    assert {r["DeviceId"] for r in run.metrics.collect()} == names
    both = training.train_targets(series, "1 hour", tiers={"quick": (300, 60, False)})
    assert all({r["DeviceId"] for r in b.metrics.collect()} == names for b in both.values())
    ahead = run.future.collect()
    assert {r["DeviceId"] for r in ahead} == names and all(r["predicted"] == r["predicted"] for r in ahead)
    best = M.best_order(M.order_search(rows, "NumVehicles", {"quick": (300, 60, False)}, 12)).collect()
    assert {r["DeviceId"] for r in best} == names and len(best) == len(names)


def test_orders_beyond_the_design_fail_clearly():
    import numpy as np
    import pytest as pt

    from roadflow.models import solve as S

    lay = S.Layout(1, 26)
    gram = np.eye(lay.size)
    S.fit(gram, 100.0, lay, (26, 0, 2), (0, 0, 0, 0))
    for order in ((26, 1, 0), (28, 0, 0), (60, 0, 0), (1, 0, 3)):
        with pt.raises(ValueError):
            S.fit(gram, 100.0, lay, order, (0, 0, 0, 0))


def test_observation_moves_the_forecast(spark):
    """The observed row is the newest lag: another observed value gives another forecast, from its own stamp."""
    from roadflow.models import fit as M
    from roadflow.models import forecast as P
    from roadflow.plans import training
    from roadflow.schemas import TARGET_REGRESSORS
    from roadflow.session import stage

    series = stage(_series_of(spark, [400]), "observed")
    models, full = M.fit_models(stage(training.design(series, "NumVehicles"), "design"), "NumVehicles", order=(1, 0, 0))
    models = stage(models, "models")

    def ahead(value):
        seen = spark.createDataFrame([("N400", 3, value)], "DeviceId string, steps int, NumVehicles double").selectExpr(
            "*", "timestamp_ntz'2024-01-17 16:00:00' AS BucketTime",
            *[f"0.0D AS {c}" for c in TARGET_REGRESSORS["NumVehicles"]])
        rows = P.forecast_requests(P.observed_requests(full, series, models, seen, "NumVehicles", "1 hour")).collect()
        return sorted((r["step"], r["BucketTime"].hour, r["predicted"]) for r in rows)

    low, high = ahead(20.0), ahead(30.0)
    assert [r[:2] for r in low] == [r[:2] for r in high] == [(1, 17), (2, 18), (3, 19)]
    w = models.first()["w"][0]
    assert abs((high[0][2] - low[0][2]) - 10 * w) < 1e-6 and abs((high[1][2] - low[1][2]) - 10 * w * w) < 1e-6


def test_candidates_share_the_regressors(monkeypatch):
    """A search solves the regressors once for each matrix; weights are those of a fit of its own, collinear flags included."""
    rng, reach = np.random.default_rng(5), 122
    lay = M.layout("NumVehicles", True, reach)
    n, m = 400, lay.m
    x = rng.normal(3, 1, (n, m))
    x[:, 8:] = 0.0
    x[np.arange(n), 8 + rng.integers(0, 4, n)] = 1.0  # four flags add up to the constant
    gram_of = lambda lags: np.column_stack([np.ones(n), x, lags]).T @ np.column_stack([np.ones(n), x, lags])
    lags = rng.normal(5, 1, (n, lay.size - 1 - m)) + rng.normal(0, 1, (n, 1))
    solved, solve = [], S.least_squares
    monkeypatch.setattr(S, "least_squares", lambda *a: solved.append(1) or solve(*a))
    common = S.Common(gram_of(lags), n, lay, M.REACH)
    for order, season in M.candidates(True):
        got, calls = common.fit(order, season), len(solved)
        want = S.fit(gram_of(lags), n, lay, order, season, M.REACH)
        assert calls == len(solved) - 1
        del solved[:]
        for name in ("const", "beta", "w", "theta"):
            np.testing.assert_allclose(got[name], want[name], rtol=1e-7, atol=1e-9)
    # Lags that are copies of each other are left to the fit of its own.
    twins = np.repeat(lags[:, :1], lags.shape[1], axis=1)
    got, want = (f((2, 0, 0), M.NO_SEASON) for f in (S.Common(gram_of(twins), n, lay, M.REACH).fit,
                 lambda o, z: S.fit(gram_of(twins), n, lay, o, z, M.REACH)))
    np.testing.assert_allclose(got["w"], want["w"])


def test_fitted_models_are_solved_once(rows, monkeypatch):
    """Devices without a model are looked for among staged models, not by solving all of them again."""
    models, _ = M.fit_models(rows, "NumVehicles")
    plan = models._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "MapInArrow" not in plan
