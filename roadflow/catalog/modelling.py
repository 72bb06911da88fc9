"""Queries of the feature, fit, search, forecast and evaluation jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..models import evaluate as E
from ..models import fit as M
from ..models import forecast as P
from ..models import store
from ..operators import timeseries as T
from ..plans import documents as Doc
from ..plans import training
from ..plans.features import model_features as features
from ..schemas import TARGET_REGRESSORS
from ..sources import configs
from ..sources import sample_feeds as S
from ..schemas import WEATHER_COLS
from ..session import scratch_path, stage
from . import inputs as I
from .joining import METRICS_SQL, _metric_rows
from .registry import query, rounded
from .sqltext import dummies, holiday, sql

H = I.HOUR_S


def _features_sql(target: str) -> str:
    lags = ", ".join(
        f"round(coalesce(lag({c}) OVER w, {c}), 8) AS {c}_lag1" for c in TARGET_REGRESSORS[target]
    )
    return sql(
        f"SELECT DeviceId, BucketTime, round({target}, 8) AS y, {lags}, {holiday('BucketTime')} AS IsHoliday, "
        f"{dummies('BucketTime')} FROM series WINDOW w AS (PARTITION BY DeviceId ORDER BY BucketTime)",
        "series", grain=H,
    )


@query("model_features", _features_sql("NumVehicles"))
def model_features(spark, d):
    return rounded(features(I.series(spark, d), "NumVehicles"))


@query("model_features_speed", _features_sql("AvgSpeed"))
def model_features_speed(spark, d):
    return rounded(features(I.series(spark, d), "AvgSpeed"))


# Persistence forecasts: SQL-checkable scores without a solver.
_NAIVE = {
    "f": """SELECT DeviceId, BucketTime, NumVehicles AS actual, lag(NumVehicles) OVER (PARTITION BY DeviceId ORDER BY
    BucketTime) AS predicted, AvgSpeed AS actual2, lag(AvgSpeed) OVER (PARTITION BY DeviceId ORDER BY BucketTime) AS predicted2
    FROM series""",
    "sc": """SELECT DeviceId, 'NumVehicles' AS TargetCol, actual AS y, predicted AS p FROM f WHERE predicted IS NOT NULL
    UNION ALL SELECT DeviceId, 'AvgSpeed', actual2, predicted2 FROM f WHERE predicted IS NOT NULL""",
    "mt": """SELECT DeviceId, TargetCol, count(*) AS n, avg(abs(y - p)) AS MAE, sqrt(avg((y - p) * (y - p))) AS RMSE,
    coalesce(avg(abs((y - p) / y)) FILTER (WHERE y > 0), 0) * 100 AS MAPE,
    1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS R2 FROM sc GROUP BY ALL""",
}


def _naive(spark, d):
    s = I.series(spark, d)
    w = T.series_window(["DeviceId"])
    parts = [
        s.select("DeviceId", "BucketTime", F.lit(t).alias("TargetCol"), F.col(t).alias("actual"),
                 F.lag(t, 1).over(w).alias("predicted"))
        for t in ("NumVehicles", "AvgSpeed")
    ]
    return parts[0].unionByName(parts[1]).filter(F.col("predicted").isNotNull())


@query(
    "forecast_metrics",
    sql("SELECT DeviceId, TargetCol, n, round(MAE, 6) AS MAE, round(RMSE, 6) AS RMSE, round(MAPE, 6) AS MAPE, "
        "round(R2, 6) AS R2 FROM mt", "series", grain=H, extra=_NAIVE),
)
def forecast_metrics(spark, d):
    return rounded(E.forecast_metrics(_naive(spark, d), ["DeviceId", "TargetCol"]), places=6)


@query(
    "backtest_metrics",
    sql("SELECT DeviceId, CAST(BucketTime AS DATE) AS day, count(*) AS n, round(avg(abs(actual - predicted)), 6) AS MAE, "
        "round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) AS RMSE, "
        "round(coalesce(avg(abs((actual - predicted) / actual)) FILTER (WHERE actual > 0), 0) * 100, 6) AS MAPE, "
        "round(CASE WHEN count(*) > 1 AND var_pop(actual) > 0 THEN 1 - sum((actual - predicted) * (actual - predicted)) "
        "/ (var_pop(actual) * count(*)) ELSE 0 END, 6) AS R2 FROM f WHERE predicted IS NOT NULL GROUP BY ALL",
        "series", grain=H, extra=_NAIVE),
)
def backtest_metrics(spark, d):
    """Scores of supplied forecasts per device and day, by the dashboard's rule."""
    rows = _naive(spark, d).filter(F.col("TargetCol") == "NumVehicles").withColumn("day", F.to_date("BucketTime"))
    return rounded(E.forecast_metrics(rows, ["DeviceId", "day"], dashboard_rule=True), places=6)


_LIMIT_SQL = (
    "CASE WHEN TargetCol = 'NumVehicles' THEN MAE BETWEEN 0 AND 80 AND RMSE BETWEEN 0 AND 100 AND MAPE BETWEEN 0 AND 25 "
    "AND R2 >= 0 ELSE MAE BETWEEN 0 AND 12 AND RMSE BETWEEN 0 AND 20 AND MAPE BETWEEN 0 AND 20 AND R2 >= 0.4 END"
)


@query(
    "meets_targets",
    sql(f"SELECT row, DeviceId, TargetCol, {_LIMIT_SQL} AS success FROM metrics".replace("SELECT row", 'SELECT "row"'),
        "ev", extra=METRICS_SQL),
)
def meets_targets(spark, d):
    return _metric_rows(spark, d).select("row", "DeviceId", "TargetCol", E.meets_targets().alias("success"))


@query(
    "metric_labels",
    sql("""SELECT "row", CASE WHEN MAPE < 25 THEN 'good' ELSE 'poor' END AS mape_label,
        CASE WHEN R2 > 0 THEN 'good' ELSE 'poor' END AS r2_label, CASE WHEN MAPE < 20 THEN 'good' ELSE 'poor' END AS strict_mape,
        CASE WHEN R2 > 0.4 THEN 'good' ELSE 'poor' END AS strict_r2 FROM metrics""", "ev", extra=METRICS_SQL),
)
def metric_labels(spark, d):
    rows = E.metric_labels(_metric_rows(spark, d))
    strict = E.metric_labels(rows.drop("mape_label", "r2_label"), 20.0, 0.4).select(
        "row", F.col("mape_label").alias("strict_mape"), F.col("r2_label").alias("strict_r2")
    )
    return rows.select("row", "mape_label", "r2_label").join(strict, "row")


_TIERS = ["cfg1_auto_fast", "cfg2_auto_seasonal", "cfg3_auto_long"]


@query(
    "tier_select",
    sql(f"""SELECT DeviceId, TargetCol, "window", MAE, success FROM (SELECT *, row_number() OVER (PARTITION BY DeviceId, TargetCol
        ORDER BY NOT success, CASE WHEN success THEN k ELSE MAE END, k, MAE) AS rn FROM (SELECT DeviceId, TargetCol, k,
        ['cfg1_auto_fast','cfg2_auto_seasonal','cfg3_auto_long'][k] AS "window", MAE, {_LIMIT_SQL} AS success FROM (
        SELECT *, CAST("row" // 2 % 3 + 1 AS INTEGER) AS k FROM metrics))) WHERE rn = 1""", "ev", extra=METRICS_SQL),
)
def tier_select(spark, d):
    """Every metric row belongs to one of the three tiers; a tier may have many rows."""
    tiers = F.array(*[F.lit(t) for t in _TIERS])
    rows = _metric_rows(spark, d).withColumn("window", F.get(tiers, (F.floor(F.col("row") / 2) % 3).cast("int")))
    return E.tier_select(rows, _TIERS).select("DeviceId", "TargetCol", "window", "MAE", "success")


@query(
    "order_source",
    sql("""SELECT DeviceId, CASE WHEN top > 300 THEN 3 ELSE 1 END AS p, 0 AS q, 0 AS sp, 0 AS s,
        CASE WHEN top > 300 THEN 'manual' ELSE 'auto' END AS ConfigSource FROM (SELECT max("value") AS top,
        'N' || CAST(user_id // 10 AS VARCHAR) AS DeviceId FROM ev GROUP BY ALL)""", "ev"),
)
def order_source(spark, d):
    """Devices that ever read above 300 have a manual order, the others a searched one."""
    node = F.concat(F.lit("N"), F.floor(F.col("user_id") / 10).cast("string"))
    devices = S.events(spark, d).groupBy(node.alias("DeviceId")).agg(F.max("value").alias("top"))
    fixed = lambda p: [F.lit(v).alias(c) for c, v in (("p", p), ("q", 0), ("sp", 0), ("s", 0))]
    manual = devices.filter("top > 300").select("DeviceId", *fixed(3))
    auto = devices.select("DeviceId", *fixed(1))
    return E.order_source(devices, manual, None, auto)


@query(
    "residual_acf",
    sql("""SELECT DeviceId, n, CAST(k AS INTEGER) AS lag, round(s / v, 8) AS acf FROM (
        SELECT a.DeviceId, g.k, sum(a.c * b.c) AS s FROM cc a CROSS JOIN (SELECT unnest(range(1, 41)) AS k) g
        JOIN cc b ON b.DeviceId = a.DeviceId AND b.i = a.i - g.k GROUP BY ALL)
        JOIN (SELECT DeviceId, count(*) AS n, sum(c * c) AS v FROM cc GROUP BY ALL) USING (DeviceId)""",
        "series", grain=H, extra={**_NAIVE,
        "cc": """SELECT DeviceId, r - avg(r) OVER (PARTITION BY DeviceId) AS c, row_number() OVER (PARTITION BY DeviceId
        ORDER BY BucketTime) AS i FROM (SELECT DeviceId, BucketTime, actual - predicted AS r FROM f WHERE predicted IS NOT NULL)"""}),
)
def residual_acf(spark, d):
    return rounded(E.residual_acf(_residuals(spark, d)))


def _residuals(spark, d):
    rows = _naive(spark, d).filter(F.col("TargetCol") == "NumVehicles")
    return rows.withColumn("residual", F.col("actual") - F.col("predicted"))


@query(
    "ljung_box",
    sql("""SELECT DeviceId, CAST(10 AS INTEGER) AS dof, round(q, 6) AS lb_stat, round(exp(-q/2) * (1 + q/2 + pow(q/2,2)/2
        + pow(q/2,3)/6 + pow(q/2,4)/24), 6) AS lb_pvalue FROM (SELECT DeviceId, n * (n + 2) * sum(pow(s / v, 2) / (n - k)) AS q FROM (
        SELECT a.DeviceId, g.k, sum(a.c * b.c) AS s FROM cc a CROSS JOIN (SELECT unnest(range(1, 11)) AS k) g
        JOIN cc b ON b.DeviceId = a.DeviceId AND b.i = a.i - g.k GROUP BY ALL)
        JOIN (SELECT DeviceId, count(*) AS n, sum(c * c) AS v FROM cc GROUP BY ALL) USING (DeviceId) GROUP BY DeviceId, n)""",
        "series", grain=H, extra={**_NAIVE,
        "cc": """SELECT DeviceId, r - avg(r) OVER (PARTITION BY DeviceId) AS c, row_number() OVER (PARTITION BY DeviceId
        ORDER BY BucketTime) AS i FROM (SELECT DeviceId, BucketTime, actual - predicted AS r FROM f WHERE predicted IS NOT NULL)"""}),
)
def ljung_box(spark, d):
    return rounded(E.ljung_box(_residuals(spark, d)), places=6)


@query(
    "residual_normal",
    sql("""SELECT DeviceId, round(avg(actual - predicted), 8) AS mean, round(stddev_pop(actual - predicted), 6) AS std
        FROM f WHERE predicted IS NOT NULL GROUP BY ALL""", "series", grain=H, extra=_NAIVE),
)
def residual_normal(spark, d):
    return rounded(rounded(E.normal_fit(_residuals(spark, d)), ["mean"]), ["std"], 6)


@query(
    "residual_hist",
    sql("""SELECT DeviceId, bin, n FROM (SELECT e.DeviceId, CAST(b AS INTEGER) AS bin, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT
        DeviceId FROM h) e CROSS JOIN (SELECT unnest(range(30)) AS b) LEFT JOIN (SELECT DeviceId, i, count(*) AS n FROM (
        SELECT DeviceId, least(floor((r - lo) / (hi - lo) * 30), 29) AS i FROM h) GROUP BY ALL) c
        ON c.DeviceId = e.DeviceId AND c.i = b)""", "series", grain=H, extra={**_NAIVE,
        "h": """SELECT DeviceId, actual - predicted AS r, min(actual - predicted) OVER (PARTITION BY DeviceId) AS lo,
        max(actual - predicted) OVER (PARTITION BY DeviceId) AS hi FROM f WHERE predicted IS NOT NULL"""}),
)
def residual_hist(spark, d):
    return E.residual_histogram(_residuals(spark, d)).select("DeviceId", "bin", "n")


def _quantile_sql(p: str) -> str:
    def ratio(part, r):
        return " / ".join("(" + " + ".join(f"CAST({c!r} AS DOUBLE) * pow({r}, {k})" for k, c in enumerate(cs)) + ")" for cs in E.QUANTILE[part])

    tail = f"sqrt(-ln(least({p}, 1 - {p})))"
    return (f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {ratio('middle', f'(0.180625 - ({p} - 0.5) * ({p} - 0.5))')} "
            f"ELSE sign({p} - 0.5) * CASE WHEN {tail} <= 5 THEN {ratio('near', f'({tail} - 1.6)')} ELSE {ratio('far', f'({tail} - 5)')} END END")


@query(
    "qq_points",
    sql(f"""SELECT DeviceId, i AS "rank", round(r, 8) AS ordered, round({_quantile_sql('p')}, 8) AS theoretical FROM (
        SELECT *, CAST(CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n)
        ELSE (i - 0.3175) / (n + 0.365) END AS DOUBLE) AS p FROM (SELECT DeviceId, actual - predicted AS r,
        row_number() OVER (PARTITION BY DeviceId ORDER BY actual - predicted) AS i, count(*) OVER (PARTITION BY DeviceId) AS n
        FROM f WHERE predicted IS NOT NULL))""", "series", grain=H, extra=_NAIVE),
)
def qq_points(spark, d):
    return rounded(E.qq_points(_residuals(spark, d)))


@query(
    "ci_fallback",
    sql("""SELECT f.DeviceId, BucketTime, round(greatest(predicted - s * 1.5 * 1.96, 0), 8) AS lower,
        round(predicted + s * 1.5 * 1.96, 8) AS upper FROM f JOIN (SELECT DeviceId, stddev_samp(predicted) AS s FROM f GROUP BY ALL) g
        USING (DeviceId) WHERE predicted IS NOT NULL""", "series", grain=H, extra=_NAIVE),
)
def ci_fallback(spark, d):
    rows = _residuals(spark, d).select("DeviceId", "BucketTime", "predicted")
    spread = rows.groupBy("DeviceId").agg(F.stddev_samp("predicted").alias("std_fitted"))
    out = P.fallback_interval(rows.join(spread, "DeviceId"))
    return rounded(out.select("DeviceId", "BucketTime", "lower", "upper"))


@query(
    "horizon_pick",
    sql("""SELECT DeviceId, round(max(v) FILTER (WHERE k = 3), 8) AS "15m", round(max(v) FILTER (WHERE k = 6), 8) AS "30m",
        round(max(v) FILTER (WHERE k = 12), 8) AS "60m" FROM (SELECT DeviceId, NumVehicles AS v, row_number() OVER
        (PARTITION BY DeviceId ORDER BY BucketTime) AS k FROM series) GROUP BY ALL""", "series", grain=H),
)
def horizon_pick(spark, d):
    s = I.series(spark, d)
    step = F.row_number().over(T.series_window(["DeviceId"]))
    rows = s.select("DeviceId", step.alias("step"), F.col("NumVehicles").alias("predicted"), F.lit(0).alias("origin"))
    return rounded(P.horizons(rows, {"15m": 3, "30m": 6, "60m": 12}).drop("origin"))


@query(
    "dashboard_history",
    sql("""SELECT DeviceId, part, strftime(BucketTime, '%Y-%m-%d %H:%M') AS time, round(NumVehicles, 8) AS actual, round(AvgSpeed, 8) AS speed,
        round(Rain, 8) AS rain, round(Temperature, 8) AS temp, round(Humidity, 8) AS hum, round(Visibility, 8) AS vis FROM (
        SELECT *, unnest(CASE WHEN rn <= 24 THEN ['test_actual', 'future_history'] ELSE ['history'] END) AS part FROM (
        SELECT *, row_number() OVER (PARTITION BY DeviceId ORDER BY BucketTime DESC) AS rn FROM series) WHERE rn <= 48)""",
        "series", grain=H),
)
def dashboard_history(spark, d):
    return rounded(Doc.history_points(I.series(spark, d), "NumVehicles"))


_OBS = {
    "rq": """SELECT event_id, 'N' || CAST(user_id // 10 AS VARCHAR) AS DeviceId, CASE WHEN kk % 2 = 0 THEN ts END AS t,
    "value" AS AvgSpeed, CASE WHEN kk % 3 <> 0 THEN CAST(kk AS DOUBLE) END AS Occupancy, CAST(kk AS DOUBLE) AS Confidence
    FROM ev""",
    "la": "SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY DeviceId ORDER BY BucketTime DESC) = 1",
}


@query(
    "obs_resolve",
    sql(f"""SELECT *, CAST(hour(BucketTime) AS INTEGER) AS Hour, CAST(isodow(BucketTime) - 1 AS INTEGER) AS DayOfWeek,
        {holiday('BucketTime')} AS IsHoliday, CAST(isodow(BucketTime) >= 6 AS INTEGER) AS IsWeekend FROM (
        SELECT event_id, r.DeviceId, l.DeviceId IS NOT NULL AS Known, coalesce(time_bucket(INTERVAL 1 HOUR, r.t), l.BucketTime + INTERVAL 1 HOUR) AS BucketTime,
        round(coalesce(l.NumVehicles, 0), 8) AS NumVehicles, round(r.AvgSpeed, 8) AS AvgSpeed, round(coalesce(r.Occupancy, l.Occupancy, 0), 8) AS Occupancy,
        round(r.AvgSpeed, 8) AS MedianSpeed, round(r.Confidence, 8) AS MeanConfidence, CAST(0 AS DOUBLE) AS SpeedStd
        FROM rq r LEFT JOIN la l ON l.DeviceId = r.DeviceId)""", "series", "ev", grain=H, extra=_OBS),
)
def obs_resolve(spark, d):
    cols = ["NumVehicles", "AvgSpeed", "Occupancy", "MedianSpeed", "MeanConfidence", "SpeedStd"]
    latest = T.last_row(I.series(spark, d), ["DeviceId"])
    return rounded(Doc.resolve_observations(_observations(spark, d), latest, cols, I.HOUR))


def _observations(spark, d):
    kk = F.col("kk")
    return S.events(spark, d).select(
        "event_id", F.concat(F.lit("n"), F.floor(F.col("user_id") / 10).cast("string")).alias("DeviceId"),
        F.when(kk % 2 == 0, F.col("ts")).alias("ObservationTime"), F.col("value").alias("AvgSpeed"),
        F.when(kk % 3 != 0, kk.cast("double")).alias("Occupancy"), kk.cast("double").alias("Confidence"),
    )


# --- jobs that need the solver: checked by properties in the tests -----------------


def _design(spark, d, target="NumVehicles"):
    return training.design(I.series(spark, d), target)


def _models(spark, d, target="NumVehicles", order=(2, 0, 1)):
    """Models that leave the last 12 rows out, and the rows with shocks."""
    rows = _design(spark, d, target)
    return M.fit_models(rows, target, order=order, window=(13, M.EVERYTHING), name="train")


@query("adf_order")
def adf_order(spark, d):
    return M.stationarity(_design(spark, d), "NumVehicles")


@query("order_search")
def order_search(spark, d):
    return M.order_search(_design(spark, d), "NumVehicles", training.SEARCH, 12)


@query("best_order")
def best_order(spark, d):
    return M.best_order(M.order_search(_design(spark, d), "NumVehicles", training.SEARCH, 12))


@query("tiered_optimise")
def tiered_optimise(spark, d):
    return training.optimise(I.series(spark, d), "NumVehicles")


@query("fit_models")
def fit_models(spark, d):
    return _models(spark, d)[0].select("DeviceId", "TargetCol", "p", "d", "q", "sp", "s", "n", "const", "sigma2")


@query("model_table")
def model_table(spark, d):
    """The model table stored by name and loaded again: arrays and numbers, no pickles."""
    folder = scratch_path(spark, "models")
    store.save(_models(spark, d, "AvgSpeed")[0], folder, "AvgSpeed")
    return store.load(spark, folder, "AvgSpeed")


@query("coef_report")
def coef_report(spark, d):
    return configs.coefficient_report(training.coefficients(_models(spark, d)[0], "NumVehicles"))


@query("forecast_h")
def forecast_h(spark, d):
    """24 future steps with the last regressors persisted and the calendar moved on."""
    models, rows = _models(spark, d)
    return P.forecast_requests(P.future_requests(rows, I.series(spark, d), models, "NumVehicles", 24, I.HOUR))


@query("forecast_ci")
def forecast_ci(spark, d):
    models, rows = _models(spark, d)
    return P.with_actuals(P.forecast_requests(P.holdout_requests(rows, models, "NumVehicles", 12)), rows)


@query("fitted_values")
def fitted_values(spark, d):
    models, rows = _models(spark, d)
    return P.fitted_values(rows, models, "NumVehicles")


@query("train_eval")
def train_eval(spark, d):
    return training.train(I.series(spark, d), "NumVehicles", I.HOUR, order=(2, 0, 0)).metrics


@query("train_targets")
def train_targets(spark, d):
    """Both targets of every device: searched orders, except that the configuration gives every fourth device its own."""
    # Read by the configuration and by the features and forecasts of both targets.
    series = stage(I.series(spark, d), "series")
    manual = series.select("DeviceId").distinct().filter(F.crc32(F.col("DeviceId").cast("binary")) % 4 == 0)
    config = manual.select("DeviceId", F.create_map(F.lit("NumVehicles_order"), F.lit("[2, 0, 1]")).alias("settings"))
    runs = training.train_targets(series, I.HOUR, config)
    return reduce(DataFrame.unionByName, [r.metrics for r in runs.values()])


@query("backtest_table")
def backtest_table(spark, d):
    """Every stamp is an origin of a 12-step backtest; late ones move back to the last with 12 known steps."""
    models, rows = _models(spark, d)
    origins = rows.select("DeviceId", F.col("BucketTime").alias("origin"))
    wanted = P.backtest_requests(rows, models, origins, "NumVehicles", 12)
    found = P.with_error(P.forecast_requests(wanted, actual=True))
    return found.select("DeviceId", "BucketTime", *[c for c in found.columns if c not in ("DeviceId", "BucketTime")])


@query(
    "backtest_origin_scores",
    sql("""SELECT DeviceId, origin, count(*) AS n, round(avg(abs(y - p)), 6) AS MAE, round(sqrt(avg((y - p) * (y - p))), 6) AS RMSE,
        round(coalesce(avg(abs((y - p) / y)) FILTER (WHERE y > 0), 0) * 100, 6) AS MAPE,
        round(CASE WHEN count(*) > 1 AND var_pop(y) > 0 THEN 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) ELSE 0 END, 6) AS R2
        FROM (SELECT w.DeviceId, w.origin, a.NumVehicles AS y, b.NumVehicles AS p FROM placed w
        JOIN num a ON a.DeviceId = w.DeviceId AND a.rn < w.rn AND a.rn >= w.rn - 12
        JOIN num b ON b.DeviceId = w.DeviceId AND b.rn = w.rn) GROUP BY ALL""", "series", "ev", grain=H, extra={
        "num": """SELECT DeviceId, BucketTime, NumVehicles, row_number() OVER (PARTITION BY DeviceId ORDER BY BucketTime DESC) AS rn,
        count(*) OVER (PARTITION BY DeviceId) AS size FROM series""",
        "asked": "SELECT DISTINCT 'N' || CAST(user_id // 10 AS VARCHAR) AS DeviceId, ts AS origin FROM ev",
        "placed": """SELECT k.DeviceId, k.origin, least(greatest(coalesce(s.rn, z.size), 13), z.size) AS rn FROM asked k
        JOIN (SELECT DeviceId, count(*) AS size FROM series GROUP BY ALL) z ON z.DeviceId = k.DeviceId
        ASOF LEFT JOIN num s ON k.DeviceId = s.DeviceId AND k.origin >= s.BucketTime"""}),
)
def backtest_origin_scores(spark, d):
    """Scores of every event's stamp as an origin, forecast by its last value: stamps off the grid and at both ends included."""
    series = I.series(spark, d)
    w = T.series_window(["DeviceId"])
    size = F.count(F.lit(1)).over(W.partitionBy("DeviceId"))
    rows = stage(series.select("DeviceId", "BucketTime", F.col("NumVehicles").alias("y"),
                               (size - F.row_number().over(w) + 1).alias("rn")), "numbered")
    node = F.concat(F.lit("N"), F.floor(F.col("user_id") / 10).cast("string"))
    origins = S.events(spark, d).select(node.alias("DeviceId"), F.col("ts").alias("origin"))
    return rounded(P.origin_scores(P.repeated_last(rows, origins, 12)), places=6)


@query("dashboard_doc")
def dashboard_doc(spark, d):
    series = I.series(spark, d)
    run = training.train(series, "NumVehicles", I.HOUR, order=(2, 0, 0))
    return Doc.device_documents(Doc.history_points(series, "NumVehicles"), run.holdout, run.future, run.metrics)


@query("node_forecast")
def node_forecast(spark, d):
    """The newest observation of each device, forecast an hour or more ahead from its own stamp."""
    models, rows = _models(spark, d, "AvgSpeed")
    series = I.series(spark, d)
    cols = ["NumVehicles", "AvgSpeed", "Occupancy", "AvgDensity", "AvgHeadway", "FlowRate", "MeanConfidence", *WEATHER_COLS]
    latest = T.last_row(series, ["DeviceId"])
    newest = Doc.resolve_observations(T.last_row(
        _observations(spark, d).withColumn("BucketTime", F.col("event_id")), ["DeviceId"]
    ).drop("BucketTime"), latest, cols, I.HOUR)
    asked = newest.withColumn("_minutes", F.lit(12 * 60)).withColumn("steps", Doc.horizon_steps("_minutes", 60))
    ahead = P.forecast_requests(P.observed_requests(rows, series, models, asked, "AvgSpeed", I.HOUR))
    tested = P.with_actuals(P.forecast_requests(P.holdout_requests(rows, models, "AvgSpeed", 12)), rows)
    return Doc.node_forecast(ahead, series, newest, "AvgSpeed", E.forecast_metrics(tested, ["DeviceId"]))
