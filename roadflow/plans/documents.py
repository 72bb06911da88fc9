"""Nested dashboard documents and request resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import add_steps, calendar, floor_to
from ..operators.timeseries import tail_n

POINT = {
    "speed": "AvgSpeed", "rain": "Rain", "temp": "Temperature", "hum": "Humidity", "vis": "Visibility",
}


def _minute(c) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm")


def history_points(series: DataFrame, target: str, test: int = 24, keep: int = 24) -> DataFrame:
    """Rows of the document's three history lists: device, part, time and values.

    history: the ``keep`` rows before the test part; test_actual: the test part;
    future_history: the last ``keep`` rows.
    """
    tail = tail_n(series, test + keep, ["DeviceId"])
    from pyspark.sql import Window as W

    rn = F.row_number().over(W.partitionBy("DeviceId").orderBy(F.col("BucketTime").desc()))
    parts = F.array(
        F.when(F.col("_rn") > test, F.lit("history")),
        F.when(F.col("_rn") <= test, F.lit("test_actual")),
        F.when(F.col("_rn") <= keep, F.lit("future_history")),
    )
    return (
        tail.withColumn("_rn", rn)
        .withColumn("part", F.explode(F.array_compact(parts)))
        .select(
            "DeviceId", "part", _minute("BucketTime").alias("time"), F.col(target).alias("actual"),
            *[F.col(c).alias(k) for k, c in POINT.items()],
        )
    )


def forecast_points(forecasts: DataFrame, part: str) -> DataFrame:
    return forecasts.select(
        "DeviceId", F.lit(part).alias("part"), _minute("BucketTime").alias("time"), "predicted"
    )


def device_documents(
    history: DataFrame, test: DataFrame, future: DataFrame, metrics: DataFrame
) -> DataFrame:
    """One nested document per device; every list is bounded by its window."""
    values = ["time", "actual", *POINT]

    def listed(df, part, fields):
        return F.sort_array(
            F.collect_list(F.when(F.col("part") == part, F.struct(*fields)))
        ).alias(part)

    past = history.groupBy("DeviceId").agg(
        *[listed(history, p, values) for p in ("history", "test_actual", "future_history")]
    )
    ahead = (
        forecast_points(test, "test_predict")
        .unionByName(forecast_points(future, "future_forecast"))
        .groupBy("DeviceId")
        .agg(*[listed(None, p, ["time", "predicted"]) for p in ("test_predict", "future_forecast")])
    )
    at = lambda k: F.col("future_forecast")[k]["predicted"]
    horizons = F.struct(
        at(0).alias("1m"), at(0).alias("5m"), at(2).alias("15m"), at(5).alias("30m"), at(11).alias("60m")
    )
    scores = metrics.select("DeviceId", F.struct("MAE", "RMSE", "MAPE", "R2").alias("metrics"))
    return (
        past.join(ahead, "DeviceId", "left").join(scores, "DeviceId", "left")
        .withColumn("horizons", horizons)
    )


def resolve_observations(
    requests: DataFrame, latest: DataFrame, cols: list[str], step: str = "5 minutes"
) -> DataFrame:
    """Observation rows completed from each device's latest row.

    Device ids are upper-cased; ``Confidence`` stands in for MeanConfidence, AvgSpeed for
    MedianSpeed; what is still missing comes from the latest row, then 0. Without a time
    the observation belongs to the step after the latest row; stamps are put on the grid.
    A device without a latest row stays, with ``Known`` false and no time but its own.
    """
    alias = {"MeanConfidence": "Confidence", "MedianSpeed": "AvgSpeed"}
    have = set(requests.columns)
    last = latest.select(
        "DeviceId", F.lit(True).alias("_known"), F.col("BucketTime").alias("_t"),
        *[F.col(c).alias(f"_l_{c}") for c in cols if c in latest.columns]
    )
    joined = requests.withColumn("DeviceId", F.upper("DeviceId")).join(last, "DeviceId", "left")

    def value(c):
        options = [F.col(c)] if c in have else []
        options += [F.col(alias[c])] if alias.get(c) in have else []
        options += [F.col(f"_l_{c}")] if c in latest.columns else []
        return F.coalesce(*options, F.lit(0.0)).alias(c)

    time = F.coalesce(floor_to("ObservationTime", step), add_steps("_t", 1, step))
    rest = [c for c in requests.columns if c not in cols + ["DeviceId", "ObservationTime", "Confidence"]]
    known = F.coalesce("_known", F.lit(False)).alias("Known")
    out = joined.select("DeviceId", *rest, known, time.alias("BucketTime"), *[value(c) for c in cols])
    return out.withColumns({k: v for k, v in calendar("BucketTime").items() if k not in ("Day", "Month")})


def horizon_steps(minutes, step_minutes: int = 5) -> Column:
    """Forecast steps of a horizon in minutes, one at least."""
    return F.greatest(F.lit(1), F.floor(F.col(minutes) / step_minutes)).cast("int")


def node_forecast(
    forecasts: DataFrame, actuals: DataFrame, resolved: DataFrame, target: str, metrics: DataFrame | None = None
) -> DataFrame:
    """Joint answer per step: the forecast target, other measures known or as observed, and the target's scores.

    ``metrics`` (DeviceId, MAE, RMSE, MAPE, R2) has a row for each device at most; a device without scores shows
    zeros. Every observed device is answered: one that is not known, or has no model, has a single row
    without a step, and ``Status`` says why. A measure that ``actuals`` lack is shown as observed.
    """
    places = {"NumVehicles": 1, "AvgSpeed": 2, "Occupancy": 2, "AvgDensity": 2, "AvgHeadway": 2, "FlowRate": 2, "MeanConfidence": 2}
    others = [c for c in places if c != target]
    measured = [c for c in others if c in actuals.columns]
    known = actuals.select("DeviceId", "BucketTime", F.lit(1).alias("_hit"), *[F.col(c).alias(f"_k_{c}") for c in measured])
    seen = resolved.select("DeviceId", "Known", *[F.col(c).alias(f"_o_{c}") for c in others])
    joined = seen.join(forecasts, "DeviceId", "left").join(known, ["DeviceId", "BucketTime"], "left")
    scores = {"Mae": ("MAE", 2), "Rmse": ("RMSE", 2), "Mape": ("MAPE", 2), "R2": ("R2", 3)}
    if metrics is None:
        joined = joined.withColumns({f"_m_{c}": F.lit(0.0) for c, _ in scores.values()})
    else:
        joined = joined.join(metrics.select("DeviceId", *[F.col(c).alias(f"_m_{c}") for c, _ in scores.values()]), "DeviceId", "left")
    value = lambda c: F.when(F.col("_hit") == 1, F.col(f"_k_{c}")).otherwise(F.col(f"_o_{c}")) if c in measured else F.col(f"_o_{c}")
    answered = F.col("step").isNotNull()
    status = F.when(answered, "ok").when(F.col("Known"), "no model").otherwise("unknown device")
    return joined.select(
        "DeviceId", status.alias("Status"), "step", F.col("BucketTime").alias("Time"),
        *[
            F.when(answered, F.round(F.col("predicted") if c == target else value(c), n)).alias("Confidence" if c == "MeanConfidence" else c)
            for c, n in places.items()
        ],
        F.struct(*[F.round(F.coalesce(f"_m_{c}", F.lit(0.0)), n).alias(k) for k, (c, n) in scores.items()]).alias("Metrics"),
    )
