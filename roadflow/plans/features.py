"""Regressor tables of the forecast targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import DUMMY_COLS, calendar_dummies, is_holiday
from ..operators.timeseries import series_window
from ..schemas import TARGET_REGRESSORS

#: Raw lags of the target that a design holds: the near ones (three terms or a long autoregression of five, two
#: differences), and those that seasons of 12 and 60 steps reach with two differences and, for 60, a seasonal one.
LAGS = (*range(1, 8), 12, 13, 14, 24, 25, 26, *range(60, 66), 120, 121, 122)
#: Lags of the shocks: two near ones and one season.
SHOCK_LAGS = (1, 2, 60)
#: How far lags may reach: the nearer a model looks, the earlier in a series its rows begin.
REACHES = (7, 26, 65, 122)
#: Values before a forecast that models may weigh.
MAX_LAG, MAX_SHOCK = max(LAGS), max(SHOCK_LAGS)


def regressor_names(target: str) -> list[str]:
    return [f"{c}_lag1" for c in TARGET_REGRESSORS[target]] + ["IsHoliday"] + DUMMY_COLS


def model_features(series: DataFrame, target: str) -> DataFrame:
    """Target and regressors of a gap-free device series.

    Regressors are lag-1 values (the first row repeats its own value, as a backward fill
    would give), the holiday flag and one-hot hour and weekday on a fixed vocabulary.
    """
    return as_design(lagged_regressors(series, (target,)), target)


def lagged_regressors(series: DataFrame, targets: tuple[str, ...]) -> DataFrame:
    """Targets as they are and the lag-1 values of all their regressors."""
    w = series_window(["DeviceId"])
    names = dict.fromkeys(c for t in targets for c in TARGET_REGRESSORS[t])
    lagged = [F.coalesce(F.lag(c, 1).over(w), F.col(c)).alias(f"{c}_lag1") for c in names]
    return series.select("DeviceId", "BucketTime", *dict.fromkeys(targets), *lagged)


def as_design(lagged: DataFrame, target: str) -> DataFrame:
    """One target's columns of ``lagged_regressors`` with the flags of the calendar, and ``rn`` if it is there."""
    return lagged.select(
        "DeviceId", "BucketTime", F.col(target).alias("y"), *[f"{c}_lag1" for c in TARGET_REGRESSORS[target]],
        is_holiday("BucketTime").alias("IsHoliday"),
        *[v.alias(k) for k, v in calendar_dummies("BucketTime").items()],
        *(["rn"] if "rn" in lagged.columns else []),
    )


def with_row_numbers(features: DataFrame) -> DataFrame:
    """Column ``rn``, the row counted from the end."""
    size = F.count(F.lit(1)).over(W.partitionBy("DeviceId"))
    return features.withColumn("rn", size - F.row_number().over(series_window(["DeviceId"])) + 1)


def with_target_lags(features: DataFrame) -> DataFrame:
    """Columns y1, y2 .., the target so many steps back (``LAGS``), and ``rn``, the row counted from the end."""
    w = series_window(["DeviceId"])
    return with_row_numbers(features.withColumns({f"y{k}": F.lag("y", k).over(w) for k in LAGS}))


LAG_COLS = [f"y{k}" for k in LAGS]
SHOCK_COLS = [f"e{k}" for k in SHOCK_LAGS]
