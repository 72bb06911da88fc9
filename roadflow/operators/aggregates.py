"""Aggregations of the feeds by time, device and lane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, one_row, ratio_or_null, total
from ..schemas import (
    CATEGORIES, COUNT_COLS, KEYS, PROFILE_COLS, RATIO_COLS, SERIES, TRAFFIC_METRICS,
    WEATHER_COLS,
)
from .quantiles import exact_medians, exact_quantiles, hot_groups  # noqa: F401

HOT_ROWS = 1_000_000


def weighted_average(value, weight) -> Column:
    """Weighted mean over present values with a positive weight, else the plain mean."""
    v, w = col(value), col(weight)
    valid = v.isNotNull() & (w > 0)
    return F.coalesce(
        F.try_divide(F.sum(F.when(valid, v * w)), F.sum(F.when(valid, w))), F.avg(v)
    )


def traffic_by_key(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg("NumVehicles").alias("NumVehicles"),
        *[
            weighted_average(c, "NumVehicles").alias(c)
            for c in ("AvgSpeed", "Occupancy", "AvgDensity", "AvgHeadway")
        ],
        F.avg("FlowRate").alias("FlowRate"),
        F.count(F.lit(1)).alias("TrafficRowsInKey"),
    )


def median_impute(df: DataFrame, cols: list[str] = TRAFFIC_METRICS) -> DataFrame:
    """Nulls take the column's median over the whole table, or 0 without any value."""
    median = one_row(exact_medians(df, cols))
    return df.withColumns({c: F.coalesce(F.col(c), median[c], F.lit(0.0)) for c in cols})


def vehicle_class_counts(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(*_class_counts())


def _class_counts() -> list[Column]:
    return [
        F.count_if(F.col("VehicleCategory") == cat).alias(name)
        for cat, name in zip(CATEGORIES, COUNT_COLS)
    ]


def _vehicle_aggs() -> list[Column]:
    return [
        F.avg("TravelTimeSec").alias("AvgTravelTime"),
        F.stddev_pop("Speed").alias("SpeedStd"),
        F.avg("Confidence").alias("MeanConfidence"),
        F.count(F.lit(1)).alias("VehicleRows"),
        *_class_counts(),
    ]


def vehicle_by_key(
    df: DataFrame, keys: list[str] = KEYS, hot: DataFrame | None = None
) -> DataFrame:
    """Vehicle statistics and class counts in one grouping per key.

    Everything but the median combines map-side into a few numbers. The median keeps a
    key's distinct speeds, so the keys in ``hot`` (see ``hot_groups``) are split off and
    take theirs from the bracketed quantile, which never holds a group in one task.
    """
    order = [*keys, "AvgTravelTime", "MedianSpeed", "SpeedStd", "MeanConfidence", "VehicleRows",
             *COUNT_COLS]
    small = lambda d: d.groupBy(*keys).agg(F.median("Speed").alias("MedianSpeed"), *_vehicle_aggs())
    if hot is None or hot.isEmpty():
        return small(df).select(*order)
    cool = small(df.join(hot, keys, "left_anti"))
    warm = df.join(hot, keys, "left_semi")
    medians = exact_quantiles(warm, ["Speed"], [0.5], keys).select(
        *keys, F.col("value").alias("MedianSpeed")
    )
    stats = warm.groupBy(*keys).agg(*_vehicle_aggs())
    return cool.select(*order).unionByName(stats.join(medians, keys, "left").select(*order))


def vehicle_ratios(df: DataFrame) -> DataFrame:
    """Class shares of the counted vehicles; null for a key without any."""
    counted = total(COUNT_COLS)
    return df.withColumns(
        {r: ratio_or_null(F.col(c), counted) for c, r in zip(COUNT_COLS, RATIO_COLS)}
    )


def vehicle_features(
    df: DataFrame, keys: list[str] = KEYS, hot: DataFrame | None = None
) -> DataFrame:
    return vehicle_ratios(vehicle_by_key(df, keys, hot))


def mean_by(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def hourly_profile(df: DataFrame, cols: list[str] = PROFILE_COLS) -> DataFrame:
    return mean_by(df.withColumn("Hour", F.hour("BucketTime")), SERIES + ["Hour"], cols)


def global_hourly_profile(df: DataFrame, cols: list[str] = PROFILE_COLS) -> DataFrame:
    return mean_by(df.withColumn("Hour", F.hour("BucketTime")), ["Hour"], cols)


def weather_by_time(df: DataFrame) -> DataFrame:
    return mean_by(df, ["BucketTime"], WEATHER_COLS)


def device_series(df: DataFrame, cols: list[str]) -> DataFrame:
    """Lane means: one row per device and time."""
    return mean_by(df, ["DeviceId", "BucketTime"], cols)


def daily_join_diagnostics(joined: DataFrame) -> DataFrame:
    """Matched and unmatched rows by day from a join with a ``match`` column."""
    return (
        joined.groupBy(F.to_date("BucketTime").alias("Date"))
        .agg(
            F.count_if(F.col("match") == "left_only").alias("TrafficWithoutVehicle"),
            F.count_if(F.col("match") == "both").alias("TrafficWithVehicle"),
            F.count_if(F.col("match") == "right_only").alias("VehicleWithoutTraffic"),
        )
        .withColumn("TrafficRows", F.col("TrafficWithoutVehicle") + F.col("TrafficWithVehicle"))
        .withColumn(
            "MatchedPercent",
            F.when(
                F.col("TrafficRows") > 0,
                F.col("TrafficWithVehicle") / F.col("TrafficRows") * 100.0,
            ).otherwise(0.0),
        )
    )


