"""Feeds and intermediate tables shared by the named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import aggregates as A
from ..operators import clean as K
from ..operators import timeseries as T
from ..plans import etl
from ..schemas import KEYS, TRAFFIC_METRICS, WEATHER_COLS
from ..session import stage
from ..sources import sample_feeds as S

HOUR, HOUR_S = "1 hour", 3600
FIVE, FIVE_S = "5 minutes", 300


def traffic_clean(spark: SparkSession, d: str, step: str = HOUR) -> DataFrame:
    return K.clean_traffic(S.traffic_feed(spark, d, step))


def vehicle_clean(spark: SparkSession, d: str, step: str = HOUR) -> DataFrame:
    return K.clean_vehicle(S.vehicle_feed(spark, d, step))


def weather_mean(spark: SparkSession, d: str, step: str = HOUR) -> DataFrame:
    return A.weather_by_time(K.clean_weather(S.weather_feed(spark, d, step)))


def traffic_agg(spark: SparkSession, d: str, step: str = HOUR) -> DataFrame:
    return A.traffic_by_key(traffic_clean(spark, d, step))


def traffic_obs(spark: SparkSession, d: str, step: str = HOUR) -> DataFrame:
    return A.median_impute(traffic_agg(spark, d, step).select(*KEYS, *TRAFFIC_METRICS))


def vehicle_feat(spark: SparkSession, d: str, step: str = HOUR) -> DataFrame:
    return A.vehicle_features(vehicle_clean(spark, d, step))


def observed(spark: SparkSession, d: str, step: str = HOUR) -> DataFrame:
    """The per-key table, staged as the ETL job does: several branches read it."""
    table = etl.observed_table(traffic_agg(spark, d, step), vehicle_feat(spark, d, step))
    return stage(table, "observed")


def device_freq(spark: SparkSession, d: str, step: str = HOUR) -> DataFrame:
    """Lane means of the interval feed on a regular index with weather; gaps stay open."""
    dev = A.device_series(traffic_obs(spark, d, step), TRAFFIC_METRICS)
    return T.asfreq(dev, step).join(weather_mean(spark, d, step), "BucketTime", "left")


def series(spark: SparkSession, d: str, step: str = HOUR) -> DataFrame:
    """The same without gaps: next value, else previous, else 0."""
    cols = TRAFFIC_METRICS + WEATHER_COLS
    filled = T.bfill_ffill(device_freq(spark, d, step), cols, ["DeviceId"])
    return filled.select("DeviceId", "BucketTime", *cols)


def etl_run(spark: SparkSession, d: str, step: str = FIVE) -> etl.EtlResult:
    return etl.build(
        S.traffic_feed(spark, d, step), S.vehicle_feed(spark, d, step),
        S.weather_feed(spark, d, step), etl.EtlOptions(step=step),
    )
