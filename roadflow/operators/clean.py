"""Cleaning steps of the traffic, vehicle and weather feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType, TimestampNTZType

from ..functions import columns as C
from ..functions.calendar import floor_to, parse_bucket_time
from ..schemas import (
    KEYS, TRAFFIC_DEFAULTS, TRAFFIC_METRICS, VALID_RANGES, VEHICLE_NUMBERS, WEATHER_COLS,
)


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Numbers from text, junk as null. Integer columns pass, so filters on them reach the scan."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns(
        {c: C.to_number(c) for c in cols if c in kinds and not isinstance(kinds[c], IntegralType)}
    )


def normalize_lane(df: DataFrame, lane: str = "Lane") -> DataFrame:
    """Integer text when every present lane is numeric, otherwise a text key.

    The decision covers the whole column, as a scalar subquery.
    """
    numeric = df.agg(F.count(lane) == F.count(C.to_number(lane))).scalar()
    as_int = C.to_number(lane).cast("long").cast("string")
    return df.withColumn(lane, F.when(numeric, as_int).otherwise(C.normalize_key(lane)))


def device_id(use_node_id: bool = True) -> Column:
    return C.normalize_key("NodeId" if use_node_id else "DeviceId")


def bucket_time(df: DataFrame, align: str | None) -> Column:
    """Stamp on the minute, or floored to ``align`` when given; text is parsed first."""
    is_stamp = isinstance(df.schema["BucketTime"].dataType, TimestampNTZType)
    if is_stamp:
        return floor_to("BucketTime", align or "1 minute")
    parsed = parse_bucket_time("BucketTime")
    return floor_to(parsed, align) if align else parsed


def normalize_keys(df: DataFrame, use_node_id: bool = True, align: str | None = None) -> DataFrame:
    """Effective device id, parsed time and lane; a text lane stays a text key."""
    out = df.withColumns({"DeviceId": device_id(use_node_id), "BucketTime": bucket_time(df, align)})
    if isinstance(df.schema["Lane"].dataType, NumericType):
        return out.withColumn("Lane", F.col("Lane").cast("int"))
    return normalize_lane(out)


def lacks_key(df: DataFrame, use_node_id: bool = True, align: str | None = None) -> Column:
    """True for rows that ``drop_null_keys`` will drop once their keys are normalised."""
    lane = C.normalize_key(F.col("Lane").cast("string"))
    return bucket_time(df, align).isNull() | device_id(use_node_id).isNull() | lane.isNull()


def filter_interval(df: DataFrame, interval_type: int | None = 5) -> DataFrame:
    return df if interval_type is None else df.filter(F.col("IntervalType") == interval_type)


def drop_null_keys(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return df.dropna(subset=keys)


def negatives_to_null(df: DataFrame, cols: list[str] = TRAFFIC_METRICS) -> DataFrame:
    return df.withColumns({c: C.non_negative(c) for c in cols})


def range_to_null(df: DataFrame, ranges: dict = VALID_RANGES) -> DataFrame:
    return df.withColumns({c: C.in_range(c, lo, hi) for c, (lo, hi) in ranges.items()})


def range_violations(df: DataFrame, ranges: dict = VALID_RANGES) -> DataFrame:
    return df.agg(
        *[F.count_if(C.out_of_range(c, lo, hi)).alias(c) for c, (lo, hi) in ranges.items()]
    )


def with_category(df: DataFrame) -> DataFrame:
    return df.withColumn("VehicleCategory", C.vehicle_category("VehicleClass"))


def fill_constants(df: DataFrame, values: dict = TRAFFIC_DEFAULTS) -> DataFrame:
    return df.fillna({k: v for k, v in values.items() if k in df.columns})


def align_features(df: DataFrame, expected: list[str], keep: list[str] = ()) -> DataFrame:
    """Project to an expected column list; absent columns and nulls become 0."""
    have = set(df.columns)
    return df.select(
        *keep,
        *[
            (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c)
            for c in expected
        ],
    )


def drop_matching(df: DataFrame, *patterns: str) -> DataFrame:
    """Drop the columns whose name contains one of the patterns."""
    return df.drop(*[c for c in df.columns if any(p in c for p in patterns)])


def clean_traffic(
    df: DataFrame, interval_type: int | None = 5, align: str | None = None, **keys
) -> DataFrame:
    """One interval type, non-null keys, junk and negative measures as null."""
    # The interval test comes first: on a Parquet feed it reaches the scan.
    kept = filter_interval(coerce_numeric(df, ["IntervalType"]), interval_type)
    parsed = coerce_numeric(normalize_keys(kept, align=align, **keys), TRAFFIC_METRICS)
    return negatives_to_null(drop_null_keys(parsed))


def clean_vehicle(df: DataFrame, align: str | None = None, **keys) -> DataFrame:
    parsed = coerce_numeric(normalize_keys(df, align=align, **keys), VEHICLE_NUMBERS)
    return with_category(range_to_null(drop_null_keys(parsed)))


def clean_weather(df: DataFrame, align: str | None = None) -> DataFrame:
    out = coerce_numeric(df.withColumn("BucketTime", bucket_time(df, align)), WEATHER_COLS)
    return out.filter(F.col("BucketTime").isNotNull()).select("BucketTime", *WEATHER_COLS)
