"""The three feeds as views over an event table (event_id, ts, user_id, event_type, value, props).

Every event is one row of the interval feed and of the detection feed, and every
``error`` event one of the weather feed, so the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import floor_to


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn(
        "kk", F.get_json_object("props", "$.k").cast("int")
    )


def _node() -> Column:
    return F.concat(F.lit(" n"), F.floor(F.col("user_id") / 10).cast("string"), F.lit(" "))


def _lane() -> Column:
    return (F.col("event_id") % 2 + 1).cast("int")


def traffic_feed(spark: SparkSession, folder: str, step: str = "5 minutes") -> DataFrame:
    kk, value, no = F.col("kk"), F.col("value"), F.col("event_id")
    return events(spark, folder).select(
        no.cast("string").alias("Id"),
        floor_to("ts", step).alias("BucketTime"),
        F.lit("").alias("DeviceId"),
        _node().alias("NodeId"),
        _lane().alias("Lane"),
        F.when(no % 4 == 0, 1).when(no % 4 == 1, 15).otherwise(5).alias("IntervalType"),
        (kk % 20 - 1).cast("double").alias("NumVehicles"),
        F.when(kk % 10 != 3, value).alias("AvgSpeed"),
        F.when(kk != 50, kk.cast("double")).alias("Occupancy"),
        (value / 5).alias("AvgDensity"),
        (kk / 10).alias("AvgHeadway"),
        (value * 12).alias("FlowRate"),
        F.col("ts").alias("OccurDate"),
        kk.cast("double").alias("Confidence"),
    )


def vehicle_feed(spark: SparkSession, folder: str, step: str = "5 minutes") -> DataFrame:
    kk, no, kind = F.col("kk"), F.col("event_id"), F.col("event_type")
    code = (
        F.when(kind == "click", 2.0).when(kind == "view", 3.0).when(kind == "purchase", 6.0)
        .when(kind == "signup", 7.0).otherwise(4.0)
    )
    return events(spark, folder).select(
        no.cast("string").alias("Id"),
        F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("Plate"),
        floor_to("ts", step).alias("BucketTime"),
        F.lit("").alias("DeviceId"),
        _node().alias("NodeId"),
        F.when(kind == "error", (kk % 2 + 1).cast("int")).otherwise(_lane()).alias("Lane"),
        code.alias("VehicleClass"),
        F.col("value").alias("Speed"),
        F.when(kk >= 5, kk * 10.0).alias("TravelTimeSec"),
        (kk + no % 7).cast("double").alias("Confidence"),
        F.col("ts").alias("OccurDate"),
        F.when(kk % 15 != 7, F.concat(F.lit("c"), (kk % 15).cast("string"))).alias("VehicleColor"),
    )


def weather_feed(spark: SparkSession, folder: str, step: str = "5 minutes") -> DataFrame:
    kk = F.col("kk")
    return events(spark, folder).filter(F.col("event_type") == "error").select(
        floor_to("ts", step).alias("BucketTime"),
        (kk / 10).alias("Rain"),
        (20 + kk / 10).alias("Temperature"),
        (50 + kk / 2).alias("Humidity"),
        (9000 - kk * 10).cast("double").alias("Visibility"),
        (kk / 20).alias("WindSpeed"),
    )


def with_copies(feed: DataFrame) -> DataFrame:
    """The feed plus exact copies of the readings on lane 2."""
    return feed.unionByName(feed.filter(F.col("Lane") == 2))
