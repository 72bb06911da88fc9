"""Sinks of the processed table, reports, configuration and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import daily_join_diagnostics
from ..operators.joins import unmatched, with_match
from ..operators.validate import class_code_counts
from ..schemas import CLASS_TO_CATEGORY, FINAL_COLS, KEYS, STRICT_COLS, TRAFFIC_METRICS


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV with a header; with ``mark`` every file begins with a UTF-8 byte order mark, as spreadsheets expect."""
    first = df.columns[0]
    out = df.withColumnRenamed(first, f"\ufeff{first}") if mark else df
    out.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_processed_csv(df: DataFrame, path: str) -> None:
    write_csv(df.select(*FINAL_COLS), path, mark=True)


def write_strict_csv(df: DataFrame, path: str) -> None:
    """The variant without OtherVehicleCount."""
    write_csv(df.select(*STRICT_COLS), path, mark=True)


def write_audits(traffic: DataFrame, vehicle: DataFrame, path: str) -> None:
    """Audit tables of the join of traffic and vehicle keys below ``path``: ``unmatched`` traffic rows, and ``daily`` counts."""
    lone = unmatched(traffic, vehicle).select(*KEYS, *TRAFFIC_METRICS, "VehicleDataMissing")
    write_csv(lone, f"{path}/unmatched", mark=True)
    joined = with_match(traffic.select(*KEYS), vehicle.select(*KEYS))
    write_csv(daily_join_diagnostics(joined), f"{path}/daily", mark=True)


def class_map(vehicle: DataFrame, interval_type: int | None = 5) -> DataFrame:
    """The class-map document as one row: the fixed codes, and the codes of a clean vehicle feed that have none of them."""
    codes = class_code_counts(vehicle).filter(F.col("code").isNotNull() & ~F.col("code").isin(list(CLASS_TO_CATEGORY)))
    fixed = F.create_map(*[F.lit(x) for code, name in CLASS_TO_CATEGORY.items() for x in (str(code), name)])
    return codes.agg(F.sort_array(F.collect_list("code")).alias("OtherVehicleClassCodesObserved")).select(
        F.lit("low").alias("mapping_confidence"), fixed.alias("VehicleClassToCategory"), "OtherVehicleClassCodesObserved",
        F.lit("NodeId").alias("effective_device_id_source"), F.lit(interval_type).cast("int").alias("traffic_interval_type_kept"))


def write_processed(df: DataFrame, path: str, by_day: bool = True) -> None:
    """Parquet by day: a device may hold a third of the rows, a day holds every device."""
    out = df.withColumn("Date", F.to_date("BucketTime")) if by_day else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy("Date") if by_day else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
