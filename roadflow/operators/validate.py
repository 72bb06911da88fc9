"""Quality counters over feeds and the processed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_close, total
from ..schemas import COUNT_COLS, KEYS, RATIO_COLS


def null_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Missing values by column and in total."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.withColumn("total_missing", total(cols))


def quality_checks(df: DataFrame) -> DataFrame:
    """Ratio bounds, positive class counts and the legacy fill signature."""
    counts = total(COUNT_COLS)
    in_bounds = [F.col(c).between(0, 1) for c in RATIO_COLS]
    signature = (counts == 0) & (F.col("SpeedStd") == 0) & is_close("MedianSpeed", "AvgSpeed")
    return df.agg(
        F.bool_and(
            F.coalesce(in_bounds[0] & in_bounds[1] & in_bounds[2] & in_bounds[3], F.lit(False))
        ).alias("class_ratio_bounds_ok"),
        F.bool_and((F.col("NumVehicles") <= 0) | (counts > 0)).alias(
            "vehicle_count_positive_all_rows"
        ),
        F.count_if(F.coalesce(signature, F.lit(False))).alias("legacy_signature_rows"),
    )


def class_code_counts(df: DataFrame, code: str = "VehicleClass") -> DataFrame:
    return df.groupBy(F.rint(code).cast("int").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def key_overlap(left: DataFrame, right: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Key counts of both sides, the shared count and its percentage of the left.

    One pass over both sides: a key carries a flag per side, a single grouping joins them.
    """
    flagged = (
        left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
        .unionByName(right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
        .groupBy(*keys)
        .agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    )
    sums = flagged.agg(
        F.sum("_l").alias("traffic_keys"),
        F.sum("_r").alias("vehicle_keys"),
        F.sum(F.col("_l") * F.col("_r")).alias("matched_keys"),
    )
    return sums.withColumn(
        "matched_percent",
        F.round(
            F.when(F.col("traffic_keys") > 0, F.col("matched_keys") / F.col("traffic_keys") * 100)
            .otherwise(0.0),
            2,
        ),
    )
