"""Descriptive reports over the raw feeds."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import floor_to
from ..functions.columns import one_row
from ..operators.quantiles import exact_medians, exact_quantiles, meet
from ..operators.timeseries import time_grid


def traffic_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("OccurDate").alias("first_seen"),
        F.max("OccurDate").alias("last_seen"), F.avg("AvgSpeed").alias("mean_speed"),
        F.avg("NumVehicles").alias("mean_vehicles"), F.avg("FlowRate").alias("mean_flow"),
    )


def vehicle_summary(df: DataFrame) -> DataFrame:
    """Row, time and value summary; the median by the bracketed quantile, plates exactly."""
    base = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("OccurDate").alias("first_seen"),
        F.max("OccurDate").alias("last_seen"), F.avg("Speed").alias("mean_speed"),
        F.avg("Confidence").alias("mean_confidence"),
    )
    plates = df.agg(F.count_distinct("Plate"))
    return base.withColumns(
        {"plates": plates.scalar(), "median_speed": exact_medians(df, ["Speed"]).scalar()}
    )


def hourly_volume_by_interval(df: DataFrame, kinds: tuple[int, ...] = (1, 5, 15)) -> DataFrame:
    """Vehicles per hour, one column per interval type; combinations without rows are null."""
    return df.filter(F.col("BucketTime").isNotNull()).groupBy(
        floor_to("BucketTime", "1 hour").alias("hour")
    ).pivot("IntervalType", list(kinds)).agg(F.sum("NumVehicles")).withColumnsRenamed(
        {str(k): f"interval_{k}" for k in kinds}
    )


def speed_by_hour(df: DataFrame, kinds: tuple[int, ...] = (1, 5, 15)) -> DataFrame:
    return df.groupBy(F.hour("BucketTime").alias("hour")).pivot("IntervalType", list(kinds)).agg(
        F.avg("AvgSpeed")
    ).withColumnsRenamed({str(k): f"interval_{k}" for k in kinds})


def hourly_count_dense(df: DataFrame) -> DataFrame:
    """Rows per hour with zeros for the empty hours in between."""
    seen = df.filter(F.col("BucketTime").isNotNull())
    counts = seen.groupBy(floor_to("BucketTime", "1 hour").alias("BucketTime")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return time_grid(seen, "1 hour").join(counts, "BucketTime", "left").select(
        F.col("BucketTime").alias("hour"), F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair over rows where both are present, long form."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    wide = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    name = lambda a, b: f"{a}|{b}" if f"{a}|{b}" in wide.columns else f"{b}|{a}"
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("a"), F.lit(b).alias("b"),
                (F.lit(1.0) if a == b else F.col(f"`{name(a, b)}`")).alias("r"),
            )
            for a, b in product(cols, cols)
        ]
    )
    return wide.select(F.explode(cells).alias("_c")).select("_c.a", "_c.b", "_c.r")


def histogram(df: DataFrame, column: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the last one is closed."""
    by = by or []
    values = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    ends = values.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    if by:
        joined = meet(values, ends, by, "_x")
    else:
        joined = values.withColumn("_e", one_row(ends)).select("_x", "_c", "_e.*")
    index = F.when(F.col("_hi") > F.col("_lo"), F.least(
        F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)
    )).otherwise(F.lit(0))
    counts = joined.groupBy(*by, index.cast("int").alias("bin")).agg(F.sum("_c").alias("n"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, [*by, "bin"], "left").select(
        *by, "bin", (F.col("_lo") + width * F.col("bin")).alias("left"),
        (F.col("_lo") + width * (F.col("bin") + 1)).alias("right"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull()).groupBy(column)
        .agg(F.count(F.lit(1)).alias("n")).orderBy(column)
    )


def boxplot(df: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles and whiskers per group; whiskers end at the last value within 1.5 IQR."""
    rows = df.select(by, value).dropna()
    long = exact_quantiles(rows, [value], [0.25, 0.5, 0.75], [by])
    pick = lambda p: F.max(F.when(F.col("prob") == p, F.col("value")))
    quart = long.groupBy(by).agg(
        F.max("n").alias("n"), pick(0.25).alias("q1"), pick(0.5).alias("median"), pick(0.75).alias("q3")
    )
    iqr = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    x = F.col(value)
    reach = (
        meet(rows.distinct(), quart, [by], value)
        .groupBy(by)
        .agg(F.min(F.when(x >= low, x)).alias("_lo"), F.max(F.when(x <= high, x)).alias("_hi"))
    )
    return quart.join(reach, by).select(
        by, "n", F.least("_lo", "q1").alias("whisker_low"), "q1", "median", "q3",
        F.greatest("_hi", "q3").alias("whisker_high"),
    )
