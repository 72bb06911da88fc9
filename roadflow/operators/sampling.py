"""Top-k, exact-size samples and device subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_values(
    df: DataFrame, column: str, k: int, weight: str | None = None, label: str | None = None
) -> DataFrame:
    """The k largest groups by row count or by the sum of ``weight``."""
    key = F.coalesce(F.col(column), F.lit(label)) if label else F.col(column)
    measure = F.sum(weight) if weight else F.count(F.lit(1))
    return (
        df.groupBy(key.alias(column))
        .agg(measure.alias("total"))
        .orderBy(F.col("total").desc_nulls_last(), F.col(column).asc_nulls_last())
        .limit(k)
    )


def sample_n(df: DataFrame, n: int, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """Exactly n rows, repeatable for a seed; all rows when there are no more than n.

    Rows are ordered by a digest of the columns ``by`` (all of them unless given), then by their content. Every
    task keeps its own first n, and only these meet.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in by or df.columns])
    return df.withColumn("_h", F.md5(text.cast("binary"))).orderBy("_h", *df.columns).limit(n).drop("_h")


def first_devices(df: DataFrame, n: int) -> DataFrame:
    """Rows of the first n devices in name order."""
    names = df.select("DeviceId").distinct().orderBy("DeviceId").limit(n)
    return df.join(names, "DeviceId", "left_semi")
