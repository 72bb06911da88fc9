"""Integer apportionment of a total over vehicle classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import COUNT_COLS, RATIO_COLS
from .columns import clip, half_even, ratio_or_zero, total


def _nine(x):
    return F.floor(x * 1e9 + 0.5) / F.lit(1e9)


def largest_remainder(df: DataFrame, total_col: str = "NumVehicles") -> DataFrame:
    """Split ``round(total)`` over five classes by the largest-remainder rule.

    The fifth share is what the four ratios leave of 1. A class gains one of the
    left-over units when fewer classes have a larger fraction than there are units;
    equal fractions rank in class order. Plain arithmetic on columns: no shuffle and no
    lambda. The total and the fractions are compared at nine decimals, so that ties do
    not hang on the order in which a mean was summed.
    """
    keep = [c for c in df.columns if c not in COUNT_COLS + RATIO_COLS + [total_col]]
    n = len(COUNT_COLS)
    whole = df.select(*keep, half_even(_nine(F.col(total_col))).alias(total_col), *RATIO_COLS)
    shares = whole.withColumn("_rest", clip(1.0 - total(RATIO_COLS), 0.0, 1.0))
    parts = RATIO_COLS + ["_rest"]
    shares = shares.withColumn("_sum", total(parts))
    targets = shares.withColumns(
        {f"_t{i}": F.col(p) / F.col("_sum") * F.col(total_col) for i, p in enumerate(parts)}
    )
    floors = targets.withColumns({f"_f{i}": F.floor(f"_t{i}").cast("long") for i in range(n)})
    fractions = floors.withColumns(
        {
            **{f"_r{i}": _nine(F.col(f"_t{i}") - F.col(f"_f{i}")) for i in range(n)},
            "_left": F.col(total_col) - total([f"_f{i}" for i in range(n)]),
        }
    )

    def rank(i):
        ahead = [
            (F.col(f"_r{j}") >= F.col(f"_r{i}") if j < i else F.col(f"_r{j}") > F.col(f"_r{i}"))
            for j in range(n)
            if j != i
        ]
        return total([a.cast("int") for a in ahead])

    counted = fractions.withColumns(
        {
            name: F.col(f"_f{i}") + (rank(i) < F.col("_left")).cast("long")
            for i, name in enumerate(COUNT_COLS)
        }
    )
    return counted.select(
        *keep, total_col, *COUNT_COLS,
        *[ratio_or_zero(c, total_col).alias(r) for c, r in zip(COUNT_COLS, RATIO_COLS)],
    )


def class_ratios(df: DataFrame, total_col: str = "NumVehicles") -> DataFrame:
    """Ratios of the class counts to the total, 0 where the total is 0."""
    return df.withColumns(
        {r: ratio_or_zero(c, total_col) for c, r in zip(COUNT_COLS, RATIO_COLS)}
    )
