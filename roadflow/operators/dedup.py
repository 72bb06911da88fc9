"""Duplicate removal and duplicate counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedup_exact(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedup_id(
    df: DataFrame, id_col: str = "Id", order_by: list[str] | None = None, last: Column | None = None
) -> DataFrame:
    """First row of each id by ``order_by`` (then by all columns, nulls last); null ids all stay.

    Rows for which ``last`` holds lose against any other row of their id, so a junk copy never
    takes the place of a usable reading. ``min`` over a struct is a partial aggregate, so a hot id
    is reduced inside every map task instead of being sorted in one window. Null ids never enter the grouping.
    """
    rest = [c for c in df.columns if c != id_col]
    lead = [c for c in (order_by or []) if c != id_col]
    order = lead + [c for c in rest if c not in lead]
    junk = F.lit(False) if last is None else F.coalesce(last, F.lit(True))
    # A struct compares field by field and nulls come first, so each column follows its null flag.
    ranked = [x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"_null{i}"), F.col(c))]
    first = (
        df.filter(F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(F.min(F.struct(junk.alias("_junk"), *ranked)).alias("_first"))
        .select(id_col, *[F.col(f"_first.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )
    return first.unionByName(df.filter(F.col(id_col).isNull()))


def dedup_rows(
    df: DataFrame, id_col: str = "Id", order_by: list[str] | None = None, last: Column | None = None
) -> DataFrame:
    """Exact duplicates and repeated ids in one pass.

    Exact copies share their id, so rows with an id need only the grouping by id;
    rows without one are de-duplicated on all columns.
    """
    with_id = dedup_id(df.filter(F.col(id_col).isNotNull()), id_col, order_by, last)
    return with_id.unionByName(df.filter(F.col(id_col).isNull()).dropDuplicates())


def dedup_counts(df: DataFrame, id_col: str = "Id") -> DataFrame:
    """Raw rows, exact copies and repeated ids, as one row."""
    distinct = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    by_id = distinct.groupBy(id_col).agg(
        F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_kept")
    )
    return by_id.agg(
        F.sum("_rows").alias("rows_raw"),
        (F.sum("_rows") - F.sum("_kept")).alias("exact_duplicates_removed"),
        F.coalesce(
            F.sum(F.when(F.col(id_col).isNotNull(), F.col("_kept") - 1)), F.lit(0)
        ).alias("duplicate_ids_removed"),
        F.sum(F.when(F.col(id_col).isNull(), F.col("_kept")).otherwise(1)).alias(
            "rows_after_raw_dedup"
        ),
    )


def dup_key_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share their key with another row, and the number of keys."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias(
                "duplicate_key_rows"
            ),
            F.count(F.lit(1)).alias("unique_keys"),
        )
    )


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def assert_unique(df: DataFrame, keys: list[str], name: str = "table") -> DataFrame:
    """The same rows, failing at run time when a key occurs twice.

    The check is a scalar subquery over an aggregate, so nothing is collected.
    """
    verdict = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.coalesce(F.max("_n"), F.lit(0)).alias("_most"))
        .select(
            F.when(
                F.col("_most") > 1, F.raise_error(F.lit(f"{name}: keys {keys} are not unique"))
            ).alias("_bad")
        )
    )
    return df.filter(verdict.scalar().isNull())
