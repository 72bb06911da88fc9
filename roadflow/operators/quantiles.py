"""Exact quantiles that never hold a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage

ACCURACY = 10_000
SALTS = 32
#: Buckets of a ranked group, and ranks of one value that are written out together.
BUCKETS, RUN = 256, 100_000


def exact_quantiles(
    df: DataFrame, value_cols: list[str], probs: list[float], by: list[str] | None = None,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Exact linear-interpolated quantiles, long form: by.., column, prob, n, value.

    1. One mergeable sketch per group brackets every wanted rank to within
       2/accuracy of the group's rows.
    2. Rows below the bracket are only counted; rows inside it are pre-aggregated
       to (value, count), so a window sees at most a sliver of the distinct values.
    A rank outside its bracket (the sketch's error bound rules it out) fails loudly.
    """
    by = by or []
    slack = 2.0 / accuracy
    ends = [min(max(p + s, 0.0), 1.0) for p in probs for s in (-slack, slack)]
    long = df.select(
        *by,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                    for c in value_cols
                ]
            )
        ).alias("_v"),
    ).select(*by, "_v.column", "_v.value").filter(F.col("value").isNotNull())
    group = by + ["column"]
    sketch = long.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("value", ends, accuracy).alias("_ends"),
    )
    wanted = F.array(
        *[
            F.struct(
                F.lit(p).alias("prob"),
                F.col("_ends")[2 * i].alias("lo"),
                F.col("_ends")[2 * i + 1].alias("hi"),
            )
            for i, p in enumerate(probs)
        ]
    )
    brackets = sketch.select(*group, "n", F.explode(wanted).alias("_b")).select(
        *group, "n", "_b.prob", "_b.lo", "_b.hi"
    )
    per_group = brackets.groupBy(*group).agg(
        F.first("n").alias("n"),
        F.collect_list(F.struct("prob", "lo", "hi")).alias("_bs"),  # one entry per probability
    )
    # The brackets are repeated per salt, so a hot group's rows meet them in many tasks even
    # where the bracket table is too large to broadcast.
    spread = per_group.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = long.withColumn("_salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int"))
    # Each row meets the few brackets of its group. Rows beside a bracket shrink to one
    # count with their nearest value, which also serves a rank one step outside.
    zone = F.when(F.col("value") < F.col("lo"), -1).when(F.col("value") > F.col("hi"), 1).otherwise(0)
    met = (
        salted.join(spread, [*group, "_salt"])
        .select(*group, "n", "value", F.explode("_bs").alias("_b"))
        .select(*group, "n", "value", "_b.prob", "_b.lo", "_b.hi")
        .withColumn("_zone", zone)
        .withColumn("_key", F.when(F.col("_zone") == 0, F.col("value")))
        .groupBy(*group, "prob", "n", "_zone", "_key")
        .agg(
            F.count(F.lit(1)).alias("_c"), F.min("value").alias("_min"), F.max("value").alias("_max")
        )
    )
    order = W.partitionBy(*group, "prob").orderBy("_zone", "_key")
    ranked = met.withColumn("_cum", F.sum("_c").over(order)).withColumn(
        "_rank", (F.col("n") - 1) * F.col("prob")
    )

    def at(rank):
        here = (F.col("_cum") > rank) & (F.col("_cum") - F.col("_c") <= rank)
        edge = (
            F.when(F.col("_zone") == 0, F.col("_key"))
            .when((F.col("_zone") < 0) & (rank == F.col("_cum") - 1), F.col("_max"))
            .when((F.col("_zone") > 0) & (rank == F.col("_cum") - F.col("_c")), F.col("_min"))
        )
        return F.max(F.when(here, edge))

    picked = ranked.groupBy(*group, "prob", "n").agg(
        F.first("_rank").alias("_rank"),
        at(F.floor("_rank")).alias("_a"),
        at(F.ceil("_rank")).alias("_z"),
    )
    ok = F.col("_a").isNotNull() & F.col("_z").isNotNull()
    frac = F.col("_rank") - F.floor("_rank")
    return picked.select(
        *group, "prob", "n",
        F.when(~ok, F.raise_error(F.lit("quantile rank outside its bracket")).cast("double"))
        .otherwise(F.col("_a") + (F.col("_z") - F.col("_a")) * frac)
        .alias("value"),
    )


def meet(values: DataFrame, facts: DataFrame, by: list[str], value: str) -> DataFrame:
    """``values`` (one row for each ``by`` and value) with the columns of ``facts`` (one row for each ``by``).

    Facts are repeated per salt, so the values of a hot group meet them in many tasks.
    """
    spread = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = values.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))
    return salted.join(spread, [*by, "_salt"]).drop("_salt")


def exact_ranks(df: DataFrame, by: list[str], value: str, rank: str = "rank", size: str = "n") -> DataFrame:
    """by.., value, rank, n: every row's place in its group by value, without a task that holds a whole group.

    1. Rows shrink to distinct values with their counts.
    2. A mergeable sketch cuts each group into ranges of about 1/BUCKETS of its distinct values.
    3. Ranges are counted, and what lies below each is added to the ranks inside it.

    Equal values take consecutive ranks. Null values and rows with a null in ``by`` have none.
    """
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c")).dropna(subset=[*by, value])
    edges = counted.groupBy(*by).agg(F.percentile_approx(value, [k / BUCKETS for k in range(1, BUCKETS)], ACCURACY).alias("_edges"))
    below = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    # Written once: sketches may differ from one computation to the next, buckets must not.
    placed = stage(meet(counted, edges, by, value).select(*by, value, "_c", below.alias("_bucket")), "ranges")
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy(*by, "_bucket").agg(F.sum("_c").alias("_in")).withColumns({
        "_start": F.coalesce(F.sum("_in").over(before), F.lit(0)), size: F.sum("_in").over(W.partitionBy(*by))})
    inside = W.partitionBy(*by, "_bucket").orderBy(value)
    last = F.col("_start") + F.sum("_c").over(inside)
    ranked = placed.join(starts.drop("_in"), [*by, "_bucket"]).withColumn("_last", last)
    # A value that many rows share is written out in runs, so no row holds them all.
    runs = ranked.withColumn("_run", F.explode(F.sequence(F.col("_last") - F.col("_c") + 1, F.col("_last"), F.lit(RUN).cast("long"))))
    one = F.explode(F.sequence(F.col("_run"), F.least(F.col("_run") + RUN - 1, F.col("_last"))))
    return runs.select(*by, value, one.alias(rank), size)


def exact_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row with the exact median of every column; null for an empty column."""
    long = exact_quantiles(df, cols, [0.5])
    return long.agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in cols])


def hot_groups(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Groups above a row count; a partial count per key, nothing else is read."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows).select(*keys)
    )
