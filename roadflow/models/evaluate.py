"""Forecast scores, acceptance rules and residual diagnostics."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators.quantiles import exact_ranks
from ..operators.timeseries import series_window
from ..plans.explore import histogram
from .solve import chi2_tail

# Accepted scores per target (MAE, RMSE, MAPE at most, R2 at least).
LIMITS = {"NumVehicles": (80.0, 100.0, 25.0, 0.0), "AvgSpeed": (12.0, 20.0, 20.0, 0.4)}


def forecast_metrics(
    df: DataFrame, by: list[str], actual: str = "actual", predicted: str = "predicted",
    dashboard_rule: bool = False,
) -> DataFrame:
    """MAE, RMSE, MAPE and R2 per group in one partial aggregate.

    MAPE uses positive actuals only (0 without any). A constant actual scores R2 = 1 when
    it is met exactly and 0 otherwise; the dashboard rule gives 0 there and for one row.
    """
    y, f = F.col(actual), F.col(predicted)
    err = y - f
    sums = df.filter(y.isNotNull() & f.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("MAE"),
        F.sqrt(F.avg(err * err)).alias("RMSE"),
        (F.coalesce(F.avg(F.when(y > 0, F.abs(err / y))), F.lit(0.0)) * 100).alias("MAPE"),
        F.sum(err * err).alias("_sse"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"),
    )
    flat = F.lit(0.0) if dashboard_rule else F.when(F.col("_sse") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst")).otherwise(flat)
    if dashboard_rule:
        r2 = F.when(F.col("n") <= 1, F.lit(0.0)).otherwise(r2)
    return sums.withColumn("R2", r2).drop("_sse", "_sst")


def meets_targets(target: Column | str = "TargetCol") -> Column:
    """Whether the scores of a row satisfy its target's limits."""
    t = F.col(target) if isinstance(target, str) else target

    def within(name):
        mae, rmse, mape, r2 = LIMITS[name]
        return (
            F.col("MAE").between(0, mae) & F.col("RMSE").between(0, rmse)
            & F.col("MAPE").between(0, mape) & (F.col("R2") >= r2)
        )

    return F.when(t == "NumVehicles", within("NumVehicles")).otherwise(within("AvgSpeed"))


def tier_select(scored: DataFrame, tiers: list[str]) -> DataFrame:
    """First tier that meets the limits, else the tier with the smallest MAE; of several rows of a tier the best."""
    rank = F.array_position(F.array(*[F.lit(t) for t in tiers]), F.col("window"))
    ok = meets_targets()
    marked = scored.withColumns({"success": ok, "_rank": rank})
    order = F.struct(
        (~F.col("success")).alias("miss"),
        F.when(F.col("success"), F.col("_rank").cast("double")).otherwise(F.col("MAE")).alias("by"),
        F.col("_rank"), F.col("MAE"),
    )
    rest = [c for c in marked.columns if c not in ("DeviceId", "TargetCol", "_rank")]
    return (
        marked.groupBy("DeviceId", "TargetCol")
        .agg(F.min_by(F.struct(*rest), order).alias("_b"))
        .select("DeviceId", "TargetCol", *[F.col(f"_b.{c}").alias(c) for c in rest])
    )


def order_source(devices: DataFrame, manual: DataFrame, default: dict | None, auto: DataFrame) -> DataFrame:
    """Order per device: manual, else default (search switched off), else searched.

    Whatever of p, d, q, sp, sd, sq, s the sources give is passed on; a null d is left to the stationarity test.
    """
    given = {*manual.columns, *auto.columns, *(default or {})}
    cols = [c for c in ("p", "d", "q", "sp", "sd", "sq", "s") if c in given]
    own = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("int").alias(c)
    tag = lambda df, name: df.select("DeviceId", F.struct(*[own(df, c) for c in cols]).alias(name))
    joined = devices.join(tag(manual, "_m"), "DeviceId", "left").join(tag(auto, "_a"), "DeviceId", "left")
    fixed = F.struct(*[F.lit(default.get(c)).cast("int").alias(c) for c in cols]) if default else F.lit(None)
    pick = F.coalesce("_m", fixed, "_a") if default else F.coalesce("_m", "_a")
    source = F.when(F.col("_m").isNotNull(), "manual").otherwise("default" if default else "auto")
    return joined.select("DeviceId", *[pick[c].alias(c) for c in cols], source.alias("ConfigSource"))


def metric_labels(df: DataFrame, mape: float = 25.0, r2: float = 0.0) -> DataFrame:
    return df.withColumns(
        {
            "mape_label": F.when(F.col("MAPE") < mape, "good").otherwise("poor"),
            "r2_label": F.when(F.col("R2") > r2, "good").otherwise("poor"),
        }
    )


def residual_acf(df: DataFrame, lags: int = 40, value: str = "residual", by: str = "DeviceId") -> DataFrame:
    """Autocorrelations 1..lags per series, long form: by, n, lag, acf."""
    mean = F.avg(value).over(W.partitionBy(by))
    w = series_window([by])
    centred = df.withColumn("_c", F.col(value) - mean)
    shifted = centred.withColumns({f"_c{k}": F.lag("_c", k).over(w) for k in range(1, lags + 1)})
    sums = shifted.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("_v"),
        *[F.sum(F.col("_c") * F.col(f"_c{k}")).alias(f"_s{k}") for k in range(1, lags + 1)],
    )
    cells = F.array(
        *[F.struct(F.lit(k).alias("lag"), F.col(f"_s{k}").alias("s")) for k in range(1, lags + 1)]
    )
    return (
        sums.select(by, "n", "_v", F.explode(cells).alias("_k"))
        .filter(F.col("_k.lag") < F.col("n"))
        .select(by, "n", F.col("_k.lag").alias("lag"),
                F.when(F.col("_v") > 0, F.col("_k.s") / F.col("_v")).otherwise(0.0).alias("acf"))
    )


@F.pandas_udf(DoubleType())
def chi2_p(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(q, int(k)) for q, k in zip(stat, dof)])


def ljung_box(df: DataFrame, lags: int = 10, value: str = "residual", by: str = "DeviceId") -> DataFrame:
    """Ljung-Box statistic and p-value at min(lags, n - 1) lags per series."""
    acf = residual_acf(df, lags, value, by)
    stat = acf.groupBy(by).agg(
        F.max("n").alias("n"), F.max("lag").alias("dof"),
        F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))).alias("_s"),
    )
    q = F.col("n") * (F.col("n") + 2) * F.col("_s")
    return stat.select(by, "dof", q.alias("lb_stat"), chi2_p(q, "dof").alias("lb_pvalue"))


def normal_fit(df: DataFrame, value: str = "residual", by: str = "DeviceId") -> DataFrame:
    return df.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def residual_histogram(df: DataFrame, bins: int = 30, value: str = "residual", by: str = "DeviceId") -> DataFrame:
    """Counts and densities of equal-width bins per series."""
    counts = histogram(df, value, bins, [by])
    n = F.sum("n").over(W.partitionBy(by))
    width = F.col("right") - F.col("left")
    return counts.withColumn("density", F.when(width > 0, F.col("n") / (n * width)))


# Wichura's rational approximations of the normal quantile (AS 241), numerator and denominator,
# constant terms first: the middle, the near and the far tail.
QUANTILE = {
    "middle": ((3.3871328727963666080, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
                4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
               (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
                2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)),
    "near": ((1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
              1.27045825245236838258, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
             (1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1,
              1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)),
    "far": ((6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 2.96560571828504891230e-1,
             2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
            (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
             7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)),
}


def normal_quantile(df: DataFrame, p: str, name: str) -> DataFrame:
    """``df`` with the inverse of the normal distribution function at column ``p``, by column arithmetic.

    What the polynomials run over is made in projections of its own: written into each term, it would grow the
    generated code beyond what the JVM takes.
    """
    def ratio(part: str) -> Column:
        r = F.col(f"_{part}")
        above, below = (reduce(lambda acc, c: acc * r + F.lit(c), reversed(cs[:-1]), F.lit(cs[-1])) for cs in QUANTILE[part])
        return above / below

    q, r = F.col("_q"), F.col("_r")
    based = df.withColumns({"_q": F.col(p) - 0.5, "_r": F.sqrt(-F.log(F.least(F.col(p), 1 - F.col(p))))})
    based = based.withColumns({"_middle": 0.180625 - q * q, "_near": r - 1.6, "_far": r - 5})
    based = based.withColumn("_tail", F.when(r <= 5, ratio("near")).otherwise(ratio("far")))
    value = F.when(F.abs(q) <= 0.425, q * ratio("middle")).otherwise(F.when(q < 0, -F.col("_tail")).otherwise(F.col("_tail")))
    return based.withColumn(name, value).drop("_q", "_r", "_middle", "_near", "_far", "_tail")


def qq_points(df: DataFrame, value: str = "residual", by: str = "DeviceId") -> DataFrame:
    """Ordered residuals against normal order-statistic medians (Filliben's estimate)."""
    top = F.pow(F.lit(0.5), 1.0 / F.col("_n"))
    median = (
        F.when(F.col("rank") == F.col("_n"), top).when(F.col("rank") == 1, 1 - top)
        .otherwise((F.col("rank") - 0.3175) / (F.col("_n") + 0.365))
    )
    ranked = exact_ranks(df, [by], value, size="_n").withColumn("_p", median)
    return normal_quantile(ranked, "_p", "theoretical").select(by, "rank", F.col(value).alias("ordered"), "theoretical")
