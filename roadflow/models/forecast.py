"""Multi-step forecasts, intervals, fitted values and backtests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.calendar import add_steps, calendar_dummies, is_holiday
from ..functions.columns import clip_low
from ..operators.timeseries import last_row
from ..plans.features import MAX_LAG, MAX_SHOCK, regressor_names
from ..schemas import TARGET_REGRESSORS
from . import solve as S
from .fit import WEIGHTS, fitted, holdout, padded, sparse_weights, tails_before, with_tails

Z95 = 1.959963984540054

FORECAST_TYPE = (
    "DeviceId string, origin timestamp_ntz, step int, BucketTime timestamp_ntz, predicted double, "
    "lower double, upper double"
)


def _matrix(lists: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Lists of numbers as the rows of a matrix, filled up with zeros; nulls are NaN."""
    size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), max(size.max(initial=0), width or 0)))
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out[:, :width]


def forecast_requests(requests: DataFrame, actual: bool = False) -> DataFrame:
    """Forecast every request row: DeviceId, origin, times[], x[][], y_tail, e_tail, weights.

    A request is a bounded set of arrays (steps x regressors), so rows run independently
    in whatever partitions they lie; nothing is grouped here. ``actual``: requests have the known targets of their
    steps (actual[]), which come back next to the forecasts, so they need not be looked up again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            steps = np.diff(column["x"].offsets.to_numpy())
            if not steps.sum():
                continue
            model = {c: _matrix(column[c]) for c in ("beta", "w", "theta")}
            model |= {c: column[c].to_numpy(zero_copy_only=False) for c in ("const", "sigma2")}
            # Requests with fewer steps than others of the batch are filled up, and cut again below.
            asked = np.arange(steps.max()) < steps[:, None]
            row = np.repeat(np.arange(len(steps)), steps)
            x = column["x"].flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(row), -1)
            xb = np.zeros(asked.shape)
            xb[asked] = model["const"][row] + np.einsum("ij,ij->i", x, model["beta"][row])
            guess = S.recurse_all(model, xb, _matrix(column["y_tail"], model["w"].shape[1]), _matrix(column["e_tail"]))[asked]
            half = Z95 * S.error_spreads(model, asked.shape[1])[asked]
            number = lambda values: pa.array(values, pa.float64(), from_pandas=True)
            found = [column["DeviceId"].take(pa.array(row)), column["origin"].take(pa.array(row)),
                     pa.array(np.nonzero(asked)[1] + 1, pa.int32()), column["times"].flatten(),
                     number(np.maximum(guess, 0.0)), number(np.maximum(guess - half, 0.0)), number(guess + half)]
            found += [column["actual"].flatten()] if actual else []
            yield pa.RecordBatch.from_arrays(found, names)

    kind = FORECAST_TYPE + (", actual double" if actual else "")
    names = [c.split()[0] for c in kind.split(", ")]
    return requests.select(
        "DeviceId", "origin", "times", "x", "y_tail", "e_tail", *WEIGHTS, *(["actual"] if actual else [])
    ).mapInArrow(run, kind)


def holdout_requests(rows: DataFrame, models: DataFrame, target: str, test: int, tails: DataFrame | None = None) -> DataFrame:
    """Requests for the last ``test`` rows of each series, with their actual regressors.

    ``tails``: what lies before these rows, where it is known already; ``rows`` need no shocks then.
    """
    held = holdout(rows, target, 1, test, tails=tails).withColumn("origin", F.col("times")[0])
    return held.join(models.select("DeviceId", *WEIGHTS), "DeviceId")


def future_requests(
    rows: DataFrame, series: DataFrame, models: DataFrame, target: str, n: int, step: str, tails: DataFrame | None = None
) -> DataFrame:
    """Requests for the n steps after each series: last regressors, future calendar. ``tails`` as in ``holdout_requests``."""
    names = regressor_names(target)
    origin = rows.groupBy("DeviceId").agg(F.max("BucketTime").alias("origin"))
    # The regressors of the first future step are the last row's values: a true lag of one.
    last = last_row(series.select("DeviceId", "BucketTime", *TARGET_REGRESSORS[target]), ["DeviceId"])
    ahead = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn(
        "t", add_steps("BucketTime", F.col("step"), step)
    )
    values = {f"{c}_lag1": F.col(c) for c in TARGET_REGRESSORS[target]}
    ahead = ahead.withColumns({**values, "IsHoliday": is_holiday("t"), **calendar_dummies("t")})
    arrays = ahead.groupBy("DeviceId").agg(
        F.sort_array(
            F.collect_list(F.struct("t", F.array(*[F.col(c).cast("double") for c in names]).alias("x")))
        ).alias("_s")
    )
    asked = arrays.select("DeviceId", F.col("_s.t").alias("times"), F.col("_s.x").alias("x")).join(origin, "DeviceId")
    return with_tails(asked, tails_before(rows, 0) if tails is None else tails).join(models.select("DeviceId", *WEIGHTS), "DeviceId")


def observed_requests(
    rows: DataFrame, series: DataFrame, models: DataFrame, observed: DataFrame, target: str, step: str
) -> DataFrame:
    """Requests that start from an observation: DeviceId, BucketTime, ``steps``, the target and its regressors.

    The model is extended by the observed row, not refitted: the observed target becomes the newest lag, its
    distance from the one-step forecast the newest shock. Later steps see the observed regressors
    and the calendar of their own stamps. One observation per device.
    """
    regressors = TARGET_REGRESSORS[target]
    tail = tails_before(rows, 0).select("DeviceId", F.col("y_tail").alias("_y"), F.col("e_tail").alias("_e"))
    last = last_row(series.select("DeviceId", "BucketTime", *regressors), ["DeviceId"]).select(
        "DeviceId", *[F.col(c).alias(f"_last_{c}") for c in regressors])
    seen = observed.select("DeviceId", F.col("BucketTime").alias("origin"), "steps", F.col(target).alias("_now"),
                           *[F.col(c).alias(f"_seen_{c}") for c in regressors])
    joined = seen.join(tail, "DeviceId").join(last, "DeviceId").join(models.select("DeviceId", *WEIGHTS), "DeviceId")

    def x_at(prefix, t):
        values = [F.col(f"{prefix}{c}") for c in regressors] + [is_holiday(t), *calendar_dummies(t).values()]
        return F.array(*[v.cast("double") for v in values])

    def times(a, b):
        return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))

    one = F.col("const") + times(F.col("beta"), x_at("_last_", F.col("origin"))) + times(F.col("w"), F.col("_y")) + times(
        F.col("theta"), F.col("_e"))
    ahead = F.transform(F.sequence(F.lit(1), F.col("steps")), lambda k: add_steps(F.col("origin"), k, step))
    return joined.withColumns({"times": ahead, "_one": one}).select(
        "DeviceId", "origin", "times", F.transform("times", lambda t: x_at("_seen_", t)).alias("x"),
        F.concat(F.array("_now"), F.slice("_y", 1, MAX_LAG - 1)).alias("y_tail"),
        F.concat(F.array(F.col("_now") - F.col("_one")), F.slice("_e", 1, MAX_SHOCK - 1)).alias("e_tail"), *WEIGHTS)


def placed_origins(rows: DataFrame, origins: DataFrame, n: int) -> DataFrame:
    """(DeviceId, asked, origin, rn, steps): each origin at a row of its series, moved as little as needed.

    An origin stands at the last row that is not after it; one before the series at its first row, one with fewer
    than n rows after it moves back. A series of n rows or fewer starts at its first row and has fewer steps.
    """
    asked = origins.select("DeviceId", F.col("origin").alias("BucketTime"), F.lit(None).cast("long").alias("rn"),
                           F.lit(1).alias("_asked")).distinct()
    known = rows.select("DeviceId", "BucketTime", F.col("rn").cast("long").alias("rn"), F.lit(0).alias("_asked"))
    before = W.partitionBy("DeviceId").orderBy("BucketTime", "_asked")
    met = known.unionByName(asked).withColumn("_rn", F.last("rn", True).over(before)).where("_asked = 1")
    sizes = rows.groupBy("DeviceId").agg(F.max("rn").cast("long").alias("_size"))
    at = F.least(F.greatest(F.coalesce("_rn", "_size"), F.lit(n + 1)), "_size")
    return met.join(sizes, "DeviceId").select(
        "DeviceId", F.col("BucketTime").alias("asked"), at.alias("rn"), F.least(at - 1, F.lit(n)).cast("int").alias("steps"))


def backtest_requests(
    rows: DataFrame, models: DataFrame, origins: DataFrame, target: str, n: int, step: str | None = None
) -> DataFrame:
    """Requests for many origins at once: the n known rows after each origin, with their regressors.

    Origins (DeviceId, origin) may be any stamps (``placed_origins``), and the steps are the rows that follow, gaps
    or not; ``origin`` is the stamp asked for, ``start`` that of the row it stands at. Only a series of one row has
    no step to forecast. Tails are gathered where an origin stands, so their arrays move for origins only.
    """
    names = regressor_names(target)
    placed = placed_origins(rows, origins, n).where("steps > 0")
    asked = placed.groupBy("DeviceId", "rn").agg(F.collect_list("asked").alias("_asked"))
    back = W.partitionBy("DeviceId").orderBy("BucketTime")
    newest = lambda c, k: F.reverse(F.collect_list(F.coalesce(c, F.lit(0.0))).over(back.rowsBetween(1 - k, 0)))
    step = F.struct(F.col("BucketTime").alias("t"), F.array(*[F.col(c).cast("double") for c in names]).alias("x"),
                    F.col("y").cast("double").alias("y"))
    # Rows and origins are shuffled as they are, and never by a broadcast: there may be as many origins as rows. The
    # arrays of a request are made behind the last shuffle.
    stands = rows.select("DeviceId", F.col("rn").cast("long").alias("rn"), "BucketTime", "y", "e", step.alias("_step")).join(
        asked.hint("merge"), ["DeviceId", "rn"], "left")
    met = stands.withColumns({
        "_y": newest("y", MAX_LAG), "_e": newest("e", MAX_SHOCK), "_s": F.collect_list("_step").over(back.rowsBetween(1, n)),
    }).where("_asked IS NOT NULL").join(models.select("DeviceId", *WEIGHTS), "DeviceId")
    return met.select("DeviceId", F.explode("_asked").alias("origin"), F.col("BucketTime").alias("start"), F.col("_s.t").alias("times"),
                      F.col("_s.x").alias("x"), F.col("_s.y").alias("actual"), *padded(F.col("_y"), F.col("_e")), *WEIGHTS)


def repeated_last(rows: DataFrame, origins: DataFrame, n: int) -> DataFrame:
    """The plainest forecast, to hold others against: the value at the origin for each of the n rows after it.

    ``rows``: DeviceId, BucketTime, y, rn. Gives DeviceId, origin, step, predicted, actual.
    """
    placed = placed_origins(rows, origins, n).where("steps > 0").select("DeviceId", F.col("asked").alias("origin"), "rn")
    after = W.partitionBy("DeviceId").orderBy(F.col("rn").desc()).rowsBetween(1, n)
    known = rows.select("DeviceId", F.col("rn").cast("long").alias("rn"), F.col("y").alias("predicted"),
                        F.collect_list(F.struct(F.col("y").alias("actual"))).over(after).alias("_ahead"))
    # As many origins as rows: no side is small enough for a broadcast, whatever their files weigh.
    met = placed.join(known.hint("merge"), ["DeviceId", "rn"])
    return met.select("DeviceId", "origin", "predicted", F.posexplode("_ahead").alias("step", "_a")).select(
        "DeviceId", "origin", "predicted", (F.col("step") + 1).alias("step"), "_a.actual")


def origin_scores(forecasts: DataFrame) -> DataFrame:
    """MAE, RMSE, MAPE and R2 of each origin's forecast, by the dashboard's rule."""
    from .evaluate import forecast_metrics

    return forecast_metrics(forecasts, ["DeviceId", "origin"], dashboard_rule=True)


def with_actuals(forecasts: DataFrame, rows: DataFrame) -> DataFrame:
    """Forecast, actual and absolute error where the stamp is known."""
    actual = rows.select("DeviceId", "BucketTime", F.col("y").alias("actual"))
    return with_error(forecasts.join(actual.hint("merge"), ["DeviceId", "BucketTime"], "left"))


def with_error(forecasts: DataFrame) -> DataFrame:
    return forecasts.withColumn("error", F.abs(F.col("actual") - F.col("predicted")))


def fitted_values(rows: DataFrame, models: DataFrame, target: str) -> DataFrame:
    """One-step fitted values and residuals of every row with complete lags."""
    joined = rows.join(sparse_weights(models), "DeviceId")
    return joined.select(
        "DeviceId", "BucketTime", "rn", "y", fitted(target).alias("fitted")
    ).filter(F.col("fitted").isNotNull()).withColumn("residual", F.col("y") - F.col("fitted"))


def fallback_interval(df: DataFrame, spread: str = "std_fitted") -> DataFrame:
    """Plain interval: 1.96 times 1.5 standard deviations (10 where unknown), lower end >= 0."""
    half = F.coalesce(F.col(spread) * 1.5, F.lit(10.0)) * 1.96
    return df.withColumns(
        {"lower": clip_low(F.col("predicted") - half), "upper": F.col("predicted") + half}
    )


def horizons(forecasts: DataFrame, picks: dict[str, int]) -> DataFrame:
    """Chosen steps of each forecast as columns."""
    return forecasts.groupBy("DeviceId", "origin").agg(
        *[F.max(F.when(F.col("step") == k, F.col("predicted"))).alias(name) for name, k in picks.items()]
    )
