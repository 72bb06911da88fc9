"""Fitting, order search and model tables for many series at once."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.timeseries import series_window
from ..plans.features import (
    LAG_COLS, LAGS, MAX_LAG, MAX_SHOCK, REACHES, SHOCK_COLS, SHOCK_LAGS, regressor_names, with_target_lags,
)
from ..session import shuffle_partitions
from ..session import stage as staged
from . import solve as S
from .moments import lag_moments, series_moments
from .onepass import Study, studied

LONG_AR = 5  # lags of the first-stage regression that estimates the shocks
ADF_ROWS = 60  # complete rows from which the stationarity test is run
FREE_ROWS = 8  # rows for each column from which the first stage weighs all lags freely
LEAST_TRAIN = 60  # training rows that a search asks of a short series, if it has them
EVERYTHING = 2**31 - 1

# Candidate orders (p, d, q).
ORDERS = [
    (1, 0, 0), (2, 0, 0), (3, 0, 0), (1, 0, 1), (2, 0, 1), (0, 0, 1), (0, 0, 2),
    (1, 1, 0), (2, 1, 0), (1, 1, 1), (2, 1, 1), (3, 1, 0),
]
# Seasonal terms (P, D, Q, s) tried with the first five orders.
SEASONALS = [(1, 0, 0, 60), (1, 1, 0, 60), (2, 0, 0, 60), (1, 0, 1, 60)]
#: Seasons of an hour of five-minute steps, tried besides.
HOURLY = [(1, 0, 0, 12), (2, 0, 0, 12)]
NO_SEASON = (0, 0, 0, 0)

MODEL_TYPE = (
    "DeviceId string, TargetCol string, window string, p int, d int, q int, sp int, sd int, sq int, s int, n double, const double, "
    "beta array<double>, w array<double>, theta array<double>, sigma2 double, coef array<double>, "
    "pvalue array<double>, terms array<string>, adf_p_before double, adf_p_after double, status string"
)
MODEL_COLS = [f.split()[0] for f in MODEL_TYPE.split(", ")]
WEIGHTS = ["const", "beta", "w", "theta", "sigma2"]


REACH = (MAX_LAG, MAX_SHOCK)
ORDER_COLS = ["p", "q", "sp", "sd", "sq", "s"]


def candidates(seasonal: bool = True) -> list[tuple[tuple, tuple]]:
    """Orders, and the first five with every seasonal term."""
    with_season = [(order, season) for season in SEASONALS + HOURLY for order in ORDERS[:5]]
    return [(order, NO_SEASON) for order in ORDERS] + (with_season if seasonal else [])


def within(lags: tuple[int, ...], reach: int) -> tuple[int, ...]:
    return tuple(k for k in lags if k <= reach)


def raw_columns(target: str) -> dict[int, list[str]]:
    return {r: regressor_names(target) + ["y", *[f"y{k}" for k in within(LAGS, r)]] for r in REACHES}


def shock_columns() -> dict[int, list[str]]:
    return {r: [f"e{k}" for k in within(SHOCK_LAGS, r)] for r in REACHES}


@cache
def layout(target: str, shocks: bool, reach: int) -> S.Layout:
    return S.Layout(len(regressor_names(target)), within(LAGS, reach), within(SHOCK_LAGS, reach) if shocks else ())


def sparse_weights(models: DataFrame) -> DataFrame:
    """Weights of the raw lags and shocks only, so a join does not carry the zeros between them."""
    pick = lambda c, lags: F.array(*[F.col(c)[k - 1] for k in lags])
    return models.select("DeviceId", F.col("const").alias("_const"), F.col("beta").alias("_beta"),
                         pick("w", LAGS).alias("_w"), pick("theta", SHOCK_LAGS).alias("_theta"))


def weighed(weights: str, names: list[str], only_used: bool = False) -> Column:
    """Sum of weight times column. ``only_used``: a column whose weight is 0 may be unknown."""
    total = F.lit(0.0)
    for i, c in enumerate(names):
        term = F.col(weights)[i] * F.col(c)
        total = total + (F.when(F.col(weights)[i] != 0, term).otherwise(F.lit(0.0)) if only_used else term)
    return total


def fitted(target: str, shocks: bool = True) -> Column:
    """One-step fitted value of a row that carries ``sparse_weights``; null where a lag that counts is unknown."""
    value = F.col("_const") + weighed("_beta", regressor_names(target)) + weighed("_w", LAG_COLS, True)
    return value + weighed("_theta", SHOCK_COLS, True) if shocks else value


def fixed_ranges(rows: DataFrame, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """The same range of ``rn`` for every series, as far as it has rows."""
    ends = [c for i, (low, high) in enumerate(windows.values()) for c in (
        F.lit(low).alias(f"low_{i}"), F.least(F.lit(high), "size").alias(f"high_{i}"))]
    return staged(rows.groupBy("DeviceId").agg(F.max("rn").cast("int").alias("size")).select("DeviceId", *ends), "ranges")


def search_ranges(rows: DataFrame, tiers: dict[str, tuple[int, int, bool]], test: int) -> DataFrame:
    """Training rows of every series and tier: before the validation rows, fewer where the series is short."""
    known, ends = F.col("size") - test, []
    for i, (train, val, _) in enumerate(tiers.values()):
        short = F.greatest(F.lit(LEAST_TRAIN), known - val)
        rows_of = F.when(known >= train + val, F.lit(train)).otherwise(short)
        low = test + val + 1
        ends += [F.lit(low).alias(f"low_{i}"), F.least(low - 1 + rows_of, "size").cast("int").alias(f"high_{i}")]
    return staged(rows.groupBy("DeviceId").agg(F.max("rn").cast("int").alias("size")).select("DeviceId", *ends), "ranges")


def _each_series(moments: DataFrame, target: str, solve_one) -> DataFrame:
    """Run ``solve_one(grams, row)`` on every moment row; ``grams``: reach -> (matrix, rows). It yields model dicts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                for found in solve_one(read_grams(row["grams"]), row):
                    out.append({**row, "TargetCol": target, **found})
            yield pd.DataFrame(out, columns=MODEL_COLS)

    return spread(moments).mapInPandas(run, MODEL_TYPE)


def spread(moments: DataFrame) -> DataFrame:
    """One small row per series, much work for each: dealt out evenly, where sizes in bytes would put all into one task."""
    return moments.repartition(shuffle_partitions(moments.sparkSession), "DeviceId")


def read_grams(grams) -> dict[int, tuple[np.ndarray, float]]:
    square = lambda g: np.asarray(g).reshape(math.isqrt(len(g)), -1)
    return {g["reach"]: (square(g["gram"]), g["n"]) for g in grams}


def nearest(grams: dict, order: tuple, seasonal: tuple) -> int | None:
    """The nearest reach that holds a model, if the series has rows of it."""
    need = S.reach_of(order, seasonal)
    if need > REACHES[-1]:
        raise ValueError(f"order {order} {seasonal} looks {need} steps back; designs hold {REACHES[-1]}")
    return min((r for r in grams if r >= need), default=None)


def _labelled(model: dict, order, seasonal, d, before=None, after=None) -> dict:
    return {
        **model, "p": order[0], "d": d, "q": order[2], "sp": seasonal[0],
        "sd": seasonal[1], "sq": seasonal[2], "s": seasonal[3], "adf_p_before": before, "adf_p_after": after, "status": "fitted",
    }


def with_fallback(models: DataFrame, rows: DataFrame, target: str, name: str, stored: bool = False) -> DataFrame:
    """``models`` plus a row of order (1, 0, 0) for every device that has none: it repeats the last value.

    Such devices are too short for a complete row of lags; ``status`` tells them apart. ``models`` are staged, unless
    they are ``stored``: they are read once as they are and once to see which devices have none.
    """
    models = models if stored else staged(models, "fitted")
    per = rows.groupBy("DeviceId").agg(F.coalesce(F.var_pop("y"), F.lit(0.0)).alias("_var"), F.count("y").alias("_n"))
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    plain = {
        "TargetCol": F.lit(target), "window": F.lit(name), "p": F.lit(1), "d": F.lit(0), "q": F.lit(0),
        "sp": F.lit(0), "sd": F.lit(0), "sq": F.lit(0), "s": F.lit(0), "n": F.col("_n").cast("double"), "const": F.lit(0.0),
        "beta": zeros(len(regressor_names(target))), "w": F.concat(F.array(F.lit(1.0)), zeros(MAX_LAG - 1)),
        "theta": zeros(MAX_SHOCK), "sigma2": F.col("_var"), "coef": zeros(0), "pvalue": zeros(0),
        "terms": F.array().cast("array<string>"), "adf_p_before": F.lit(None).cast("double"),
        "adf_p_after": F.lit(None).cast("double"), "status": F.lit("fallback"),
    }
    missing = per.join(models.select("DeviceId"), "DeviceId", "left_anti")
    return models.unionByName(missing.select("DeviceId", *[v.alias(k) for k, v in plain.items()]))


def stationarity(rows: DataFrame, target: str, windows: dict | None = None) -> DataFrame:
    """Difference order per series by the augmented Dickey-Fuller test, p before and after."""
    windows = windows or {"all": (1, EVERYTHING)}
    return first_stage(rows, target, fixed_ranges(rows, windows), list(windows)).select(
        "DeviceId", "TargetCol", "window", "d", "adf_p_before", "adf_p_after"
    )


def first_stage(rows: DataFrame, target: str, ranges: DataFrame, names: list[str]) -> DataFrame:
    """Difference order and a long autoregression per series and window, all windows in one pass.

    The test has the lag count of the series' own length. The autoregression weighs all lags of the design freely
    where there are rows enough, so that its residuals hold no season; else the five nearest.
    """
    def rows_of(i):
        return F.greatest(F.col(f"high_{i}") - F.col(f"low_{i}") + 1, F.lit(0))

    def lags(i):
        asked = F.least(F.ceil(12 * F.pow(rows_of(i) / 100, F.lit(0.25))), F.floor(rows_of(i) / 2) - 3)
        return (F.greatest(asked, F.lit(0)) + 3).cast("int")

    widest = ranges.agg(F.greatest(*[F.max(lags(i)) for i in range(len(names))], F.lit(3))).first()[0] or 3
    unit_roots = lag_moments(rows, ranges, names, lags, widest).withColumnRenamed("grams", "lagged")
    moments = series_moments(rows, raw_columns(target), ranges, names).join(unit_roots, ["DeviceId", "window"], "left")

    def one(grams, row):
        yield first_model(grams, read_grams(row["lagged"]) if row["lagged"] is not None else {}, target)

    found = _each_series(moments, target, one)
    return with_fallback(found, rows, target, names[0]) if len(names) == 1 else found


def first_model(grams: dict, lagged: dict, target: str) -> dict:
    """Difference order and long autoregression of one series; ``lagged``: moments of all lags that the test asks for."""
    d, before, after = 0, None, None
    for reach, (gram, n) in lagged.items():
        # Too few rows tell nothing about unit roots.
        if n >= ADF_ROWS:
            d, before, after = S.difference_order(gram, n, S.Layout(0, reach, ()), reach - 3)
    rich = [r for r, (gram, n) in grams.items() if n >= FREE_ROWS * len(gram)]
    reach = max(rich, default=min(grams))
    (gram, n), lay = grams[reach], layout(target, False, reach)
    order = (min(LONG_AR, int(n // 12)), d, 0)
    model = S.free_autoregression(gram, n, lay, REACH) if rich else S.fit(gram, n, lay, order, NO_SEASON, REACH)
    return _labelled({**model, "n": n}, order, NO_SEASON, d, before, after)


def with_shocks(rows: DataFrame, stage: DataFrame, target: str, suffix: str = "") -> DataFrame:
    """The first-stage residual ``e`` and its lags ``e1``, ``e2``, ``e60`` next to every row.

    The model side has one row per series, so the join adds columns, not rows. A series without a first stage has no shocks.
    """
    w = series_window(["DeviceId"])
    weights = sparse_weights(stage)
    joined = rows.join(weights, "DeviceId", "left").withColumn(f"e{suffix}", F.col("y") - fitted(target, False))
    return joined.drop(*weights.columns[1:]).withColumns({f"e{k}{suffix}": F.lag(f"e{suffix}", k).over(w) for k in SHOCK_LAGS})


def training_rows(features: DataFrame) -> DataFrame:
    """Feature rows with the target's lags and the row number from the end."""
    return with_target_lags(features)


def fit_models(
    rows: DataFrame, target: str, orders: DataFrame | None = None, order: tuple = (1, 0, 0),
    seasonal: tuple = NO_SEASON, window: tuple[int, int] = (1, EVERYTHING), name: str = "all",
) -> tuple[DataFrame, DataFrame]:
    """Model table and the rows with shocks it was fitted on.

    ``orders`` (DeviceId, p, q and optionally sp, sd, sq, s, d) gives each series its own order; d is that of the
    stationarity test unless given there. A series that is too short for its seasonal terms, or whose seasonal fit
    does not come out finite, falls back to the plain order.
    """
    fits = fit_windows(rows, target, {name: window}, orders, order, seasonal)
    first = fits.where("w1 IS NOT NULL").select(
        "DeviceId", F.col("const1").alias("const"), F.col("beta1").alias("beta"), F.col("w1").alias("w"),
        F.array_repeat(F.lit(0.0), MAX_SHOCK).alias("theta"))
    whole = rows if set(LAG_COLS) <= set(rows.columns) else with_target_lags(rows.drop("rn"))
    return models_of(fits, rows, target, name), with_shocks(whole, first, target)


FIT_TYPE = MODEL_TYPE + ", const1 double, beta1 array<double>, w1 array<double>, y_tail array<double>, e_tail array<double>"


def fit_windows(
    rows: DataFrame, target: str, windows: dict[str, tuple[int, int]], orders: DataFrame | None = None, order: tuple = (1, 0, 0),
    seasonal: tuple = NO_SEASON,
) -> DataFrame:
    """Models of every series on several windows, from one pass over the rows; staged.

    Orders are those of ``fit_models`` in the first window; the others take the order and the d that the first was fitted
    with. Besides the models there are the weights of the first stage (``const1``, ``beta1``, ``w1``) and the tails
    before each window's newest row (``y_tail``, ``e_tail``), once for each series and window: ``status`` is null where a
    row holds nothing else.
    """
    names, facts = list(windows), fixed_ranges(rows, windows)
    default = dict(zip(ORDER_COLS, (order[0], order[2], *seasonal)))
    given = [] if orders is None else [c for c in [*ORDER_COLS, "d"] if c in orders.columns]
    if given:
        own = orders.groupBy("DeviceId").agg(F.collect_list(F.struct(*given)).alias("orders"))
        facts = facts.join(own, "DeviceId", "left")
    newest = [low - 1 for low, _ in windows.values()]

    def first(grams, lagged):
        if grams:
            return first_model(grams, lagged, target)
        # The same model as ``with_fallback`` gives: the last value is repeated.
        none = {"d": 0, "adf_p_before": None, "adf_p_after": None}
        return {"const": 0.0, "beta": [0.0] * len(regressor_names(target)), "w": [1.0] + [0.0] * (MAX_LAG - 1), **none}

    def answer(device: str, study: Study, known: dict) -> list[dict]:
        out = []
        for i, name in enumerate(names):
            stage = study.first[i]
            kept = {"const1": stage["const"], "beta1": stage["beta"], "w1": stage["w"], **study.tails(i, newest[i])}
            out.append({"DeviceId": device, "TargetCol": target, "window": name, **kept})
        for asked in (known.get("orders") or [{}]):
            asked = {**default, "d": None, **{c: v for c, v in asked.items() if v is not None}}
            for i, name in enumerate(names):
                found = None
                if study.second[i]:
                    found = _fit_one(study.second[i], target, asked, study.first[i])
                    out.append({"DeviceId": device, "TargetCol": target, "window": name, **found})
                if not i:
                    asked = {c: found[c] for c in [*ORDER_COLS, "d"]} if found else {**dict.fromkeys([*ORDER_COLS, "d"], 0), "p": 1}
        return out

    keep = max(newest) + MAX_LAG
    return staged(studied(rows, target, facts, names, keep, first, S.lag_count, answer, FIT_TYPE, "orders" if given else None), "fits")


def _fit_one(grams: dict, target: str, asked: dict, stage: dict) -> dict:
    d = stage["d"] if asked["d"] is None else int(asked["d"])
    o, sea = (asked["p"], d, asked["q"]), (asked["sp"], asked["sd"], asked["sq"], asked["s"])
    for season in dict.fromkeys((sea, NO_SEASON)):
        reach = nearest(grams, o, season)
        if reach is None:
            continue
        gram, n = grams[reach]
        model = S.fit(gram, n, layout(target, True, reach), o, season, REACH)
        if np.isfinite(model["sigma2"]) and np.all(np.isfinite(model["w"])):
            break
    return _labelled({**model, "n": n}, o, season, d, stage["adf_p_before"], stage["adf_p_after"])


def models_of(fits: DataFrame, rows: DataFrame, target: str, name: str) -> DataFrame:
    """The models of one window, with a fallback for every device that has none."""
    return with_fallback(fits.where((F.col("window") == name) & F.col("status").isNotNull()).select(*MODEL_COLS), rows, target, name, True)


def tails_of(fits: DataFrame, name: str) -> DataFrame:
    """``y_tail`` and ``e_tail`` before the newest row of a window (``tails_before``)."""
    return fits.where((F.col("window") == name) & F.col("y_tail").isNotNull()).select("DeviceId", "y_tail", "e_tail")


def order_search(
    rows: DataFrame, target: str, tiers: dict[str, tuple[int, int, bool]], test: int = 0,
) -> DataFrame:
    """Every candidate order scored on a validation tail: one row per series, tier, order.

    ``tiers``: name -> (training rows, validation rows, seasonal). The last ``test`` rows
    stay untouched; a short series trains on the rows it has. All tiers come from one pass: training enters as
    moments, validation as an array of at most the tier's validation rows, whatever the length of the series.
    Orders that a series is too short for are not scored.
    """
    names, out = list(tiers), None

    def first(grams, lagged):
        return first_model(grams, lagged, target) if grams else None

    def answer(device: str, study: Study, known: dict) -> list[dict]:
        found = []
        for i, (name, (_, val, seasonal)) in enumerate(tiers.items()):
            if study.second[i]:
                x, actual = study.rows(test + 1, test + val)
                scored = _score(study.second[i], target, candidates(seasonal), x, actual, study.tails(i, test + val))
                found += [dict(zip(SCORE_COLS, (device, target, name, *s))) for s in scored]
        return found

    keep = test + max(val for _, val, _ in tiers.values()) + MAX_LAG
    # Few rows, dear to make: read once as they are and once to see which series have none.
    scored = staged(studied(rows, target, search_ranges(rows, tiers, test), names, keep, first, S.lag_count, answer, SCORE_TYPE), "scores")
    for name in names:
        whole = unscored(scored.where(F.col("window") == name), rows, target, name)
        out = whole if out is None else out.unionByName(whole)
    return out


def unscored(scored: DataFrame, rows: DataFrame, target: str, name: str) -> DataFrame:
    """``scored`` plus one row without scores, order (1, 0, 0), for every device too short to be scored."""
    missing = rows.select("DeviceId").distinct().join(scored.select("DeviceId"), "DeviceId", "left_anti")
    plain = {"TargetCol": F.lit(target), "window": F.lit(name), "p": F.lit(1), **{c: F.lit(0) for c in ("d", "q", "sp", "sd", "sq", "s")}}
    none = {c: F.lit(None).cast("double") for c in ("MAE", "RMSE", "MAPE", "R2")}
    return scored.unionByName(missing.select("DeviceId", *[v.alias(k) for k, v in {**plain, **none}.items()]))


def tails_before(rows: DataFrame, rn: int, suffix: str = "") -> DataFrame:
    """``y_tail`` and ``e_tail`` of every series: what lies before its row ``rn``, newest first.

    One from before the series counts as the oldest that is known, an unknown shock as 0.
    """
    kept = rows.where(F.col("rn").between(rn + 1, rn + MAX_LAG))
    newest = F.sort_array(F.collect_list(F.struct("rn", F.col("y").alias("y"), F.col(f"e{suffix}").alias("e"))))
    return kept.groupBy("DeviceId").agg(newest.alias("_t")).select("DeviceId", *padded(F.col("_t.y"), F.col("_t.e")))


def padded(values: Column, shocks: Column) -> list[Column]:
    """Both tails at their full length, from what is known."""
    last = F.coalesce(F.get(values, F.size(values) - 1), F.lit(0.0))
    known = F.transform(shocks, lambda e: F.coalesce(e, F.lit(0.0)))
    return [F.slice(F.concat(values, F.array_repeat(last, MAX_LAG)), 1, MAX_LAG).alias("y_tail"),
            F.slice(F.concat(known, F.array_repeat(F.lit(0.0), MAX_SHOCK)), 1, MAX_SHOCK).alias("e_tail")]


def with_tails(requests: DataFrame, tails: DataFrame) -> DataFrame:
    """``requests`` with their tails; a series without earlier rows looks back on zeros."""
    none = lambda c, n: F.coalesce(c, F.array_repeat(F.lit(0.0), n)).alias(c)
    others = [c for c in requests.columns if c != "DeviceId"]
    return requests.join(tails, "DeviceId", "left").select("DeviceId", *others, none("y_tail", MAX_LAG), none("e_tail", MAX_SHOCK))


def holdout(
    rows: DataFrame, target: str, first: int, last: int, suffix: str = "", tails: DataFrame | None = None,
) -> DataFrame:
    """Rows ``rn`` in [first, last] of each series as arrays in time order (bounded size).

    ``x``: regressors per step, ``actual``: target per step, ``y_tail`` / ``e_tail``: lags
    at the first step, newest first (``tails``, where they are known already).
    """
    names = regressor_names(target)
    kept = rows.filter(F.col("rn").between(first, last))
    step = F.struct(
        F.col("BucketTime").alias("t"), F.col("y"),
        F.array(*[F.col(c).cast("double") for c in names]).alias("x"),
    )
    steps = kept.groupBy("DeviceId").agg(F.sort_array(F.collect_list(step)).alias("_steps")).select(
        "DeviceId", F.col("_steps.t").alias("times"), F.col("_steps.y").alias("actual"), F.col("_steps.x").alias("x"))
    return with_tails(steps, tails_before(rows, last, suffix) if tails is None else tails)


SCORE_TYPE = (
    "DeviceId string, TargetCol string, window string, p int, d int, q int, sp int, sd int, sq int, s int, "
    "MAE double, RMSE double, MAPE double, R2 double"
)


SCORE_COLS = [f.split()[0] for f in SCORE_TYPE.split(", ")]


def _score(grams: dict, target: str, tries: list[tuple], x: np.ndarray, actual: np.ndarray, tails: dict) -> list[tuple]:
    """Order, season and scores of every candidate that the series has rows for and whose forecast is finite."""
    held: dict[int, list] = {}
    for at, (order, sea) in enumerate(tries):
        reach = nearest(grams, order, sea)
        if reach is not None:
            held.setdefault(reach, []).append(at)
    if not held:
        return []
    found = [S.Common(*grams[k], layout(target, True, k), REACH).fit_all([tries[i] for i in at]) for k, at in held.items()]
    models = {c: np.concatenate([m[c] for m in found]) for c in ("const", "beta", "w", "theta")}
    xb = models["const"][:, None] + models["beta"] @ x.T
    back = [np.broadcast_to(tails[c], (len(xb), len(tails[c]))) for c in ("y_tail", "e_tail")]
    guesses = S.recurse_all(models, xb, *back)
    finite = np.isfinite(guesses).all(axis=1)
    kept = [tries[i] for i, good in zip([i for at in held.values() for i in at], finite) if good]
    scored = scores(actual, np.maximum(guesses[finite], 0.0))
    return [(*order, *sea, *map(float, row)) for (order, sea), row in zip(kept, scored)]


def scores(actual: np.ndarray, guesses: np.ndarray) -> np.ndarray:
    """MAE, RMSE, MAPE and R2 of each row of ``guesses``."""
    err, pos = actual - guesses, actual > 0
    sse, sst = np.square(err).sum(axis=1), float(np.square(actual - actual.mean()).sum())
    r2 = 1 - sse / sst if sst > 0 else (sse == 0).astype(float)
    mape = np.abs(err[:, pos] / actual[pos]).mean(axis=1) * 100 if pos.any() else np.zeros(len(err))
    return np.column_stack([np.abs(err).mean(axis=1), np.sqrt(sse / err.shape[1]), mape, r2])


def best_order(scored: DataFrame) -> DataFrame:
    """Candidate with the smallest validation error per series and window.

    Equal errors go to the smaller model.
    """
    rank = F.struct("MAE", "p", "q", "sp", "sd", "sq", "d", "s")
    rest = [c for c in scored.columns if c not in ("DeviceId", "TargetCol", "window")]
    return (
        scored.groupBy("DeviceId", "TargetCol", "window")
        .agg(F.min_by(F.struct(*rest), rank).alias("_b"))
        .select("DeviceId", "TargetCol", "window", *[F.col(f"_b.{c}").alias(c) for c in rest])
    )
