"""Train, select and evaluate forecast models for every device of a target."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import evaluate as E
from ..models import fit as M
from ..models import forecast as P
from ..sources import configs
from ..session import stage
from .features import as_design, lagged_regressors, model_features, with_row_numbers

TEST_STEPS = 12
TARGETS = ("NumVehicles", "AvgSpeed")
HORIZONS = {"Forecast_15min": 3, "Forecast_30min": 6, "Forecast_60min": 12}

# Search split (training rows, validation rows) and the optimiser's tiers.
SEARCH = {"search": (1000, 120, True)}
TIERS = {
    "cfg1_auto_fast": (500, 12, False),
    "cfg2_auto_seasonal": (800, 12, True),
    "cfg3_auto_long": (1500, 12, True),
}


def design(series: DataFrame, target: str) -> DataFrame:
    """Feature rows with lags, staged: every fit, score and forecast reads them."""
    return stage(M.training_rows(model_features(series, target)), f"design-{target}")


def narrow_designs(series: DataFrame, targets: tuple[str, ...]) -> dict[str, DataFrame]:
    """Feature rows of each target and their numbers, for jobs whose passes make the lags themselves.

    What the targets share is staged once; lags of the target are left out and the calendar follows from the stamp.
    """
    rows = stage(with_row_numbers(lagged_regressors(series, targets)), "rows")
    return {target: as_design(rows, target) for target in targets}


@dataclass(frozen=True)
class TrainResult:
    metrics: DataFrame  # one row per device: scores, order, test p-values, horizons
    models: DataFrame  # models of the training part
    holdout: DataFrame  # forecast and actual of the test steps
    future: DataFrame  # forecast of the steps after the data


def train(
    series: DataFrame, target: str, step: str = "5 minutes", orders: DataFrame | None = None,
    order: tuple = (1, 0, 0), source: str = "default", rows: DataFrame | None = None,
) -> TrainResult:
    """Fit on all but the last hour, score on it, refit on everything, look an hour ahead.

    ``orders`` may name each device's source in ``ConfigSource``; ``rows`` is a design that is already there.
    """
    rows = narrow_designs(series, (target,))[target] if rows is None else rows
    sources = orders if orders is not None and "ConfigSource" in orders.columns else None
    # One pass fits both windows; the refit keeps the order and d of the training part.
    fits = M.fit_windows(rows, target, {"train": (TEST_STEPS + 1, M.EVERYTHING), "all": (1, M.EVERYTHING)}, orders, order)
    models = stage(M.models_of(fits, rows, target, "train"), "models")
    last = rows.where(F.col("rn") <= TEST_STEPS)
    tested = P.with_actuals(
        P.forecast_requests(P.holdout_requests(rows, models, target, TEST_STEPS, M.tails_of(fits, "train"))), last
    )
    tested = stage(tested, "holdout")
    everything = M.models_of(fits, rows, target, "all")
    future = P.forecast_requests(
        P.future_requests(rows, series, everything, target, TEST_STEPS, step, M.tails_of(fits, "all"))
    )
    white = E.ljung_box(
        tested.withColumn("residual", F.col("actual") - F.col("predicted")), 10
    ).select("DeviceId", F.col("lb_pvalue").alias("LjungBox_pvalue"))
    named = models.select("DeviceId", F.lit(source).alias("ConfigSource")) if sources is None else sources.select("DeviceId", "ConfigSource")
    metrics = (
        E.forecast_metrics(tested, ["DeviceId"])
        .join(
            models.select(
                "DeviceId", "TargetCol", "adf_p_before", "adf_p_after",
                F.concat(F.lit("("), F.concat_ws(", ", "p", "d", "q"), F.lit(")")).alias("Order"),
                F.concat(F.lit("("), F.concat_ws(", ", "sp", "sd", "sq", "s"), F.lit(")")).alias(
                    "Seasonal_Order"
                ),
            ),
            "DeviceId",
        )
        .join(white, "DeviceId", "left")
        .join(P.horizons(future, HORIZONS).drop("origin"), "DeviceId", "left")
        .join(named, "DeviceId", "left")
    )
    return TrainResult(metrics, models, tested, future)


def train_targets(
    series: DataFrame, step: str = "5 minutes", config: DataFrame | None = None, default: dict | None = None,
    tiers: dict | None = None, targets: tuple[str, ...] = TARGETS,
) -> dict[str, TrainResult]:
    """Models of every device and target, each with its own order.

    A device that the configuration (``sources.configs``) gives an order keeps it; the others take ``default``
    (p, d, q and, if wanted, sp, sd, sq, s) where it is given, and else the best order of a search. Devices with an order are not searched.
    Targets are trained side by side: the small jobs of one run while the other's passes keep the cores busy.
    """
    def one(target: str, rows: DataFrame) -> TrainResult:
        devices = rows.select("DeviceId").distinct()
        manual = devices.select("DeviceId", *[F.lit(None).cast("int").alias(c) for c in (*M.ORDER_COLS, "d")]).limit(0)
        if config is not None:
            manual = configs.orders(configs.effective(devices, config), target).drop("train_length")
        manual = stage(manual, "manual-orders")
        searched = manual
        if default is None:
            open_ = rows.join(manual, "DeviceId", "left_anti")
            searched = M.best_order(M.order_search(open_, target, tiers or SEARCH, TEST_STEPS))
        orders = stage(E.order_source(devices, manual, default, searched), "orders")
        return train(series, target, step, orders, rows=rows)

    designs = narrow_designs(series, targets)
    with ThreadPoolExecutor(max(len(designs), 1)) as pool:
        return dict(zip(designs, pool.map(one, designs, designs.values())))


def search(series: DataFrame, target: str, tiers: dict | None = None, test: int = TEST_STEPS) -> DataFrame:
    """Scores of every candidate order of every device."""
    return M.order_search(narrow_designs(series, (target,))[target], target, tiers or SEARCH, test)


def optimise(series: DataFrame, target: str) -> DataFrame:
    """Best order per tier, then the first tier that meets the limits (else the best one)."""
    return E.tier_select(M.best_order(search(series, target, TIERS)), list(TIERS))


def coefficients(models: DataFrame, target: str) -> DataFrame:
    """Long form of the model table: DeviceId, TargetCol, name, coef, pvalue."""
    from .features import regressor_names

    names = F.concat(F.array(*[F.lit(n) for n in ["const", *regressor_names(target)]]), F.col("terms"))
    return models.select(
        "DeviceId", "TargetCol", F.explode(F.arrays_zip(names.alias("name"), "coef", "pvalue")).alias("_c")
    ).select("DeviceId", "TargetCol", "_c.name", "_c.coef", "_c.pvalue")
