"""The pass over whole series: its matrices against plain numpy, long and gappy series, and how many passes a training takes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadflow.models import fit as M
from roadflow.models import onepass
from roadflow.models import solve as S
from roadflow.plans import training
from roadflow.plans.features import LAGS, REACHES, SHOCK_LAGS, regressor_names

from .test_seasons import ar, series_of

TARGET = "NumVehicles"
PLAIN = [c for c in regressor_names(TARGET) if c not in onepass.FLAGS]


def parts(n, unknown=(), size=97):
    """Rows of a series as the pass gets them: rn, y, regressors, flags as bits."""
    rng = np.random.default_rng(3)
    flags = rng.integers(0, 2, (n, len(onepass.FLAGS)))
    rows = np.column_stack([np.arange(n, 0, -1), ar(n), rng.normal(5, 2, (n, len(PLAIN))), flags @ (1 << np.arange(flags.shape[1]))])
    rows[list(unknown), 1] = np.nan
    return [rows[at : at + size] for at in range(0, n, size)], flags


def study(given, ends, keep=200):
    held = onepass.Held()
    for part in given:
        held.add(part)
    first = lambda grams, lagged: M.first_model(grams, lagged, TARGET) if grams else None
    return held, onepass.Study(held, TARGET, ends, keep, first, S.lag_count)


def by_hand(rows, flags, ends, model):
    """reach -> (matrix, rows) with shocks, straight from the definition."""
    y, x = rows[:, 1], np.column_stack([rows[:, 2 : 2 + len(PLAIN)], flags])
    back = lambda v, k: np.concatenate([np.full(min(k, len(v)), np.nan), v[: max(len(v) - k, 0)]])
    w, found = np.asarray(model["w"]), {}
    e = y - model["const"] - x @ np.asarray(model["beta"]) - sum(w[k - 1] * back(y, k) for k in LAGS if w[k - 1] != 0)
    for reach in REACHES:
        z = np.column_stack([np.ones(len(y)), x, y, *[back(y, k) for k in LAGS if k <= reach], *[back(e, k) for k in SHOCK_LAGS if k <= reach]])
        z = z[~np.isnan(z).any(axis=1) & (rows[:, 0] >= ends[0]) & (rows[:, 0] <= ends[1])]
        if len(z):
            found[reach] = (z.T @ z, len(z))
    return found, e


@pytest.mark.parametrize("n, unknown", [(900, ()), (900, (300, 301, 640)), (90, ()), (20, ()), (6, ())])
def test_matrices_of_windows_that_overlap(n, unknown):
    ends = [(13, n), (1, n), (133, min(700, n))]
    given, flags = parts(n, unknown)
    _, got = study(given, ends)
    for i, window in enumerate(ends):
        if got.first[i] is None:
            assert not got.second[i]
            continue
        want, e = by_hand(np.concatenate(given), flags, window, got.first[i])
        assert set(got.second[i]) == set(want)
        for reach, (gram, rows) in want.items():
            assert got.second[i][reach][1] == rows
            np.testing.assert_allclose(got.second[i][reach][0], gram, rtol=1e-8, atol=1e-4)
        tails, y = got.tails(i, 12), np.concatenate(given)[:, 1]
        before = min(n - 12, 122)
        if before > 0:
            np.testing.assert_allclose(tails["y_tail"][:before], y[::-1][12 : 12 + before])
            np.testing.assert_allclose(tails["e_tail"][: min(before, 60)], np.nan_to_num(e[::-1][12 : 12 + before][:60]), atol=1e-6)


def test_a_long_series_waits_in_a_file(monkeypatch):
    """Rows beyond the bound leave the memory and give the same matrices, whatever blocks they are read in."""
    given, _ = parts(1500)
    _, whole = study(given, [(13, 1500)])
    monkeypatch.setattr(onepass, "HELD", 250)
    monkeypatch.setattr(onepass, "BLOCK", 61)
    held, cut = study(given, [(13, 1500)])
    assert held.file is not None and held.rows <= 250 and sum(map(len, held)) == 1500
    for reach, (gram, n) in whole.second[0].items():
        assert cut.second[0][reach][1] == n
        np.testing.assert_allclose(cut.second[0][reach][0], gram, rtol=1e-8, atol=1e-4)
    np.testing.assert_allclose(cut.tails(0, 12)["e_tail"], whole.tails(0, 12)["e_tail"], atol=1e-6)


def test_two_windows_are_two_fits(spark):
    """The refit keeps order and d of the training part; both are those of fits on their own, short series included."""
    rows = training.narrow_designs(series_of(spark, {"a": ar(700), "b": 50 + np.cumsum(ar(400, 7) - 20) / 10, "c": ar(18), "d": ar(2)}), (TARGET,))[TARGET]
    orders = spark.createDataFrame([("a", 2, 1, 0), ("c", 1, 0, 0)], "DeviceId string, p int, q int, sd int")
    fits = M.fit_windows(rows, TARGET, {"train": (13, M.EVERYTHING), "all": (1, M.EVERYTHING)}, orders, (1, 0, 1))
    train = M.models_of(fits, rows, TARGET, "train")
    alone = {"train": M.fit_models(rows, TARGET, orders, (1, 0, 1), window=(13, M.EVERYTHING), name="train")}
    alone["all"] = M.fit_models(rows, TARGET, train.select("DeviceId", *M.ORDER_COLS, "d"), name="all")
    for name, rn in (("train", 12), ("all", 0)):
        got = {r["DeviceId"]: r.asDict() for r in M.models_of(fits, rows, TARGET, name).collect()}
        want = {r["DeviceId"]: r.asDict() for r in alone[name][0].collect()}
        assert set(got) == set(want) == {"a", "b", "c", "d"}
        for device, model in want.items():
            for c, v in model.items():
                assert got[device][c] == (pytest.approx(v, rel=1e-4, abs=1e-5) if isinstance(v, float) or c in ("beta", "w", "theta") else v) or c in ("coef", "pvalue")
        tails = {r["DeviceId"]: r for r in M.tails_of(fits, name).collect()}
        for r in M.tails_before(alone[name][1], rn).collect():
            np.testing.assert_allclose(tails[r["DeviceId"]]["y_tail"], r["y_tail"])
            np.testing.assert_allclose(tails[r["DeviceId"]]["e_tail"], r["e_tail"], atol=1e-8)


def test_training_takes_two_passes_over_narrow_rows(spark, monkeypatch):
    """A target's rows are shuffled for the search and for the fits, without lags; before, six times with all of them."""
    passes, pass_of = [], onepass.studied

    def counted(rows, *more):
        out = pass_of(rows, *more)
        passes.append((set(rows.columns), out._jdf.queryExecution().optimizedPlan().toString()))
        return out

    monkeypatch.setattr(M, "studied", counted)
    monkeypatch.setattr(M, "series_moments", lambda *a: pytest.fail("moments of wide rows"))
    series = series_of(spark, {"a": ar(300), "b": ar(260, 9)})
    run = training.train_targets(series, tiers={"s": (100, 24, False)}, targets=(TARGET,))[TARGET]
    assert run.metrics.count() == 2 and len(passes) == 2
    for columns, plan in passes:
        assert not columns & {*M.LAG_COLS, *M.SHOCK_COLS} and "Window" not in plan


def test_orders_given_twice_are_fitted_twice(spark):
    rows = training.narrow_designs(series_of(spark, {"a": ar(200)}), (TARGET,))[TARGET]
    orders = spark.createDataFrame([("a", 1), ("a", 2)], "DeviceId string, p int")
    models, _ = M.fit_models(rows, TARGET, orders)
    assert sorted(r["p"] for r in models.select("p").collect()) == [1, 2]
    assert models.select(F.min("n")).first()[0] == models.select(F.max("n")).first()[0]
