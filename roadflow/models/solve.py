"""Least squares on moment matrices: the only numeric helper the model jobs need.

A series is described by the Gram matrix of the raw vector ``[1, x_1..x_m, y_0, y_k.., e_j..]``: regressors, the
target and a sparse set of its lags, lagged shocks. Differences, seasonal differences, autoregressive and seasonal
terms are linear in the raw lags, so every candidate model is a transform of one matrix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np


@dataclass(frozen=True)
class Layout:
    """Positions inside the raw vector. A number of lags or shocks stands for all from 1 on."""

    m: int  # regressors
    lags: tuple[int, ...] | int
    shocks: tuple[int, ...] | int = 2

    def __post_init__(self) -> None:
        for name in ("lags", "shocks"):
            given = getattr(self, name)
            if isinstance(given, int):
                object.__setattr__(self, name, tuple(range(1, given + 1)))

    @property
    def size(self) -> int:
        return 2 + self.m + len(self.lags) + len(self.shocks)

    @cached_property
    def _y(self) -> dict[int, int]:
        return {k: 1 + self.m + i for i, k in enumerate((0, *self.lags))}

    @cached_property
    def _e(self) -> dict[int, int]:
        return {k: 2 + self.m + len(self.lags) + i for i, k in enumerate(self.shocks)}

    def y(self, k: int) -> int:
        if k not in self._y:
            raise ValueError(f"lag {k} of the target is asked for; the design holds {self.lags}")
        return self._y[k]

    def e(self, k: int) -> int:
        if k not in self._e:
            raise ValueError(f"shock term {k} is asked for; the design holds {self.shocks}")
        return self._e[k]


def _unit(size: int, at: int) -> np.ndarray:
    row = np.zeros(size)
    row[at] = 1.0
    return row


def difference_terms(d: int, seasonal_d: int = 0, s: int = 0) -> dict[int, float]:
    """(1 - B)^d (1 - B^s)^D as lag -> coefficient."""
    terms = {0: 1.0}
    for step in [1] * d + [s] * seasonal_d:
        shifted = {k + step: -c for k, c in terms.items()}
        terms = {k: terms.get(k, 0.0) + shifted.get(k, 0.0) for k in {**terms, **shifted}}
    return terms


def diff_row(lay: Layout, k: int, d: int, seasonal_d: int = 0, s: int = 0) -> np.ndarray:
    """The differenced target k steps back, over the raw vector."""
    row = np.zeros(lay.size)
    for i, c in difference_terms(d, seasonal_d, s).items():
        row[lay.y(k + i)] += c
    return row


def terms_of(order: tuple, seasonal: tuple) -> tuple[list[int], list[int]]:
    """Lags of the differenced target and of the shocks that a model has."""
    (p, _, q), (big_p, _, big_q, s) = order, seasonal
    near = lambda n, big: list(range(1, n + 1)) + [s * j for j in range(1, big + 1) if s * j > n]
    return near(p, big_p), near(q, big_q)


def reach_of(order: tuple, seasonal: tuple) -> int:
    """The farthest raw lag or shock that a model looks back to."""
    ks, js = terms_of(order, seasonal)
    return max([max(ks, default=0) + max(difference_terms(order[1], seasonal[1], seasonal[3])), *js])


def least_squares(gram: np.ndarray, rows: np.ndarray, goal: np.ndarray, n: float):
    """Coefficients, standard errors and residual sum of squares; constant columns get 0."""
    a = rows @ gram @ rows.T
    b = rows @ gram @ goal
    scale = np.sqrt(np.maximum(np.diag(a), 0.0))
    scale[scale == 0] = 1.0
    values, vectors = np.linalg.eigh(a / np.outer(scale, scale))
    used = np.abs(values) > 1e-10 * np.abs(values).max()
    inv = (vectors[:, used] / values[used]) @ vectors[:, used].T
    coef = inv @ (b / scale) / scale
    sse = max(float(goal @ gram @ goal - coef @ b), 0.0)
    dof = max(n - int(used.sum()), 1.0)
    se = np.sqrt(np.maximum(np.diag(inv), 0.0) * sse / dof) / scale
    return coef, se, sse, dof


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _weights(lay: Layout, whole: np.ndarray, reach: tuple[int, int]) -> dict:
    """``w`` and ``theta`` of raw weights, dense up to ``reach``."""
    w, theta = np.zeros(reach[0]), np.zeros(reach[1])
    for k in lay.lags:
        w[k - 1] = whole[lay.y(k)]
    for k in lay.shocks:
        theta[k - 1] = whole[lay.e(k)]
    return {"w": w, "theta": theta}


def _model(lay: Layout, rows: np.ndarray, goal: np.ndarray, solved: tuple, terms: list[str], reach: tuple[int, int]) -> dict:
    """The answer phrased on the raw vector: y is ``const + beta . x + w . (y_1, y_2 ..) + theta . (e_1, e_2 ..)``.

    ``w`` and ``theta`` are dense up to ``reach``, so forecasts need not know the layout.
    """
    coef, se, sse, dof = solved
    whole = coef @ rows - goal
    dense = _weights(lay, whole, reach)
    return {
        "const": float(coef[0]), "beta": whole[1 : 1 + lay.m].tolist(), **{k: v.tolist() for k, v in dense.items()},
        "sigma2": sse / dof, "coef": coef.tolist(),
        "pvalue": [2 * normal_tail(abs(c) / v) if v > 0 else 1.0 for c, v in zip(coef, se)], "terms": terms,
    }


def reaches(lay: Layout, reach: tuple[int, int] | None) -> tuple[int, int]:
    return reach or (max(lay.lags, default=0), max(lay.shocks, default=0))


@cache
def design_rows(lay: Layout, order: tuple, seasonal: tuple) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Terms of a model besides the regressors and its goal, over the raw vector; the names of the terms."""
    d, seasonal_d, s = order[1], seasonal[1], seasonal[3]
    ks, js = terms_of(order, seasonal)
    rows = [diff_row(lay, k, d, seasonal_d, s) for k in ks] + [_unit(lay.size, lay.e(j)) for j in js]
    return np.array(rows).reshape(-1, lay.size), diff_row(lay, 0, d, seasonal_d, s), [f"ar{k}" for k in ks] + [f"ma{j}" for j in js]


def fit(gram: np.ndarray, n: float, lay: Layout, order: tuple, seasonal: tuple, reach: tuple[int, int] | None = None) -> dict:
    """One model: regressors, p lags, P seasonal lags, q shocks and Q seasonal shocks on the (d, D)-th difference."""
    own, goal, terms = design_rows(lay, order, seasonal)
    rows = np.vstack([np.eye(1 + lay.m, lay.size), own])
    return _model(lay, rows, goal, least_squares(gram, rows, goal, n), terms, reaches(lay, reach))


class Common:
    """Many models of one Gram matrix: the regressors that all of them have are taken out once.

    What is left for each model is a system of its few terms (Frisch-Waugh-Lovell). Where a model's terms, or the
    regressors themselves, are too close to collinear to tell this from ``fit``, ``fit`` decides.
    """

    EXACT, CLEAR = 1e-13, 1e-6  # shares of the largest eigenvalue that count as none and as some

    def __init__(self, gram: np.ndarray, n: float, lay: Layout, reach: tuple[int, int]) -> None:
        self.gram, self.n, self.lay, self.reach = gram, n, lay, reach
        self.width = c = 1 + lay.m
        scale = np.sqrt(np.maximum(np.diag(gram)[:c], 0.0))
        scale[scale == 0] = 1.0
        values, vectors = np.linalg.eigh(gram[:c, :c] / np.outer(scale, scale))
        share = np.abs(values) / np.abs(values).max()
        self.clear = bool(np.all((share < self.EXACT) | (share > self.CLEAR)))
        used = share > self.CLEAR
        inv = (vectors[:, used] / values[used]) @ vectors[:, used].T / np.outer(scale, scale)
        self.on_regressors = inv @ gram[:c]
        self.rest = gram - gram[:, :c] @ self.on_regressors

    def fit(self, order: tuple, seasonal: tuple) -> dict:
        """``const``, ``beta``, ``w`` and ``theta`` of ``fit``."""
        return {c: v[0] for c, v in self.fit_all([(order, seasonal)]).items()}

    def fit_all(self, tries: list[tuple]) -> dict:
        """``fit`` of many models: ``const``, ``beta``, ``w`` and ``theta`` as arrays, a model a row."""
        lay, width = self.lay, self.width
        out = {"const": np.empty(len(tries)), "beta": np.empty((len(tries), lay.m)),
               "w": np.zeros((len(tries), self.reach[0])), "theta": np.zeros((len(tries), self.reach[1]))}
        left_over = list(range(len(tries)))
        if self.clear and np.all(np.isfinite(self.rest)):
            rows, goal, void = stacked(lay, tuple(tries))
            flat = rows.reshape(-1, lay.size)
            left = (flat @ self.rest).reshape(rows.shape)
            scale = np.sqrt(np.maximum(((flat @ self.gram) * flat).sum(axis=1), 0.0)).reshape(rows.shape[:2])
            ok = np.all((scale > 0) | void, axis=1)
            scale[scale == 0] = 1.0
            a = left @ rows.transpose(0, 2, 1) / (scale[:, :, None] * scale[:, None, :])
            a[:, np.arange(rows.shape[1]), np.arange(rows.shape[1])] += void
            values, vectors = np.linalg.eigh(a)
            ok &= values[:, 0] > self.CLEAR
            values[~ok] = 1.0
            b = np.einsum("cij,cj->ci", left, goal) / scale
            coef = np.einsum("cij,cj->ci", vectors, np.einsum("cji,cj->ci", vectors, b) / values) / scale
            whole = np.einsum("ci,cij->cj", coef, rows) - goal
            whole[:, :width] = -(whole @ self.on_regressors.T)
            out["const"], out["beta"] = whole[:, 0].copy(), whole[:, 1:width].copy()
            if lay.lags:
                out["w"][:, np.array(lay.lags) - 1] = whole[:, lay.y(lay.lags[0]) : lay.y(lay.lags[0]) + len(lay.lags)]
            if lay.shocks:
                out["theta"][:, np.array(lay.shocks) - 1] = whole[:, lay.e(lay.shocks[0]) :]
            left_over = np.flatnonzero(~ok)
        for i in left_over:
            found = fit(self.gram, self.n, lay, *tries[i], self.reach)
            for c in out:
                out[c][i] = found[c]
        return out


@cache
def stacked(lay: Layout, tries: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and goals of many models, those of few terms filled up with empty ones; which terms are such."""
    found = [design_rows(lay, *one) for one in tries]
    rows = np.zeros((len(found), max(len(r) for r, _, _ in found), lay.size))
    for i, (own, _, _) in enumerate(found):
        rows[i, : len(own)] = own
    sizes = np.array([len(r) for r, _, _ in found])
    return rows, np.array([g for _, g, _ in found]), np.arange(rows.shape[1]) >= sizes[:, None]


@cache
def _free_rows(lay: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Constant, regressors and every lag of the layout; the target."""
    return np.delete(np.eye(2 + lay.m + len(lay.lags), lay.size), lay.y(0), axis=0), _unit(lay.size, lay.y(0))


def free_autoregression(gram: np.ndarray, n: float, lay: Layout, reach: tuple[int, int] | None = None) -> dict:
    """All lags of the layout with a weight of their own: any difference and season is a case of it."""
    rows, goal = _free_rows(lay)
    return _model(lay, rows, goal, least_squares(gram, rows, goal, n), [f"ar{k}" for k in lay.lags], reaches(lay, reach))


def recurse(model: dict, xb: np.ndarray, y_tail: np.ndarray, e_tail: np.ndarray) -> np.ndarray:
    """h-step forecast; tails are newest first, ``xb`` is const + beta . x per step."""
    w, theta = np.asarray(model["w"]), np.asarray(model["theta"])
    past = np.asarray(y_tail, dtype=float)[: len(w)]
    shocks = [(j, theta[j]) for j in np.flatnonzero(theta)]
    out = []
    for h, base in enumerate(xb):
        shock = sum(t * e_tail[j - h] for j, t in shocks if 0 <= j - h < len(e_tail))
        value = float(base + w @ past + shock)
        out.append(value)
        past = np.concatenate(([value], past[:-1]))
    return np.asarray(out)


def error_spread(model: dict, steps: int) -> np.ndarray:
    """Standard error of the h-step forecast from the model's impulse weights."""
    w, theta = model["w"], model["theta"]
    psi = [1.0]
    for j in range(1, steps):
        psi.append(
            sum(w[i] * psi[j - 1 - i] for i in range(min(j, len(w))))
            + (theta[j - 1] if j <= len(theta) else 0.0)
        )
    return np.sqrt(model["sigma2"] * np.cumsum(np.square(psi)))


def recurse_all(models: dict, xb: np.ndarray, y_tail: np.ndarray, e_tail: np.ndarray) -> np.ndarray:
    """``recurse`` for many models at once, one a row; ``w`` and ``theta`` are matrices."""
    w, theta = models["w"], models["theta"]
    steps, reach = xb.shape[1], w.shape[1]
    # What is forecast goes in front of what is known, newest first.
    past = np.hstack([np.zeros_like(xb), y_tail[:, :reach]])
    base = np.array(xb, dtype=float)
    for j in np.flatnonzero(theta.any(axis=0)):
        # Known shocks reach the first j + 1 steps, the newest the last of them.
        first, last = max(j + 1 - e_tail.shape[1], 0), min(j + 1, steps)
        if first < last:
            base[:, first:last] += theta[:, j : j + 1] * e_tail[:, j - np.arange(first, last)]
    for h in range(steps):
        at = steps - h
        past[:, at - 1] = base[:, h] + np.einsum("ij,ij->i", w, past[:, at : at + reach])
    return past[:, :steps][:, ::-1]


def error_spreads(models: dict, steps: int) -> np.ndarray:
    """``error_spread`` for many models at once, one a row."""
    w, theta = models["w"], models["theta"]
    psi = np.ones((len(w), steps))
    for j in range(1, steps):
        near = min(j, w.shape[1])
        psi[:, j] = np.einsum("ij,ij->i", w[:, :near], psi[:, j - near : j][:, ::-1])
        if j <= theta.shape[1]:
            psi[:, j] += theta[:, j - 1]
    return np.sqrt(models["sigma2"][:, None] * np.cumsum(np.square(psi), axis=1))


# Response surface of the Dickey-Fuller t statistic with a constant
# (MacKinnon 1994), lower and upper part, and the ends of its range.
TAU_STAR, TAU_MIN, TAU_MAX = -1.61, -18.83, 2.74
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def dickey_fuller_p(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    surface = TAU_SMALL if tau <= TAU_STAR else TAU_LARGE
    return normal_tail(-sum(c * tau**i for i, c in enumerate(surface)))


def lag_count(n: int) -> int:
    """Lagged differences that the test on n rows may use."""
    return max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 3))


@cache
def _test_rows(lay: Layout, d: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Constant, level and lagged differences of the d-th difference, and the goal of the test."""
    steps = [diff_row(lay, k, d) - diff_row(lay, k + 1, d) for k in range(most + 1)]
    return np.array([_unit(lay.size, 0), diff_row(lay, 1, d), *steps[1:]]), steps[0]


NESTED = 1e-8  # least share of the largest eigenvalue from which regressions are solved inside each other


def nested_tests(gram: np.ndarray, n: float, rows: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(t statistic of the level, residual sum) of the regressions on the first 2, 3 .. rows, from one factor.

    The leading part of a Cholesky factor, and of its inverse, is that of the leading matrix. None where the rows are too close to collinear.
    """
    a, b = rows @ gram @ rows.T, rows @ gram @ goal
    scale = np.sqrt(np.maximum(np.diag(a), 0.0))
    if not np.all(scale > 0) or not np.all(np.isfinite(a)):
        return None
    a = a / np.outer(scale, scale)
    values = np.linalg.eigvalsh(a)
    if values[0] <= NESTED * values[-1]:
        return None
    back = np.linalg.inv(np.linalg.cholesky(a))
    z = back @ (b / scale)
    # Row j of ``back`` adds its share to the level's weight and variance in every regression that has row j.
    level = np.cumsum(back[:, 1] * z)[1:]
    spread = np.cumsum(back[:, 1] ** 2)[1:]
    sse = np.maximum(goal @ gram @ goal - np.cumsum(z * z)[1:], 0.0)
    dof = np.maximum(n - np.arange(2, len(rows) + 1), 1.0)
    se = np.sqrt(spread * sse / dof)
    return np.divide(level, se, out=np.zeros_like(level), where=se > 0), sse


def dickey_fuller(gram: np.ndarray, n: float, lay: Layout, d: int, most: int) -> float:
    """p-value of the augmented test on the d-th difference with up to ``most`` lagged differences, chosen by AIC."""
    rows, goal = _test_rows(lay, d, most)
    found = nested_tests(gram, n, rows, goal)
    if found is None:
        solved = [least_squares(gram, rows[: 2 + k], goal, n) for k in range(most + 1)]
        found = [coef[1] / se[1] if se[1] > 0 else 0.0 for coef, se, _, _ in solved], [sse for _, _, sse, _ in solved]
    aic = [n * math.log(max(sse / n, 1e-300)) + 2 * (k + 2) for k, sse in enumerate(found[1])]
    return dickey_fuller_p(found[0][int(np.argmin(aic))])


def difference_order(gram: np.ndarray, n: float, lay: Layout, lags: int, most: int = 2):
    """Smallest d with a p-value below 0.05 (else the largest), p before and after."""
    before = dickey_fuller(gram, n, lay, 0, lags)
    d, after = 0, before
    while after >= 0.05 and d < most:
        d += 1
        after = dickey_fuller(gram, n, lay, d, lags)
    return d, before, after


def chi2_tail(x: float, dof: int) -> float:
    """Upper tail of the chi-squared distribution for a whole number of degrees."""
    if x <= 0:
        return 1.0
    if dof % 2 == 0:
        term = total = math.exp(-x / 2)
        for i in range(1, dof // 2):
            term *= x / 2 / i
            total += term
        return min(total, 1.0)
    total = math.erfc(math.sqrt(x / 2))
    term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for i in range(1, (dof - 1) // 2 + 1):
        total += term
        term *= x / (2 * i + 1)
    return min(total, 1.0)
