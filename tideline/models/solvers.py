"""Dense solvers for one small standardised problem (a fold, or a moment matrix).

Everything is written on the moments ``G = X'WX / n``, ``g = X'Wy / n`` so that a
fold and a whole history (whose moments Spark sums) use the same code.
"""

from __future__ import annotations

import numpy as np

from tideline.models import quantile

# Default parameters of the regressors.
DEFAULTS = {
    "OLS": {},
    "Ridge": {"alpha": 1.0},
    "Lasso": {"alpha": 1.0, "l1_ratio": 1.0},
    "ElasticNet": {"alpha": 1.0, "l1_ratio": 0.5},
    "HuberRegressor": {"epsilon": 1.35, "alpha": 0.0001},
    "QuantileRegressor": {"quantile": 0.5, "alpha": 1.0},
    "RobustElasticNet": {"epsilon": 0.1, "alpha": 0.01, "l1_ratio": 0.5},
    "RobustLasso": {"epsilon": 0.1, "alpha": 0.01, "l1_ratio": 1.0},
    "BayesianRidge": {"alpha_1": 1e-6, "alpha_2": 1e-6, "lambda_1": 1e-6, "lambda_2": 1e-6},
}


def configurations(models) -> list[tuple[str, str, dict]]:
    """Names, or (label, model, parameters), as (label, model, parameters)."""
    return [(m, m, {}) if isinstance(m, str) else tuple(m) for m in models]


def min_norm(G, g):
    """Least squares of smallest norm, also when G is singular."""
    return np.linalg.pinv(G, rcond=1e-12, hermitian=True) @ g


def ridge(G, g, penalty):
    return np.linalg.solve(G + penalty * np.eye(len(g)), g)


def elastic_net(G, g, l1, l2, start=None, sweeps=2_000, tol=1e-9):
    """Coordinate descent for b'Gb/2 - g'b + l1 |b|_1 + l2 |b|^2 / 2.

    Stops when a sweep over all coordinates lowers the objective by a negligible
    part of what was gained so far; between those, only non-zero ones move.
    """
    b = np.zeros(len(g)) if start is None else start.copy()
    slack, step = g - G @ b, np.diag(G) + l2
    usable = np.flatnonzero(np.diag(G) > 0)
    gained = float(abs(g @ b))

    def sweep(coordinates):
        lowered = 0.0
        for j in coordinates:
            pull = slack[j] + G[j, j] * b[j]
            size = abs(pull) - l1
            new = 0.0 if size <= 0 else np.copysign(size, pull) / step[j]
            move = new - b[j]
            if move:
                np.subtract(slack, G[j] * move, out=slack)
                b[j] = new
                lowered += 0.5 * step[j] * move * move
        return lowered

    for _ in range(sweeps):
        lowered = sweep(usable)
        gained += lowered
        if lowered <= tol * gained:
            break
        for _ in range(20):
            inner = sweep(np.flatnonzero(b))
            gained += inner
            if inner <= tol * gained:
                break
    return b


def weighted_moments(X, y, w):
    """Centred moments and the centres; the intercept is my - mx @ b."""
    total = w.sum()
    mx, my = w @ X / total, w @ y / total
    Xc = X - mx
    WX = Xc * w[:, None]
    return WX.T @ Xc / len(y), WX.T @ (y - my) / len(y), mx, my


def reweighted(X, y, weigh, solve, rounds=100, tol=1e-6):
    """Alternate row weights and a weighted solve until the fit stands still."""
    b, c = np.zeros(X.shape[1]), float(np.median(y))
    fitted = np.full(len(y), c)
    for _ in range(rounds):
        w, shift = weigh(y - fitted)
        G, g, mx, my = weighted_moments(X, y + shift, w)
        b = solve(G, g, b)
        c = my - mx @ b
        before, fitted = fitted, X @ b + c
        if np.abs(fitted - before).max() <= tol * (np.std(y) + 1e-12):
            break
    return b, c


def huber_scale(r, epsilon, rounds=100):
    """Scale that minimises sum(s + s H(r / s)) with H quadratic up to epsilon."""
    s = max(float(np.sqrt(np.mean(r * r))), 1e-12)
    for _ in range(rounds):
        out = np.abs(r) > epsilon * s
        room = len(r) - epsilon**2 * out.sum()
        new = np.sqrt((r[~out] ** 2).sum() / room) if room > 0 else s * 2
        new = max(float(new), 1e-12)
        if abs(new - s) <= 1e-12 * s:
            break
        s = new
    return s


def fit(model, X, y, params):
    """Coefficients, intercept, and the predictive deviation as a function (or None)."""
    n, d = X.shape
    one = np.ones(n)
    if model in ("OLS", "Ridge", "Lasso", "ElasticNet", "BayesianRidge"):
        G, g, mx, my = weighted_moments(X, y, one)
        syy = float(np.mean((y - my) ** 2))
        b, sd = solve_moments(model, G, g, syy, n, params)
        deviation = (lambda Z: sd(Z - mx)) if sd else None
        return b, my - mx @ b, deviation
    if model == "QuantileRegressor":
        q, alpha = params["quantile"], params["alpha"]
        if alpha >= max(q, 1 - q):  # the penalty outweighs every subgradient
            return np.zeros(d), float(np.quantile(y, q)), None
        b, c, _ = quantile.fit(X, y, q, alpha)
        return b, c, None
    epsilon, alpha = params["epsilon"], params["alpha"]
    if model == "HuberRegressor":
        state = {}

        def weigh(r):
            state["s"] = s = huber_scale(r, epsilon)
            return np.minimum(1.0, epsilon * s / np.maximum(np.abs(r), 1e-300)), 0.0

        b, c = reweighted(X, y, weigh, lambda G, g, b: ridge(G, g, alpha * state["s"] / n))
        return b, c, None
    l1, l2 = alpha * params["l1_ratio"], alpha * (1 - params["l1_ratio"])

    def clipped(r):
        return np.minimum(1.0, epsilon / np.maximum(np.abs(r), 1e-300)), 0.0

    b, c = reweighted(X, y, clipped, lambda G, g, b: elastic_net(G, g, l1, l2, b))
    return b, c, None


def solve_moments(model, G, g, syy, n, params):
    """Coefficients from centred moments, for the squared-error models."""
    if model == "OLS":
        return min_norm(G, g), None
    if model == "Ridge":
        return ridge(G, g, params["alpha"] / n), None
    if model in ("Lasso", "ElasticNet"):
        a, r = params["alpha"], params["l1_ratio"]
        return elastic_net(G, g, a * r, a * (1 - r)), None
    return bayesian_ridge(G, g, syy, n, params)


def bayesian_ridge(G, g, syy, n, params, rounds=300, tol=1e-3):
    """Evidence maximisation for noise precision a and weight precision l."""
    values, vectors = np.linalg.eigh(G * n)
    values = np.maximum(values, 0.0)
    proj = vectors.T @ (g * n)
    a, l = 1.0 / (syy + np.finfo(float).eps), 1.0
    b = None
    for _ in range(rounds):
        new = vectors @ (proj / (values + l / a))
        sse = max(n * syy - 2 * n * new @ g + n * new @ G @ new, 0.0)
        gamma = float((a * values / (l + a * values)).sum())
        l = (gamma + 2 * params["lambda_1"]) / (new @ new + 2 * params["lambda_2"])
        a = (n - gamma + 2 * params["alpha_1"]) / (sse + 2 * params["alpha_2"])
        done = b is not None and np.abs(b - new).sum() < tol
        b = new
        if done:
            break
    b = vectors @ (proj / (values + l / a))

    def deviation(Z):
        spread = ((Z @ vectors) ** 2 / (l + a * values)).sum(axis=1)
        return np.sqrt(spread + 1.0 / a)

    return b, deviation
