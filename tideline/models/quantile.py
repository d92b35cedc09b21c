"""Linear quantile regression with an absolute penalty, solved exactly on one fold.

minimise  mean(pinball(y - X b - c)) + alpha |b|_1,  a linear program. A primal-dual interior point method works on its
dual, where every row has one bounded multiplier and every input one linear constraint:

    maximise y'u   with  -(1 - q)/n <= u <= q/n,  sum(u) = 0,  |X'u| <= alpha.

The multipliers of the constraints are the coefficients. The solver reports the duality gap: the penalised loss of the
coefficients it returns, less the value of a feasible u. No other fit has a loss lower by more than the gap. At the end the
fit moves to the vertex next to it, where as many rows as there are non-zero numbers lie on the plane, if that loses nothing.
"""

from __future__ import annotations

import numpy as np


#: Rows up to which the normal equations are solved by rows; beyond, by inputs, and refined.
BY_ROWS = 1024


def loss(X, y, b, c, q, alpha) -> float:
    r = y - X @ b - c
    return float(np.maximum(q * r, (q - 1) * r).mean() + alpha * np.abs(b).sum())


def best_intercept(r, q) -> float:
    """A q-quantile of the residuals: the intercept of least loss for given coefficients."""
    ordered = np.sort(r)
    return float(ordered[min(len(r) - 1, max(0, int(np.ceil(q * len(r))) - 1))])


def dual_value(X, y, u, q, alpha, plane) -> float:
    """y'u of the multipliers once they are made feasible: the part in the ``plane`` of the free columns goes, the rest is shrunk into all bounds."""
    n = len(y)
    u = u - plane @ (plane.T @ u)
    room = [1.0]
    if u.max() > 0:
        room.append(q / n / u.max())
    if u.min() < 0:
        room.append((1 - q) / n / -u.min())
    steep = np.abs(X.T @ u).max(initial=0.0)
    if steep > 0 and alpha > 0:
        room.append(alpha / steep)
    return float(min(room) * (y @ u))


def _normal_equations(X, tp, ts):
    """Solver for (X diag(tp) X' + diag(ts)) u = v, by a factor of the smaller side, refined with the matrix itself."""
    if len(X) <= BY_ROWS:
        matrix = (X * tp) @ X.T
        matrix[np.diag_indices(len(X))] += ts + 1e-14 * ts.max()
        factor = np.linalg.cholesky(matrix)

        def rough(v):
            return np.linalg.solve(factor.T, np.linalg.solve(factor, v))

    else:
        factor = np.linalg.cholesky(np.diag(1.0 / np.maximum(tp, 1e-300)) + (X.T / ts) @ X)

        def rough(v):
            return v / ts - (X @ np.linalg.solve(factor.T, np.linalg.solve(factor, X.T @ (v / ts)))) / ts

    def solve(v):
        out = rough(v)
        for _ in range(2):
            out += rough(v - X @ (tp * (X.T @ out)) - ts * out)
        return out

    return solve


def _vertex(X, y, b, c, q, alpha):
    """The vertex of the program next to a fit: rows of least residual meet the plane of the non-zero coefficients."""
    held = np.flatnonzero(np.abs(b) > 1e-6 * max(1.0, np.abs(b).max(initial=0.0)))
    rows = np.argsort(np.abs(y - X @ b - c), kind="stable")[: len(held) + 1]
    try:
        exact = np.linalg.solve(np.column_stack([X[np.ix_(rows, held)], np.ones(len(rows))]), y[rows])
    except np.linalg.LinAlgError:
        return b, c
    moved = np.zeros(len(b))
    moved[held] = exact[:-1]
    return (moved, float(exact[-1])) if loss(X, y, moved, exact[-1], q, alpha) <= loss(X, y, b, c, q, alpha) else (b, c)


@np.errstate(over="ignore", invalid="ignore", divide="ignore")  # a step that leaves the numbers ends the rounds
def fit(X, y, q=0.5, alpha=1.0, tol=1e-9, rounds=200):
    """Coefficients, intercept and the duality gap, relative to the loss of the constant fit.

    Variables of the program: b = p - m (p, m >= 0), residual = s - t (s, t >= 0), c free. Without a penalty b is free as well.
    """
    n, d = X.shape
    base = loss(X, y, np.zeros(d), best_intercept(y, q), q, alpha)
    if base <= 0:  # all targets are equal
        return np.zeros(d), best_intercept(y, q), 0.0
    center, size = best_intercept(y, q), max(float(np.std(y)), 1e-300)
    z, one = (y - center) / size, np.ones((n, 1))
    P, free = (X, one) if alpha > 0 else (X[:, :0], np.hstack([X, one]))
    k = P.shape[1]
    sides, values, _ = np.linalg.svd(free, full_matrices=False)
    plane = sides[:, values > 1e-10 * values.max()]
    cost = np.concatenate([np.full(2 * k, float(alpha)), np.full(n, q / n), np.full(n, (1 - q) / n)])
    x = np.concatenate([np.full(2 * k, 1.0 / max(1, k)), np.maximum(z, 0) + 0.5, np.maximum(-z, 0) + 0.5])
    u, f, w = np.zeros(n), np.zeros(free.shape[1]), cost * 0.5
    best = (np.inf, np.zeros(d), 0.0)

    def times(v):  # constraint matrix of p, m, s, t
        return P @ (v[:k] - v[k : 2 * k]) + v[2 * k : 2 * k + n] - v[2 * k + n :]

    def back(v):
        g = P.T @ v
        return np.concatenate([g, -g, v, -v])

    def longest(v, dv):
        down = dv < 0
        return min(1.0, float((-v[down] / dv[down]).min(initial=np.inf)))

    for _ in range(rounds):
        b = x[:k] - x[k : 2 * k] if alpha > 0 else f[:d]
        c = best_intercept(z - X @ b, q)
        gap = (loss(X, z, b, c, q, alpha) - dual_value(X, z, u, q, alpha, plane)) * size / base
        if gap < best[0]:
            best = (gap, b.copy(), c)
        if gap <= tol:
            break
        primal, dual, level = z - times(x) - free @ f, cost - back(u) - w, free.T @ u
        mu, theta = x @ w / len(x), x / w
        try:
            invert = _normal_equations(P, theta[:k] + theta[k : 2 * k], theta[2 * k : 2 * k + n] + theta[2 * k + n :])
        except np.linalg.LinAlgError:
            break
        spread = np.column_stack([invert(column) for column in free.T])

        def direction(target, theta=theta, w=w, x=x, primal=primal, dual=dual, level=level, invert=invert, spread=spread):
            """Newton step towards products x * w = target."""
            rest = target / w - x  # what the products ask of x, before the dual step
            raw = invert(primal - times(rest) + times(theta * dual))
            df = np.linalg.lstsq(free.T @ spread, free.T @ raw + level, rcond=1e-13)[0]
            du = raw - spread @ df
            dw = dual - back(du)
            return rest - theta * dw, du, df, dw

        dx, du, df, dw = direction(np.zeros(len(x)))
        after = (x + longest(x, dx) * dx) @ (w + longest(w, dw) * dw) / len(x)
        dx, du, df, dw = direction(mu * (after / mu) ** 3 - dx * dw)
        step, turn = 0.9995 * longest(x, dx), 0.9995 * longest(w, dw)
        x, f = x + step * dx, f + step * df
        u, w = u + turn * du, w + turn * dw
        if not (np.isfinite(x).all() and np.isfinite(w).all() and np.isfinite(f).all()):
            break
    gap, b, c = best
    b, c = _vertex(X, z, b, c, q, alpha)
    return b * size, center + c * size, max(gap, 0.0)
