"""Final models on the whole history of every series.

A series is never brought together. Blocks of its rows give partial moment
matrices, Spark sums them, and only the d x d result of a series is solved.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.models import quantile, solvers
from tideline.operators.quantiles import exact_quantiles
from tideline.operators.storage import materialize
from tideline.shipping import ship_package

BLOCK_ROWS = 2048
BROADCAST_NUMBERS = 4_000_000
WHOLE_CELLS = 4_000_000
QUANTILE_GAP = 1e-6
SQUARED = ("OLS", "Ridge", "Lasso", "ElasticNet", "BayesianRidge")
ROBUST = ("HuberRegressor", "RobustElasticNet", "RobustLasso")
#: Model and all its parameters, by label.
Plans = dict[str, tuple[str, dict]]


def _lookup(df: DataFrame) -> DataFrame:
    """Broadcast a table of per-series arrays only if it holds few numbers in all."""
    arrays = [F.size(f.name) for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    each = reduce(lambda a, b: a + b, [F.greatest(n, F.lit(0)) for n in arrays], F.lit(len(df.columns)))
    numbers = df.agg(F.sum(each.cast("long"))).first()[0] or 0
    return F.broadcast(df) if numbers <= BROADCAST_NUMBERS else df


def scalers(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population deviation of every element of ``x`` per series."""
    each = rows.select(*keys, F.posexplode("x").alias("j", "v"))
    stats = each.groupBy(*keys, "j").agg(
        F.avg("v").alias("center"), F.stddev_pop("v").alias("spread")
    )
    spread = F.when(F.col("spread") == 0, F.lit(1.0)).otherwise(F.col("spread"))
    packed = stats.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("j", "center", spread.alias("spread")))).alias("_s")
    )
    return packed.select(*keys, F.col("_s.center").alias("center"), F.col("_s.spread").alias("spread"))


def scaled(rows: DataFrame, scaler: DataFrame, keys: Sequence[str]) -> DataFrame:
    z = F.expr(
        "transform(x, (v, i) -> (v - get(center, i)) / get(spread, i))"
    )
    return rows.join(_lookup(scaler), list(keys)).select(*keys, "idx", "target", z.alias("z"))


def _partial(pdf: pd.DataFrame, keys: list[str], plans: Plans | None) -> pd.DataFrame:
    """Moment matrix of one block of rows, and its part of the residual scale; weighted if there are ``plans``."""
    Z = np.vstack(pdf["z"].to_numpy())
    y = pdf["target"].to_numpy(float)
    head = {k: pdf[k].iloc[0] for k in keys}
    w, scale = np.ones(len(y)), [float(len(y))]
    if plans:
        epsilon = plans[head["model"]][1]["epsilon"]
        s = pdf["s"].iloc[0]
        r = np.abs(y - Z @ np.asarray(pdf["coefficients"].iloc[0]) - pdf["intercept"].iloc[0])
        w = np.minimum(1.0, epsilon * s / np.maximum(r, 1e-300))
        inside = r <= epsilon * s
        scale += [float((r[inside] ** 2).sum()), float((~inside).sum())]
    A = np.column_stack([np.ones(len(y)), Z, y])
    M = (A * w[:, None]).T @ A
    return pd.DataFrame({**head, "i": np.arange(-1, len(M)), "part": [scale, *M]})


def moments(rows: DataFrame, keys: Sequence[str], plans: Plans | None = None) -> DataFrame:
    """Row i of the (weighted) moment matrix of [1, z, y] per group; -1 is the scale."""
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "i int, part array<double>"])
    blocks = rows.withColumn("_block", F.floor(F.col("idx") / BLOCK_ROWS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _partial(pdf, keys, plans)

    parts = blocks.groupBy(*keys, "_block").applyInPandas(run, schema)
    cells = parts.select(*keys, "i", F.posexplode("part").alias("j", "v"))
    summed = cells.groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))
    return summed.groupBy(*keys, "i").agg(
        F.array_sort(F.collect_list(F.struct("j", "v"))).getField("v").alias("row")
    )


def _centred(pdf: pd.DataFrame):
    ordered = pdf.sort_values("i")["row"].to_list()
    return _centred_matrix(np.vstack(ordered[1:]), ordered[0])


def _centred_matrix(M: np.ndarray, scale):
    total = M[0, 0]
    m = M[0] / total
    C = M / total - np.outer(m, m)
    return C[1:-1, 1:-1], C[1:-1, -1], C[-1, -1], total, m[1:-1], m[-1], scale


def _solve(pdf: pd.DataFrame, keys: list[str], plans: Plans) -> pd.DataFrame:
    G, g, syy, n, mx, my, _ = _centred(pdf)
    head = {k: pdf[k].iloc[0] for k in keys}
    out = []
    for label, (model, params) in plans.items():
        b, _ = solvers.solve_moments(model, G, g, syy, n, params)
        out.append({**head, "model": label, "intercept": my - mx @ b, "coefficients": b})
    return pd.DataFrame(out)


def _model_schema(rows: DataFrame, keys: Sequence[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    head = [f"{k} {types[k]}" for k in keys]
    return ", ".join([*head, "model string, intercept double, coefficients array<double>"])


def _advance(model: str, p: dict, centred: tuple, s: float, old: np.ndarray, old_c: float):
    """One reweighted step: intercept, coefficients, scale, and how far they moved."""
    G, g, _, total, mx, my, (n, squares, outside) = centred
    share = total / n  # the loss is averaged over rows, not over weights
    G, g = G * share, g * share
    if model == "HuberRegressor":
        room = n - p["epsilon"] ** 2 * outside
        s = max(float(np.sqrt(squares / room)) if room > 0 else 2 * s, 1e-12)
        b = solvers.ridge(G, g, p["alpha"] * s / n)
    else:
        l1 = p["alpha"] * p["l1_ratio"]
        b = solvers.elastic_net(G, g, l1, p["alpha"] - l1, old)
    c = my - mx @ b
    return c, b, s, max(np.abs(b - old).max(initial=0.0), abs(c - old_c))


def _refit(pdf: pd.DataFrame, keys: list[str], plans: Plans) -> pd.DataFrame:
    """One reweighted step; the next round's scale comes from the same pass."""
    head = {k: pdf[k].iloc[0] for k in keys}
    old = np.asarray(pdf["coefficients"].iloc[0])
    made = _advance(*plans[head["model"]], _centred(pdf), pdf["s"].iloc[0], old, pdf["intercept"].iloc[0])
    c, b, s, moved = made
    return pd.DataFrame([{**head, "intercept": c, "coefficients": b, "s": s, "moved": moved}])


def _whole(pdf: pd.DataFrame, keys: list[str], plans: Plans, rounds: int, tol: float) -> pd.DataFrame:
    """All rounds for a series that fits one task, from its least squares fit."""
    Z, y = np.vstack(pdf["z"].to_numpy()), pdf["target"].to_numpy(float)
    A = np.column_stack([np.ones(len(y)), Z, y])
    head, out = {k: pdf[k].iloc[0] for k in keys}, []
    for label, (model, params) in plans.items():
        if model == "QuantileRegressor":
            b, c, gap = quantile.fit(Z, y, params["quantile"], params["alpha"])
            row = {"model": label, "intercept": c, "coefficients": b, "rounds": 1}
            out.append({**head, **row, "converged": bool(gap <= QUANTILE_GAP)})
            continue
        epsilon = params["epsilon"]
        b, c, s = np.asarray(pdf["coefficients"].iloc[0]), pdf["intercept"].iloc[0], 1.0
        for turn in range(1, rounds + 1):
            r = np.abs(y - Z @ b - c)
            w = np.minimum(1.0, epsilon * s / np.maximum(r, 1e-300))
            inside = r <= epsilon * s
            scale = [float(len(y)), float((r[inside] ** 2).sum()), float((~inside).sum())]
            centred = _centred_matrix((A * w[:, None]).T @ A, scale)
            c, b, s, moved = _advance(model, params, centred, s, b, c)
            if moved <= tol:
                break
        row = {"model": label, "intercept": c, "coefficients": b, "rounds": turn}
        out.append({**head, **row, "converged": bool(moved <= tol)})
    return pd.DataFrame(out)


def _robust(z: DataFrame, start: DataFrame, keys: list[str], plans: Plans, rounds: int, tol: float):
    """Iteratively reweighted fits, and quantile fits.

    A series of at most ``WHOLE_CELLS`` numbers takes all its rounds in one task; longer
    ones take one distributed pass per round for all models, until all have converged. Quantile fits with a penalty that
    leaves inputs in are linear programs and need the rows together: for longer series they are refused.
    """
    start = start.select(*keys, "intercept", "coefficients")
    sizes = z.groupBy(*keys).agg((F.count(F.lit(1)) * F.max(F.size("z"))).alias("_cells"))
    sizes = materialize(sizes)
    z = z.join(_lookup(sizes), keys)
    small = z.filter(F.col("_cells") <= WHOLE_CELLS).drop("_cells")
    shape = f"{_model_schema(z, keys)}, rounds int, converged boolean"

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return _whole(pdf, keys, plans, rounds, tol)

    made = small.join(_lookup(start), keys).groupBy(*keys).applyInPandas(whole, shape)
    if sizes.filter(F.col("_cells") > WHOLE_CELLS).isEmpty():
        return made
    if any(model == "QuantileRegressor" for model, _ in plans.values()):
        raise ValueError(f"quantile regression over a whole series needs at most {WHOLE_CELLS} numbers, or a penalty of at least max(q, 1 - q)")
    long = z.filter(F.col("_cells") > WHOLE_CELLS).drop("_cells")
    there = sizes.filter(F.col("_cells") > WHOLE_CELLS).drop("_cells")
    return made.unionByName(_by_passes(long, start.join(there, keys), keys, plans, rounds, tol))


def _by_passes(z: DataFrame, start: DataFrame, keys: list[str], plans: Plans, rounds: int, tol: float):
    by = [*keys, "model"]
    each = F.explode(F.array(*[F.lit(m) for m in plans])).alias("model")
    line = materialize(
        start.select(*keys, each, "intercept", "coefficients").withColumn("s", F.lit(1.0))
    )
    schema = f"{_model_schema(z, keys)}, s double, moved double"

    def refit(pdf: pd.DataFrame) -> pd.DataFrame:
        return _refit(pdf, by, plans)

    for turn in range(1, rounds + 1):  # noqa: B007
        matrix = moments(z.join(_lookup(line), keys), by, plans)
        made = matrix.join(_lookup(line), by).groupBy(*by).applyInPandas(refit, schema)
        made = materialize(made)
        line = made.drop("moved")
        if made.agg(F.max("moved")).first()[0] <= tol:
            break
    told = made.withColumns({"rounds": F.lit(turn), "converged": F.col("moved") <= tol})
    return told.drop("s", "moved")


def fit_history(
    rows: DataFrame,
    keys: Sequence[str],
    models: Sequence[str | tuple] = SQUARED,
    rounds: int = 2000,
    tol: float = 1e-9,
) -> DataFrame:
    """One row per series and model: intercept, coefficients, and the scaler.

    ``rows`` needs the keys, ``idx``, ``x`` and ``target``; the coefficients apply
    to ``(x - center) / spread``. ``models`` are names or (label, model, parameters). ``rounds`` and ``converged`` tell of
    reweighted fits how many rounds they took, at most ``rounds``, and whether they came within ``tol``; of
    quantile fits, whether their duality gap is negligible.
    """
    ship_package(rows.sparkSession)
    keys = list(keys)
    plans = {label: (model, {**solvers.DEFAULTS[model], **params}) for label, model, params in solvers.configurations(models)}
    scaler = materialize(scalers(rows, keys))
    z = scaled(rows, scaler, keys)
    squared = {n: p for n, p in plans.items() if p[0] in SQUARED}
    constant = {n: p for n, p in plans.items() if p[0] == "QuantileRegressor" and p[1]["alpha"] >= max(p[1]["quantile"], 1 - p[1]["quantile"])}
    robust = {n: p for n, p in plans.items() if n not in squared and n not in constant}
    if robust:
        z = materialize(z)  # read once per round
    base = moments(z, keys)
    first = {"_start": ("Ridge", solvers.DEFAULTS["Ridge"])}
    wanted = squared | first if robust or not squared else squared

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        return _solve(pdf, keys, wanted)

    solved = base.groupBy(*keys).applyInPandas(solve, _model_schema(z, keys))
    if robust:
        solved = materialize(solved)
    made = solved.filter(F.col("model").isin(list(squared)))
    made = made.withColumns({"rounds": F.lit(1), "converged": F.lit(True)})
    if robust:
        start = solved.filter(F.col("model") == "_start").drop("model")
        made = made.unionByName(_robust(z, start, keys, robust, rounds, tol))
    for label, (_, params) in constant.items():
        center = exact_quantiles(rows, keys, "target", {"intercept": params["quantile"]})
        flat = scaler.select(
            *keys, F.transform("center", lambda _: F.lit(0.0)).alias("coefficients")
        )
        level = center.join(flat, keys).withColumns(
            {"model": F.lit(label), "rounds": F.lit(1), "converged": F.lit(True)}
        )
        made = made.unionByName(level.select(*made.columns))
    return made.join(scaler, keys)


def predict_history(rows: DataFrame, models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Apply the final models to rows with ``x``."""
    dot = F.expr(
        "aggregate(transform(x, (v, i) -> (v - get(center, i)) / get(spread, i) *"
        " get(coefficients, i)), intercept, (a, v) -> a + v)"
    )
    return rows.join(_lookup(models), list(keys)).select(
        *keys, "idx", "model", "target", dot.alias("prediction")
    )
