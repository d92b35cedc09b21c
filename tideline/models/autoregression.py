"""Autoregression of order p on d-times differenced series.

Conditional least squares from sums of products per series: lags are windows,
the sums are an aggregation with map-side combine, and only the p x p systems
(one row per series) reach Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.layout import Series, lay_out
from tideline.shipping import ship_package

# Fixed value: default order.
ORDER = (5, 1, 0)


def check_order(order) -> tuple[int, int, int]:
    if len(order) != 3 or any(not isinstance(k, int) or k < 0 for k in order):
        raise ValueError("order must be three non-negative integers (p, d, q)")
    if order[2] != 0:
        raise ValueError("moving-average terms are not supported, use q = 0")
    if order[0] == 0:
        raise ValueError("at least one autoregressive term is needed")
    return tuple(order)


def fit(df: DataFrame, value: str, order=ORDER, series: Series = Series()) -> DataFrame:
    """Per series: ``coefficients`` (p values), ``intercept`` (0 if d > 0), and the
    last values ``tail`` and ``levels`` a forecast starts from."""
    p, d, _ = check_order(order)
    ship_package(df.sparkSession)
    keys = list(series.keys)
    layout = lay_out(df, series)
    rows = layout.spread(df.select(*keys, series.time, value), p + d + 1)
    w = layout.window()
    rows = rows.withColumn("_d0", F.col(value))
    for k in range(1, d + 1):
        step = F.col(f"_d{k - 1}") - F.lag(f"_d{k - 1}", 1).over(w)
        rows = rows.withColumn(f"_d{k}", step)
    rows = rows.withColumns({f"_l{i}": F.lag(f"_d{d}", i).over(w) for i in range(1, p + 1)})
    rows = layout.own(rows.withColumn("_l0", F.col(f"_d{d}")))
    whole = F.greatest(*[F.col(f"_l{i}").isNull().cast("int") for i in range(p + 1)]) == 0
    names = [F.when(whole, F.col(f"_l{i}")) for i in range(p + 1)]
    # With an intercept: covariances about the mean, which keep their digits at a large level.
    product = (lambda a, b: F.sum(a * b)) if d else F.covar_pop
    sums = [F.count_if(whole).cast("double").alias("_n")]
    for i, a in enumerate(names):
        sums.append(F.avg(a).alias(f"_s{i}"))
        for j in range(i, p + 1):
            sums.append(product(a, names[j]).alias(f"_s{i}_{j}"))
    at = F.col(series.time)
    last = [
        F.max_by(F.array(*[F.col(f"_l{i}") for i in range(p)]), at).alias("tail"),
        F.max_by(F.array(*[f"_d{k}" for k in range(d)]) if d else F.array(F.lit(0.0)), at).alias(
            "levels"
        ),
    ]
    packed = rows.groupBy(*keys).agg(*sums, *last)
    cross = F.array(*[F.col(f"_s{min(i, j)}_{max(i, j)}") for i in range(p + 1) for j in range(p + 1)])
    totals = F.array(*[F.col(f"_s{i}") for i in range(p + 1)])
    table = packed.select(*keys, "_n", cross.alias("_cross"), totals.alias("_totals"), "tail", "levels")
    types = {f.name: f.dataType.simpleString() for f in table.schema}
    schema = ", ".join(
        [
            *[f"{k} {types[k]}" for k in keys],
            "n double, coefficients array<double>, intercept double",
            "tail array<double>, levels array<double>",
        ]
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found, b, intercept = _solve(pdf, p, d)
            out = pdf[[*keys]].assign(n=pdf["n"])
            out["coefficients"] = [v if ok else None for v, ok in zip(b.tolist(), found, strict=True)]
            out["intercept"] = np.where(found, intercept, np.nan)
            yield out.assign(tail=pdf["tail"], levels=pdf["levels"])

    table = table.withColumnsRenamed({"_n": "n", "_cross": "cross", "_totals": "means"})
    return table.mapInPandas(solve, schema)


def _stack(column: pd.Series, width: int) -> np.ndarray:
    """Arrays of one length as rows, missing elements as NaN."""
    return np.array(column.tolist(), dtype=float).reshape(len(column), width)


def _solve(pdf: pd.DataFrame, p: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All systems of a batch at once: which have an answer, coefficients, intercepts."""
    cross = _stack(pdf["cross"], (p + 1) * (p + 1)).reshape(-1, p + 1, p + 1)
    found = np.isfinite(cross).all((1, 2))
    cross = np.where(found[:, None, None], cross, 0.0)
    inverse = np.linalg.pinv(cross[:, 1:, 1:], rcond=np.finfo(float).eps * p, hermitian=True)
    b = (inverse @ cross[:, 1:, :1])[:, :, 0]
    if d > 0:
        return found, b, np.zeros(len(b))
    means = np.nan_to_num(_stack(pdf["means"], p + 1))
    return found, b, means[:, 0] - (means[:, 1:] * b).sum(1)


def forecast(models: DataFrame, steps: int, order=ORDER, keys=("series_id",)) -> DataFrame:
    """``steps`` rows per series: iterate the recursion, then sum back d times."""
    _, d, _ = check_order(order)
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in models.schema}
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "step int, forecast double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["coefficients"].notna()]
            paths = _paths(pdf, steps, d)
            out = pdf[keys].loc[pdf.index.repeat(steps)].reset_index(drop=True)
            out["step"] = np.tile(np.arange(1, steps + 1), len(pdf))
            out["forecast"] = paths.ravel()
            yield out

    return models.mapInPandas(run, schema)


def _paths(pdf: pd.DataFrame, steps: int, d: int) -> np.ndarray:
    """Series x steps: the recursion runs over the steps, for all series of a batch."""
    made = np.empty((len(pdf), steps))
    if not len(pdf):
        return made
    p = len(pdf["coefficients"].iloc[0])
    b, recent = _stack(pdf["coefficients"], p), _stack(pdf["tail"], p)
    intercept = pdf["intercept"].to_numpy(float)
    for k in range(steps):
        made[:, k] = intercept + (b * recent).sum(1)
        recent = np.c_[made[:, k], recent[:, :-1]]
    levels = _stack(pdf["levels"], max(d, 1))
    for k in reversed(range(d)):
        made = levels[:, k : k + 1] + made.cumsum(1)
    return made
