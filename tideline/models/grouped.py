"""Fit and predict every fold of every series in parallel.

A fold is a bounded group (train plus test block), so it is shipped once to a
Python worker that fits all requested models on it. A failing model only fills
the ``error`` column of its own rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.models import solvers
from tideline.operators.lookup import lookup
from tideline.operators.metrics import evaluate
from tideline.shipping import ship_package

Params = Mapping[str, float]
FitPredict = Callable[[np.ndarray, np.ndarray, np.ndarray, Params], object]


def standardise(train: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scale by the train rows; a column without spread is only centred."""
    center, spread = train.mean(axis=0), train.std(axis=0)
    noise = len(train) * np.finfo(float).eps * np.abs(center)
    spread = np.where(spread <= noise, 1.0, spread)
    return (train - center) / spread, (test - center) / spread


def solver(model: str, X, y, Z, params: Params):
    """Prediction and predictive deviation of a built-in model."""
    b, c, deviation = solvers.fit(model, X, y, {**solvers.DEFAULTS[model], **params})
    return Z @ b + c, deviation(Z) if deviation else None


def grid(model: str, **choices: Sequence[float]) -> list[tuple[str, str, dict]]:
    """All parameter combinations of one model as (label, model, params)."""
    combos: list[dict] = [{}]
    for name, values in choices.items():
        combos = [{**c, name: v} for c in combos for v in values]
    return [(model + _label(c), model, c) for c in combos]


def _label(params: Params) -> str:
    return "(" + ",".join(f"{k}={v}" for k, v in params.items()) + ")" if params else ""


def _fit_fold(
    pdf: pd.DataFrame, keys: list[str], configs: list[tuple], custom: Mapping[str, FitPredict]
) -> pd.DataFrame:
    if "_chosen" in pdf:  # the series has configurations of its own
        configs = [(c["model"], c["base_model"], {e["key"]: e["value"] for e in c["params"]}) for c in pdf["_chosen"].iloc[0]]
    pdf = pdf.sort_values("idx")
    fitted = pdf["is_train"].to_numpy(bool)
    x, y = np.vstack(pdf["x"].to_numpy()), pdf["target"].to_numpy(float)
    X, Z = standardise(x[fitted], x[~fitted])
    test = pdf.loc[~fitted, [*keys, "fold", "idx", "target"]]
    out = []
    for label, model, params in configs:
        rows = test.assign(
            model=label, prediction=np.nan, prediction_sd=np.nan, error=None, base_model=model
        )
        try:
            run = custom.get(model) or partial(solver, model)
            made = run(X, y[fitted], Z, params)
            mean, sd = made if isinstance(made, tuple) else (made, None)
            rows["prediction"] = mean
            if sd is not None:
                rows["prediction_sd"] = sd
        except Exception as failure:  # one model must not stop the others
            rows["error"] = f"{type(failure).__name__}: {failure}"
        out.append(rows)
    made = pd.concat(out, ignore_index=True)
    names = ["model", "target", "prediction", "prediction_sd", "error", "base_model"]
    return made[[*keys, "fold", "idx", *names]]


def fit_predict(
    fold_rows: DataFrame,
    keys: Sequence[str],
    models: Sequence[str | tuple] = tuple(solvers.DEFAULTS),
    custom: Mapping[str, FitPredict] | None = None,
    chosen: DataFrame | None = None,
) -> DataFrame:
    """Predictions for the test rows of every fold and model.

    ``models`` holds names or ``(label, model, params)`` rows, e.g. from
    :func:`grid`. ``custom`` adds own models: ``f(X, y, Z, params)`` gets the
    scaled train rows, their targets and the scaled test rows. ``model`` is the
    label of a configuration, ``base_model`` the model it configures.

    ``chosen`` (keys, ``model``, ``base_model``, ``params``, as :func:`tune` makes it) gives each series
    configurations of its own in place of ``models``; series without any are left out.
    """
    ship_package(fold_rows.sparkSession)
    configs = solvers.configurations(models)
    keys = list(keys)
    columns = [*keys, "fold", "idx", "is_train", "target", "x"]
    rows = fold_rows.select(*columns)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(
        [
            *[f"{k} {types[k]}" for k in keys],
            f"fold {types['fold']}, idx {types['idx']}, model string, target double",
            "prediction double, prediction_sd double, error string, base_model string",
        ]
    )
    own = dict(custom or {})
    if chosen is not None:
        each = chosen.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("model", "base_model", F.map_entries("params").alias("params")))).alias("_chosen"))
        rows = lookup(rows, each, keys, cell_bytes=256)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _fit_fold(pdf, keys, configs, own)

    made = rows.groupBy(*keys, "fold").applyInPandas(run, schema)
    return made.na.replace(float("nan"), None, ["prediction", "prediction_sd"])


def tune(
    fold_rows: DataFrame, keys: Sequence[str], models: Sequence[str | tuple], by: str = "mae"
) -> DataFrame:
    """The best configuration per series and model, by the mean error over the given folds.

    ``fold_rows`` holds the folds to choose on, e.g. :func:`early_folds`. Gives the keys, ``base_model``, the label
    ``model``, its ``params`` and the error ``tuned_error``; of equal ones, the first label.
    """
    configs = solvers.configurations(models)
    made = fit_predict(fold_rows, keys, configs).filter("error IS NULL")
    errors = evaluate(made, [*keys, "base_model", "model", "fold"])
    mean = errors.groupBy(*keys, "base_model", "model").agg(F.avg(by).alias("error"))
    best = mean.groupBy(*keys, "base_model").agg(F.min(F.struct("error", "model")).alias("best"))
    known = parameter_map(configs)
    return best.select(
        *keys, "base_model", F.col("best.model").alias("model"), F.try_element_at(known, F.col("best.model")).alias("params"),
        F.col("best.error").alias("tuned_error"),
    )


def parameter_map(configs: Sequence[tuple]) -> Column:
    """Parameters by label, as a map column."""
    pairs = []
    for label, _, params in configs:
        values = [F.lit(x) for k, v in params.items() for x in (k, float(v))]
        made = F.create_map(*values) if values else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
        pairs += [F.lit(label), made]
    return F.create_map(*pairs)


def early_folds(fold_rows: DataFrame, share: float, train: int, step: int) -> DataFrame:
    """Folds that end within the first ``share`` of a series' rows."""
    return fold_rows.filter(F.col("fold") * step + (train + step) <= F.col("rows") * share)


def later_folds(fold_rows: DataFrame, share: float, train: int, step: int) -> DataFrame:
    """Folds whose test rows all lie behind the first ``share``: none of them took part in a choice."""
    return fold_rows.filter(F.col("fold") * step + train >= F.col("rows") * share)
