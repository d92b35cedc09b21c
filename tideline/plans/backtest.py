"""Walk-forward evaluation of feature sets, from rows to the report."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.models import closed_form, grouped, history
from tideline.operators import report
from tideline.operators.folds import TRAIN_ROWS, folds, test_rows
from tideline.operators.layout import Series, lay_out, number_valid
from tideline.operators.metrics import evaluate
from tideline.operators.parts import attach
from tideline.operators.storage import materialize
from tideline.operators.target import target
from tideline.plans.features import LOOKBACKS, feature_sets


logger = logging.getLogger(__name__)

#: Rows of a table of keys that may be broadcast.
FEW = 500_000


@dataclass(frozen=True)
class Evaluation:
    """The tables of a run; all but ``rows`` and ``predictions`` are lazy."""

    rows: DataFrame  # keys, lookback, idx, x, target
    names: dict[int, tuple[str, ...]]  # inputs per lookback, in the order of x
    predictions: DataFrame
    fold_metrics: DataFrame
    results: DataFrame
    totals: DataFrame
    configs: tuple[tuple, ...] = ()  # label, model and parameters of what was evaluated


def evaluate_models(
    df: DataFrame,
    target_col: str,
    lookbacks: Sequence[int] = LOOKBACKS,
    models: Sequence[str | tuple] = tuple(grouped.solvers.DEFAULTS),
    custom: Mapping[str, grouped.FitPredict] | None = None,
    baselines: Mapping[str, Sequence[float]] = report.BASELINES,
    series: Series = Series(),
    train: int = TRAIN_ROWS,
    target_type: str = "return",
    horizon: int = 1,
    fill: str | None = None,
    tune_share: float | None = None,
) -> Evaluation:
    """Features, folds, fits, metrics and comparison for all series at once.

    The feature rows of all lookbacks are made in one pass and written once to the checkpoint folder: folds, final
    fits and repeated reports read them from there instead of recomputing. With ``tune_share`` the folds in that first
    share of a series choose one configuration per series and model among ``models``; only the folds behind it are
    evaluated, with the chosen ones.
    """
    sets = feature_sets(df, target_col, lookbacks, series, None, target_type, horizon, fill).stored()
    keys = [*series.keys, "lookback"]
    made = materialize(predictions(sets.rows, keys, models, custom, train, tune_share))
    return summarise(sets.rows, sets.names, made, models, baselines, keys)


def predictions(
    rows: DataFrame, keys: Sequence[str], models: Sequence[str | tuple], custom: Mapping[str, grouped.FitPredict] | None = None,
    train: int = TRAIN_ROWS, tune_share: float | None = None,
) -> DataFrame:
    """Predictions of all folds, or with ``tune_share`` of the later folds by the configurations chosen on the early ones."""
    every, step = folds(rows, train), test_rows(train)
    if tune_share is None:
        return grouped.fit_predict(every, keys, models, custom)
    chosen = materialize(grouped.tune(grouped.early_folds(every, tune_share, train, step), keys, models))
    return grouped.fit_predict(grouped.later_folds(every, tune_share, train, step), keys, models, custom, chosen)


def summarise(
    rows: DataFrame, names: Mapping[int, Sequence[str]], made: DataFrame, models: Sequence[str | tuple],
    baselines: Mapping[str, Sequence[float]], keys: Sequence[str],
) -> Evaluation:
    """Fold metrics, averages against the baselines, and totals of written predictions."""
    fold_metrics = evaluate(made.filter("error IS NULL"), [*keys, "model", "base_model", "fold"])
    averages = report.average_folds(fold_metrics, [*keys, "model", "base_model"])
    results = report.compare(averages, report.baseline_table(made.sparkSession, baselines))
    configs = tuple(grouped.solvers.configurations(models))
    return Evaluation(rows, dict(names), made, fold_metrics, results, report.totals(results), configs)


def final_models(evaluation: Evaluation, keys: Sequence[str] = ("series_id", "lookback")) -> DataFrame | None:
    """The winners, fitted on their whole history with a scaler from all rows and the parameters they won with.

    A row holds all that is needed to apply a model later: label, ``base_model``, ``params``, the ``names`` of its inputs,
    scaler, coefficients, and its ``scores`` in the walk-forward. Own models are callbacks without coefficients:
    they are named in the log instead.
    """
    won = materialize(report.winners(evaluation.results, [*keys, "model"]))
    names = {r[0] for r in won.select("model").distinct().collect()}
    configs = [c for c in evaluation.configs if c[0] in names and c[1] in grouped.solvers.DEFAULTS]
    if names - {c[0] for c in configs}:
        logger.warning("no final fit for own models: %s", sorted(names - {c[0] for c in configs}))
    if not configs:
        return None
    rows = evaluation.rows.join(F.broadcast(won.select(*keys).distinct()) if won.count() <= FEW else won.select(*keys).distinct(), list(keys), "left_semi")
    fitted = history.fit_history(rows, keys, configs).join(won, [*keys, "model"], "left_semi")
    inputs = F.create_map(*[v for n, made in evaluation.names.items() for v in (F.lit(n), F.array(*[F.lit(c) for c in made]))])
    full = [(label, model, {**grouped.solvers.DEFAULTS[model], **params}) for label, model, params in configs]
    base = F.create_map(*[F.lit(v) for label, model, _ in full for v in (label, model)])
    measured = ["n_folds", "avg_mae", "std_mae", "avg_rmse", "avg_directional_accuracy", "baseline_mae", "improvement"]
    scores = evaluation.results.select(*keys, "model", F.struct(*measured).alias("scores"))
    told = fitted.withColumns(
        {
            "base_model": F.try_element_at(base, F.col("model")),
            "params": F.try_element_at(grouped.parameter_map(full), F.col("model")),
            "names": F.try_element_at(inputs, F.col("lookback")),
        }
    )
    return told.join(scores, [*keys, "model"])


def one_input_folds(
    df: DataFrame,
    price: str,
    series: Series = Series(),
    train: int = TRAIN_ROWS,
    target_type: str = "log_return",
) -> DataFrame:
    """Fold rows with the last return as the only input ``x`` of the next return."""
    return folds(one_input_rows(df, price, series, target_type), train)


def one_input_rows(df: DataFrame, price: str, series: Series = Series(), target_type: str = "log_return") -> DataFrame:
    """Numbered complete rows: ``x``, the last return, and ``target``, the next."""
    layout = lay_out(df, series)
    w = layout.window()
    rows = layout.spread(df.select(*series.keys, series.time, price), 2, 1)
    rows = attach(rows, [target(price, w, target_type)])
    rows = rows.withColumn("x", F.ln(F.try_divide(F.col(price), F.lag(price, 1).over(w))))
    complete = F.col("x").isNotNull() & F.col("target").isNotNull()
    return number_valid(rows, layout, complete)


def closed_form_predictions(
    df: DataFrame, price: str, series: Series = Series(), alpha: float = 0.05
) -> DataFrame:
    return closed_form.predict(one_input_folds(df, price, series), series.keys, "x", alpha=alpha)


def one_step_forecasts(
    df: DataFrame, price: str, window: int = TRAIN_ROWS, series: Series = Series()
) -> DataFrame:
    """For every row: a line through the last ``window`` rows, applied to this row.

    Regresses the return on the return before it. Both sums and the line are
    trailing windows, so each row is a fold of its own without any copy.
    """
    layout = lay_out(df, series)
    w = layout.window()
    past = w.rowsBetween(-window, -1)
    rows = layout.spread(df.select(*series.keys, series.time, price), window + 3)
    growth = F.ln(F.try_divide(F.col(price), F.lag(price, 1).over(w)))
    rows = rows.withColumn("target", growth).withColumn("x", F.lag("target", 1).over(w))
    known = F.col("x").isNotNull() & F.col("target").isNotNull()
    x, y = F.when(known, F.col("x")), F.when(known, F.col("target"))
    rows = rows.withColumns(
        {
            "_n": F.count(x).over(past),
            "_mx": F.avg(x).over(past),
            "_my": F.avg(y).over(past),
            "_xy": F.covar_pop(x, y).over(past),
            "_xx": F.var_pop(x).over(past),
        }
    )
    slope = F.coalesce(F.try_divide("_xy", "_xx"), F.lit(0.0))
    rows = rows.withColumn("prediction", F.col("_my") + slope * (F.col("x") - F.col("_mx")))
    rows = layout.own(rows).filter(known & (F.col("_n") == window))
    return rows.select(*series.keys, series.time, "target", "prediction")
