"""Error measures of predictions, as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalars import ratio
from tideline.operators.quantiles import exact_quantiles

# Switch point of the Huber loss, levels of the pinball losses.
HUBER_DELTA = 1.35
PINBALL_LEVELS = {"quantile_loss_10": 0.1, "quantile_loss_90": 0.9}
UNCERTAINTY_GUARD = 1e-8

METRICS = (
    "mae",
    "mse",
    "rmse",
    "median_ae",
    "q90_ae",
    "huber_loss",
    "quantile_loss_10",
    "quantile_loss_90",
    "directional_accuracy",
    "information_coefficient",
)


def _means(y: Column, p: Column) -> dict[str, Column]:
    e = y - p
    a, d = F.abs(e), F.lit(HUBER_DELTA)
    huber = F.when(a <= d, a * a * 0.5).otherwise(d * a - d * d * 0.5)
    same_sign = (F.signum(y) == F.signum(p)).cast("double")
    spread = F.stddev_pop(y) * F.stddev_pop(p)
    return {
        "mae": F.avg(a),
        "mse": F.avg(e * e),
        "rmse": F.sqrt(F.avg(e * e)),
        "huber_loss": F.avg(huber),
        **{
            name: F.avg(F.greatest(e * q, e * (q - 1.0))) for name, q in PINBALL_LEVELS.items()
        },
        "directional_accuracy": F.when(F.count(e) > 1, F.avg(same_sign)).otherwise(0.0),
        "information_coefficient": F.coalesce(ratio(F.covar_pop(y, p), spread), F.lit(0.0)),
        "mape": F.avg(F.abs(ratio(e, y))),
    }


def evaluate(
    df: DataFrame,
    keys: Sequence[str],
    actual: str = "target",
    predicted: str = "prediction",
    bounded: bool = True,
) -> DataFrame:
    """All metrics per group, and the mean predictive deviation if there is one.

    ``bounded`` says that a group fits a task, as the test block of a fold does.
    Otherwise the two quantiles are found by selection instead of by holding the
    errors of a group in memory.
    """
    y, p = F.col(actual), F.col(predicted)
    error = F.abs(y - p)
    measures = _means(y, p)
    if "prediction_sd" in df.columns:
        sd = F.col("prediction_sd")
        measures["prediction_std"] = F.avg(sd)
        measures["prediction_uncertainty"] = F.avg(sd / (F.abs(p) + UNCERTAINTY_GUARD))
    if bounded:
        measures["median_ae"] = F.median(error)
        measures["q90_ae"] = F.percentile(error, 0.9)
    out = df.groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()])
    if bounded:
        return out
    errors = df.select(*keys, error.alias("_error"))
    tails = exact_quantiles(errors, keys, "_error", {"median_ae": 0.5, "q90_ae": 0.9})
    return out.join(tails, list(keys), "left")


def rmse_and_mae(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row; NULL on an empty table."""
    e = F.col(actual) - F.col(predicted)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
