"""Models with one input (or none) as fold aggregates: no Python, no solver.

On one standardised input x (mean 0, variance 1 over the train rows) with
c = cov(x, y), the penalised least-squares slopes are

    OLS          c
    Ridge        n c / (n + alpha)
    Lasso        soft(c, alpha)
    ElasticNet   soft(c, alpha l1) / (1 + alpha (1 - l1))

and the intercept is the train mean of y. The quantile model with its default
penalty has slope 0: the pinball subgradient never exceeds the penalty on a
standardised input, so its prediction is the train quantile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.folds import in_train, scale

MODELS = ("Mean", "OLS", "Ridge", "Lasso", "ElasticNet", "QuantileRegressor")


def soft(c: str, cut: float) -> str:
    return f"signum({c}) * greatest(abs({c}) - {cut!r}D, 0D)"


def predict(
    fold_rows: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str = "target",
    alpha: float = 1.0,
    l1_ratio: float = 0.5,
    quantile: float = 0.5,
) -> DataFrame:
    """Predictions of all closed-form models for the test rows of every fold."""
    w = Window.partitionBy(*keys, "fold")
    xs = f"{x}_scaled"
    rows = scale(fold_rows, [x], keys).withColumns(
        {
            "_n": F.count(in_train(F.col(y))).over(w).cast("double"),
            "_mean": F.avg(in_train(F.col(y))).over(w),
            "_cov": F.covar_pop(in_train(F.col(xs)), in_train(F.col(y))).over(w),
            "_quantile": F.percentile(in_train(F.col(y)), quantile).over(w),
        }
    )
    shrink = f"(1D + {alpha * (1 - l1_ratio)!r}D)"
    line = {
        "Mean": "_mean",
        "OLS": f"_mean + _cov * `{xs}`",
        "Ridge": f"_mean + _n * _cov / (_n + {float(alpha)!r}D) * `{xs}`",
        "Lasso": f"_mean + {soft('_cov', float(alpha))} * `{xs}`",
        "ElasticNet": f"_mean + {soft('_cov', alpha * l1_ratio)} / {shrink} * `{xs}`",
        "QuantileRegressor": "_quantile",
    }
    each = ", ".join(f"struct('{m}' AS model, {e} AS prediction)" for m, e in line.items())
    return (
        rows.filter(~F.col("is_train"))
        .withColumn("_p", F.explode(F.expr(f"array({each})")))
        .select(*keys, "fold", "idx", "_p.model", F.col(y).alias("target"), "_p.prediction")
    )
