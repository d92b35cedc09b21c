"""Combining the predictions of several models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalars import ratio
from tideline.operators.layout import Series, lay_out


def average(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Plain mean over the models of each predicted row."""
    return predictions.groupBy(*keys).agg(
        F.first("target").alias("target"), F.avg("prediction").alias("prediction")
    )


def weighted(
    predictions: DataFrame, fold_mae: DataFrame, series_keys: Sequence[str], trailing_folds: int
) -> DataFrame:
    """Mean weighted by one over the recent error of each model.

    The weight of a model in a fold is the inverse of its mean error over the
    ``trailing_folds`` folds before; folds without a past use equal weights.
    ``fold_mae`` has one row per series, model and fold. It is laid out like a
    series with the fold as its clock, so long histories are cut as well.
    """
    by = [*series_keys, "model"]
    series = Series(tuple(by), "fold", bucket=1024)
    layout = lay_out(fold_mae, series)
    past = layout.window().rowsBetween(-trailing_folds, -1)
    recent = F.coalesce(ratio(F.lit(1.0), F.avg("mae").over(past)), F.lit(1.0))
    rows = layout.spread(fold_mae.select(*by, "fold", "mae"), trailing_folds)
    weights = layout.own(rows.withColumn("_w", recent)).select(*by, "fold", "_w")
    rows = predictions.join(weights, [*by, "fold"])
    total = F.sum(F.col("_w") * F.col("prediction"))
    return rows.groupBy(*series_keys, "fold", "idx").agg(
        F.first("target").alias("target"), ratio(total, F.sum("_w")).alias("prediction")
    )
