"""Fold averages, comparison with baselines, totals, winners."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.scalars import ratio
from tideline.operators.metrics import METRICS

# Mean absolute error to beat per model at lookback 21, 63, 126.
BASELINES = {
    "OLS": (0.025050, 0.020837, 0.018284),
    "Ridge": (0.024659, 0.020573, 0.018098),
    "Lasso": (0.024659, 0.020573, 0.018098),
    "ElasticNet": (0.024659, 0.020573, 0.018098),
    "GaussianProcess": (0.015234, 0.012678, 0.011134),
    "RandomForest": (0.007892, 0.007134, 0.006824),
    "ExtraTrees": (0.008845, 0.007967, 0.007612),
    "HuberRegressor": (0.024000, 0.020000, 0.017500),
    "QuantileRegressor": (0.023000, 0.019500, 0.017000),
    "RobustElasticNet": (0.022000, 0.018500, 0.016000),
    "RobustLasso": (0.021500, 0.018000, 0.015500),
    "BayesianRidge": (0.024000, 0.020000, 0.017500),
}
BASELINE_LOOKBACKS = (21, 63, 126)

# Results that are averages over folds, and what they are without a value.
AVERAGED = {
    "directional_accuracy": 0.0,
    "information_coefficient": 0.0,
    "huber_loss": float("inf"),
    "median_ae": float("inf"),
    "q90_ae": float("inf"),
    "prediction_std": 0.0,
    "prediction_uncertainty": 0.0,
}


def baseline_table(
    spark: SparkSession, baselines: Mapping[str, Sequence[float]] = BASELINES
) -> DataFrame:
    rows = [
        (model, lookback, float(value))
        for model, values in baselines.items()
        for lookback, value in zip(BASELINE_LOOKBACKS, values)
    ]
    return spark.createDataFrame(rows, "model string, lookback int, baseline_mae double")


def average_folds(fold_metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population deviation of every metric over the folds of a model."""
    names = [m for m in (*METRICS, "prediction_std", "prediction_uncertainty")]
    present = [m for m in names if m in fold_metrics.columns]
    return fold_metrics.groupBy(*keys).agg(
        F.count("mae").cast("int").alias("n_folds"),
        *[F.avg(m).alias(f"avg_{m}") for m in present],
        *[F.stddev_pop(m).alias(f"std_{m}") for m in present],
    )


def compare(averages: DataFrame, baselines: DataFrame) -> DataFrame:
    """Add the baseline and whether it is beaten.

    A configuration has the baseline of its ``base_model`` (of ``model`` without that
    column). Rows without a baseline stay, with ``has_baseline`` false. The baseline
    table has one row per model and lookback, a fixed small number.
    """
    of = "base_model" if "base_model" in averages.columns else "model"
    known = F.broadcast(baselines.select(F.col("model").alias(of), "lookback", "baseline_mae"))
    joined = averages.join(known, [of, "lookback"], "left")
    joined = joined.withColumn("has_baseline", F.col("baseline_mae").isNotNull())
    base, mae = F.col("baseline_mae"), F.col("avg_mae")
    gain = F.when(base > 0, ratio(base - mae, base) * 100).otherwise(0.0)
    filled = {
        f"avg_{m}": F.coalesce(
            F.col(f"avg_{m}") if f"avg_{m}" in averages.columns else F.lit(None).cast("double"),
            F.lit(default),
        )
        for m, default in AVERAGED.items()
    }
    return joined.withColumns({**filled, "beats_baseline": F.coalesce(mae < base, F.lit(False)), "improvement": gain})


def totals(results: DataFrame, by: Sequence[str] = ("lookback",)) -> DataFrame:
    """Models with a baseline and winners per lookback, and over everything (NULL lookback)."""
    wins = F.count_if("beats_baseline")
    return results.filter("has_baseline").rollup(*by).agg(
        F.count(F.lit(1)).alias("total_models"),
        wins.alias("beating_baseline"),
        F.coalesce(ratio(wins.cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0)).alias(
            "success_rate"
        ),
    )


def winners(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    return results.filter("beats_baseline").select(*keys).distinct()


def keep_winners(df: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the models that beat their baseline."""
    return df.join(winners(results, keys), list(keys), "left_semi")


def comparison_matrix(results: DataFrame, keys: Sequence[str], lookbacks: Sequence[int]) -> DataFrame:
    """Average error per model (rows) and lookback (columns ``mae_<lookback>``)."""
    return results.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("lookback") == n, F.col("avg_mae"))).alias(f"mae_{n}")
            for n in lookbacks
        ]
    )


def error_histogram(
    predictions: DataFrame, keys: Sequence[str], low: float, high: float, bins: int
) -> DataFrame:
    """Counts of prediction errors per bin; the outer bins take what lies outside."""
    error = F.col("target") - F.col("prediction")
    bin_of = F.width_bucket(error, F.lit(low), F.lit(high), F.lit(bins)).cast("int")
    return predictions.groupBy(*keys, bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("errors"))
