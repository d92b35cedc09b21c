"""From a path to a summary, in a folder that a broken run is resumed from."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tideline.models import grouped
from tideline.models.history import predict_history
from tideline.operators import report
from tideline.operators.folds import TRAIN_ROWS
from tideline.operators.layout import Series
from tideline.plans import backtest
from tideline.plans.features import LOOKBACKS, FeatureSets, feature_sets
from tideline.sources.readers import load_data


@dataclass(frozen=True)
class Run:
    """The stored tables of a run; ``models`` is None if nothing beat its baseline."""

    folder: str
    rows: DataFrame
    predictions: DataFrame
    results: DataFrame
    totals: DataFrame
    models: DataFrame | None


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def kept(spark: SparkSession, path: str, make, by: Sequence[str] = ()) -> DataFrame:
    """The table at ``path``; made and written first unless an earlier run finished it."""
    if not _there(spark, path):
        make().write.mode("overwrite").partitionBy(*by).parquet(path)
    return spark.read.parquet(path)


def run_path(
    spark: SparkSession,
    path: str,
    target_col: str,
    folder: str,
    lookbacks: Sequence[int] = LOOKBACKS,
    models: Sequence[str | tuple] = tuple(grouped.solvers.DEFAULTS),
    baselines: Mapping[str, Sequence[float]] = report.BASELINES,
    series: Series = Series(),
    train: int = TRAIN_ROWS,
    target_type: str = "return",
    horizon: int = 1,
    fill: str | None = None,
    tune_share: float | None = None,
    **reading,
) -> Run:
    """Read a CSV or Parquet file, make the features, walk forward, compare, and keep the winners.

    Every table is written to ``folder``: ``rows`` and ``predictions`` by lookback, ``results``, ``totals`` and
    ``models``. A second call goes on behind the last table that was finished. ``settings`` says what a folder was made
    with, and a call with others is refused. ``reading`` goes to :func:`load_data`; by default the
    target column is the only one required, and nothing is renamed.
    """
    options = {"renames": {}, "required": [target_col], "keys": list(series.keys)} | reading
    configs = grouped.solvers.configurations(models)
    settings = json.dumps(
        [path, target_col, list(lookbacks), configs, {k: list(v) for k, v in baselines.items()}, list(series.keys), series.time,
         train, target_type, horizon, fill, tune_share, {k: str(v) for k, v in sorted(options.items())}]
    )
    df = None

    def source() -> DataFrame:
        nonlocal df
        df = df if df is not None else load_data(spark, path, **options)
        return df

    if not _there(spark, f"{folder}/settings"):
        source()  # a missing file or column shows before anything is written
    stored = kept(spark, f"{folder}/settings", lambda: spark.createDataFrame([(settings,)], "settings string")).first()[0]
    if stored != settings:
        raise ValueError(f"{folder} holds a run with other settings: {stored}")
    keys = [*series.keys, "lookback"]

    def sets() -> FeatureSets:
        return feature_sets(source(), target_col, lookbacks, series, None, target_type, horizon, fill)

    named = kept(spark, f"{folder}/names", lambda: spark.createDataFrame(list(sets().names.items()), "lookback int, names array<string>"))
    names = {r["lookback"]: tuple(r["names"]) for r in named.collect()}
    rows = kept(spark, f"{folder}/rows", lambda: sets().rows, ["lookback"])
    made = kept(spark, f"{folder}/predictions", lambda: backtest.predictions(rows, keys, models, None, train, tune_share), ["lookback"])
    run = backtest.summarise(rows, names, made, models, baselines, keys)
    results = kept(spark, f"{folder}/results", lambda: run.results)
    totals = kept(spark, f"{folder}/totals", lambda: report.totals(results))
    final = backtest.Evaluation(rows, names, made, run.fold_metrics, results, totals, run.configs)
    if results.filter("beats_baseline").isEmpty():
        return Run(folder, rows, made, results, totals, None)
    fitted = kept(spark, f"{folder}/models", lambda: backtest.final_models(final, keys), ["lookback"])
    return Run(folder, rows, made, results, totals, fitted)


def apply_models(spark: SparkSession, folder: str, rows: DataFrame, keys: Sequence[str] = ("series_id", "lookback")) -> DataFrame:
    """Predictions of a run's kept models for feature rows (keys, ``idx``, ``x``, ``target``)."""
    return predict_history(rows, spark.read.parquet(f"{folder}/models"), keys)
