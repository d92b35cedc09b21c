"""Tree ensembles through Spark ML: distributed over rows, not over series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame

# Default sizes and seeds of the two ensembles.
FOREST = {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 2, "seed": 42}
BOOSTED = {
    "maxIter": 100,
    "stepSize": 0.1,
    "maxDepth": 5,
    "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
    "seed": 42,
}
# Common names of the parameters and their names here.
ALIASES = {
    "n_estimators": "maxIter",
    "learning_rate": "stepSize",
    "max_depth": "maxDepth",
    "subsample": "subsamplingRate",
    "random_state": "seed",
}


def boosted_params(params: Mapping[str, object] | None = None) -> dict[str, object]:
    """Defaults overridden by the caller's values, under either name."""
    given = dict(params or {})
    if "colsample_bytree" in given:
        given["featureSubsetStrategy"] = str(given.pop("colsample_bytree"))
    return {**BOOSTED, **{ALIASES.get(k, k): v for k, v in given.items()}}


def with_vector(rows: DataFrame, column: str = "x") -> DataFrame:
    return rows.withColumn("features", array_to_vector(column))


def forest(**params: object) -> RandomForestRegressor:
    return RandomForestRegressor(labelCol="target", **{**FOREST, **params})


def boosted(params: Mapping[str, object] | None = None) -> GBTRegressor:
    return GBTRegressor(labelCol="target", **boosted_params(params))


def assemble(inputs: Sequence[str], estimator) -> Pipeline:
    """Estimator over named columns; the fitted model can be saved with its inputs."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(inputs), outputCol="features"), estimator])


def importances(model, names: Sequence[str]) -> list[tuple[str, float]]:
    """Share of each input in a fitted ensemble, largest first."""
    pairs = zip(names, model.featureImportances.toArray().tolist())
    return sorted(pairs, key=lambda pair: -pair[1])
