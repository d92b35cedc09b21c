"""Writing feature sets and fitted models."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.plans.features import FeatureSet, FeatureSets


def write_feature_sets(sets: FeatureSets | Iterable[FeatureSet], path: str, mode: str = "append") -> None:
    """One Parquet table, a folder per lookback: ``x`` and ``target`` per row.

    A reader that filters on ``lookback`` opens that folder only. With ``mode="replace"`` the lookbacks that are written
    take the place of stored ones, and the others stay.
    """
    several = [sets.rows] if isinstance(sets, FeatureSets) else [s.rows.withColumn("lookback", F.lit(s.lookback)) for s in sets]
    for rows in several:
        out = rows.write.partitionBy("lookback")
        if mode == "replace":
            out = out.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        else:
            out = out.mode(mode)
        out.parquet(path)


def read_feature_rows(spark: SparkSession, path: str, lookbacks: Iterable[int] | None = None) -> DataFrame:
    """Stored feature rows; with ``lookbacks`` only their folders are opened."""
    rows = spark.read.parquet(path)
    return rows if lookbacks is None else rows.filter(F.col("lookback").isin(list(lookbacks)))


def write_table(df: DataFrame, path: str, by: Iterable[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
