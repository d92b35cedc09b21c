"""Sliding input sequences and min-max scaling of one value column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalars import ratio
from tideline.operators.layout import Series, lay_out
from tideline.operators.lookup import lookup


def create_sequences(
    df: DataFrame, value: str, length: int, series: Series = Series()
) -> DataFrame:
    """Per row: the ``length`` values before it as ``sequence``, its own as ``y``.

    Rows without a full history (or with a gap in it) have no sequence.
    """
    layout = lay_out(df, series)
    w = layout.window().rowsBetween(-length, -1)
    rows = layout.spread(df, length).withColumn("sequence", F.collect_list(value).over(w))
    rows = layout.own(rows.withColumn("y", F.col(value)))
    return rows.filter((F.size("sequence") == length) & F.col("y").isNotNull())


def fit_min_max(train: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    return train.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def _width():
    span = F.col("high") - F.col("low")
    return F.when(span == 0, F.lit(1.0)).otherwise(span)


def min_max(df: DataFrame, limits: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Scale to [0, 1] by the limits of the train rows; one limit row per series."""
    scaled = ratio(F.col(value) - F.col("low"), _width())
    return lookup(df, limits, keys).withColumn(f"{value}_scaled", scaled).drop("low", "high")


def inverse_min_max(df: DataFrame, limits: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    restored = F.col(value) * _width() + F.col("low")
    return lookup(df, limits, keys).withColumn(f"{value}_restored", restored).drop("low", "high")


def test_sequences(
    train: DataFrame, test: DataFrame, value: str, length: int, series: Series = Series()
) -> DataFrame:
    """Sequences of the test rows; the first ones reach back into the train rows.

    ``test`` follows ``train`` in time. Windows find the last train rows of each
    series, so nothing is ranked or cut off beforehand.
    """
    both = train.withColumn("_test", F.lit(False)).unionByName(test.withColumn("_test", F.lit(True)))
    return create_sequences(both, value, length, series).filter("_test").drop("_test")


test_sequences.__test__ = False  # not a pytest function
