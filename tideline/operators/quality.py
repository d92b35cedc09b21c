"""Quality report of a table, and checks of single rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.layout import Series, lay_out
from tideline.operators.lookup import lookup
from tideline.operators.quantiles import exact_quantiles

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def table_summary(df: DataFrame, time: str = "time") -> DataFrame:
    """Rows, columns and time range of the table: one row."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.lit(len(df.columns)).alias("total_columns"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
    )


def column_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column: nulls, count, mean, deviation, range, quartiles."""
    columns = list(columns or numeric_columns(df))
    pairs = ", ".join(f"struct('{c}' AS column, CAST(`{c}` AS DOUBLE) AS v)" for c in columns)
    cells = df.select(F.expr(f"inline(array({pairs}))"))
    basic = [
        F.count_if(F.col("v").isNull()).alias("nulls"),
        F.count("v").alias("count"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    ]
    return exact_quantiles(cells, ["column"], "v", QUARTILES, also=basic)


def time_gaps(df: DataFrame, max_days: int, series: Series = Series()) -> DataFrame:
    """Rows that follow their predecessor by more than ``max_days`` days."""
    layout = lay_out(df, series)
    rows = layout.spread(df.select(*series.keys, series.time), 1)
    before = F.lag(series.time, 1).over(layout.window())
    rows = layout.own(rows.withColumn("previous_time", before))
    days = F.datediff(F.to_date(series.time), F.to_date("previous_time"))
    return rows.withColumn("gap_days", days).filter(F.col("gap_days") > max_days)


def range_violations(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Values outside their allowed range, counted per column."""
    flags = [
        F.count_if(~F.col(c).between(low, high)).alias(f"{c}_out_of_range")
        for c, (low, high) in bounds.items()
    ]
    return df.agg(*flags)


def outliers(
    df: DataFrame, value: str, keys: Sequence[str] = ("series_id",), reach: float = 1.5
) -> DataFrame:
    """Flag rows outside ``reach`` interquartile ranges, and give their z score.

    The per-series limits join back on the key without gathering a series that
    holds much of the data in one task.
    """
    keys = list(keys)
    spread = [F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std")]
    limits = exact_quantiles(df, keys, value, {"_q25": 0.25, "_q75": 0.75}, also=spread)
    rows = lookup(df, limits, keys)
    width = F.col("_q75") - F.col("_q25")
    low, high = F.col("_q25") - width * reach, F.col("_q75") + width * reach
    return rows.withColumns(
        {
            "z_score": F.try_divide(F.col(value) - F.col("_mean"), "_std"),
            "is_outlier": (F.col(value) < low) | (F.col(value) > high),
        }
    ).drop("_q25", "_q75", "_mean", "_std")


def duplicate_times(df: DataFrame, keys: Sequence[str] = ("series_id",), time: str = "time") -> DataFrame:
    """Times that a series has more than once, and how many rows they have."""
    return df.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
