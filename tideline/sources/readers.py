"""Reading and checking one table of series."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.scalars import nan_to_null

logger = logging.getLogger(__name__)

# Column renamed on load, and the dates a table should cover.
RENAMES = {"gold": "Gold_Price_USD"}
REQUIRED = ("Gold_Price_USD",)
FIRST_DAY, LAST_DAY = "1987-01-01", "2025-05-28"


def _is_parquet(spark: SparkSession, path: str) -> bool:
    """By the name, and for a folder without a telling name by the files in it."""
    name = path.rstrip("/").lower()
    if name.endswith((".parquet", ".pq")):
        return True
    if name.endswith((".csv", ".csv.gz", ".txt")):
        return False
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return not files.select("path").isEmpty()


def _numbers(df: DataFrame, columns: Sequence[str], lost: str) -> DataFrame:
    """Text columns as doubles. Cells that hold text and no number are counted first."""
    made = {c: F.expr(f"try_cast(trim(`{c}`) AS DOUBLE)") for c in columns}
    if columns:
        bad = [F.count_if((F.trim(c) != "") & value.isNull()).alias(c) for c, value in made.items()]
        found = {c: n for c, n in df.agg(*bad).first().asDict().items() if n}
        if found and lost == "raise":
            raise ValueError(f"text in columns read as numbers (cells): {found}; name them in keys")
        for c, n in found.items():
            logger.warning("column %s: %d cells hold text and become NULL", c, n)
    return df.withColumns(made)


def read_table(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType | None = None,
    time: str = "time",
    keys: Sequence[str] = (),
    lost: str = "raise",
) -> DataFrame:
    """CSV (header) or Parquet, time parsed, NaN turned into NULL.

    Without a schema the ``keys`` of a CSV (columns that name the series, or other
    text) stay strings and all columns but the time become doubles. One pass counts
    cells that hold text instead of a number; they raise, or with
    ``lost="report"`` are logged. A missing path raises.
    """
    if _is_parquet(spark, path):
        df = spark.read.parquet(path)
    elif schema is not None:
        df = spark.read.schema(schema).option("header", True).csv(path)
    else:
        header = spark.read.option("header", True).csv(path).columns
        kinds = [T.StructField(c, T.TimestampNTZType() if c == time else T.StringType()) for c in header]
        df = spark.read.schema(T.StructType(kinds)).option("header", True).csv(path)
        df = _numbers(df, [c for c in header if c != time and c not in keys], lost)
    if time in df.columns and isinstance(df.schema[time].dataType, T.StringType):
        df = df.withColumn(time, F.to_timestamp_ntz(time))
    doubles = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(c) for c in doubles})


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def require_time(df: DataFrame, time: str = "time") -> None:
    kind = df.schema[time].dataType
    if not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        raise TypeError(f"column {time!r} must be a date or timestamp, not {kind.simpleString()}")


def coverage(
    df: DataFrame,
    keys: Sequence[str] = (),
    time: str = "time",
    first: str = FIRST_DAY,
    last: str = LAST_DAY,
) -> DataFrame:
    """First and last time, and whether they cover the expected range."""
    return df.groupBy(*keys).agg(*_coverage(time, first, last))


def _coverage(time: str, first: str, last: str) -> list:
    start, end = F.min(time), F.max(time)
    covered = (start <= F.lit(first).cast("date")) & (end >= F.lit(last).cast("date"))
    return [start.alias("first_time"), end.alias("last_time"), covered.alias("in_range")]


def _nulls(columns: Sequence[str]) -> list:
    return [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns]


def null_counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*_nulls(columns))


def load_data(
    spark: SparkSession,
    path: str,
    renames: Mapping[str, str] = RENAMES,
    required: Sequence[str] = REQUIRED,
    time: str = "time",
    first: str = FIRST_DAY,
    last: str = LAST_DAY,
    keys: Sequence[str] = (),
    series_id: str | None = None,
    lost: str = "raise",
) -> DataFrame:
    """Read, rename, check. Gaps and a short date range are only reported.

    ``series_id`` names the one series of a file without a key column.
    """
    df = read_table(spark, path, time=time, keys=keys, lost=lost).withColumnsRenamed(dict(renames))
    if series_id is not None:
        df = df.withColumn("series_id", F.lit(series_id))
    require_columns(df, required)
    require_time(df, time)
    facts = df.agg(*_coverage(time, first, last), *_nulls(required)).first()
    if not facts["in_range"]:
        logger.warning("time range %s to %s is not as expected", facts[0], facts[1])
    for c in required:
        if facts[f"{c}_nulls"]:
            logger.warning("column %s has %d nulls", c, facts[f"{c}_nulls"])
    return df
