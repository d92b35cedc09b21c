"""Daily series derived from the order, line-item and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _from_orders(spark: SparkSession, folder: str, key) -> DataFrame:
    return (
        table(spark, folder, "orders")
        .groupBy(key.alias("series_id"), F.col("o_orderdate").alias("time"))
        .agg(
            F.max("o_totalprice").alias("price"),
            F.count(F.lit(1)).cast("double").alias("cov1"),
            F.min("o_totalprice").alias("cov2"),
        )
    )


def daily_by_priority(spark: SparkSession, folder: str) -> DataFrame:
    return _from_orders(spark, folder, F.col("o_orderpriority"))


def daily_all(spark: SparkSession, folder: str) -> DataFrame:
    return _from_orders(spark, folder, F.lit("all"))


def by_supplier(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .groupBy(
            F.col("l_suppkey").cast("string").alias("series_id"), F.col("l_shipdate").alias("time")
        )
        .agg(
            F.max("l_extendedprice").alias("price"),
            F.max("l_quantity").alias("cov1"),
            F.count(F.lit(1)).cast("double").alias("cov2"),
        )
    )


def by_user(spark: SparkSession, folder: str) -> DataFrame:
    """One row per user and instant; the largest value of an instant counts."""
    return (
        table(spark, folder, "events")
        .groupBy(F.col("user_id").cast("string").alias("series_id"), F.col("ts").alias("time"))
        .agg(F.max("value").alias("price"))
    )
