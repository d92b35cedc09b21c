"""Times the headline work at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tideline.operators.metrics import evaluate  # noqa: E402
from tideline.plans import backtest as bt  # noqa: E402
from tideline.plans import features as ft  # noqa: E402
from tideline.plans.queries import QUERIES  # noqa: E402
from tideline.sources.tables import by_supplier, daily_by_priority  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def supplier_rolling(spark, sf):
    return ft.create_rolling_statistics(by_supplier(spark, sf), ["price", "cov1"], ft.WINDOWS)


def supplier_technical(spark, sf):
    return ft.create_technical_indicators(by_supplier(spark, sf), "price", ft.WINDOWS)


def supplier_returns(spark, sf):
    return ft.create_returns_and_volatility(by_supplier(spark, sf), "price", ft.WINDOWS)


def supplier_interactions(spark, sf):
    return ft.create_interaction_features(by_supplier(spark, sf), "price", ["cov1", "cov2"])


def supplier_features_63(spark, sf):
    return ft.feature_set(by_supplier(spark, sf), "price", 63).rows


def priority_features_21(spark, sf):
    return ft.feature_set(daily_by_priority(spark, sf), "price", 21).rows


def supplier_fold_metrics(spark, sf):
    made = bt.closed_form_predictions(by_supplier(spark, sf), "price")
    return evaluate(made, ["series_id", "model", "fold"])


HEADLINE = [
    supplier_rolling,
    supplier_technical,
    supplier_returns,
    supplier_interactions,
    supplier_features_63,
    priority_features_21,
    supplier_fold_metrics,
]
REGISTERED = [
    "lags",
    "calendar",
    "targets",
    "exponential_average",
    "fold_metrics",
    "model_results",
    "one_step_forecasts",
    "ensemble_weighted",
    "autoregression_forecast",
    "value_sequences",
    "column_statistics",
    "solver_predictions",
]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    work = {f.__name__: f for f in HEADLINE} | {n: QUERIES[n] for n in REGISTERED}
    only = sys.argv[1:]
    run(QUERIES["lags"](spark, SF_DIR))  # start the JVM's compiler and the Python side
    seconds = {}
    for name, f in work.items():
        if only and name not in only:
            continue
        start = time.perf_counter()
        run(f(spark, SF_DIR))
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of features, folds and metrics",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(SF_DIR).name,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
