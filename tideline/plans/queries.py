"""The registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.models import autoregression, grouped, history, trees
from tideline.operators import ensemble, quality, report, sequences
from tideline.operators.folds import folds, scale
from tideline.operators.layout import Series, with_positions
from tideline.operators.lookup import lookup
from tideline.operators.metrics import evaluate, rmse_and_mae
from tideline.operators.storage import materialize, scratch_folder
from tideline.plans import backtest as bt
from tideline.plans import features as ft
from tideline.plans.run import apply_models, run_path
from tideline.sources import readers
from tideline.sources.sinks import read_feature_rows, write_feature_sets, write_table
from tideline.sources.tables import by_supplier, by_user, daily_all, daily_by_priority, table

# Small chunks, so that the queries named "cut_" split every series over tasks.
CUT = Series(chunk_rows=400)
ALPHA = 0.05
# Errors of this data are far above the daily-price baselines: some queries compare at this multiple.
BASELINE_SCALE = 40

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def day(column: str = "time"):
    return F.col(column).cast("date").cast("string").alias("day")


def shown(df: DataFrame, digits: dict[str, int], *others) -> DataFrame:
    """Key, day and the given columns, rounded."""
    values = [(F.round(c, d) + F.lit(0.0)).alias(c) for c, d in digits.items()]
    return df.select("series_id", day(), *others, *values)


def relative(pattern: str) -> list:
    """Averages as a share of the price: cents divided by a count often end in a 5."""
    return [F.round(F.col(c) / F.col("price"), 6).alias(c) for c in (pattern.format(n=n) for n in ft.WINDOWS)]


# Sources and checks ---------------------------------------------------------


@query
def table_summary(spark, sf):
    made = quality.table_summary(daily_by_priority(spark, sf))
    return made.select(
        "total_rows", "total_columns",
        F.col("first_time").cast("date").cast("string").alias("first_time"),
        F.col("last_time").cast("date").cast("string").alias("last_time"),
    )


@query
def column_statistics(spark, sf):
    made = quality.column_statistics(table(spark, sf, "lineitem"))
    rounded = [(F.round(c, 4) + 0.0).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")]
    return made.select("column", "nulls", "count", *rounded)


@query
def coverage(spark, sf):
    made = readers.coverage(daily_by_priority(spark, sf), ["series_id"], first="1995-02-01", last="1998-08-01")
    dates = [F.col(c).cast("date").cast("string").alias(c) for c in ("first_time", "last_time")]
    return made.select("series_id", *dates, "in_range")


@query
def null_counts(spark, sf):
    lagged = ft.create_lagged_features(daily_by_priority(spark, sf), ["price", "cov1"], [5])
    return readers.null_counts(lagged, ["price", "price_lag_5", "cov1_lag_5"], ["series_id"])


@query
def time_gaps(spark, sf):
    made = quality.time_gaps(daily_by_priority(spark, sf), 3)
    return made.select("series_id", day(), day("previous_time").alias("previous_day"), "gap_days")


@query
def range_violations(spark, sf):
    return quality.range_violations(table(spark, sf, "lineitem"), {"l_quantity": (2.0, 49.0), "l_discount": (0.0, 0.09)})


@query
def outliers(spark, sf):
    made = quality.outliers(by_supplier(spark, sf), "cov2", reach=1.0)
    return shown(made, {"cov2": 1, "z_score": 6}, "is_outlier")


# Features -------------------------------------------------------------------


@query
def lags(spark, sf):
    made = ft.create_lagged_features(daily_by_priority(spark, sf), ["price", "cov1"], ft.LAGS)
    return shown(made, {c: 2 for c in made.columns if "_lag_" in c})


@query
def documented_lags(spark, sf):
    made = ft.create_lagged_features(daily_by_priority(spark, sf), ["price"], [1, 2, 3, 5, 10, 20])
    return shown(made, {c: 2 for c in made.columns if "_lag_" in c})


def _rolling(spark, sf, digits: dict[str, int], source=daily_by_priority, windows=ft.WINDOWS, series=Series()):
    made = ft.create_rolling_statistics(source(spark, sf), ["price", "cov1"], windows, series)
    return shown(
        made,
        {f"{c}_rolling_{s}_{n}": d for c in ("price", "cov1") for s, d in digits.items() for n in windows},
    )


@query
def rolling_mean_std(spark, sf):
    made = ft.create_rolling_statistics(daily_by_priority(spark, sf), ["price", "cov1"], ft.WINDOWS)
    digits = {f"cov1_rolling_mean_{n}": 6 for n in ft.WINDOWS}
    digits |= {f"{c}_rolling_{s}_{n}": 2 for c in ("price", "cov1") for s in ("std", "volatility") for n in ft.WINDOWS}
    return shown(made, digits, *relative("price_rolling_mean_{n}"))


@query
def rolling_range(spark, sf):
    return _rolling(spark, sf, {"min": 2, "max": 2})


@query
def rolling_quantiles(spark, sf):
    return _rolling(spark, sf, {"median": 5, "iqr": 5})


@query
def rolling_moments(spark, sf):
    return _rolling(spark, sf, {"skew": 6, "kurt": 6})


@query
def rolling_documented_windows(spark, sf):
    return _rolling(spark, sf, {"median": 5, "max": 2}, windows=(5, 10, 20, 60))


@query
def rolling_supplier(spark, sf):
    return _rolling(spark, sf, {"median": 5, "min": 2}, source=by_supplier, windows=(5, 21))


@query
def cut_rolling(spark, sf):
    return _rolling(spark, sf, {"median": 5, "skew": 6}, source=daily_all, windows=(21, 63), series=CUT)


def _technical(spark, sf, digits: dict[str, int], windows=ft.WINDOWS, **options):
    made = ft.create_technical_indicators(daily_by_priority(spark, sf), "price", windows, **options)
    return shown(made, {f"price_{s}_{n}": d for s, d in digits.items() for n in windows if f"price_{s}_{n}" in made.columns})


@query
def moving_average_bands(spark, sf):
    made = ft.create_technical_indicators(daily_by_priority(spark, sf), "price", ft.WINDOWS)
    digits = {f"price_bb_{s}_{n}": 2 for s in ("upper", "lower", "width") for n in ft.WINDOWS}
    return shown(made, digits, *relative("price_sma_{n}"))


@query
def strength_index(spark, sf):
    return _technical(spark, sf, {"rsi": 6})


@query
def momentum_and_position(spark, sf):
    return _technical(spark, sf, {"momentum": 6, "position": 6})


@query
def exponential_average(spark, sf):
    return _technical(spark, sf, {"ema": 4})


@query
def cut_exponential_average(spark, sf):
    return _technical(spark, sf, {"ema": 4}, windows=(5, 21), series=CUT)


def _with_gaps(spark, sf):
    """The daily price without the days that saw a single order."""
    price = F.when(F.col("cov1") > 1, F.col("price"))
    return daily_by_priority(spark, sf).withColumn("price", price)


@query
def padded_momentum(spark, sf):
    made = ft.create_technical_indicators(_with_gaps(spark, sf), "price", [5, 21], fill="pad")
    return shown(made, {"price_momentum_5": 6, "price_momentum_21": 6})


@query
def cut_padded_momentum(spark, sf):
    made = ft.create_technical_indicators(_with_gaps(spark, sf), "price", [5, 21], CUT, "pad")
    return shown(made, {"price_momentum_5": 6, "price_momentum_21": 6})


@query
def exponential_average_with_gaps(spark, sf):
    made = ft.create_technical_indicators(_with_gaps(spark, sf), "price", [10], CUT)
    return shown(made, {"price_ema_10": 4})


@query
def returns(spark, sf):
    made = ft.create_returns_and_volatility(daily_by_priority(spark, sf), "price", [5])
    return shown(made, {"price_return": 6, "price_log_return": 6})


@query
def returns_by_user(spark, sf):
    made = ft.create_returns_and_volatility(by_user(spark, sf), "price", [5])
    return made.select(
        "series_id", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("at"),
        *[(F.round(c, 6) + 0.0).alias(c) for c in ("price_return", "price_log_return")],
    )


@query
def return_risk(spark, sf):
    made = ft.create_returns_and_volatility(daily_by_priority(spark, sf), "price", ft.WINDOWS)
    kinds = ("vol_cluster", "downside_risk", "upside_potential", "var_5", "cvar_5")
    return shown(made, {f"price_{k}_{n}": 6 for k in kinds for n in ft.WINDOWS})


@query
def drawdown(spark, sf):
    made = ft.create_returns_and_volatility(daily_by_priority(spark, sf), "price", ft.WINDOWS)
    return shown(made, {f"price_max_drawdown_{n}": 6 for n in ft.WINDOWS})


@query
def interactions(spark, sf):
    made = ft.create_interaction_features(daily_by_priority(spark, sf), "price", ["cov1", "cov2"])
    digits = {"x": 0, "ratio": 4, "diff": 2}
    return shown(made, {f"price_{k}_{c}": d for k, d in digits.items() for c in ("cov1", "cov2")})


@query
def rolling_correlation(spark, sf):
    made = ft.create_interaction_features(daily_by_priority(spark, sf), "price", ["cov1", "cov2"])
    return shown(made, {f"price_corr_{c}_{n}": 6 for c in ("cov1", "cov2") for n in (21, 63)})


@query
def change_interactions(spark, sf):
    """Day-over-day change times covariate."""
    changed = ft.create_returns_and_volatility(daily_by_priority(spark, sf), "price", [])
    made = ft.create_interaction_features(
        changed.select("series_id", "time", F.col("price_return").alias("change"), "cov1"), "change", ["cov1"]
    )
    return shown(made, {"change_x_cov1": 6, "change_ratio_cov1": 6, "change_diff_cov1": 6})


@query
def calendar(spark, sf):
    made = ft.create_calendar_features(daily_by_priority(spark, sf))
    new = [c for c in made.columns if c not in ("series_id", "time", "price", "cov1", "cov2")]
    circles = [c for c in new if c.endswith(("_sin", "_cos"))]
    parts = [F.col(c).alias("day_of_month" if c == "day" else c) for c in new if c not in circles]
    return shown(made, {c: 6 for c in circles}, *parts)


@query
def targets(spark, sf):
    df = daily_by_priority(spark, sf)
    made = df
    for kind in ("return", "log_return", "price"):
        made = ft.create_target_variable(made, "price", kind, 2).withColumnRenamed("target", f"target_{kind}")
    return shown(made, {"target_return": 6, "target_log_return": 6, "target_price": 2})


@query
def feature_rows(spark, sf):
    """Complete rows of the lookback 21 feature set: count, and sums of some inputs."""
    one = ft.feature_set(daily_by_priority(spark, sf), "price", 21)
    wide = one.wide()
    return wide.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("complete_rows"),
        F.min(F.col("time").cast("date").cast("string")).alias("first_day"),
        F.max(F.col("time").cast("date").cast("string")).alias("last_day"),
        F.round(F.avg("price_lag_21"), 2).alias("mean_lag_21"),
        F.round(F.avg("cov1_rolling_mean_10"), 6).alias("mean_cov1_10"),
        F.round(F.avg("price_rsi_21"), 6).alias("mean_rsi"),
        F.round(F.avg("price_corr_cov2_63"), 6).alias("mean_corr"),
        F.round(F.avg("target"), 6).alias("mean_target"),
    )


def _set_facts(rows: DataFrame, by: list[str], **inputs) -> DataFrame:
    """Complete rows, first and last day, and rounded averages of some inputs and the target."""
    at = F.col("time").cast("date").cast("string")
    means = [F.round(F.avg(c), d).alias(name) for name, (c, d) in inputs.items()]
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("complete_rows"), F.min(at).alias("first_day"), F.max(at).alias("last_day"),
        *means, F.round(F.avg("target"), 6).alias("mean_target"),
    )


@query
def feature_lookbacks(spark, sf):
    """The complete rows of all lookbacks, from one pass; inputs are taken by their place in the lookback's array."""
    sets = ft.feature_sets(daily_by_priority(spark, sf), "price", ft.LOOKBACKS)

    def taken(name: str):
        place = F.create_map(*[F.lit(v) for n, names in sets.names.items() for v in (n, names.index(name))])
        return F.get("x", F.try_element_at(place, F.col("lookback")))

    inputs = {"mean_lag_21": ("price_lag_21", 2), "mean_cov1_10": ("cov1_rolling_mean_10", 6), "mean_rsi": ("price_rsi_21", 6), "mean_corr": ("price_corr_cov2_63", 6)}
    made = _set_facts(sets.rows, ["series_id", "lookback"], **{k: (taken(c), d) for k, (c, d) in inputs.items()})
    sizes = F.create_map(*[F.lit(v) for n, names in sets.names.items() for v in (n, len(names))])
    return made.withColumn("inputs", F.try_element_at(sizes, F.col("lookback")))


@query
def feature_set_all_days(spark, sf):
    """A few inputs and the target per complete row of the lookback 63 set."""
    wide = ft.create_features(daily_all(spark, sf), "price", [63], target_type="log_return")[63]
    picks = {"price_lag_21": 2, "price_momentum_63": 6, "cov1_rolling_median_63": 5, "price_max_drawdown_63": 6}
    return shown(wide, {**picks, "price_corr_cov1_63": 6, "target": 6}, "quarter")


@query
def sufficient_series(spark, sf):
    """Which series keep at least two lookbacks of rows, per lookback."""
    rows = with_positions(by_supplier(spark, sf).select("series_id", "time"), Series())
    counts = rows.groupBy("series_id").agg(F.max("rows").alias("rows"))
    lookbacks = F.explode(F.array(*[F.lit(n) for n in (21, 63, 126, 252)])).alias("lookback")
    return counts.select("series_id", "rows", lookbacks).filter("rows >= 2 * lookback")


# Folds and closed-form models -----------------------------------------------


@query
def fold_members(spark, sf):
    rows = with_positions(daily_by_priority(spark, sf).select("series_id", "time"), Series())
    return folds(rows).select("series_id", day(), F.col("idx").cast("int").alias("idx"), "fold", "is_train")


@query
def cut_fold_sizes(spark, sf):
    rows = with_positions(daily_all(spark, sf).select("series_id", "time"), CUT)
    return folds(rows).groupBy("series_id", "fold", "is_train").agg(
        F.count(F.lit(1)).alias("members"),
        F.min("idx").cast("int").alias("first_idx"),
        F.max("idx").cast("int").alias("last_idx"),
    )


@query
def fold_scaling(spark, sf):
    rows = scale(bt.one_input_folds(daily_all(spark, sf), "price"), ["x"], ["series_id"])
    return rows.select(
        "series_id", "fold", "is_train", F.col("idx").cast("int").alias("idx"),
        (F.round("x_scaled", 6) + 0.0).alias("x_scaled"),
    )


def _predictions(spark, sf, source=daily_by_priority):
    return bt.closed_form_predictions(source(spark, sf), "price", alpha=ALPHA)


def _lookback(predictions: DataFrame) -> DataFrame:
    """The one-input models do not depend on the lookback; compare with all three."""
    lookbacks = F.explode(F.array(*[F.lit(n) for n in ft.LOOKBACKS])).alias("lookback")
    return predictions.select("*", lookbacks)


@query
def closed_form_predictions(spark, sf):
    made = _predictions(spark, sf)
    values = [(F.round(c, 6) + 0.0).alias(c) for c in ("target", "prediction")]
    return made.select("series_id", "fold", F.col("idx").cast("int").alias("idx"), "model", *values)


@query
def fold_metrics(spark, sf):
    made = evaluate(_predictions(spark, sf), ["series_id", "model", "fold"])
    values = [c for c in made.columns if c not in ("series_id", "model", "fold")]
    return made.select("series_id", "model", "fold", *[(F.round(c, 6) + 0.0).alias(c) for c in values])


@query
def pooled_metrics(spark, sf):
    """Metrics over all test rows of a model: groups too large to hold at scale."""
    made = evaluate(_predictions(spark, sf), ["model"], bounded=False)
    return made.select("model", *[(F.round(c, 6) + 0.0).alias(c) for c in ("mae", "median_ae", "q90_ae", "mape")])


@query
def rmse_mae(spark, sf):
    made = rmse_and_mae(_predictions(spark, sf).filter("model = 'OLS'"), "target", "prediction")
    return made.select(*[F.round(c, 6).alias(c) for c in made.columns])


def _results(spark, sf):
    made = evaluate(_predictions(spark, sf), ["series_id", "model", "fold"])
    averages = report.average_folds(made, ["series_id", "model"])
    scaled = {m: tuple(BASELINE_SCALE * v for v in values) for m, values in report.BASELINES.items()}
    return report.compare(_lookback(averages), report.baseline_table(spark, scaled)).filter("has_baseline")


@query
def model_results(spark, sf):
    columns = ["avg_mae", "std_mae", "baseline_mae", "improvement", "avg_rmse", "avg_directional_accuracy",
               "avg_information_coefficient", "avg_huber_loss", "avg_median_ae", "avg_q90_ae",
               "avg_prediction_std", "avg_prediction_uncertainty"]
    return _results(spark, sf).select(
        "series_id", "model", "lookback", "n_folds", "beats_baseline",
        *[(F.round(c, 6) + 0.0).alias(c) for c in columns],
    )


@query
def result_totals(spark, sf):
    made = report.totals(_results(spark, sf))
    return made.select("lookback", "total_models", "beating_baseline", F.round("success_rate", 6).alias("success_rate"))


@query
def winning_rows(spark, sf):
    """Test rows per model and lookback of the models that beat their baseline."""
    keys = ["series_id", "model", "lookback"]
    kept = report.keep_winners(_lookback(_predictions(spark, sf)), _results(spark, sf), keys)
    return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("test_rows"))


@query
def comparison_matrix(spark, sf):
    made = report.comparison_matrix(_results(spark, sf), ["series_id", "model"], ft.LOOKBACKS)
    return made.select("series_id", "model", *[F.round(c, 6).alias(c) for c in ("mae_21", "mae_63", "mae_126")])


@query
def error_histogram(spark, sf):
    return report.error_histogram(_predictions(spark, sf), ["series_id", "model"], -2.0, 2.0, 8)


@query
def one_step_forecasts(spark, sf):
    made = bt.one_step_forecasts(daily_by_priority(spark, sf), "price")
    return shown(made, {"target": 6, "prediction": 6})


@query
def ensemble_average(spark, sf):
    made = ensemble.average(_predictions(spark, sf), ["series_id", "fold", "idx"])
    values = [(F.round(c, 6) + 0.0).alias(c) for c in ("target", "prediction")]
    return made.select("series_id", "fold", F.col("idx").cast("int").alias("idx"), *values)


@query
def ensemble_weighted(spark, sf):
    predictions = _predictions(spark, sf)
    mae = evaluate(predictions, ["series_id", "model", "fold"]).select("series_id", "model", "fold", "mae")
    made = ensemble.weighted(predictions, mae, ["series_id"], 3)
    values = [(F.round(c, 6) + 0.0).alias(c) for c in ("target", "prediction")]
    return made.select("series_id", "fold", F.col("idx").cast("int").alias("idx"), *values)


# Grouped solvers on the same folds ------------------------------------------


def _vector_folds(spark, sf):
    rows = bt.one_input_folds(daily_by_priority(spark, sf), "price")
    return rows.withColumn("x", F.array("x"))


SOLVER_MODELS = (
    ("OLS", "OLS", {}),
    ("Ridge", "Ridge", {"alpha": ALPHA}),
    ("Lasso", "Lasso", {"alpha": ALPHA}),
    ("ElasticNet", "ElasticNet", {"alpha": ALPHA}),
    ("QuantileRegressor", "QuantileRegressor", {}),
)


@query
def solver_predictions(spark, sf):
    """The grouped solvers on one input, where SQL has the closed form."""
    made = grouped.fit_predict(_vector_folds(spark, sf), ["series_id"], SOLVER_MODELS)
    values = [(F.round(c, 6) + 0.0).alias(c) for c in ("target", "prediction")]
    return made.select("series_id", "fold", F.col("idx").cast("int").alias("idx"), "model", *values)


@query
def custom_model(spark, sf):
    """An own model as a callback: the mean of the train targets."""
    made = grouped.fit_predict(_vector_folds(spark, sf), ["series_id"], ["TrainMean"], {"TrainMean": train_mean})
    return made.select("series_id", "fold", F.col("idx").cast("int").alias("idx"), F.round("prediction", 6).alias("prediction"))


def train_mean(X, y, Z, params):
    return [y.mean()] * len(Z)


RIDGE_GRID = (0.1, 1.0, 10.0, 100.0)


@query
def tuned_ridge(spark, sf):
    """Best declared penalty per series, chosen on the first fifth of the rows."""
    rows = _vector_folds(spark, sf).filter("idx < 0.2 * rows AND fold * 31 + 157 <= 0.2 * rows")
    made = grouped.fit_predict(rows, ["series_id"], grouped.grid("Ridge", alpha=RIDGE_GRID))
    scores = report.average_folds(evaluate(made, ["series_id", "model", "fold"]), ["series_id", "model"])
    return scores.groupBy("series_id").agg(
        F.min_by("model", "avg_mae").alias("best"), F.round(F.min("avg_mae"), 6).alias("avg_mae")
    )


@query
def tuned_ridge_applied(spark, sf):
    """The penalty chosen on the first fifth, per series, used on the folds behind it."""
    made = bt.predictions(_vector_folds_rows(spark, sf), ["series_id"], grouped.grid("Ridge", alpha=RIDGE_GRID), tune_share=0.2)
    scores = report.average_folds(evaluate(made, ["series_id", "model", "fold"]), ["series_id", "model"])
    return scores.select("series_id", F.col("model").alias("best"), "n_folds", F.round("avg_mae", 6).alias("avg_mae"))


def _vector_folds_rows(spark, sf):
    """Numbered rows with one input, before they are copied to folds."""
    return bt.one_input_rows(daily_by_priority(spark, sf), "price").withColumn("x", F.array("x"))


QUANTILE = ("Quantile", "QuantileRegressor", {"quantile": 0.7, "alpha": 0.05})


@query
def quantile_predictions(spark, sf):
    """Upper quantile with a penalty that leaves the input in."""
    rows = bt.one_input_folds(daily_all(spark, sf), "price").withColumn("x", F.array("x"))
    made = grouped.fit_predict(rows, ["series_id"], [QUANTILE])
    values = [(F.round(c, 6) + 0.0).alias(c) for c in ("target", "prediction")]
    return made.select("series_id", "fold", F.col("idx").cast("int").alias("idx"), *values)


@query
def path_to_summary(spark, sf):
    """A table written as Parquet, then one call from its path to the totals; the penalties leave the train mean and median."""
    folder = scratch_folder(spark, "run")
    daily_all(spark, sf).write.parquet(f"{folder}/prices.parquet")
    raised = {m: tuple(BASELINE_SCALE * v for v in values) for m, values in report.BASELINES.items()}
    made = run_path(
        spark, f"{folder}/prices.parquet", "price", f"{folder}/run", (21, 63), ["Lasso", "QuantileRegressor"], raised, target_type="log_return",
    )
    totals = made.totals.select("lookback", "total_models", "beating_baseline")
    shown = made.results.select(
        "series_id", "lookback", "model", "n_folds", "beats_baseline", *[F.round(c, 6).alias(c) for c in ("avg_mae", "std_mae", "baseline_mae")]
    )
    return shown.join(F.broadcast(totals), "lookback")


@query
def kept_models(spark, sf):
    """Final models written with their scaler and parameters, read back, and applied to the same rows."""
    rows = _rows_with_input(spark, sf).withColumn("lookback", F.lit(21))
    configs = ["OLS", ("Ridge(alpha=50)", "Ridge", {"alpha": 50.0})]
    folder = scratch_folder(spark, "models")
    write_table(history.fit_history(rows, ["series_id", "lookback"], configs), f"{folder}/models", ["lookback"])
    made = apply_models(spark, folder, rows)
    values = [(F.round(c, 6) + 0.0).alias(c) for c in ("target", "prediction")]
    return made.select("series_id", "model", F.col("idx").cast("int").alias("idx"), *values)


@query
def stored_feature_rows(spark, sf):
    """Feature sets of two lookbacks written by lookback, one of them replaced by its later half, and read back."""
    sets = ft.feature_sets(daily_by_priority(spark, sf), "price", (5, 21))
    path = f"{scratch_folder(spark, 'sets')}/sets"
    write_feature_sets(sets, path)
    later = ft.FeatureSets(read_feature_rows(spark, path, [21]).filter(F.col("idx") * 2 >= F.col("rows")), sets.names, sets.integers, sets.series)
    write_feature_sets(later.stored(), path, "replace")
    made = read_feature_rows(spark, path)
    return _set_facts(made, ["series_id", "lookback"], mean_lag_5=(F.get("x", F.lit(sets.names[21].index("price_lag_5"))), 2))


@query
def fold_models(spark, sf):
    """All solver models on the full inputs of all lookbacks (more inputs than rows)."""
    run = bt.evaluate_models(daily_all(spark, sf), "price", ft.LOOKBACKS, target_type="log_return")
    return run.results.select("series_id", "lookback", "model", "n_folds", "avg_mae", "avg_prediction_std", "beats_baseline")


def _rows_with_input(spark, sf):
    df = daily_by_priority(spark, sf)
    made = ft.create_target_variable(df, "price", "log_return")
    made = ft.create_returns_and_volatility(made, "price", [])
    made = made.dropna("any", subset=["target", "price_log_return"])
    return with_positions(made, Series()).withColumn("x", F.array("price_log_return", "cov1"))


@query
def history_models(spark, sf):
    """Whole-history fits on two inputs from distributed moments."""
    made = history.fit_history(_rows_with_input(spark, sf), ["series_id"], ["OLS", "Ridge", "QuantileRegressor"])
    return made.select(
        "series_id", "model", (F.round("intercept", 6) + 0.0).alias("intercept"),
        (F.round(F.get("coefficients", F.lit(0)), 6) + 0.0).alias("b1"),
        (F.round(F.get("coefficients", F.lit(1)), 6) + 0.0).alias("b2"),
    )


@query
def robust_history_models(spark, sf):
    """Reweighted whole-history fits: Huber and the robust elastic nets."""
    made = history.fit_history(_rows_with_input(spark, sf), ["series_id"], history.ROBUST)
    return made.select("series_id", "model", "intercept", "coefficients", "converged")


@query
def robust_history_conditions(spark, sf):
    """Whether the robust nets meet the conditions of their minimum, from sums over all rows.

    With residuals clipped at epsilon, their mean product with an input is the slope of the loss: for an input that is left
    in it equals the pull of the penalty, for one that is left out it stays below it, and the clipped residuals have mean 0.
    """
    rows = _rows_with_input(spark, sf)
    keys, nets = ["series_id"], ("RobustElasticNet", "RobustLasso")
    made = materialize(history.fit_history(rows, keys, nets))
    defaults = {m: grouped.solvers.DEFAULTS[m] for m in nets}
    per_model = lambda f: F.create_map(*[F.lit(v) for m, p in defaults.items() for v in (m, float(f(p)))])
    epsilon, l1, l2 = (
        F.try_element_at(per_model(f), F.col("model"))
        for f in (lambda p: p["epsilon"], lambda p: p["alpha"] * p["l1_ratio"], lambda p: p["alpha"] * (1 - p["l1_ratio"]))
    )
    z = [(F.get("x", F.lit(j)) - F.get("center", F.lit(j))) / F.get("spread", F.lit(j)) for j in (0, 1)]
    b = [F.get("coefficients", F.lit(j)) for j in (0, 1)]
    residual = F.col("target") - F.col("intercept") - z[0] * b[0] - z[1] * b[1]
    clipped = F.greatest(F.least(residual, epsilon), -epsilon)
    joined = lookup(rows.select(*keys, "x", "target"), made, keys)
    slopes = joined.groupBy(*keys, "model").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(clipped).alias("level"), *[F.avg(clipped * z[j]).alias(f"slope_{j}") for j in (0, 1)],
        *[F.first(b[j]).alias(f"b_{j}") for j in (0, 1)],
    )
    off = [
        F.when(F.col(f"b_{j}") == 0, F.greatest(F.abs(f"slope_{j}") - l1, F.lit(0.0))).otherwise(
            F.abs(F.col(f"slope_{j}") - l2 * F.col(f"b_{j}") - l1 * F.signum(f"b_{j}"))
        )
        for j in (0, 1)
    ]
    return slopes.select(*keys, "model", "rows", (F.greatest(F.abs("level"), *off) < 1e-6).alias("is_minimum"))


def _tree_rows(spark, sf):
    one = ft.feature_set(daily_all(spark, sf), "price", 21, target_type="log_return")
    rows = materialize(one.rows.select("series_id", "time", "x", "target"))
    return trees.with_vector(rows), one.names


@query
def forest_importance(spark, sf):
    rows, inputs = _tree_rows(spark, sf)
    model = trees.forest().fit(rows)
    pairs = trees.importances(model, inputs)
    return spark.createDataFrame(pairs, "feature string, importance double")


@query
def boosted_predictions(spark, sf):
    """Boosted trees, fitted on the first four fifths of the days, on the rest."""
    rows, _ = _tree_rows(spark, sf)
    split = rows.agg(F.percentile(F.unix_seconds(F.col("time").cast("timestamp")), 0.8)).first()[0]
    later = F.unix_seconds(F.col("time").cast("timestamp")) > split
    model = trees.boosted().fit(rows.filter(~later))
    return model.transform(rows.filter(later)).select("series_id", day(), "target", "prediction")


# Autoregression and sequences -----------------------------------------------


@query
def autoregression_forecast(spark, sf):
    order = (1, 1, 0)
    models = autoregression.fit(daily_by_priority(spark, sf), "price", order)
    made = autoregression.forecast(models, 5, order)
    return made.select("series_id", "step", F.round("forecast", 2).alias("forecast"))


@query
def cut_autoregression(spark, sf):
    models = autoregression.fit(daily_all(spark, sf), "price", (1, 1, 0), CUT)
    return models.select(
        "series_id", F.col("n").cast("long").alias("n"), F.round(F.get("coefficients", F.lit(0)), 6).alias("phi"),
    )


@query
def autoregression_level(spark, sf):
    """One lag of the level itself, with an intercept."""
    models = autoregression.fit(daily_by_priority(spark, sf), "price", (1, 0, 0))
    return models.select(
        "series_id", F.col("n").cast("long").alias("n"),
        F.round(F.get("coefficients", F.lit(0)), 6).alias("phi"), F.round("intercept", 2).alias("intercept"),
    )


@query
def autoregression_default_order(spark, sf):
    models = autoregression.fit(by_supplier(spark, sf), "price")
    return autoregression.forecast(models, 5)


@query
def autoregression_conditions(spark, sf):
    """Whether the residuals of the default order are orthogonal to each of its lags, from sums over all rows."""
    df = by_supplier(spark, sf)
    p = autoregression.ORDER[0]
    models = autoregression.fit(df, "price").select("series_id", "n", "coefficients")
    moved = ft.create_lagged_features(df.select("series_id", "time", "price"), ["price"], [1])
    moved = moved.select("series_id", "time", (F.col("price") - F.col("price_lag_1")).alias("step"))
    lagged = ft.create_lagged_features(moved, ["step"], range(1, p + 1)).dropna("any")
    rows = lookup(lagged, models, ["series_id"])
    past = [F.col(f"step_lag_{k}") for k in range(1, p + 1)]
    left = F.col("step") - sum((F.get("coefficients", F.lit(k)) * v for k, v in enumerate(past)), F.lit(0.0))
    ties = [F.abs(F.sum(left * v)) / F.sqrt(F.sum(left * left) * F.sum(v * v)) for v in past]
    return rows.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("rows"), (F.first("n") == F.count(F.lit(1))).alias("all_used"), (F.greatest(*ties) < 1e-9).alias("is_minimum")
    )


@query
def value_sequences(spark, sf):
    made = sequences.create_sequences(daily_by_priority(spark, sf), "price", 10)
    text = F.array_join(F.transform("sequence", lambda v: F.round(v, 0).cast("long").cast("string")), ",")
    return made.select("series_id", day(), text.alias("sequence"), F.round("y", 2).alias("y"))


def _split(spark, sf):
    df = daily_by_priority(spark, sf)
    rows = with_positions(df.select("series_id", "time", "price"), Series())
    early = F.col("idx") < F.floor(F.col("rows") * 0.8)
    keep = ["series_id", "time", "price"]
    return rows.filter(early).select(*keep), rows.filter(~early).select(*keep)


@query
def min_max_scaling(spark, sf):
    train, test = _split(spark, sf)
    limits = sequences.fit_min_max(train, "price", ["series_id"])
    scaled = sequences.min_max(test, limits, "price", ["series_id"])
    back = sequences.inverse_min_max(scaled, limits, "price_scaled", ["series_id"])
    return shown(back, {"price_scaled": 6, "price_scaled_restored": 2})


@query
def held_out_sequences(spark, sf):
    train, test = _split(spark, sf)
    made = sequences.test_sequences(train, test, "price", 5)
    text = F.array_join(F.transform("sequence", lambda v: F.round(v, 0).cast("long").cast("string")), ",")
    return made.select("series_id", day(), text.alias("sequence"), F.round("y", 2).alias("y"))


# Flagship -------------------------------------------------------------------


def _mean_model_report(spark, sf):
    df = daily_all(spark, sf)
    predictions = bt.closed_form_predictions(df, "price", alpha=1.0).filter("model = 'Lasso'")
    averages = report.average_folds(evaluate(predictions, ["series_id", "model", "fold"]), ["series_id", "model"])
    made = report.compare(_lookback(averages), report.baseline_table(spark)).filter("has_baseline")
    return made.select(
        "series_id", "model", "lookback", "n_folds", F.round("avg_mae", 6).alias("avg_mae"),
        F.round("std_mae", 6).alias("std_mae"), F.round("baseline_mae", 6).alias("baseline_mae"),
        "beats_baseline", F.round("improvement", 4).alias("improvement"),
    )


@query
def walk_forward_report(spark, sf):
    return _mean_model_report(spark, sf)


