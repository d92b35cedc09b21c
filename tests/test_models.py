import os
import shutil

import numpy as np
import pandas as pd
import pytest

from frames import to_spark, walk
from tideline.models import autoregression, grouped, history, quantile, solvers, trees
from tideline.operators import report
from tideline.operators.folds import folds, scale
from tideline.operators.layout import Series, with_positions
from tideline.operators.lookup import lookup
from tideline.operators.metrics import evaluate, rmse_and_mae
from tideline.operators.quantiles import exact_quantiles
from tideline.plans import backtest as bt
from tideline.plans.run import apply_models, run_path

RNG = np.random.default_rng(42)


def problem(n=126, d=8, noise=0.3):
    X = RNG.normal(size=(n, d))
    X = (X - X.mean(0)) / X.std(0)
    y = X @ RNG.normal(size=d) + noise * RNG.standard_t(2, n) + 1.0
    return X, y


@pytest.mark.parametrize("n,train", [(900, 126), (314, 126), (300, 63), (252, 126), (251, 126), (283, 126), (284, 126)])
def test_folds_equal_the_loop(spark, n, train):
    df = spark.range(n).selectExpr("id AS idx", f"CAST({n} AS BIGINT) AS rows")
    got = {(r.idx, r.fold, r.is_train) for r in folds(df, train).collect()}
    step, want = train // 4, set()
    i = 0
    while n >= 2 * train and i * step + train + step < n:
        want |= {(r, i, True) for r in range(i * step, i * step + train)}
        want |= {(r, i, False) for r in range(i * step + train, i * step + train + step)}
        i += 1
    assert got == want


def test_scaling_uses_train_rows_and_keeps_constant_columns(spark):
    rows = [("a", 0, i, i < 4, float(i), 7.0 if i < 4 else 9.0) for i in range(6)]
    df = spark.createDataFrame(rows, "series_id string, fold int, idx int, is_train boolean, x double, k double")
    got = scale(df, ["x", "k"], ["series_id"]).orderBy("idx").toPandas()
    assert np.allclose(got["x_scaled"], (np.arange(6) - 1.5) / np.std([0, 1, 2, 3]))
    assert got["k_scaled"].tolist() == [0, 0, 0, 0, 2, 2]


def test_metrics(spark):
    y = RNG.normal(size=100)
    p = y + 0.1 * RNG.normal(size=100)
    df = spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(y, p)], "model string, target double, prediction double")
    e = y - p
    a = np.abs(e)
    want = {
        "mae": a.mean(), "mse": (e**2).mean(), "rmse": np.sqrt((e**2).mean()), "median_ae": np.median(a),
        "q90_ae": np.percentile(a, 90), "huber_loss": (0.5 * e**2).mean(),
        "quantile_loss_10": np.maximum(0.1 * e, -0.9 * e).mean(), "quantile_loss_90": np.maximum(0.9 * e, -0.1 * e).mean(),
        "directional_accuracy": (np.sign(y) == np.sign(p)).mean(), "information_coefficient": np.corrcoef(y, p)[0, 1],
    }
    for bounded in (True, False):
        got = evaluate(df, ["model"], bounded=bounded).first().asDict()
        for name, value in want.items():
            assert got[name] == pytest.approx(value, abs=1e-12), name
    flat = df.withColumn("prediction", df.target * 0 + 1.0)
    assert evaluate(flat, ["model"]).first()["information_coefficient"] == 0.0
    one = evaluate(df.limit(1), ["model"]).first()
    assert one["directional_accuracy"] == 0.0 and one["information_coefficient"] == 0.0
    assert rmse_and_mae(df.limit(0), "target", "prediction").first()["rmse"] is None


@pytest.mark.parametrize("accuracy", [100_000, 200])
def test_exact_quantiles_with_coarse_and_fine_sketches(spark, accuracy):
    values = {"a": RNG.normal(size=5000), "b": np.round(RNG.exponential(size=777), 1), "c": np.array([3.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k string, v double")
    levels = {"q05": 0.05, "q50": 0.5, "q75": 0.75, "q100": 1.0}
    for r in exact_quantiles(df, ["k"], "v", levels, accuracy).collect():
        for name, p in levels.items():
            assert r[name] == pytest.approx(np.quantile(values[r.k], p), abs=1e-12)
    whole = exact_quantiles(df, [], "v", {"m": 0.5}, accuracy).first().m
    assert whole == pytest.approx(np.median(np.concatenate(list(values.values()))))


@pytest.mark.parametrize("most", [20, 100])
def test_exact_quantiles_narrow_wide_brackets(spark, most):
    ties = np.r_[np.zeros(600), np.ones(600), RNG.normal(size=50)]
    values = {"all different": RNG.normal(size=8000), "ties": ties, "two": np.repeat([1.0, 2.0], 500), "few": np.arange(5.0)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k string, v double")
    levels = {"q00": 0.0, "q05": 0.05, "q50": 0.5, "q77": 0.77, "q100": 1.0}
    got = exact_quantiles(df, ["k"], "v", levels, accuracy=300, most=most).collect()
    assert {r.k for r in got} == set(values)
    for r in got:
        for name, p in levels.items():
            assert r[name] == pytest.approx(np.quantile(values[r.k], p), abs=1e-12), (r.k, name)


def test_lookup_splits_hot_series_from_others(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"s{i}", i) for i in range(1500)] + [(None, 1), ("unknown", 2)]
    df = spark.createDataFrame(rows, "k string, v int")
    table = spark.createDataFrame([("hot", 1.0)] + [(f"s{i}", float(i)) for i in range(1500)], "k string, w double")
    small, large = (sorted(map(tuple, lookup(df, table, ["k"], limit=n).collect())) for n in (1 << 20, 0))
    assert small == large and len(small) == 4500
    assert lookup(df.limit(0), table, ["k"], limit=0).count() == 0


def objective(model, X, y, b, c, p):
    r, n = y - X @ b - c, len(y)
    if model == "HuberRegressor":
        best = np.inf
        for s in np.geomspace(0.05, 5, 400) * np.std(y):
            z = np.abs(r / s)
            loss = np.where(z <= p["epsilon"], z**2, 2 * p["epsilon"] * z - p["epsilon"] ** 2)
            best = min(best, n * s + (s * loss).sum())
        return best + p["alpha"] * b @ b
    if model == "QuantileRegressor":
        return np.maximum(p["quantile"] * r, (p["quantile"] - 1) * r).mean() + p["alpha"] * np.abs(b).sum()
    a, l1 = p["alpha"], p.get("l1_ratio", 0.0)
    if model.startswith("Robust"):
        e = p["epsilon"]
        loss = np.where(np.abs(r) <= e, 0.5 * r**2, e * np.abs(r) - 0.5 * e**2).mean()
    else:
        loss = 0.5 * (r**2).mean()
    if model == "Ridge":
        return loss + 0.5 * a / n * b @ b
    return loss + a * (l1 * np.abs(b).sum() + 0.5 * (1 - l1) * b @ b)


@pytest.mark.parametrize(
    "model,params",
    [
        ("Ridge", {}), ("Lasso", {"alpha": 0.1}), ("ElasticNet", {"alpha": 0.1}), ("HuberRegressor", {}),
        ("QuantileRegressor", {"alpha": 0.02}), ("QuantileRegressor", {"alpha": 0.05, "quantile": 0.9}),
        ("RobustElasticNet", {}), ("RobustLasso", {}),
    ],
)
@pytest.mark.parametrize("seed", range(3))
def test_solvers_reach_the_minimum(model, params, seed):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(120, 8))
    y = X[:, :3].sum(1) + rng.standard_t(3, size=120)
    X = (X - X.mean(0)) / X.std(0)
    p = {**solvers.DEFAULTS[model], **params}
    b, c, _ = solvers.fit(model, X, y, p)
    best = objective(model, X, y, b, c, p)
    for _ in range(300):
        size = 10.0 ** rng.uniform(-4, -0.5)
        other = objective(model, X, y, b + size * rng.normal(size=len(b)), c + size * rng.normal(), p)
        assert other >= best - 2e-5 * abs(best)


@pytest.mark.parametrize("seed", range(30))
def test_quantile_fits_close_the_duality_gap(seed):
    rng = np.random.default_rng(seed)
    n, d = [(120, 8), (126, 208), (126, 3), (1500, 6)][seed % 4]
    X = rng.normal(size=(n, d))
    y = X[:, :3].sum(1) * (seed % 3) + rng.standard_t(3, size=n)
    if seed % 5 == 0:
        X[:, 1], X[:, 2] = X[:, 0], 0.0  # equal and empty inputs
        y = np.round(y)  # ties
    q, alpha = [(0.5, 0.02), (0.9, 0.05), (0.1, 0.001), (0.5, 0.3), (0.7, 0.0)][seed % 5]
    b, c, gap = quantile.fit(X, y, q, alpha)
    assert gap <= 1e-8
    best = quantile.loss(X, y, b, c, q, alpha)
    for _ in range(200):
        size = 10.0 ** rng.uniform(-5, -0.5)
        assert quantile.loss(X, y, b + size * rng.normal(size=d), c + size * rng.normal(), q, alpha) >= best - 2e-8


def test_quantile_fits_of_flat_and_exact_rows():
    assert quantile.fit(np.zeros((100, 3)), np.ones(100), 0.3, 0.01)[1:] == (1.0, 0.0)
    b, c, gap = quantile.fit(np.arange(10.0)[:, None], np.arange(10.0) * 2 + 1, 0.3, 1e-4)
    assert (b[0], c) == (pytest.approx(2.0), pytest.approx(1.0)) and gap <= 1e-8


def test_least_squares_has_minimum_norm_with_more_inputs_than_rows():
    X, y = RNG.normal(size=(30, 60)), RNG.normal(size=30)
    b, c, _ = solvers.fit("OLS", X, y, {})
    want = np.linalg.lstsq(X - X.mean(0), y - y.mean(), rcond=None)[0]
    assert np.allclose(b, want, atol=1e-8) and np.allclose(X @ b + c, y)


def test_default_penalties_give_constants():
    X, y = problem()
    y = y / y.std() * 0.01
    for model in ("Lasso", "ElasticNet"):
        b, c, _ = solvers.fit(model, X, y, solvers.DEFAULTS[model])
        assert not b.any() and c == pytest.approx(y.mean())
    b, c, _ = solvers.fit("QuantileRegressor", X, y, solvers.DEFAULTS["QuantileRegressor"])
    assert not b.any() and c == pytest.approx(np.median(y))


def test_bayesian_ridge_is_a_ridge_with_its_own_precisions():
    X, y = problem(noise=0.5)
    b, c, sd = solvers.fit("BayesianRidge", X, y, solvers.DEFAULTS["BayesianRidge"])
    ols = np.linalg.lstsq(X - X.mean(0), y - y.mean(), rcond=None)[0]
    assert np.abs(b).sum() < np.abs(ols).sum() and np.allclose(b, ols, atol=0.2)
    noise = np.std(y - X @ b - c)
    assert (sd(X) > 0.9 * noise).all() and sd(10 * X).mean() > sd(X).mean()


def fold_table(spark, n=300, d=10):
    x, y = RNG.normal(size=(n, d)), RNG.normal(size=n)
    rows = [("s", i, n, x[i].tolist(), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, idx bigint, rows bigint, x array<double>, target double")


def test_grouped_fits_cover_all_models_and_isolate_errors(spark):
    def broken(X, y, Z, params):
        raise RuntimeError("no luck")

    models = [*solvers.DEFAULTS, "Broken", *grouped.grid("Ridge", alpha=[0.1, 10.0])]
    made = grouped.fit_predict(folds(fold_table(spark), 63), ["series_id"], models, {"Broken": broken}).toPandas()
    k = (300 - 63 - 1) // 15
    assert made.groupby("model").size().to_dict() == {m if isinstance(m, str) else m[0]: 15 * k for m in models}
    bad = made[made.model == "Broken"]
    assert bad["prediction"].isna().all() and bad["error"].str.contains("no luck").all()
    good = made[made.model != "Broken"]
    assert good["prediction"].notna().all() and good["error"].isna().all()
    assert made[made.model == "BayesianRidge"]["prediction_sd"].gt(0).all()
    assert folds(fold_table(spark, 50), 126).count() == 0


def test_history_fit_equals_a_direct_fit(spark):
    df = fold_table(spark, 400, 5)
    models = [*history.SQUARED, *history.ROBUST, "QuantileRegressor"]
    made = history.fit_history(df, ["series_id"], models).toPandas().set_index("model")
    assert made["converged"].all() and made.loc["RobustLasso", "rounds"] > 1
    pdf = df.toPandas()
    x, y = np.vstack(pdf["x"]), pdf["target"].to_numpy()
    X = (x - x.mean(0)) / x.std(0)
    for model in models:
        b, c, _ = solvers.fit(model, X, y, solvers.DEFAULTS[model])
        assert np.allclose(made.loc[model, "coefficients"], b, atol=2e-3), model
        assert made.loc[model, "intercept"] == pytest.approx(c, abs=2e-3)
    applied = history.predict_history(df, history.fit_history(df, ["series_id"], ["OLS"]), ["series_id"])
    b, c, _ = solvers.fit("OLS", X, y, {})
    got = applied.orderBy("idx").toPandas()["prediction"]
    assert np.allclose(got, X @ b + c)


def test_history_fits_take_parameters(spark):
    df = fold_table(spark, 400, 5)
    models = [*grouped.grid("Ridge", alpha=[0.5, 80.0]), ("Low", "QuantileRegressor", {"quantile": 0.2, "alpha": 0.01}), ("Near", "HuberRegressor", {"epsilon": 1.1})]
    made = history.fit_history(df, ["series_id"], models).toPandas().set_index("model")
    pdf = df.toPandas()
    x, y = np.vstack(pdf["x"]), pdf["target"].to_numpy()
    X = (x - x.mean(0)) / x.std(0)
    for label, model, params in models:
        b, c, _ = solvers.fit(model, X, y, {**solvers.DEFAULTS[model], **params})
        assert np.allclose(made.loc[label, "coefficients"], b, atol=2e-3), label
        assert made.loc[label, "intercept"] == pytest.approx(c, abs=2e-3) and made.loc[label, "converged"]
    assert np.abs(made.loc["Ridge(alpha=80.0)", "coefficients"]).sum() < np.abs(made.loc["Ridge(alpha=0.5)", "coefficients"]).sum()


def test_long_series_refuse_quantile_programs(spark, monkeypatch):
    monkeypatch.setattr(history, "WHOLE_CELLS", 0)
    with pytest.raises(ValueError, match="quantile"):
        history.fit_history(fold_table(spark, 300, 2), ["series_id"], [("Low", "QuantileRegressor", {"alpha": 0.01})])


def test_tuning_reaches_the_later_folds(spark):
    df = fold_table(spark, 600, 3)
    every, grid = folds(df, 63), grouped.grid("Ridge", alpha=[0.1, 1000.0])
    early, later = grouped.early_folds(every, 0.4, 63, 15), grouped.later_folds(every, 0.4, 63, 15)
    best = grouped.tune(early, ["series_id"], grid).first()
    made = grouped.fit_predict(later, ["series_id"], [], chosen=grouped.tune(early, ["series_id"], grid)).toPandas()
    same = grouped.fit_predict(later, ["series_id"], [c for c in grid if c[0] == best.model]).toPandas()
    assert best.params == {"alpha": float(best.model[12:-1])} and set(made["model"]) == {best.model}
    order = ["fold", "idx"]
    assert np.allclose(made.sort_values(order)["prediction"], same.sort_values(order)["prediction"])
    assert made["fold"].min() * 15 + 63 >= 240 and early.agg({"fold": "max"}).first()[0] * 15 + 78 <= 240


def test_robust_fits_by_passes_equal_those_in_one_task(spark, monkeypatch):
    df = fold_table(spark, 300, 2)
    fit = lambda n: history.fit_history(df, ["series_id"], history.ROBUST, rounds=n).toPandas().set_index("model")
    whole, short = fit(8), fit(1)
    monkeypatch.setattr(history, "WHOLE_CELLS", 0)
    passes = fit(8)
    for model in history.ROBUST:
        assert np.allclose(passes.loc[model, "coefficients"], whole.loc[model, "coefficients"], atol=1e-9)
        assert passes.loc[model, "rounds"] <= 8
    assert not short["converged"].any()  # one round is told apart from a finished fit


def test_autoregression(spark):
    with pytest.raises(ValueError):
        autoregression.check_order((1, 1))
    with pytest.raises(ValueError):
        autoregression.check_order((1, -1, 0))
    with pytest.raises(ValueError):
        autoregression.check_order((1, 1, 1))
    e, d = RNG.normal(size=700), np.zeros(700)
    for t in range(2, 700):
        d[t] = 0.6 * d[t - 1] - 0.3 * d[t - 2] + e[t]
    pdf = walk(700, 1, "ar")
    pdf["price"] = 100 + d.cumsum()
    df = to_spark(spark, pdf)
    for series in (Series(), Series(chunk_rows=100)):
        fitted = autoregression.fit(df, "price", (2, 1, 0), series)
        r = fitted.first()
        step = np.diff(pdf["price"])
        A = np.column_stack([step[1:-1], step[:-2]])
        want = np.linalg.lstsq(A, step[2:], rcond=None)[0]
        assert np.allclose(r.coefficients, want) and abs(want[0] - 0.6) < 0.15
        path = autoregression.forecast(fitted, 3, (2, 1, 0)).orderBy("step").toPandas()["forecast"]
        first = want @ [step[-1], step[-2]]
        second = want @ [first, step[-1]]
        assert np.allclose(path[:2], pdf["price"].iloc[-1] + np.cumsum([first, second]))


def test_boosting_parameters_merge():
    assert trees.boosted_params()["maxIter"] == 100
    merged = trees.boosted_params({"n_estimators": 5, "colsample_bytree": 0.5, "maxDepth": 2})
    assert (merged["maxIter"], merged["featureSubsetStrategy"], merged["maxDepth"]) == (5, "0.5", 2)


def test_trees_fit_save_and_rank(spark, tmp_path):
    df = fold_table(spark, 200, 3).selectExpr("x[0] AS a", "x[1] AS b", "x[2] AS c", "5 * x[1] AS target")
    model = trees.assemble(["a", "b", "c"], trees.forest(numTrees=5, maxDepth=4)).fit(df)
    assert trees.importances(model.stages[-1], ["a", "b", "c"])[0][0] == "b"
    model.write().overwrite().save(str(tmp_path / "model"))
    boosted = trees.assemble(["a", "b", "c"], trees.boosted({"n_estimators": 3})).fit(df)
    assert boosted.transform(df).count() == 200


def test_report(spark):
    rows = [("s", 21, m, f, v) for m, vs in {"OLS": (0.01, 0.03), "Ridge": (0.03, 0.05), "Other": (0.0, 0.0)}.items() for f, v in enumerate(vs)]
    fm = spark.createDataFrame(rows, "series_id string, lookback int, model string, fold int, mae double")
    keys = ["series_id", "lookback", "model"]
    results = report.compare(report.average_folds(fm, keys), report.baseline_table(spark)).toPandas().set_index("model")
    assert not results.loc["Other", "has_baseline"] and not results.loc["Other", "beats_baseline"]
    assert results.loc["OLS", "avg_mae"] == pytest.approx(0.02) and results.loc["OLS", "std_mae"] == pytest.approx(0.01)
    assert results.loc["OLS", "beats_baseline"] and not results.loc["Ridge", "beats_baseline"]
    assert results.loc["OLS", "improvement"] == pytest.approx((0.02505 - 0.02) / 0.02505 * 100)
    assert results.loc["OLS", "n_folds"] == 2 and np.isinf(results.loc["OLS", "avg_huber_loss"])
    table = report.compare(report.average_folds(fm, keys), report.baseline_table(spark))
    total = {r.lookback: (r.total_models, r.beating_baseline, r.success_rate) for r in report.totals(table).collect()}
    assert total == {21: (2, 1, 0.5), None: (2, 1, 0.5)}


def test_configurations_keep_their_baseline(spark):
    df = to_spark(spark, walk(340, 7, "a"))
    run = bt.evaluate_models(df, "price", [21], ["Ridge", *grouped.grid("Ridge", alpha=[0.1, 10.0])])
    got = run.results.toPandas()
    assert set(got["model"]) == {"Ridge", "Ridge(alpha=0.1)", "Ridge(alpha=10.0)"}
    assert got["has_baseline"].all() and set(got["baseline_mae"]) == {0.024659}


def test_evaluation_from_rows_to_final_models(spark):
    df = to_spark(spark, pd.concat([walk(340, 7, "a"), walk(60, 8, "short")]))
    big = {m: (9.0, 9.0, 9.0) for m in report.BASELINES}
    run = bt.evaluate_models(df, "price", [21], ["Ridge", "Lasso"], baselines=big)
    got = run.results.toPandas()
    assert set(got["series_id"]) == {"a"} and set(got["model"]) == {"Ridge", "Lasso"}
    rows = run.rows.filter("series_id = 'a'").first().rows
    assert (got["n_folds"] == (rows - 126 - 1) // 31).all() and got["beats_baseline"].all()
    assert run.totals.filter("lookback IS NULL").first().beating_baseline == 2
    final = bt.final_models(run)
    assert {(r.model, len(r.coefficients)) for r in final.collect()} == {("Ridge", 204 - 37), ("Lasso", 204 - 37)}
    assert len(run.names[21]) == 204 - 37


def test_final_models_keep_what_they_won_with(spark):
    df = to_spark(spark, walk(340, 7, "a"))
    big = {m: (9.0, 9.0, 9.0) for m in report.BASELINES}
    run = bt.evaluate_models(df, "price", [21], grouped.grid("Ridge", alpha=[0.1, 10.0]), baselines=big, tune_share=0.6)
    final = bt.final_models(run).collect()
    assert len(final) == 1 and final[0].base_model == "Ridge" and final[0].model == f"Ridge(alpha={final[0].params['alpha']})"
    assert tuple(final[0].names) == run.names[21] and len(final[0].center) == len(final[0].coefficients) == len(final[0].names)
    assert final[0].scores.avg_mae == run.results.first().avg_mae and final[0].scores.n_folds > 0


def test_run_from_a_path_is_resumed(spark, tmp_path):
    pdf = pd.concat([walk(330, 7, "a"), walk(60, 8, "short")])
    path, folder = str(tmp_path / "prices.csv"), str(tmp_path / "run")
    pdf.to_csv(path, index=False)
    big = {m: (9.0, 9.0, 9.0) for m in report.BASELINES}
    options = dict(lookbacks=[21, 63], models=["Ridge", "Lasso"], baselines=big)
    first = run_path(spark, path, "price", folder, **options)
    assert {(r.lookback, r.model) for r in first.results.collect()} == {(n, m) for n in (21, 63) for m in ("Ridge", "Lasso")}
    assert first.totals.filter("lookback IS NULL").first().beating_baseline == 4 and first.models.count() == 4
    mine = first.rows.filter("lookback = 21")
    assert apply_models(spark, folder, mine).count() == 2 * mine.count()
    stamps = {n: os.path.getmtime(f"{folder}/{n}/_SUCCESS") for n in ("rows", "predictions")}
    os.remove(f"{folder}/results/_SUCCESS")
    shutil.move(path, path + ".gone")  # the rows are stored: a resumed run does not need the file
    again = run_path(spark, path, "price", folder, **options)
    assert again.results.count() == 4 and stamps == {n: os.path.getmtime(f"{folder}/{n}/_SUCCESS") for n in stamps}
    with pytest.raises(ValueError, match="other settings"):
        run_path(spark, path, "price", folder, **options | {"models": ["OLS"]})
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        run_path(spark, str(tmp_path / "none.csv"), "price", str(tmp_path / "other"))
    assert not (tmp_path / "other").exists()


def test_positions_of_cut_and_whole_series_agree(spark):
    df = to_spark(spark, walk(500, 3, "a")).select("series_id", "time")
    whole = with_positions(df, Series()).orderBy("time").toPandas()
    cut = with_positions(df, Series(chunk_rows=90)).orderBy("time").toPandas()
    assert whole["idx"].tolist() == list(range(500)) and cut[["idx", "rows"]].equals(whole[["idx", "rows"]])
