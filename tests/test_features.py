import numpy as np
import pandas as pd
import pytest

from frames import expected, to_spark, walk
from tideline.operators.layout import Series, lay_out
from tideline.plans import features as ft

DAY = 86_400_000_000
WHOLE = Series()
CUT = Series(chunk_rows=200, bucket=7 * DAY)
TOLERANCE = {"skew": 1e-7, "kurt": 1e-6}


def compare(got, want, names):
    key = ["series_id", "time"]
    got = got.sort_values(key).reset_index(drop=True)
    want = want.sort_values(key).reset_index(drop=True)
    assert len(got) == len(want)
    assert (got["time"].to_numpy() == want["time"].to_numpy()).all()
    for c in names:
        a, b = got[c].astype(float).to_numpy(), want[c].astype(float).to_numpy()
        if "_corr_" in c:  # a flat frame gives noise or infinity in pandas, NULL here
            b = np.where(np.isfinite(b) & (np.abs(b) <= 1 + 1e-9), b, np.nan)
            b = np.where(np.isnan(a), np.nan, b)
        assert (np.isnan(a) == np.isnan(b)).all(), c
        tol = next((v for k, v in TOLERANCE.items() if k in c), 1e-9)
        assert np.allclose(a, b, rtol=tol, atol=tol * 10, equal_nan=True), c


@pytest.fixture(scope="module")
def table(spark):
    pdf = pd.concat(
        [
            walk(400, 1, "a", nulls=[(0, 2), (50, 53), (398, 400)], flat=(120, 215)),
            walk(330, 2, "b"),
            walk(1, 3, "one"),
        ]
    )
    return pdf, to_spark(spark, pdf)


@pytest.mark.parametrize("series", [WHOLE, CUT], ids=["whole", "cut"])
def test_families_match_pandas(table, series):
    pdf, df = table
    df = df.cache()
    assert lay_out(df, series).is_cut == (series is CUT)
    want = pd.concat([expected(g) for _, g in pdf.groupby("series_id")])
    cols, windows = ["price", "cov1", "cov2"], [5, 21, 63]
    checks = [
        ft.create_lagged_features(df, cols, [1, 5, 21], series),
        ft.create_rolling_statistics(df, cols, windows, series),
        ft.create_technical_indicators(df, "price", [5, 10, 21, 63], series),
        ft.create_returns_and_volatility(df, "price", windows, series),
        ft.create_interaction_features(df, "price", ["cov1", "cov2"], series),
        ft.create_calendar_features(df),
        ft.create_target_variable(df, "price", series=series),
    ]
    for frame in checks:
        names = [c for c in frame.columns if c not in df.columns]
        assert names and not any(n.startswith("_") for n in names)
        compare(frame.toPandas(), want, names)


@pytest.mark.parametrize("series", [WHOLE, CUT], ids=["whole", "cut"])
def test_feature_set_keeps_complete_rows(table, series):
    pdf, df = table
    want = pd.concat([expected(g) for _, g in pdf.groupby("series_id")])
    made = ft.create_features(df, "price", [21], series)[21]
    names = [c for c in made.columns if c not in ("series_id", "time")]
    assert len(names) == len(set(names)) == 3 + 12 + 81 + 22 + 20 + 10 + 19 + 1
    got = made.toPandas()
    # Flat frames have no correlation here, so those rows are incomplete.
    complete = want[[c for c in names]].replace([np.inf, -np.inf], np.nan).dropna().index
    want = want.loc[:, ["series_id", "time", *names]].dropna(subset=names)
    merged = got[["series_id", "time"]].merge(want, on=["series_id", "time"], how="left")
    assert merged["target"].notna().all() and len(complete) >= len(got) > 300
    compare(got, merged, names)


def test_cut_and_whole_agree_on_long_null_runs(spark):
    pdf = walk(3000, 5, "n", nulls=[(0, 40), (300, 2600)])
    df = to_spark(spark, pdf)
    series = Series(chunk_rows=250, bucket=5 * DAY)
    for fill in (None, "pad"):
        frames = [
            ft.create_technical_indicators(df, "price", [5, 63], s, fill).toPandas()
            for s in (WHOLE, series)
        ]
        want = expected(pdf, windows=(5, 63))
        names = ["price_ema_5", "price_ema_63"]
        if fill:
            want["price_momentum_5"] = pdf["price"].ffill().pct_change(5)
            names.append("price_momentum_5")
        for frame in frames:
            compare(frame, want, names)


def test_buckets_narrow_until_a_chunk_fits(spark):
    """Ticks half a millisecond apart: the default bucket would hold them all."""
    pdf = walk(1500, 9, "ticks")
    pdf["time"] = pd.Timestamp("2024-03-10 02:30:00") + pd.to_timedelta(np.arange(1500) * 500, "us")
    pdf.loc[1400:, "time"] += pd.Timedelta(days=40)
    df = to_spark(spark, pdf)
    series = Series(chunk_rows=200)
    layout = lay_out(df, series)
    assert layout.is_cut and layout.series.bucket < 200 * 500
    assert layout.spread(df).groupBy("_chunk").count().agg({"count": "max"}).first()[0] <= 400
    got = ft.create_lagged_features(df, ["price"], [1, 5], series).toPandas()
    compare(got, expected(pdf), ["price_lag_1", "price_lag_5"])


def test_missing_columns_are_skipped(table):
    _, df = table
    assert ft.create_lagged_features(df, ["nope", "price"], [1]).columns[-1] == "price_lag_1"
    assert ft.create_technical_indicators(df, "nope", [5]) is df
    assert ft.create_returns_and_volatility(df, "nope", [5]) is df
    assert ft.create_calendar_features(df, "nope") is df
    assert ft.create_target_variable(df, "nope") is df


def test_target_types(table):
    pdf, df = table
    b = df.filter("series_id = 'b'")
    p = pdf[pdf.series_id == "b"]["price"].reset_index(drop=True)
    wants = {"return": p.shift(-3) / p - 1, "log_return": np.log(p.shift(-3) / p), "price": p.shift(-3)}
    for kind, want in wants.items():
        got = ft.create_target_variable(b, "price", kind, 3).toPandas().sort_values("time")["target"]
        assert np.allclose(got.to_numpy(), want.to_numpy(), equal_nan=True)
    with pytest.raises(ValueError):
        ft.create_target_variable(b, "price", "unknown")


def test_too_few_rows_give_no_features(spark):
    df = to_spark(spark, walk(5, 1, "short"))
    assert ft.create_features(df, "price", [100])[100].count() == 0


def test_rising_series_has_full_strength(spark):
    pdf = walk(40, 1, "up")
    pdf["price"] = np.arange(40.0) + 1
    got = ft.create_technical_indicators(to_spark(spark, pdf), "price", [21]).toPandas()
    rsi = got.sort_values("time")["price_rsi_21"]
    assert np.isnan(rsi.iloc[0]) and (rsi.iloc[1:] == 100).all()


def test_zero_price_gives_null_ratios(spark):
    pdf = walk(6, 1, "z")
    pdf["price"] = [1.0, 0.0, 2.0, -1.0, 3.0, 3.0]
    got = ft.create_returns_and_volatility(to_spark(spark, pdf), "price", [5]).toPandas()
    got = got.sort_values("time").reset_index(drop=True)
    assert got["price_return"].isna().tolist() == [True, False, True, False, False, False]
    assert got["price_log_return"].isna().tolist() == [True, True, True, True, True, False]
