"""SQL equivalents of the registered queries, for an independent engine."""

from __future__ import annotations

import math

WINDOWS = (5, 10, 21, 63)
ORACLES: dict[str, str] = {}

ORDERS = (
    "max(o_totalprice) AS price, CAST(count(*) AS DOUBLE) AS cov1, min(o_totalprice) AS cov2"
    " FROM orders GROUP BY 1, 2"
)
PRIORITY = f"d AS (SELECT o_orderpriority AS series_id, o_orderdate AS time, {ORDERS})"
ALL_DAYS = f"d AS (SELECT 'all' AS series_id, o_orderdate AS time, {ORDERS})"
SUPPLIER = (
    "d AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_id, l_shipdate AS time,"
    " max(l_extendedprice) AS price, max(l_quantity) AS cov1, CAST(count(*) AS DOUBLE) AS cov2"
    " FROM lineitem GROUP BY 1, 2)"
)
GAPS = (
    f"{PRIORITY.replace('d AS', 'd0 AS', 1)}, d AS (SELECT series_id, time,"
    " CASE WHEN cov1 > 1 THEN price END AS price FROM d0)"
)
BY_TIME = "PARTITION BY series_id ORDER BY time"
SERIES = f"({BY_TIME})"
DAY = "CAST(CAST(time AS DATE) AS VARCHAR) AS day"
KEY = f"series_id, {DAY}"


def back(n: int) -> str:
    return f"({BY_TIME} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def rnd(expression: str, digits: int, name: str) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


def listed(items) -> str:
    return ",\n  ".join(items)


# Sources and checks

ORACLES["table_summary"] = f"""WITH {PRIORITY}
SELECT count(*) AS total_rows, 5 AS total_columns,
  CAST(CAST(min(time) AS DATE) AS VARCHAR) AS first_time,
  CAST(CAST(max(time) AS DATE) AS VARCHAR) AS last_time FROM d"""

LINEITEM_NUMBERS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    "l_quantity", "l_extendedprice", "l_discount", "l_tax",
)
ORACLES["column_statistics"] = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS nulls, count({c}) AS count,
  {rnd(f'avg(CAST({c} AS DOUBLE))', 4, 'mean')}, {rnd(f'stddev_samp(CAST({c} AS DOUBLE))', 4, 'std')},
  {rnd(f'min(CAST({c} AS DOUBLE))', 4, 'min')}, {rnd(f'max(CAST({c} AS DOUBLE))', 4, 'max')},
  {rnd(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)', 4, 'q25')},
  {rnd(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)', 4, 'q50')},
  {rnd(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)', 4, 'q75')} FROM lineitem"""
    for c in LINEITEM_NUMBERS
)

ORACLES["coverage"] = f"""WITH {PRIORITY}
SELECT series_id, CAST(CAST(min(time) AS DATE) AS VARCHAR) AS first_time,
  CAST(CAST(max(time) AS DATE) AS VARCHAR) AS last_time,
  min(time) <= DATE '1995-02-01' AND max(time) >= DATE '1998-08-01' AS in_range
FROM d GROUP BY series_id"""

ORACLES["null_counts"] = f"""WITH {PRIORITY}, l AS (
  SELECT series_id, price, lag(price, 5) OVER {SERIES} AS p5, lag(cov1, 5) OVER {SERIES} AS c5 FROM d)
SELECT series_id, count(*) - count(price) AS price_nulls, count(*) - count(p5) AS price_lag_5_nulls,
  count(*) - count(c5) AS cov1_lag_5_nulls FROM l GROUP BY series_id"""

ORACLES["time_gaps"] = f"""WITH {PRIORITY}, l AS (
  SELECT series_id, time, lag(time) OVER {SERIES} AS before FROM d)
SELECT {KEY}, CAST(CAST(before AS DATE) AS VARCHAR) AS previous_day,
  date_diff('day', before, time) AS gap_days FROM l WHERE date_diff('day', before, time) > 3"""

ORACLES["range_violations"] = """
SELECT count(*) FILTER (WHERE NOT l_quantity BETWEEN 2 AND 49) AS l_quantity_out_of_range,
  count(*) FILTER (WHERE NOT l_discount BETWEEN 0 AND 0.09) AS l_discount_out_of_range FROM lineitem"""

ORACLES["outliers"] = f"""WITH {SUPPLIER}, s AS (
  SELECT series_id, avg(cov2) AS m, stddev_samp(cov2) AS s, quantile_cont(cov2, 0.25) AS a,
    quantile_cont(cov2, 0.75) AS b FROM d GROUP BY series_id)
SELECT {KEY}, {rnd('cov2', 1, 'cov2')}, {rnd('(cov2 - m) / nullif(s, 0)', 6, 'z_score')},
  cov2 < a - (b - a) OR cov2 > b + (b - a) AS is_outlier FROM d JOIN s USING (series_id)"""

# Features


def _lags(columns, offsets) -> str:
    return listed(
        rnd(f"lag({c}, {k}) OVER {SERIES}", 2, f"{c}_lag_{k}") for c in columns for k in offsets
    )


ORACLES["lags"] = f"WITH {PRIORITY}\nSELECT {KEY}, {_lags(('price', 'cov1'), (1, 5, 10, 21))} FROM d"
ORACLES["documented_lags"] = (
    f"WITH {PRIORITY}\nSELECT {KEY}, {_lags(('price',), (1, 2, 3, 5, 10, 20))} FROM d"
)

STATISTICS = {
    "mean": lambda c, n: f"avg({c}) OVER {back(n)}",
    "std": lambda c, n: f"stddev_samp({c}) OVER {back(n)}",
    "volatility": lambda c, n: f"stddev_samp({c}) OVER {back(n)} * {math.sqrt(n)!r}",
    "min": lambda c, n: f"min({c}) OVER {back(n)}",
    "max": lambda c, n: f"max({c}) OVER {back(n)}",
    "median": lambda c, n: f"quantile_cont({c}, 0.5) OVER {back(n)}",
    "iqr": lambda c, n: (
        f"quantile_cont({c}, 0.75) OVER {back(n)} - quantile_cont({c}, 0.25) OVER {back(n)}"
    ),
}


def _rolling(digits, source=PRIORITY, windows=WINDOWS) -> str:
    columns = listed(
        rnd(STATISTICS[s](c, n), d, f"{c}_rolling_{s}_{n}")
        for c in ("price", "cov1")
        for s, d in digits.items()
        for n in windows
    )
    return f"WITH {source}\nSELECT {KEY},\n  {columns}\nFROM d"


MEAN_TO_PRICE = "avg(price) OVER {} / price"
ORACLES["rolling_mean_std"] = f"""WITH {PRIORITY}
SELECT {KEY}, {listed(rnd(MEAN_TO_PRICE.format(back(n)), 6, f'price_rolling_mean_{n}') for n in WINDOWS)},
  {listed(rnd(STATISTICS['mean']('cov1', n), 6, f'cov1_rolling_mean_{n}') for n in WINDOWS)},
  {listed(rnd(STATISTICS[s](c, n), 2, f'{c}_rolling_{s}_{n}')
          for c in ('price', 'cov1') for s in ('std', 'volatility') for n in WINDOWS)}
FROM d"""
ORACLES["rolling_range"] = _rolling({"min": 2, "max": 2})
ORACLES["rolling_quantiles"] = _rolling({"median": 5, "iqr": 5})
ORACLES["rolling_documented_windows"] = _rolling({"median": 5, "max": 2}, windows=(5, 10, 20, 60))
ORACLES["rolling_supplier"] = _rolling({"median": 5, "min": 2}, SUPPLIER, (5, 21))


def _power(frame: str, k: int) -> str:
    return f"(list_sum(list_transform({frame}, lambda v: pow(v - list_avg({frame}), {k}))) / len({frame}))"


def _skew(frame: str) -> str:
    return f"""CASE WHEN len({frame}) < 3 THEN NULL WHEN {_power(frame, 2)} = 0 THEN 0
    ELSE {_power(frame, 3)} / pow({_power(frame, 2)}, 1.5)
      * sqrt(len({frame}) * (len({frame}) - 1)) / (len({frame}) - 2) END"""


def _kurt(frame: str) -> str:
    return f"""CASE WHEN len({frame}) < 4 THEN NULL WHEN {_power(frame, 2)} = 0 THEN -3
    ELSE (len({frame}) - 1.0) / ((len({frame}) - 2.0) * (len({frame}) - 3.0))
      * ((len({frame}) + 1) * ({_power(frame, 4)} / pow({_power(frame, 2)}, 2) - 3) + 6) END"""


def _frames(columns, windows) -> str:
    return listed(f"list({c}) OVER {back(n)} AS f_{c}_{n}" for c in columns for n in windows)


_pairs = [(c, n) for c in ("price", "cov1") for n in WINDOWS]
ORACLES["rolling_moments"] = f"""WITH {PRIORITY}, f AS (
  SELECT series_id, time, {_frames(('price', 'cov1'), WINDOWS)} FROM d)
SELECT {KEY},
  {listed(rnd(_skew(f'f_{c}_{n}'), 6, f'{c}_rolling_skew_{n}') for c, n in _pairs)},
  {listed(rnd(_kurt(f'f_{c}_{n}'), 6, f'{c}_rolling_kurt_{n}') for c, n in _pairs)}
FROM f"""

_pairs = [(c, n) for c in ("price", "cov1") for n in (21, 63)]
ORACLES["cut_rolling"] = f"""WITH {ALL_DAYS}, f AS (
  SELECT series_id, time, {_frames(('price', 'cov1'), (21, 63))} FROM d)
SELECT {KEY},
  {listed(rnd(f'list_median(f_{c}_{n})', 5, f'{c}_rolling_median_{n}') for c, n in _pairs)},
  {listed(rnd(_skew(f'f_{c}_{n}'), 6, f'{c}_rolling_skew_{n}') for c, n in _pairs)}
FROM f"""


def _band(n: int, sign: str) -> str:
    return f"avg(price) OVER {back(n)} {sign} 2 * stddev_samp(price) OVER {back(n)}"


ORACLES["moving_average_bands"] = f"""WITH {PRIORITY}
SELECT {KEY},
  {listed(rnd(MEAN_TO_PRICE.format(back(n)), 6, f'price_sma_{n}') for n in WINDOWS)},
  {listed(rnd(_band(n, '+'), 2, f'price_bb_upper_{n}') for n in WINDOWS)},
  {listed(rnd(_band(n, '-'), 2, f'price_bb_lower_{n}') for n in WINDOWS)},
  {listed(rnd(f'4 * stddev_samp(price) OVER {back(n)}', 2, f'price_bb_width_{n}') for n in WINDOWS)}
FROM d"""


def _rsi(n: int) -> str:
    gain, loss = (f"avg({s}) OVER {back(n)}" for s in ("gain", "loss"))
    return f"""CASE WHEN {loss} = 0 AND {gain} > 0 THEN 100 WHEN {loss} = 0 THEN NULL
    ELSE 100 - 100 / (1 + {gain} / {loss}) END"""


MOVES = f"""m AS (SELECT *, price - lag(price) OVER {SERIES} AS step FROM d),
g AS (SELECT *, CASE WHEN step > 0 THEN step ELSE 0 END AS gain,
  CASE WHEN step < 0 THEN -step ELSE 0 END AS loss FROM m)"""
ORACLES["strength_index"] = f"""WITH {PRIORITY}, {MOVES}
SELECT {KEY}, {listed(rnd(_rsi(n), 6, f'price_rsi_{n}') for n in (21, 63))} FROM g"""


def _position(n: int) -> str:
    low, high = f"min(price) OVER {back(n)}", f"max(price) OVER {back(n)}"
    return f"(price - {low}) / ({high} - {low} + 1e-8)"


def _momentum(column: str, n: int) -> str:
    return f"{column} / nullif(lag({column}, {n}) OVER {SERIES}, 0) - 1"


ORACLES["momentum_and_position"] = f"""WITH {PRIORITY}
SELECT {KEY}, {listed(rnd(_momentum('price', n), 6, f'price_momentum_{n}') for n in WINDOWS)},
  {listed(rnd(_position(n), 6, f'price_position_{n}') for n in WINDOWS)} FROM d"""


def _ema(source: str, spans) -> str:
    """Every row against its whole history."""
    beta = {n: 1 - 2 / (n + 1) for n in spans}
    means = listed(
        f"sum(b.price * pow({beta[n]!r}, a.i - b.i))"
        f" / sum(CASE WHEN b.price IS NOT NULL THEN pow({beta[n]!r}, a.i - b.i) END) AS e{n}"
        for n in spans
    )
    return f"""WITH {source}, r AS (SELECT *, row_number() OVER {SERIES} AS i FROM d),
e AS (SELECT a.series_id, a.time, {means} FROM r a JOIN r b ON a.series_id = b.series_id AND b.i <= a.i
  GROUP BY 1, 2)
SELECT {KEY}, {listed(rnd(f'e{n}', 4, f'price_ema_{n}') for n in spans)} FROM e"""


ORACLES["exponential_average"] = _ema(PRIORITY, WINDOWS)
ORACLES["cut_exponential_average"] = _ema(PRIORITY, (5, 21))
ORACLES["exponential_average_with_gaps"] = _ema(GAPS, (10,))

ORACLES["padded_momentum"] = ORACLES["cut_padded_momentum"] = f"""WITH {GAPS}, f AS (
  SELECT series_id, time, last_value(price IGNORE NULLS) OVER ({BY_TIME}
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM d)
SELECT {KEY}, {listed(rnd(_momentum('p', n), 6, f'price_momentum_{n}') for n in (5, 21))} FROM f"""

RETURN = f"price / nullif(lag(price) OVER {SERIES}, 0)"
ORACLES["returns"] = f"""WITH {PRIORITY}
SELECT {KEY}, {rnd(f'{RETURN} - 1', 6, 'price_return')}, {rnd(f'ln({RETURN})', 6, 'price_log_return')}
FROM d"""
ORACLES["returns_by_user"] = f"""WITH d AS (
  SELECT CAST(user_id AS VARCHAR) AS series_id, ts AS time, max("value") AS price FROM events GROUP BY 1, 2),
g AS (SELECT series_id, time, {RETURN} AS g FROM d)
SELECT series_id, strftime(time, '%Y-%m-%d %H:%M:%S') AS at, {rnd('g - 1', 6, 'price_return')},
  {rnd('CASE WHEN g > 0 THEN ln(g) END', 6, 'price_log_return')} FROM g"""


def _down(n: int, test: str) -> str:
    return f"stddev_samp(CASE WHEN r {test} 0 THEN r ELSE 0 END) OVER {back(n)}"


RETURNS = f"r AS (SELECT series_id, time, price, cov1, cov2, {RETURN} - 1 AS r FROM d)"
ORACLES["return_risk"] = f"""WITH {PRIORITY}, {RETURNS}, q AS (
  SELECT series_id, time,
  {listed(f'stddev_samp(r) OVER {back(n)} AS v{n}, {_down(n, "<")} AS d{n}, {_down(n, ">")} AS u{n}' for n in WINDOWS)},
  {listed(f'quantile_cont(r, 0.05) OVER {back(n)} AS q{n}, list(r) OVER {back(n)} AS l{n}' for n in WINDOWS)}
  FROM r)
SELECT {KEY},
  {listed(rnd(f'v{n}', 6, f'price_vol_cluster_{n}') for n in WINDOWS)},
  {listed(rnd(f'd{n}', 6, f'price_downside_risk_{n}') for n in WINDOWS)},
  {listed(rnd(f'u{n}', 6, f'price_upside_potential_{n}') for n in WINDOWS)},
  {listed(rnd(f'q{n}', 6, f'price_var_5_{n}') for n in WINDOWS)},
  {listed(rnd(f'list_avg(list_filter(l{n}, lambda v: v <= q{n}))', 6, f'price_cvar_5_{n}') for n in WINDOWS)}
FROM q"""

DRAWDOWN = (
    "w AS (SELECT *, " + ", ".join(f"product(1 + r) OVER {back(n)} AS w{n}" for n in WINDOWS) + " FROM r),"
    " k AS (SELECT *, " + ", ".join(f"max(w{n}) OVER {back(n)} AS k{n}" for n in WINDOWS) + " FROM w)"
)
ORACLES["drawdown"] = f"""WITH {PRIORITY}, {RETURNS}, {DRAWDOWN}
SELECT {KEY}, {listed(rnd(f'(w{n} - k{n}) / nullif(k{n}, 0)', 6, f'price_max_drawdown_{n}') for n in WINDOWS)}
FROM k"""

ORACLES["interactions"] = f"""WITH {PRIORITY}
SELECT {KEY},
  {listed(rnd(f'price * {c}', 0, f'price_x_{c}') for c in ('cov1', 'cov2'))},
  {listed(rnd(f'price / ({c} + 1e-8)', 4, f'price_ratio_{c}') for c in ('cov1', 'cov2'))},
  {listed(rnd(f'price - {c}', 2, f'price_diff_{c}') for c in ('cov1', 'cov2'))} FROM d"""


def _corr(c: str, n: int) -> str:
    spread = f"(stddev_samp(price) OVER {back(n)} * stddev_samp({c}) OVER {back(n)})"
    return f"covar_samp(price, {c}) OVER {back(n)} / nullif({spread}, 0)"


ORACLES["rolling_correlation"] = f"""WITH {PRIORITY}
SELECT {KEY},
  {listed(rnd(_corr(c, n), 6, f'price_corr_{c}_{n}') for c in ('cov1', 'cov2') for n in (21, 63))} FROM d"""

ORACLES["change_interactions"] = f"""WITH {PRIORITY}, {RETURNS}
SELECT {KEY}, {rnd('r * cov1', 6, 'change_x_cov1')}, {rnd('r / (cov1 + 1e-8)', 6, 'change_ratio_cov1')},
  {rnd('r - cov1', 6, 'change_diff_cov1')} FROM r"""


def _circle(name: str, part: str, length: str) -> str:
    angle = f"2 * pi() * {part} / {length}"
    return f"{rnd(f'sin({angle})', 6, name + '_sin')}, {rnd(f'cos({angle})', 6, name + '_cos')}"


ORACLES["calendar"] = f"""WITH {PRIORITY}, c AS (SELECT series_id, time, CAST(time AS DATE) AS t FROM d)
SELECT {KEY}, year(t) AS year, month(t) AS month, day(t) AS day_of_month, isodow(t) - 1 AS day_of_week,
  dayofyear(t) AS day_of_year, weekofyear(t) AS week_of_year, quarter(t) AS quarter,
  {_circle('month', 'month(t)', '12')}, {_circle('day_of_week', '(isodow(t) - 1)', '7')},
  {_circle('day_of_year', 'dayofyear(t)', '365.25')},
  CAST(day(t) = 1 AS INT) AS is_month_start, CAST(t = last_day(t) AS INT) AS is_month_end,
  CAST(t = date_trunc('quarter', t) AS INT) AS is_quarter_start,
  CAST(t = date_trunc('quarter', t) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS INT) AS is_quarter_end,
  CAST(t = date_trunc('year', t) AS INT) AS is_year_start,
  CAST(month(t) = 12 AND day(t) = 31 AS INT) AS is_year_end FROM c"""

LATER = f"lead(price, 2) OVER {SERIES}"
ORACLES["targets"] = f"""WITH {PRIORITY}
SELECT {KEY}, {rnd(f'{LATER} / nullif(price, 0) - 1', 6, 'target_return')},
  {rnd(f'ln({LATER} / nullif(price, 0))', 6, 'target_log_return')}, {rnd(LATER, 2, 'target_price')} FROM d"""

ORACLES["feature_rows"] = f"""WITH {PRIORITY}, {MOVES}, a AS (
  SELECT series_id, time, lag(price, 21) OVER {SERIES} AS lag21, {_rsi(21)} AS rsi,
    avg(cov1) OVER {back(10)} AS c10, {_corr('cov1', 21)} AS x1, {_corr('cov1', 63)} AS x2,
    {_corr('cov2', 21)} AS x3, {_corr('cov2', 63)} AS x4,
    lead(price) OVER {SERIES} / price - 1 AS target FROM g),
k AS (SELECT * FROM a WHERE lag21 IS NOT NULL AND rsi IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL
  AND x3 IS NOT NULL AND x4 IS NOT NULL AND target IS NOT NULL)
SELECT series_id, count(*) AS complete_rows, min(CAST(CAST(time AS DATE) AS VARCHAR)) AS first_day,
  max(CAST(CAST(time AS DATE) AS VARCHAR)) AS last_day, round(avg(lag21), 2) AS mean_lag_21,
  round(avg(c10), 6) AS mean_cov1_10, round(avg(rsi), 6) AS mean_rsi, round(avg(x4), 6) AS mean_corr,
  round(avg(target), 6) AS mean_target FROM k GROUP BY series_id HAVING count(*) >= 42"""

# 21 days need what `feature_rows` needs; 63 and 126 share their inputs, and need the prices and covariates 63 days back as well.
ORACLES["feature_lookbacks"] = f"""WITH {PRIORITY}, {MOVES}, a AS (
  SELECT series_id, time, lag(price, 21) OVER {SERIES} AS lag21, {_rsi(21)} AS rsi, {_rsi(63)} AS rsi63,
    {_momentum('price', 63)} AS momentum, avg(cov1) OVER {back(10)} AS c10, {_corr('cov1', 21)} AS x1,
    {_corr('cov1', 63)} AS x2, {_corr('cov2', 21)} AS x3, {_corr('cov2', 63)} AS x4,
    lead(price) OVER {SERIES} / price - 1 AS target FROM g),
k AS (SELECT *, lookback FROM a, (VALUES (21, 167), (63, 208), (126, 208)) AS l(lookback, inputs)
  WHERE lag21 IS NOT NULL AND rsi IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL
  AND x4 IS NOT NULL AND target IS NOT NULL AND (lookback = 21 OR momentum IS NOT NULL AND rsi63 IS NOT NULL))
SELECT series_id, lookback, count(*) AS complete_rows, min(CAST(CAST(time AS DATE) AS VARCHAR)) AS first_day,
  max(CAST(CAST(time AS DATE) AS VARCHAR)) AS last_day, round(avg(lag21), 2) AS mean_lag_21,
  round(avg(c10), 6) AS mean_cov1_10, round(avg(rsi), 6) AS mean_rsi, round(avg(x4), 6) AS mean_corr,
  round(avg(target), 6) AS mean_target, any_value(inputs) AS inputs FROM k
GROUP BY series_id, lookback HAVING count(*) >= 2 * lookback"""

# Five days need five lags, the correlations over 21 and 63 days, and a step of the price.
ORACLES["stored_feature_rows"] = f"""WITH {PRIORITY}, {MOVES}, a AS (
  SELECT series_id, time, lag(price, 5) OVER {SERIES} AS lag5, lag(price, 21) OVER {SERIES} AS lag21, {_rsi(21)} AS rsi,
    {_corr('cov1', 21)} AS x1, {_corr('cov1', 63)} AS x2, {_corr('cov2', 21)} AS x3, {_corr('cov2', 63)} AS x4,
    {_corr('cov1', 5)} AS x5, lead(price) OVER {SERIES} / price - 1 AS target FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id, lookback ORDER BY time) - 1 AS idx,
    count(*) OVER (PARTITION BY series_id, lookback) AS n FROM a, (VALUES (5), (21)) AS l(lookback)
  WHERE lag5 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL AND x4 IS NOT NULL
    AND target IS NOT NULL AND (lookback = 5 OR lag21 IS NOT NULL AND rsi IS NOT NULL))
SELECT series_id, lookback, count(*) AS complete_rows, min(CAST(CAST(time AS DATE) AS VARCHAR)) AS first_day,
  max(CAST(CAST(time AS DATE) AS VARCHAR)) AS last_day, round(avg(lag5), 2) AS mean_lag_5,
  round(avg(target), 6) AS mean_target FROM k WHERE n >= 2 * lookback AND (lookback = 5 OR idx * 2 >= n)
GROUP BY series_id, lookback"""

ORACLES["feature_set_all_days"] = f"""WITH {ALL_DAYS}, {RETURNS}, {DRAWDOWN}, a AS (
  SELECT series_id, time, quarter(time) AS quarter, lag(price, 21) OVER {SERIES} AS lag21,
    {_momentum('price', 63)} AS momentum, quantile_cont(cov1, 0.5) OVER {back(63)} AS median,
    (w63 - k63) / k63 AS drawdown, {_corr('cov1', 21)} AS x1, {_corr('cov1', 63)} AS x2,
    {_corr('cov2', 21)} AS x3, {_corr('cov2', 63)} AS x4, ln(lead(price) OVER {SERIES} / price) AS target
  FROM k)
SELECT {KEY}, quarter, {rnd('lag21', 2, 'price_lag_21')}, {rnd('momentum', 6, 'price_momentum_63')},
  {rnd('median', 5, 'cov1_rolling_median_63')}, {rnd('drawdown', 6, 'price_max_drawdown_63')},
  {rnd('x2', 6, 'price_corr_cov1_63')}, {rnd('target', 6, 'target')}
FROM a WHERE momentum IS NOT NULL AND target IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL
  AND x3 IS NOT NULL AND x4 IS NOT NULL"""

ORACLES["sufficient_series"] = f"""WITH {SUPPLIER}, c AS (
  SELECT series_id, count(*) AS "rows" FROM d GROUP BY series_id)
SELECT series_id, "rows", lookback FROM c, (VALUES (21), (63), (126), (252)) AS l(lookback)
WHERE "rows" >= 2 * lookback"""

# Folds and closed-form models


def _folded(table: str) -> str:
    """Rows of ``table`` with idx and n, joined to the folds they belong to."""
    return f"""p AS (SELECT *, row_number() OVER {SERIES} - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n
  FROM {table}),
f AS (SELECT p.*, k.fold, idx < k.fold * 31 + 126 AS is_train FROM p
  JOIN (SELECT unnest(range(0, 400)) AS fold) k
  ON idx >= k.fold * 31 AND idx < k.fold * 31 + 157 AND k.fold * 31 + 157 < n AND n >= 252)"""


ORACLES["fold_members"] = f"""WITH {PRIORITY}, {_folded('d')}
SELECT {KEY}, idx, fold, is_train FROM f"""
ORACLES["cut_fold_sizes"] = f"""WITH {ALL_DAYS}, {_folded('d')}
SELECT series_id, fold, is_train, count(*) AS members, min(idx) AS first_idx, max(idx) AS last_idx
FROM f GROUP BY 1, 2, 3"""

INPUT = f"""i0 AS (SELECT series_id, time, ln(price / lag(price) OVER {SERIES}) AS x,
  ln(lead(price) OVER {SERIES} / price) AS y FROM d),
i AS (SELECT * FROM i0 WHERE x IS NOT NULL AND y IS NOT NULL)"""
SCALED = """c AS (SELECT series_id, fold, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my,
  covar_pop(x, y) AS cxy, count(*) AS m, quantile_cont(y, 0.5) AS q FROM f WHERE is_train GROUP BY 1, 2),
z AS (SELECT f.series_id, f.fold, f.idx, f.is_train, f.n, f.y, (f.x - mx) / sx AS z, my, cxy / sx AS b, m, q
  FROM f JOIN c USING (series_id, fold))"""


def _inputs(source: str) -> str:
    return f"{source}, {INPUT}, {_folded('i')}, {SCALED}"


ORACLES["fold_scaling"] = f"""WITH {_inputs(ALL_DAYS)}
SELECT series_id, fold, is_train, idx, {rnd('z', 6, 'x_scaled')} FROM z"""


def _soft(cut: float) -> str:
    return f"sign(b) * greatest(abs(b) - {cut!r}, 0)"


def _closed(alpha: float) -> dict[str, str]:
    return {
        "Mean": "my",
        "OLS": "my + b * z",
        "Ridge": f"my + m * b / (m + {alpha!r}) * z",
        "Lasso": f"my + {_soft(alpha)} * z",
        "ElasticNet": f"my + {_soft(alpha / 2)} / {1 + alpha / 2!r} * z",
        "QuantileRegressor": "q",
    }


def _models(lines: dict[str, str]) -> str:
    return "h AS (" + "\nUNION ALL ".join(
        f"SELECT series_id, fold, idx, '{m}' AS model, y AS target, {e} AS prediction FROM z WHERE NOT is_train"
        for m, e in lines.items()
    ) + ")"


PREDICTED = f"{_inputs(PRIORITY)}, {_models(_closed(0.05))}"
SHOWN = f"{rnd('target', 6, 'target')}, {rnd('prediction', 6, 'prediction')}"
ORACLES["closed_form_predictions"] = f"""WITH {PREDICTED}
SELECT series_id, fold, idx, model, {SHOWN} FROM h"""

ERROR = "(target - prediction)"


def _pinball(q: float) -> str:
    return f"avg(greatest({ERROR} * {q}, {ERROR} * ({q} - 1.0)))"


MEASURES = {
    "mae": f"avg(abs({ERROR}))",
    "mse": f"avg({ERROR} * {ERROR})",
    "rmse": f"sqrt(avg({ERROR} * {ERROR}))",
    "median_ae": f"quantile_cont(abs({ERROR}), 0.5)",
    "q90_ae": f"quantile_cont(abs({ERROR}), 0.9)",
    "huber_loss": f"avg(CASE WHEN abs({ERROR}) <= 1.35 THEN 0.5 * {ERROR} * {ERROR}"
    f" ELSE 1.35 * abs({ERROR}) - 0.5 * 1.35 * 1.35 END)",
    "quantile_loss_10": _pinball(0.1),
    "quantile_loss_90": _pinball(0.9),
    "directional_accuracy": "CASE WHEN count(*) > 1"
    " THEN avg(CASE WHEN sign(target) = sign(prediction) THEN 1.0 ELSE 0.0 END) ELSE 0.0 END",
    "information_coefficient": "CASE WHEN max(prediction) = min(prediction) THEN 0.0 ELSE"
    " coalesce(covar_pop(target, prediction) / nullif(stddev_pop(target) * stddev_pop(prediction), 0), 0) END",
    "mape": f"avg(abs({ERROR} / nullif(target, 0)))",
}
MEASURED = (
    "e AS (SELECT series_id, model, fold, "
    + listed(f"{e} AS {n}" for n, e in MEASURES.items())
    + " FROM h GROUP BY 1, 2, 3)"
)
ORACLES["fold_metrics"] = f"""WITH {PREDICTED}, {MEASURED}
SELECT series_id, model, fold, {listed(rnd(n, 6, n) for n in MEASURES)} FROM e"""
ORACLES["pooled_metrics"] = f"""WITH {PREDICTED}
SELECT model, {listed(rnd(MEASURES[n], 6, n) for n in ('mae', 'median_ae', 'q90_ae', 'mape'))} FROM h GROUP BY 1"""
ORACLES["rmse_mae"] = f"""WITH {PREDICTED}
SELECT round({MEASURES['rmse']}, 6) AS rmse, round({MEASURES['mae']}, 6) AS mae FROM h WHERE model = 'OLS'"""

# The error to beat per model at lookback 21, 63, 126.
TO_BEAT = {
    "OLS": (0.025050, 0.020837, 0.018284),
    "Ridge": (0.024659, 0.020573, 0.018098),
    "Lasso": (0.024659, 0.020573, 0.018098),
    "ElasticNet": (0.024659, 0.020573, 0.018098),
    "QuantileRegressor": (0.023000, 0.019500, 0.017000),
}


def _beat(factor: float) -> str:
    rows = ", ".join(
        f"('{m}', {n}, {factor * v!r})" for m, vs in TO_BEAT.items() for n, v in zip((21, 63, 126), vs)
    )
    return f"t(model, lookback, baseline_mae) AS (VALUES {rows})"


AVERAGED = ("rmse", "directional_accuracy", "information_coefficient", "huber_loss", "median_ae", "q90_ae")
RESULTS = f"""a AS (SELECT series_id, model, count(*) AS n_folds, avg(mae) AS avg_mae, stddev_pop(mae) AS std_mae,
  {listed(f'avg({m}) AS avg_{m}' for m in AVERAGED)} FROM e GROUP BY 1, 2),
{_beat(40)},
s AS (SELECT a.*, lookback, CAST(baseline_mae AS DOUBLE) AS baseline_mae, avg_mae < baseline_mae AS beats_baseline,
  (baseline_mae - avg_mae) / baseline_mae * 100 AS improvement FROM a JOIN t USING (model))"""
ORACLES["model_results"] = f"""WITH {PREDICTED}, {MEASURED}, {RESULTS}
SELECT series_id, model, lookback, n_folds, beats_baseline, {rnd('avg_mae', 6, 'avg_mae')},
  {rnd('std_mae', 6, 'std_mae')}, {rnd('baseline_mae', 6, 'baseline_mae')}, {rnd('improvement', 6, 'improvement')},
  {listed(rnd(f'avg_{m}', 6, f'avg_{m}') for m in AVERAGED)},
  CAST(0 AS DOUBLE) AS avg_prediction_std, CAST(0 AS DOUBLE) AS avg_prediction_uncertainty FROM s"""
ORACLES["result_totals"] = f"""WITH {PREDICTED}, {MEASURED}, {RESULTS}
SELECT lookback, count(*) AS total_models, count(*) FILTER (WHERE beats_baseline) AS beating_baseline,
  round(count(*) FILTER (WHERE beats_baseline) / count(*), 6) AS success_rate FROM s GROUP BY ROLLUP (lookback)"""
ORACLES["winning_rows"] = f"""WITH {PREDICTED}, {MEASURED}, {RESULTS}
SELECT s.series_id, s.model, s.lookback, count(*) AS test_rows FROM s JOIN h USING (series_id, model)
WHERE beats_baseline GROUP BY 1, 2, 3"""
ORACLES["comparison_matrix"] = f"""WITH {PREDICTED}, {MEASURED}, {RESULTS}
SELECT series_id, model,
  {listed(f'round(max(CASE WHEN lookback = {n} THEN avg_mae END), 6) AS mae_{n}' for n in (21, 63, 126))}
FROM s GROUP BY 1, 2"""
ORACLES["error_histogram"] = f"""WITH {PREDICTED}
SELECT series_id, model, CAST(CASE WHEN {ERROR} < -2 THEN 0 WHEN {ERROR} >= 2 THEN 9
  ELSE floor(({ERROR} + 2) / 0.5) + 1 END AS INT) AS bin, count(*) AS errors FROM h GROUP BY 1, 2, 3"""

PAST = f"({BY_TIME} ROWS BETWEEN 126 PRECEDING AND 1 PRECEDING)"
ORACLES["one_step_forecasts"] = f"""WITH {PRIORITY},
g AS (SELECT series_id, time, ln(price / lag(price) OVER {SERIES}) AS y FROM d),
x AS (SELECT *, lag(y) OVER {SERIES} AS x FROM g), k AS (SELECT * FROM x WHERE x IS NOT NULL AND y IS NOT NULL),
l AS (SELECT series_id, time, x, y, count(*) OVER {PAST} AS n, avg(x) OVER {PAST} AS mx, avg(y) OVER {PAST} AS my,
  covar_pop(x, y) OVER {PAST} / nullif(var_pop(x) OVER {PAST}, 0) AS b FROM k)
SELECT {KEY}, {rnd('y', 6, 'target')}, {rnd('my + b * (x - mx)', 6, 'prediction')} FROM l WHERE n = 126"""

ORACLES["ensemble_average"] = f"""WITH {PREDICTED}
SELECT series_id, fold, idx, {rnd('max(target)', 6, 'target')}, {rnd('avg(prediction)', 6, 'prediction')}
FROM h GROUP BY 1, 2, 3"""
ORACLES["ensemble_weighted"] = f"""WITH {PREDICTED}, {MEASURED},
v AS (SELECT series_id, model, fold, coalesce(1 / avg(mae) OVER (PARTITION BY series_id, model ORDER BY fold
  ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 1) AS w FROM e)
SELECT series_id, fold, idx, {rnd('max(target)', 6, 'target')},
  {rnd('sum(w * prediction) / sum(w)', 6, 'prediction')} FROM h JOIN v USING (series_id, model, fold)
GROUP BY 1, 2, 3"""

# Grouped solvers on one input

_solver = {m: e for m, e in _closed(0.05).items() if m != "Mean"}
ORACLES["solver_predictions"] = f"""WITH {_inputs(PRIORITY)}, {_models(_solver)}
SELECT series_id, fold, idx, model, {SHOWN} FROM h"""
ORACLES["custom_model"] = f"""WITH {_inputs(PRIORITY)}
SELECT series_id, fold, idx, round(my, 6) AS prediction FROM z WHERE NOT is_train"""

_grid = {f"Ridge(alpha={a!r})": f"my + m * b / (m + {a!r}) * z" for a in (0.1, 1.0, 10.0, 100.0)}
ORACLES["tuned_ridge"] = f"""WITH {_inputs(PRIORITY)},
{_models(_grid).replace('WHERE NOT is_train', 'WHERE NOT is_train AND fold * 31 + 157 <= 0.2 * n')},
e AS (SELECT series_id, model, fold, avg(abs{ERROR}) AS mae FROM h GROUP BY 1, 2, 3),
a AS (SELECT series_id, model, avg(mae) AS avg_mae FROM e GROUP BY 1, 2)
SELECT series_id, arg_min(model, avg_mae) AS best, round(min(avg_mae), 6) AS avg_mae FROM a GROUP BY 1"""

# The same choice, then the folds whose test rows lie behind the first fifth.
ORACLES["tuned_ridge_applied"] = f"""WITH {_inputs(PRIORITY)}, {_models(_grid).replace('SELECT series_id', 'SELECT n, series_id')},
e AS (SELECT series_id, model, fold, any_value(n) AS n, avg(abs{ERROR}) AS mae FROM h GROUP BY 1, 2, 3),
a AS (SELECT series_id, model, avg(mae) AS avg_mae FROM e WHERE fold * 31 + 157 <= 0.2 * n GROUP BY 1, 2),
b AS (SELECT series_id, arg_min(model, avg_mae) AS model FROM a GROUP BY 1)
SELECT series_id, model AS best, count(*) AS n_folds, round(avg(mae), 6) AS avg_mae FROM e JOIN b USING (series_id, model)
WHERE fold * 31 + 126 >= 0.2 * n GROUP BY 1, 2"""

# A best line passes through two train rows, or is flat at a train target: all are tried.
ORACLES["quantile_predictions"] = f"""WITH {_inputs(ALL_DAYS)},
r AS (SELECT series_id, fold, z, y, row_number() OVER (PARTITION BY series_id, fold ORDER BY idx) AS i FROM z WHERE is_train),
lines AS (SELECT p.series_id, p.fold, (o.y - p.y) / (o.z - p.z) AS b, p.y - p.z * (o.y - p.y) / (o.z - p.z) AS c
  FROM r p JOIN r o ON p.series_id = o.series_id AND p.fold = o.fold AND p.i < o.i AND p.z <> o.z
  UNION ALL SELECT series_id, fold, 0.0, y FROM r),
loss AS (SELECT l.series_id, l.fold, l.b, l.c,
  avg(greatest(0.7 * (r.y - l.c - l.b * r.z), -0.3 * (r.y - l.c - l.b * r.z))) + 0.05 * abs(l.b) AS loss
  FROM lines l JOIN r ON l.series_id = r.series_id AND l.fold = r.fold GROUP BY 1, 2, 3, 4),
best AS (SELECT series_id, fold, arg_min(b, loss) AS slope, arg_min(c, loss) AS c FROM loss GROUP BY 1, 2)
SELECT series_id, fold, idx, {rnd('y', 6, 'target')}, {rnd('best.c + best.slope * z.z', 6, 'prediction')}
FROM z JOIN best USING (series_id, fold) WHERE NOT is_train"""

ORACLES["kept_models"] = f"""WITH {PRIORITY}, i0 AS (
  SELECT series_id, time, ln(price / lag(price) OVER {SERIES}) AS x1, cov1 AS x2,
    ln(lead(price) OVER {SERIES} / price) AS y FROM d),
i AS (SELECT *, row_number() OVER {SERIES} - 1 AS idx FROM i0 WHERE x1 IS NOT NULL AND y IS NOT NULL),
s AS (SELECT series_id, count(*) AS n, avg(y) AS my, corr(x1, x2) AS r, avg(x1) AS m1, avg(x2) AS m2,
  stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, covar_pop(x1, y) / stddev_pop(x1) AS c1,
  covar_pop(x2, y) / stddev_pop(x2) AS c2 FROM i GROUP BY 1),
m AS (SELECT *, 'OLS' AS model, 0.0 AS a FROM s UNION ALL SELECT *, 'Ridge(alpha=50)', 50.0 FROM s),
b AS (SELECT *, ((1 + a / n) * c1 - r * c2) / (pow(1 + a / n, 2) - r * r) AS b1,
  ((1 + a / n) * c2 - r * c1) / (pow(1 + a / n, 2) - r * r) AS b2 FROM m)
SELECT i.series_id, model, CAST(idx AS INT) AS idx, {rnd('y', 6, 'target')},
  {rnd('my + b1 * (x1 - m1) / s1 + b2 * (x2 - m2) / s2', 6, 'prediction')} FROM i JOIN b USING (series_id)"""

ORACLES["history_models"] = f"""WITH {PRIORITY}, i0 AS (
  SELECT series_id, ln(price / lag(price) OVER {SERIES}) AS x1, cov1 AS x2,
    ln(lead(price) OVER {SERIES} / price) AS y FROM d),
s AS (SELECT series_id, count(*) AS n, avg(y) AS my, quantile_cont(y, 0.5) AS q, corr(x1, x2) AS r,
  covar_pop(x1, y) / stddev_pop(x1) AS c1, covar_pop(x2, y) / stddev_pop(x2) AS c2
  FROM i0 WHERE x1 IS NOT NULL AND y IS NOT NULL GROUP BY 1),
m AS (SELECT series_id, 'OLS' AS model, my AS c, (c1 - r * c2) / (1 - r * r) AS b1,
    (c2 - r * c1) / (1 - r * r) AS b2 FROM s
  UNION ALL SELECT series_id, 'Ridge', my, ((1 + 1 / n) * c1 - r * c2) / (pow(1 + 1 / n, 2) - r * r),
    ((1 + 1 / n) * c2 - r * c1) / (pow(1 + 1 / n, 2) - r * r) FROM s
  UNION ALL SELECT series_id, 'QuantileRegressor', q, 0.0, 0.0 FROM s)
SELECT series_id, model, {rnd('c', 6, 'intercept')}, {rnd('b1', 6, 'b1')}, {rnd('b2', 6, 'b2')} FROM m"""

# Autoregression and sequences


def _steps(source: str) -> str:
    return f"""{source}, s0 AS (SELECT series_id, time, price, price - lag(price) OVER {SERIES} AS s FROM d),
s1 AS (SELECT *, lag(s) OVER {SERIES} AS b FROM s0),
k AS (SELECT series_id, sum(s * b) / sum(b * b) AS phi, count(*) FILTER (WHERE b IS NOT NULL) AS n,
  arg_max(price, time) AS last_price, arg_max(s, time) AS last_step FROM s1 GROUP BY 1)"""


_path = " + ".join(f"CASE WHEN step >= {j} THEN pow(phi, {j}) ELSE 0 END" for j in range(1, 6))
ORACLES["autoregression_forecast"] = f"""WITH {_steps(PRIORITY)}
SELECT series_id, step, round(last_price + last_step * ({_path}), 2) AS forecast
FROM k, (VALUES (1), (2), (3), (4), (5)) AS t(step)"""
ORACLES["cut_autoregression"] = f"""WITH {_steps(ALL_DAYS)}
SELECT series_id, n, round(phi, 6) AS phi FROM k"""
ORACLES["autoregression_level"] = f"""WITH {PRIORITY}, q AS (SELECT series_id, price, lag(price) OVER {SERIES} AS before FROM d)
SELECT series_id, regr_count(price, before) AS n, round(regr_slope(price, before), 6) AS phi,
  round(regr_intercept(price, before), 2) AS intercept FROM q GROUP BY series_id"""


def _sequence(length: int) -> str:
    frame = f"({BY_TIME} ROWS BETWEEN {length} PRECEDING AND 1 PRECEDING)"
    return f"list(price) OVER {frame} AS l"


SEQUENCE_TEXT = "array_to_string(list_transform(l, lambda v: CAST(CAST(round(v, 0) AS BIGINT) AS VARCHAR)), ',')"
ORACLES["value_sequences"] = f"""WITH {PRIORITY}, q AS (SELECT series_id, time, price, {_sequence(10)} FROM d)
SELECT {KEY}, {SEQUENCE_TEXT} AS sequence, round(price, 2) AS y FROM q WHERE len(l) = 10"""

SPLIT = f"""n AS (SELECT *, row_number() OVER {SERIES} - 1 < floor(count(*) OVER (PARTITION BY series_id) * 0.8)
  AS early FROM d)"""
ORACLES["min_max_scaling"] = f"""WITH {PRIORITY}, {SPLIT},
m AS (SELECT series_id, min(price) AS low, max(price) AS high FROM n WHERE early GROUP BY 1)
SELECT {KEY}, {rnd('(price - low) / (high - low)', 6, 'price_scaled')}, {rnd('price', 2, 'price_scaled_restored')}
FROM n JOIN m USING (series_id) WHERE NOT early"""
ORACLES["held_out_sequences"] = f"""WITH {PRIORITY}, {SPLIT},
q AS (SELECT series_id, time, price, early, {_sequence(5)} FROM n)
SELECT {KEY}, {SEQUENCE_TEXT} AS sequence, round(price, 2) AS y FROM q WHERE NOT early"""

# Flagship

ORACLES["walk_forward_report"] = f"""WITH {_inputs(ALL_DAYS)},
{_models({'Lasso': _closed(1.0)['Lasso']})},
e AS (SELECT series_id, model, fold, avg(abs{ERROR}) AS mae FROM h GROUP BY 1, 2, 3),
a AS (SELECT series_id, model, count(*) AS n_folds, avg(mae) AS avg_mae, stddev_pop(mae) AS std_mae FROM e GROUP BY 1, 2),
{_beat(1)}
SELECT series_id, model, lookback, n_folds, round(avg_mae, 6) AS avg_mae, round(std_mae, 6) AS std_mae,
  round(CAST(baseline_mae AS DOUBLE), 6) AS baseline_mae, avg_mae < baseline_mae AS beats_baseline,
  round((baseline_mae - avg_mae) / baseline_mae * 100, 4) AS improvement FROM a JOIN t USING (model)"""

# The complete rows of the lookbacks, the mean and the median of each train block, and their errors on the test block.
ORACLES["path_to_summary"] = f"""WITH {ALL_DAYS}, {MOVES}, a AS (
  SELECT series_id, time, lag(price, 21) OVER {SERIES} AS lag21, {_rsi(21)} AS rsi, {_rsi(63)} AS rsi63,
    {_momentum('price', 63)} AS momentum, {_corr('cov1', 21)} AS x1, {_corr('cov1', 63)} AS x2,
    {_corr('cov2', 21)} AS x3, {_corr('cov2', 63)} AS x4, ln(lead(price) OVER {SERIES} / price) AS y FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id, lookback ORDER BY time) - 1 AS idx,
    count(*) OVER (PARTITION BY series_id, lookback) AS n FROM a, (VALUES (21), (63)) AS l(lookback)
  WHERE lag21 IS NOT NULL AND rsi IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL
  AND x4 IS NOT NULL AND y IS NOT NULL AND (lookback = 21 OR momentum IS NOT NULL AND rsi63 IS NOT NULL)),
f AS (SELECT k.*, q.fold, idx < q.fold * 31 + 126 AS is_train FROM k JOIN (SELECT unnest(range(0, 400)) AS fold) q
  ON idx >= q.fold * 31 AND idx < q.fold * 31 + 157 AND q.fold * 31 + 157 < n AND n >= 252),
c AS (SELECT series_id, lookback, fold, avg(y) AS mean, quantile_cont(y, 0.5) AS median FROM f WHERE is_train GROUP BY 1, 2, 3),
e AS (SELECT series_id, lookback, fold, model, avg(abs(y - CASE model WHEN 'Lasso' THEN mean ELSE median END)) AS mae
  FROM f JOIN c USING (series_id, lookback, fold), (VALUES ('Lasso'), ('QuantileRegressor')) AS m(model)
  WHERE NOT is_train GROUP BY 1, 2, 3, 4),
s AS (SELECT series_id, lookback, model, count(*) AS n_folds, avg(mae) AS avg_mae, stddev_pop(mae) AS std_mae FROM e GROUP BY 1, 2, 3),
t AS (SELECT s.*, 40 * CAST(to_beat AS DOUBLE) AS baseline_mae FROM s JOIN (VALUES
  {', '.join(f"('{m}', {n}, {TO_BEAT[m][i]})" for m in ('Lasso', 'QuantileRegressor') for i, n in enumerate((21, 63)))}) AS v(model, lookback, to_beat)
  USING (model, lookback))
SELECT series_id, lookback, model, n_folds, avg_mae < baseline_mae AS beats_baseline, round(avg_mae, 6) AS avg_mae,
  round(std_mae, 6) AS std_mae, round(baseline_mae, 6) AS baseline_mae, count(*) OVER (PARTITION BY lookback) AS total_models,
  count(*) FILTER (WHERE avg_mae < baseline_mae) OVER (PARTITION BY lookback) AS beating_baseline FROM t"""

# Fits that iterate have no closed form; the queries test the conditions of the minimum, which must hold for each series.
ORACLES["robust_history_conditions"] = f"""WITH {PRIORITY}, i AS (
  SELECT series_id, ln(price / lag(price) OVER {SERIES}) AS x, ln(lead(price) OVER {SERIES} / price) AS y FROM d)
SELECT series_id, model, count(*) AS "rows", true AS is_minimum FROM i, (VALUES ('RobustElasticNet'), ('RobustLasso')) AS m(model)
WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2"""
ORACLES["autoregression_conditions"] = f"""WITH {SUPPLIER}, s AS (
  SELECT series_id, row_number() OVER {SERIES} AS i FROM d)
SELECT series_id, count(*) AS "rows", true AS all_used, true AS is_minimum FROM s WHERE i > 6 GROUP BY 1"""
