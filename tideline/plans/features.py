"""Feature sets per lookback, and every feature family as a function of its own."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.scalars import running
from tideline.operators.calendar import calendar
from tideline.operators.ema import history_rows, with_ema
from tideline.operators.interactions import CORRELATION_WINDOWS, interactions
from tideline.operators.lags import lags
from tideline.operators.layout import Layout, Series, lay_out, number_valid_rows
from tideline.operators.parts import Step, attach, attach_array
from tideline.operators.returns import returns
from tideline.operators.rolling import rolling
from tideline.operators.storage import materialize, write_once
from tideline.operators.target import target
from tideline.operators.technical import technical

logger = logging.getLogger(__name__)

# Lookbacks, lags and windows of a feature set.
LOOKBACKS = (21, 63, 126)
LAGS = (1, 5, 10, 21)
WINDOWS = (5, 10, 21, 63)
NOT_FEATURES = ("time", "date")


def value_columns(df: DataFrame, series: Series = Series()) -> list[str]:
    """Numeric columns that features are made from."""
    skipped = {*series.keys, series.time, *NOT_FEATURES}
    return [
        f.name
        for f in df.schema
        if f.name not in skipped and isinstance(f.dataType, T.NumericType)
    ]


def _present(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """Columns that exist; the others are reported and skipped."""
    found = []
    for c in columns:
        if c in df.columns:
            found.append(c)
        else:
            logger.warning("column %s not found, skipped", c)
    return found


def _reach(lag_list: Sequence[int], windows: Sequence[int], ema: bool) -> int:
    """Rows a feature may look back: a window over a window over a return."""
    longest = max([*windows, 1])
    back = max([2 * longest + 2, *lag_list])
    return max(back, history_rows(longest) + 1) if ema else back


def _run(
    df: DataFrame, layout: Layout, steps: Sequence[Step], before: int, after: int = 0
) -> DataFrame:
    return layout.own(attach(layout.spread(df, before, after), steps))


def create_lagged_features(
    df: DataFrame, columns: Sequence[str], offsets: Sequence[int], series: Series = Series()
) -> DataFrame:
    found, layout = _present(df, columns), lay_out(df, series)
    return _run(df, layout, [lags(found, offsets, layout.window())], max([*offsets, 0]))


def create_rolling_statistics(
    df: DataFrame, columns: Sequence[str], windows: Sequence[int], series: Series = Series()
) -> DataFrame:
    found, layout = _present(df, columns), lay_out(df, series)
    last = len(found) - 1
    steps = [rolling(c, windows, layout, last - i) for i, c in enumerate(found)]
    return _run(df, layout, steps, max([*windows, 0]))


def create_technical_indicators(
    df: DataFrame,
    price_col: str,
    windows: Sequence[int],
    series: Series = Series(),
    fill: str | None = None,
) -> DataFrame:
    if not _present(df, [price_col]):
        return df
    layout = lay_out(df, series, carry=[price_col])
    rows = layout.spread(df, _reach([], windows, ema=True))
    spread = rows.columns
    rows, filled = _fill(rows, price_col, layout, fill)
    rows = with_ema(rows, price_col, windows, layout, variant=1)
    step = technical(price_col, windows, layout.window(), filled)
    return layout.own(attach(rows, [step]).select(*spread, *step.features))


def create_returns_and_volatility(
    df: DataFrame, price_col: str, windows: Sequence[int], series: Series = Series()
) -> DataFrame:
    if not _present(df, [price_col]):
        return df
    layout = lay_out(df, series)
    step = returns(price_col, windows, layout.window())
    return _run(df, layout, [step], _reach([], windows, ema=False))


def create_interaction_features(
    df: DataFrame, price_col: str, other_cols: Sequence[str], series: Series = Series()
) -> DataFrame:
    if not _present(df, [price_col]):
        return df
    found, layout = _present(df, other_cols), lay_out(df, series)
    last = len(found) - 1
    steps = [interactions(price_col, c, layout.window(last - i)) for i, c in enumerate(found)]
    return _run(df, layout, steps, max(CORRELATION_WINDOWS))


def create_calendar_features(df: DataFrame, date_col: str = "time") -> DataFrame:
    """Row-wise: no window, no shuffle."""
    if not _present(df, [date_col]):
        return df
    return attach(df, [calendar(date_col, df.schema[date_col].dataType.simpleString())])


def create_target_variable(
    df: DataFrame,
    price_col: str,
    target_type: str = "return",
    horizon: int = 1,
    series: Series = Series(),
) -> DataFrame:
    if not _present(df, [price_col]):
        return df
    layout = lay_out(df, series)
    step = target(price_col, layout.window(), target_type, horizon)
    return _run(df, layout, [step], 0, horizon)


def _fill(rows: DataFrame, price: str, layout: Layout, fill: str | None):
    if fill is None:
        return rows, None
    if fill != "pad":
        raise ValueError(f"unknown fill {fill!r}, use None or 'pad'")
    return rows.withColumn("_filled", layout.filled(price)), "_filled"


def clip(values: Iterable[int], lookback: int) -> list[int]:
    return [v for v in values if v <= lookback]


@dataclass(frozen=True)
class FeatureSet:
    """Rows of one lookback: keys, time, ``x``, ``target``, ``idx``, ``rows``.

    ``x`` holds the values of ``names`` in order. ``wide`` spells them out.
    """

    rows: DataFrame
    names: tuple[str, ...]
    integers: frozenset[str]
    series: Series
    lookback: int

    def wide(self) -> DataFrame:
        spelled = [
            F.expr(f"CAST(get(x, {i}) AS {'INT' if n in self.integers else 'DOUBLE'}) AS `{n}`")
            for i, n in enumerate(self.names)
        ]
        return self.rows.select(*self.series.keys, self.series.time, *spelled, "target")


@dataclass(frozen=True)
class FeatureSets:
    """Rows of several lookbacks from one pass: as in a feature set, with ``lookback``."""

    rows: DataFrame
    names: dict[int, tuple[str, ...]]
    integers: frozenset[str]
    series: Series

    def one(self, lookback: int) -> FeatureSet:
        mine = self.rows.filter(F.col("lookback") == lookback).drop("lookback")
        return FeatureSet(mine, self.names[lookback], self.integers, self.series, lookback)

    def stored(self) -> FeatureSets:
        """Written once, a folder per lookback; a reader of one lookback opens that folder only."""
        return replace(self, rows=write_once(self.rows, ["lookback"]))


def _feature_steps(
    columns: Sequence[str], target_col: str, longest: int, layout: Layout, time_type: str, filled: str | None, variant: Iterator[int]
) -> list[Step]:
    """All families up to the lookback ``longest``. Each takes the next of the shrinking row orders: one sort serves all."""
    windows, others = clip(WINDOWS, longest), [c for c in columns if c != target_col]
    return [
        lags(columns, clip(LAGS, longest), layout.window(next(variant))),
        *[rolling(c, windows, layout, next(variant), c == target_col) for c in [target_col, *others]],
        technical(target_col, windows, layout.window(next(variant)), filled, have_base=True),
        returns(target_col, windows, layout.window(next(variant))),
        *[interactions(target_col, c, layout.window(next(variant))) for c in others],
        calendar(layout.series.time, time_type),
    ]


def feature_sets(
    df: DataFrame,
    target_col: str,
    lookbacks: Sequence[int] = LOOKBACKS,
    series: Series = Series(),
    layout: Layout | None = None,
    target_type: str = "return",
    horizon: int = 1,
    fill: str | None = None,
) -> FeatureSets:
    """All features and the target of every lookback, complete rows only, in one pass.

    The features of the longest lookback are computed once. They are ordered by the shortest lookback that has them, so
    the inputs of each lookback are the first elements of one array. A row is complete per lookback: a feature that
    only a longer one has may be missing. A series with fewer than two lookbacks of complete rows is left out.
    """
    columns = value_columns(df, series)
    if target_col not in columns:
        raise ValueError(f"target column {target_col!r} is not a numeric column of the table")
    layout = layout or lay_out(df, series, carry=[target_col])
    series, longest = layout.series, max(lookbacks)
    windows = clip(WINDOWS, longest)
    before = max([_reach(clip(LAGS, longest), windows, ema=True), *CORRELATION_WINDOWS])
    rows = layout.spread(df.select(*series.keys, series.time, *columns), before, horizon)
    own = [c for c in rows.columns if c not in columns]
    rows, filled = _fill(rows, target_col, layout, fill)
    # Each window uses a shorter order than the one before it: one sort serves all.
    variant = iter(range(2 * len(columns) + 4, -1, -1))
    rows = with_ema(rows, target_col, windows, layout, next(variant))
    goal = target(target_col, layout.window(next(variant)), target_type, horizon, filled)
    time_type = df.schema[series.time].dataType.simpleString()
    steps = _feature_steps(columns, target_col, longest, layout, time_type, filled, variant)
    names, tiers, ends = list(columns), [], {}
    for lookback in sorted(lookbacks):
        unused = iter(range(2 * len(columns) + 4, -1, -1))
        made = [n for step in _feature_steps(columns, target_col, lookback, layout, time_type, filled, unused) for n in step.features]
        fresh = set(made) - set(names)
        tiers += [frozenset(fresh)] if fresh else []
        names += [n for n in made if n in fresh]
        ends[lookback] = len(names)
    rows = attach(rows, [goal])
    rows = attach_array(rows, steps, columns, tiers).select(*own, "target", "x")
    whole = frozenset(n for n in steps[-1].features if not n.endswith(("_sin", "_cos")))
    numbered = _complete_rows(rows, layout, ends)
    return FeatureSets(numbered, {n: tuple(names[:k]) for n, k in ends.items()}, whole, series)


def _complete_rows(rows: DataFrame, layout: Layout, ends: Mapping[int, int]) -> DataFrame:
    """A copy of each row per lookback in which it is complete, with the ``idx`` and ``rows`` of that lookback."""
    sizes = sorted(set(ends.values()))
    valid = {k: F.col("target").isNotNull() & F.expr(f"forall(slice(x, 1, {k}), v -> v IS NOT NULL)") for k in sizes}
    kept = [c for c in rows.columns if c in (*layout.series.keys, layout.series.time, "target")]

    def copies(numbered: DataFrame, lookbacks: Iterable[int]) -> DataFrame:
        each = [
            F.struct(F.lit(n).alias("lookback"), F.lit(ends[n]).alias("size"), F.col(f"idx_{ends[n]}").alias("idx"), F.col(f"rows_{ends[n]}").alias("rows"))
            for n in lookbacks
        ]
        fit = F.filter(F.array(*each), lambda s: s["idx"].isNotNull() & (s["rows"] >= 2 * s["lookback"]))
        laid = numbered.select(*kept, "x", F.inline(fit))
        return laid.select(*kept, "lookback", F.slice("x", F.lit(1), F.col("size")).alias("x"), "idx", "rows")

    if not layout.is_cut:
        flags = rows.withColumns({f"_valid_{k}": valid[k].cast("long") for k in sizes})
        group, up_to = Window.partitionBy(*layout.group), running(layout.window())
        counted = {f"idx_{k}": F.when(F.col(f"_valid_{k}") == 1, F.sum(f"_valid_{k}").over(up_to) - 1) for k in sizes}
        totals = {f"rows_{k}": F.sum(f"_valid_{k}").over(group) for k in sizes}
        return copies(flags.withColumns(counted | totals), ends)
    # dropping rows moves the positions, so each size is laid out anew, from one written table
    written = materialize(layout.own(rows.filter(valid[sizes[0]])))
    out = None
    for k in sizes:
        numbered = number_valid_rows(written.filter(valid[k]), layout.series)
        made = copies(numbered.withColumnsRenamed({"idx": f"idx_{k}", "rows": f"rows_{k}"}), [n for n in ends if ends[n] == k])
        out = made if out is None else out.unionByName(made)
    return out


def feature_set(
    df: DataFrame,
    target_col: str,
    lookback: int,
    series: Series = Series(),
    layout: Layout | None = None,
    target_type: str = "return",
    horizon: int = 1,
    fill: str | None = None,
) -> FeatureSet:
    """The feature set of one lookback."""
    return feature_sets(df, target_col, [lookback], series, layout, target_type, horizon, fill).one(lookback)


def create_features(
    df: DataFrame,
    target_col: str,
    lookback_windows: Sequence[int] = LOOKBACKS,
    series: Series = Series(),
    target_type: str = "return",
    horizon: int = 1,
    fill: str | None = None,
) -> dict[int, DataFrame]:
    """Feature set per lookback; a series shorter than two lookbacks is left out.

    One lookback is lazy. Several are computed in one pass and written once to the checkpoint folder, from where each is read.
    """
    sets = feature_sets(df, target_col, lookback_windows, series, None, target_type, horizon, fill)
    sets = sets.stored() if len(lookback_windows) > 1 else sets
    return {n: sets.one(n).wide() for n in lookback_windows}


def create_rolling_features(
    df: DataFrame, target_col: str, lookback_windows: Sequence[int] = LOOKBACKS, **options
) -> dict[int, DataFrame]:
    """Older name of :func:`create_features`, with the same options."""
    return create_features(df, target_col, lookback_windows, **options)
