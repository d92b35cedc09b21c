"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
SECONDS_PER_DAY = 86_400


def trailing(window: WindowSpec, rows: int) -> WindowSpec:
    """The current row and the ``rows - 1`` rows before it."""
    return window.rowsBetween(-(rows - 1), Window.currentRow)


def running(window: WindowSpec) -> WindowSpec:
    """All rows of the partition up to the current one."""
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives NULL instead of an ANSI error on a zero divisor."""
    return F.try_divide(top, bottom)


def nan_to_null(name: str) -> Column:
    return F.when(~F.isnan(name), F.col(name))


def quoted(name: str) -> str:
    return f"`{name}`"


def sorted_quantile_sql(values: str, p: float) -> str:
    """Linear-interpolation quantile of an ascending array; NULL when empty."""
    rank = f"(size({values}) - 1) * {float(p)!r}D"
    low = f"get({values}, CAST(floor({rank}) AS INT))"
    high = f"get({values}, CAST(ceil({rank}) AS INT))"
    return f"({low} + ({high} - {low}) * ({rank} - floor({rank})))"


def clock(name: str, kind: str) -> Column:
    """Whole microseconds (or counts) that never decrease with column ``name``.

    A zone-less time is taken apart into day and clock so that the session
    zone (and its summer time) cannot reorder rows.
    """
    time = F.col(name)
    if kind in ("int", "bigint"):  # a counter serves as its own clock
        return time.cast("long")
    if kind == "timestamp":
        return F.unix_micros(time)
    day = F.unix_date(F.to_date(time)).cast("long") * (SECONDS_PER_DAY * MICROS_PER_SECOND)
    if kind == "date":
        return day
    minutes = (F.hour(time) * 60 + F.minute(time)).cast("long") * (60 * MICROS_PER_SECOND)
    return day + minutes + F.expr(f"CAST(extract(SECOND FROM `{name}`) * {MICROS_PER_SECOND} AS LONG)")
