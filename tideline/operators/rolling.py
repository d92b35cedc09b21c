"""Trailing-window statistics of one column.

One sorted copy of the frame serves median, quartiles, minimum and maximum: it
costs a fraction of ``percentile`` over the same frame. Skewness and kurtosis come
from sums of powers relative to a nearby value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tideline.functions.scalars import quoted, running, sorted_quantile_sql, trailing
from tideline.operators.layout import Layout
from tideline.operators.parts import Step


def mean_name(c: str, n: int) -> str:
    return f"_mean_{c}_{n}"


def std_name(c: str, n: int) -> str:
    return f"_std_{c}_{n}"


def frame_name(c: str, n: int) -> str:
    return f"_frame_{c}_{n}"


def base_mean(c: str, n: int, w: WindowSpec) -> dict[str, Column]:
    return {mean_name(c, n): F.avg(c).over(trailing(w, n))}


def base_std(c: str, n: int, w: WindowSpec) -> dict[str, Column]:
    return {std_name(c, n): F.stddev_samp(c).over(trailing(w, n))}


def base_range(c: str, n: int, w: WindowSpec) -> dict[str, Column]:
    f = trailing(w, n)
    return {f"_low_{c}_{n}": F.min(c).over(f), f"_high_{c}_{n}": F.max(c).over(f)}


def base_frame(c: str, n: int, w: WindowSpec) -> dict[str, Column]:
    return {frame_name(c, n): F.sort_array(F.collect_list(c).over(trailing(w, n)))}


def _reference(step: Step, c: str, block: int, layout: Layout, variant: int) -> None:
    """Give every row the reference value of its block and of the next block.

    ``skewness`` and ``kurtosis`` over a sliding frame are many times slower than
    sums of powers, but powers of the raw value lose all digits when the level is
    large against the spread. Here values are taken relative to the first value
    of a block of rows. A frame spans at most two neighbouring blocks, one even
    and one odd, so each row carries its distance to the reference of either.
    """
    w = layout.window(variant)
    x, row, run = F.col(c), layout.position(variant), running(w)
    at_start = F.when(row % block == 0, x)
    step.prior |= {f"_odd_{c}": F.floor(row / F.lit(block)) % 2 == 1, f"_start_{c}": at_start}
    step.inner[f"_ref_{c}"] = F.coalesce(
        F.last(f"_start_{c}", ignorenulls=True).over(run), F.first(c, ignorenulls=True).over(run)
    )
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(
        F.lead(f"_ref_{c}", block).over(w), F.last(f"_ref_{c}").over(whole)
    )
    own, other = x - F.col(f"_ref_{c}"), x - F.col(f"_next_{c}")
    step.middle |= {f"_next_{c}": following}
    step.shifted |= {
        f"_z0_{c}": F.when(F.col(f"_odd_{c}"), other).otherwise(own),
        f"_z1_{c}": F.when(F.col(f"_odd_{c}"), own).otherwise(other),
    }


def base_powers(c: str, n: int, w: WindowSpec) -> dict[str, Column]:
    f, out = trailing(w, n), {}
    for side in (0, 1):
        z = power = F.col(f"_z{side}_{c}")
        for k in (1, 2, 3, 4):
            out[f"_p{k}{side}_{c}_{n}"] = F.sum(power).over(f)
            power = power * z
    return out


def _power_mean(c: str, n: int, k: int) -> str:
    size = f"size(`{frame_name(c, n)}`)"
    return f"(if(`_odd_{c}`, `_p{k}1_{c}_{n}`, `_p{k}0_{c}_{n}`) / {size})"


def skewness_sql(c: str, n: int) -> str:
    """Adjusted skewness; a frame without spread counts as symmetric."""
    a, b, d = (_power_mean(c, n, k) for k in (1, 2, 3))
    k, sd = f"CAST(size(`{frame_name(c, n)}`) AS DOUBLE)", quoted(std_name(c, n))
    third = f"({d} - 3 * {a} * {b} + 2 * power({a}, 3))"
    # With the sample deviation sd: g1 = third / sd^3 * (k / (k - 1))^1.5.
    return (
        f"CASE WHEN {k} < 3 THEN NULL WHEN {sd} = 0 THEN 0D"
        f" ELSE {third} / power({sd}, 3) * {k} * {k} / (({k} - 1) * ({k} - 2)) END"
    )


def kurtosis_sql(c: str, n: int) -> str:
    """Adjusted excess kurtosis; -3 for a frame without spread."""
    a, b, d, e = (_power_mean(c, n, k) for k in (1, 2, 3, 4))
    k, sd = f"CAST(size(`{frame_name(c, n)}`) AS DOUBLE)", quoted(std_name(c, n))
    fourth = f"({e} - 4 * {a} * {d} + 6 * {a} * {a} * {b} - 3 * power({a}, 4))"
    g2 = f"({fourth} / power({sd}, 4) * power({k} / ({k} - 1), 2) - 3)"
    return (
        f"CASE WHEN {k} < 4 THEN NULL WHEN {sd} = 0 THEN -3D"
        f" ELSE ({k} - 1) / (({k} - 2) * ({k} - 3)) * (({k} + 1) * {g2} + 6) END"
    )


def rolling(
    c: str, windows: Sequence[int], layout: Layout, variant: int = 0, keep: bool = False
) -> Step:
    """All statistics of column ``c``; ``keep`` leaves mean and deviation behind."""
    w, step = layout.window(variant), Step()
    _reference(step, c, max([*windows, 1]) + 1, layout, variant)
    for n in windows:
        step.windowed |= base_mean(c, n, w) | base_std(c, n, w) | base_frame(c, n, w)
        step.windowed |= base_powers(c, n, w)
        frame, std = quoted(frame_name(c, n)), quoted(std_name(c, n))
        upper, lower = sorted_quantile_sql(frame, 0.75), sorted_quantile_sql(frame, 0.25)
        step.features |= {
            f"{c}_rolling_mean_{n}": quoted(mean_name(c, n)),
            f"{c}_rolling_std_{n}": std,
            f"{c}_rolling_min_{n}": f"get({frame}, 0)",
            f"{c}_rolling_max_{n}": f"get({frame}, size({frame}) - 1)",
            f"{c}_rolling_median_{n}": sorted_quantile_sql(frame, 0.5),
            f"{c}_rolling_iqr_{n}": f"{upper} - {lower}",
            f"{c}_rolling_skew_{n}": skewness_sql(c, n),
            f"{c}_rolling_kurt_{n}": kurtosis_sql(c, n),
            f"{c}_rolling_volatility_{n}": f"{std} * {math.sqrt(n)!r}D",
        }
        if keep:
            step.kept += [mean_name(c, n), std_name(c, n)]
    return step
