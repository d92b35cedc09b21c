"""Price indicators: averages, bands, strength index, momentum, range position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from tideline.functions.scalars import quoted, trailing
from tideline.operators.ema import ema_name
from tideline.operators.parts import Step
from tideline.operators.rolling import base_mean, base_range, base_std, mean_name, std_name

# Shortest window of the strength index, band width, range guard.
STRENGTH_MIN_WINDOW = 14
BAND_DEVIATIONS = 2.0
RANGE_GUARD = 1e-8


def strength_index_sql(gain: str, loss: str) -> str:
    """100 when there are only gains, NULL when nothing moved."""
    return (
        f"CASE WHEN {loss} = 0 AND {gain} > 0 THEN 100D"
        f" ELSE 100D - try_divide(100D, 1D + try_divide({gain}, {loss})) END"
    )


def technical(
    p: str,
    windows: Sequence[int],
    w: WindowSpec,
    filled: str | None = None,
    have_base: bool = False,
) -> Step:
    """Indicators of price ``p``; EMA columns must have been added before.

    ``filled`` names a gap-free copy of the price for the momentum. With
    ``have_base`` the rolling mean and deviation are already in the table.
    """
    x = filled or p
    step = Step(prior={f"_step_{p}": F.col(p) - F.lag(p, 1).over(w)})
    move = F.col(f"_step_{p}")
    for n in windows:
        f = trailing(w, n)
        if not have_base:
            step.windowed |= base_mean(p, n, w) | base_std(p, n, w)
        step.windowed |= base_range(p, n, w)
        step.windowed[f"_ago_{p}_{n}"] = F.lag(x, n).over(w)
        mean, band = quoted(mean_name(p, n)), f"{BAND_DEVIATIONS}D * {quoted(std_name(p, n))}"
        step.features |= {
            f"{p}_sma_{n}": mean,
            f"{p}_ema_{n}": quoted(ema_name(p, n)),
            f"{p}_bb_upper_{n}": f"{mean} + {band}",
            f"{p}_bb_lower_{n}": f"{mean} - {band}",
            f"{p}_bb_width_{n}": f"({mean} + {band}) - ({mean} - {band})",
        }
        if n >= STRENGTH_MIN_WINDOW:
            gain = F.when(move > 0, move).otherwise(F.lit(0.0))
            loss = F.when(move < 0, -move).otherwise(F.lit(0.0))
            step.windowed[f"_gain_{p}_{n}"] = F.avg(gain).over(f)
            step.windowed[f"_loss_{p}_{n}"] = F.avg(loss).over(f)
            step.features[f"{p}_rsi_{n}"] = strength_index_sql(
                f"`_gain_{p}_{n}`", f"`_loss_{p}_{n}`"
            )
        low, high = f"`_low_{p}_{n}`", f"`_high_{p}_{n}`"
        step.features[f"{p}_momentum_{n}"] = f"try_divide(`{x}`, `_ago_{p}_{n}`) - 1"
        step.features[f"{p}_position_{n}"] = f"(`{p}` - {low}) / ({high} - {low} + {RANGE_GUARD!r}D)"
    return step
