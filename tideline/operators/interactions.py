"""Price against covariates: product, ratio, difference, trailing correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from tideline.functions.scalars import quoted, ratio, trailing
from tideline.operators.parts import Step

# Correlation windows (independent of the lookback), ratio guard.
CORRELATION_WINDOWS = (21, 63)
RATIO_GUARD = 1e-8


def correlation(x: Column, y: Column, over: WindowSpec) -> Column:
    """Pearson correlation of the complete pairs; NULL when a side is flat.

    ``corr`` itself raises on a flat frame in ANSI mode.
    """
    xs, ys = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_samp(xs).over(over) * F.stddev_samp(ys).over(over)
    return ratio(F.covar_samp(x, y).over(over), spread)


def interactions(
    p: str, c: str, w: WindowSpec, windows: Sequence[int] = CORRELATION_WINDOWS
) -> Step:
    """Price ``p`` against one covariate ``c``."""
    step = Step(
        features={
            f"{p}_x_{c}": f"`{p}` * `{c}`",
            f"{p}_ratio_{c}": f"try_divide(`{p}`, `{c}` + {RATIO_GUARD!r}D)",
            f"{p}_diff_{c}": f"`{p}` - `{c}`",
        }
    )
    for n in windows:
        name = f"_corr_{p}_{c}_{n}"
        step.windowed[name] = correlation(F.col(p), F.col(c), trailing(w, n))
        step.features[f"{p}_corr_{c}_{n}"] = quoted(name)
    return step
