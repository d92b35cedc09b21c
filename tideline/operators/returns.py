"""Returns and the risk measures built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from tideline.functions.scalars import quoted, ratio, sorted_quantile_sql, trailing
from tideline.operators.parts import Step

# Fixed value: the tail share of the value-at-risk columns.
TAIL = 0.05


def _tail_mean_sql(frame: str, limit: str) -> str:
    """Mean of the values of ``frame`` up to the column ``limit``."""
    fold = "(a, v) -> named_struct('s', a.s + v, 'k', a.k + 1D)"
    tail = f"filter({frame}, v -> v <= {limit})"
    mean = f"aggregate({tail}, named_struct('s', 0D, 'k', 0D), {fold}, a -> try_divide(a.s, a.k))"
    return f"CASE WHEN {limit} IS NOT NULL THEN {mean} END"


def returns(p: str, windows: Sequence[int], w: WindowSpec) -> Step:
    r = f"_return_{p}"
    growth = ratio(F.col(p), F.lag(p, 1).over(w))
    step = Step(
        prior={f"_growth_{p}": growth, r: growth - 1},
        features={f"{p}_return": quoted(r), f"{p}_log_return": f"ln(`_growth_{p}`)"},
    )
    for n in windows:
        f = trailing(w, n)
        wealth, frame = f"_wealth_{p}_{n}", f"_frame{r}_{n}"
        step.inner[wealth] = F.product(F.lit(1.0) + F.col(r)).over(f)
        step.windowed |= {
            f"_spread_{p}_{n}": F.stddev_samp(r).over(f),
            f"_down_{p}_{n}": F.stddev_samp(F.when(F.col(r) < 0, F.col(r)).otherwise(0.0)).over(f),
            f"_up_{p}_{n}": F.stddev_samp(F.when(F.col(r) > 0, F.col(r)).otherwise(0.0)).over(f),
            frame: F.sort_array(F.collect_list(r).over(f)),
            f"_peak_{p}_{n}": F.max(wealth).over(f),
        }
        step.derived[f"_var_{p}_{n}"] = sorted_quantile_sql(quoted(frame), TAIL)
        step.features |= {
            f"{p}_vol_cluster_{n}": f"`_spread_{p}_{n}`",
            f"{p}_downside_risk_{n}": f"`_down_{p}_{n}`",
            f"{p}_upside_potential_{n}": f"`_up_{p}_{n}`",
            f"{p}_var_5_{n}": f"`_var_{p}_{n}`",
            f"{p}_cvar_5_{n}": _tail_mean_sql(quoted(frame), f"`_var_{p}_{n}`"),
            f"{p}_max_drawdown_{n}": f"try_divide(`{wealth}` - `_peak_{p}_{n}`, `_peak_{p}_{n}`)",
        }
    return step
