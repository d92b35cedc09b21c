"""The value to predict: a later row seen from the current one."""

from __future__ import annotations

from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from tideline.operators.parts import Step

TARGET_TYPES = ("return", "log_return", "price")


def target(
    p: str, w: WindowSpec, target_type: str = "return", horizon: int = 1, filled: str | None = None
) -> Step:
    """``filled`` names a gap-free copy of the price for the plain return."""
    if target_type not in TARGET_TYPES:
        raise ValueError(f"unknown target type {target_type!r}, use one of {TARGET_TYPES}")
    x = filled if filled and target_type == "return" else p
    step = Step(windowed={f"_later_{p}": F.lead(x, horizon).over(w)})
    later = f"`_later_{p}`"
    step.features["target"] = {
        "return": f"try_divide({later}, `{x}`) - 1",
        "log_return": f"ln(try_divide({later}, `{x}`))",
        "price": later,
    }[target_type]
    return step
