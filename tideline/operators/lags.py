"""Values of earlier rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from tideline.operators.parts import Step


def lags(columns: Sequence[str], offsets: Sequence[int], w: WindowSpec) -> Step:
    return Step(
        windowed={f"_lag_{c}_{k}": F.lag(c, k).over(w) for c in columns for k in offsets},
        features={f"{c}_lag_{k}": f"`_lag_{c}_{k}`" for c in columns for k in offsets},
    )
