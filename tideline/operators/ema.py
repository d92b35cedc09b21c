"""Exponentially weighted mean over the whole history, without a recursion.

With weight ``b**age`` the mean at row t is ``sum(b**(t-i) x_i) / sum(b**(t-i))``.
Inside a block of rows both sums are running sums of ``x_j * b**-j``. Two block
grids, shifted by half a block, make sure that every row sits in the second half
of a block of one grid, i.e. sees at least half a block of history. Half a block
is chosen so that all older rows together weigh less than a double can resolve.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalars import ratio, running
from tideline.operators.layout import CHUNK, Layout

HISTORY_DECADES = 18.0  # older rows weigh less than 1e-18 of the sum
MAX_DECADES = 280.0  # b**-j must stay inside a double


def decay(span: int) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def _decades_per_row(span: int) -> float:
    return -math.log10(decay(span))


def history_rows(span: int) -> int:
    """Rows of history that decide the value to double precision."""
    return 1 if span == 1 else math.ceil(HISTORY_DECADES / _decades_per_row(span)) + 1


def _span_groups(spans: Sequence[int]) -> list[list[int]]:
    """Spans that can share one block length without overflow."""
    groups: list[list[int]] = []
    for span in sorted((s for s in set(spans) if s > 1), reverse=True):
        block = 2 * history_rows(groups[-1][0]) if groups else 0
        if groups and block * _decades_per_row(span) <= MAX_DECADES:
            groups[-1].append(span)
        else:
            groups.append([span])
    return groups


def ema_name(c: str, span: int) -> str:
    return f"_ema_{c}_{span}"


def with_ema(
    df: DataFrame, c: str, spans: Sequence[int], layout: Layout, variant: int = 0
) -> DataFrame:
    """Add ``_ema_{c}_{span}`` columns; ``df`` must already be spread.

    ``variant`` is the row order of the last window, which later windows reuse.
    """
    keep = df.columns
    df = df.withColumn("_row", layout.position())
    x = F.col(c)
    out: dict[str, Column] = {1: x} if 1 in spans else {}
    for group in _span_groups(spans):
        half = history_rows(group[0])
        tag = f"{c}_{group[0]}"
        for grid, shift in (("a", 0), ("b", half)):
            spot = F.col("_row") + F.lit(shift)
            block, age = f"_block_{grid}_{tag}", f"_age_{grid}_{tag}"
            df = df.withColumns(
                {block: F.floor(spot / F.lit(2 * half)), age: (spot % (2 * half)).cast("double")}
            )
            w = running(Window.partitionBy(*layout.group, block).orderBy(layout.series.order()))
            sums = {}
            for span in group:
                weight = F.pow(F.lit(1.0 / decay(span)), F.col(age))
                top = F.sum(x * weight).over(w)
                bottom = F.sum(F.when(x.isNotNull(), weight)).over(w)
                sums[f"_ema_{grid}_{c}_{span}"] = ratio(top, bottom)
            df = df.withColumns(sums)
        for span in group:
            deep = F.col(f"_age_a_{tag}") >= half
            a, b = F.col(f"_ema_a_{c}_{span}"), F.col(f"_ema_b_{c}_{span}")
            out[span] = F.when(deep, F.coalesce(a, b)).otherwise(F.coalesce(b, a))
    # A null row repeats the value of the last non-null row. Only that row is sure to
    # have seen enough history: after a long null run the sums have lost it.
    known = x.isNotNull() & layout.is_own()
    df = df.withColumns({ema_name(c, s): F.when(known, e) for s, e in out.items()})
    names = [ema_name(c, s) for s in out]
    w = running(layout.window(variant))
    df = df.withColumns({name: F.last(name, ignorenulls=True).over(w) for name in names})
    if layout.is_cut:
        df = _carry_between_chunks(df, names, layout)
    return df.select(*keep, *names)


def _carry_between_chunks(df: DataFrame, names: list[str], layout: Layout) -> DataFrame:
    """Fill values that are null up to a chunk's first non-null row."""
    keys = list(layout.series.keys)
    ends = (
        df.filter(layout.is_own())
        .groupBy(*keys, CHUNK)
        .agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_row"))).alias(n) for n in names])
    )
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    entry = ends.select(
        *keys,
        F.col(CHUNK),
        *[F.last(n, ignorenulls=True).over(earlier).alias(f"_entry{n}") for n in names],
    )
    return df.join(entry, [*keys, CHUNK], "left").withColumns(
        {n: F.coalesce(n, f"_entry{n}") for n in names}
    )


