"""Feature families as steps: windows first, then expressions over them.

A feature may need a lag, then a window over that lag, then a window over that
window; ``prior`` to ``windowed`` are these levels. ``derived`` and the final
expressions are SQL text over the named columns, and ``kept`` names window
columns that a later family uses again.

Every family windows over its own variant of the row order (see
:meth:`Layout.window`), all satisfied by one sort. Merged into a single Window
node, dozens of sliding aggregates would be compiled into one method too large
for the JVM's compiler, and would run an order of magnitude slower.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Step:
    prior: dict[str, Column] = field(default_factory=dict)
    inner: dict[str, Column] = field(default_factory=dict)
    middle: dict[str, Column] = field(default_factory=dict)
    shifted: dict[str, Column] = field(default_factory=dict)
    windowed: dict[str, Column] = field(default_factory=dict)
    derived: dict[str, str] = field(default_factory=dict)
    features: dict[str, str] = field(default_factory=dict)
    kept: list[str] = field(default_factory=list)


def _levels(df: DataFrame, step: Step) -> DataFrame:
    for level in (step.prior, step.inner, step.middle, step.shifted, step.windowed):
        if level:
            df = df.withColumns(level)
    if step.derived:
        df = df.withColumns({n: F.expr(e) for n, e in step.derived.items()})
    return df


def attach(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Add the feature columns by name and drop the intermediate ones."""
    before, names = df.columns, []
    for step in steps:
        kept = df.columns
        rows = _levels(df, step)
        named = [F.expr(f"{e} AS `{n}`") for n, e in step.features.items()]
        df = rows.select(*kept, *step.kept, *named)
        names += step.features
    return df.select(*before, *names)


def attach_array(
    df: DataFrame, steps: Sequence[Step], inputs: Sequence[str], tiers: Sequence[frozenset[str]] = ()
) -> DataFrame:
    """Add all features as one array ``x``, ``inputs`` first.

    ``tiers`` groups feature names: those of the first group come first, and so on.
    Array columns keep the plan small: hundreds of aliased columns under a
    filter make the optimizer's constraint inference explode.
    """
    before = df.columns
    tiers = tiers or [frozenset(n for step in steps for n in step.features)]
    pieces: list[list[str]] = [[] for _ in tiers]
    df = df.withColumn("_x", F.array(*inputs).cast("array<double>"))
    for i, step in enumerate(steps):
        kept, made = df.columns, []
        for t, tier in enumerate(tiers):
            values = ", ".join(f"CAST({e} AS DOUBLE)" for n, e in step.features.items() if n in tier)
            if values:
                pieces[t].append(f"_x{i}_{t}")
                made.append(F.expr(f"array({values}) AS _x{i}_{t}"))
        df = _levels(df, step).select(*kept, *step.kept, *made)
    return df.select(*before, F.concat("_x", *[p for tier in pieces for p in tier]).alias("x"))
