"""Exact quantiles of groups that may be too large for one task.

``percentile`` keeps every distinct value of a group in one buffer. Here an approximate sketch first brackets each
quantile. Plain aggregates count what lies below and inside the brackets; one that holds more than ``most`` rows
strictly inside is narrowed by a sketch of these rows. At the end at most ``most`` values of a group and level,
and the two ends of their bracket, meet in one place, however many rows the group has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.lookup import lookup
from tideline.operators.storage import materialize

#: Parts that a sketch cuts the inside of a bracket into.
GRID = 64


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    levels: Mapping[str, float],
    accuracy: int = 100_000,
    most: int = 100_000,
    also: Sequence[Column] = (),
) -> DataFrame:
    """One row per group and one column per level, linearly interpolated.

    ``also`` names further aggregates, which are made in the sketch's pass. With them, groups without values have a row too.
    """
    if not keys:
        whole = df.select(value).withColumn("_all", F.lit(0))
        return exact_quantiles(whole, ["_all"], value, levels, accuracy, most, also).drop("_all")
    keys = list(keys)
    source = df.select(*keys, value).withColumn("_v", F.col(value).cast("double"))
    df = source.select(*keys, "_v").filter("_v IS NOT NULL")
    if not also:
        source = df
    margin = 4.0 / accuracy
    points = []
    for p in levels.values():
        points += [max(0.0, p - margin), min(1.0, p + margin)]
    sketch = source.groupBy(*keys).agg(
        F.percentile_approx("_v", points, accuracy).alias("_points"),
        F.count("_v").alias("_count"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        *also,
    )
    more = [c for c in sketch.columns[len(keys) :] if c not in ("_points", "_count", "_min", "_max")]
    ends = []
    for i, p in enumerate(levels.values()):
        # A small group is its own bracket; otherwise the margin covers the sketch's error.
        ends += [
            F.expr(f"if(_count <= {most} OR {p - margin <= 0}, _min, _points[{2 * i}])").alias(f"_low{i}"),
            F.expr(f"if(_count <= {most} OR {p + margin >= 1}, _max, _points[{2 * i + 1}])").alias(f"_high{i}"),
        ]
    sketch = materialize(sketch.select("*", *ends))
    brackets = sketch.drop("_points", "_min", "_max", *more)
    # Every later step must see the same brackets, so each round of them is written.
    groups, largest = brackets.agg(F.count(F.lit(1)), F.max("_count")).first()
    below = [F.lit(0).cast("long").alias(f"_below{i}") for i in range(len(levels))]
    counted = brackets.select("*", *below)
    while groups and largest > most:
        rows = lookup(df, brackets, keys, rows=groups)
        counted = materialize(brackets.join(_count(rows, keys, len(levels)), keys))
        if counted.filter(_wide(len(levels), most)).isEmpty():
            break
        brackets = materialize(_narrowed(df, counted, keys, list(levels.values()), most, accuracy, groups))
    made = _read_off(df, counted, keys, levels, groups)
    return sketch.select(*keys, *more).join(made, keys, "left") if also else made


def _inside(i: int) -> str:
    return f"_v > _low{i} AND _v < _high{i}"


def _count(rows: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """Per group and level: rows below the bracket, and strictly inside."""
    sums = []
    for i in range(levels):
        sums += [F.count_if(F.expr(f"_v < _low{i}")).alias(f"_below{i}"), F.count_if(F.expr(_inside(i))).alias(f"_inside{i}")]
    return rows.groupBy(*keys).agg(*sums)


def _wide(levels: int, most: int) -> Column:
    """Some bracket of the group holds too many rows."""
    return F.expr(" OR ".join(f"_inside{i} > {most}" for i in range(levels)))


def _narrowed(
    df: DataFrame, counted: DataFrame, keys: list[str], levels: Sequence[float], most: int, accuracy: int, groups: int
) -> DataFrame:
    """New brackets, with strictly fewer rows inside wherever there are more than ``most``."""
    which = range(len(levels))
    bounds = [c for i in which for c in (f"_low{i}", f"_high{i}", f"_inside{i}")]
    rows = lookup(df, counted.filter(_wide(len(levels), most)).select(*keys, *bounds), keys, rows=groups)
    grid = [k / GRID for k in range(GRID + 1)]
    sketches = []
    for i in which:
        held = F.expr(f"if(_inside{i} > {most} AND {_inside(i)}, _v, NULL)")
        sketches += [
            F.percentile_approx(held, grid, accuracy).alias(f"_grid{i}"),
            F.min(held).alias(f"_first{i}"),
            F.max(held).alias(f"_last{i}"),
            F.count_if(F.expr(f"_v = _low{i}")).alias(f"_at{i}"),
        ]
    made = counted.join(rows.groupBy(*keys).agg(*sketches), keys, "left")
    ends = []
    for i, p in enumerate(levels):
        rank = f"((_count - 1) * {p!r}D)"
        # Places of the two ranks among the rows strictly inside; outside of 0 .. inside - 1 they are at an end.
        first, last = (f"({f}({rank}) - _below{i} - _at{i})" for f in ("floor", "ceil"))
        left = f"CAST(floor(({first} / _inside{i} - {4 / accuracy!r}D) * {GRID}) AS INT)"
        right = f"CAST(ceil((({last} + 1) / _inside{i} + {4 / accuracy!r}D) * {GRID}) AS INT)"
        low = (
            f"CASE WHEN _inside{i} <= {most} OR {first} < 0 THEN _low{i}"
            f" WHEN {first} >= _inside{i} THEN _high{i}"
            f" WHEN {last} >= _inside{i} THEN _last{i}"
            f" ELSE get(_grid{i}, greatest({left}, 0)) END"
        )
        high = (
            f"CASE WHEN _inside{i} <= {most} OR {last} >= _inside{i} THEN _high{i}"
            f" WHEN {last} < 0 THEN _low{i}"
            f" WHEN {first} < 0 THEN _first{i}"
            f" ELSE get(_grid{i}, least({right}, {GRID})) END"
        )
        ends += [F.expr(low).alias(f"_low{i}"), F.expr(high).alias(f"_high{i}")]
    return made.select(*keys, "_count", *ends)


def _read_off(df: DataFrame, counted: DataFrame, keys: list[str], levels: Mapping[str, float], groups: int) -> DataFrame:
    """Gather the values within each bracket and take the ones of the wanted ranks."""
    which = range(len(levels))
    bounds = [c for i in which for c in (f"_low{i}", f"_high{i}")]
    within = [f"_v BETWEEN _low{i} AND _high{i}" for i in which]
    hit = ", ".join(f"if({w}, {i}, NULL)" for i, w in enumerate(within))
    steps = (
        lookup(df, counted.select(*keys, *bounds), keys, rows=groups)
        .filter(" OR ".join(within))
        .select(*keys, "_v", F.explode(F.expr(f"array({hit})")).alias("_i"))
        .filter("_i IS NOT NULL")
        # Map-side combine shrinks each task's rows to the bracket's distinct values.
        .groupBy(*keys, "_i", "_v")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*keys, "_i")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("_v").alias("v"), "n"))).alias("_steps"))
    )
    cells = ", ".join(f"struct({i} AS _i, {p!r}D AS p, _below{i} AS below)" for i, p in enumerate(levels.values()))
    ladder = steps.join(counted.select(*keys, "_count", F.expr(f"inline(array({cells}))")), [*keys, "_i"])
    rank = "((_count - 1) * p)"

    def at(position: str) -> str:
        """Value with the given zero-based rank in the group."""
        walk = (
            "aggregate(_steps, struct(below AS seen, CAST(NULL AS DOUBLE) AS hit), (a, s) ->"
            " struct(a.seen + s.n AS seen,"
            f" if(a.hit IS NULL AND {position} < a.seen + s.n, s.v, a.hit) AS hit))"
        )
        return f"{walk}.hit"

    picked = ladder.withColumns(
        {"_lo": F.expr(at(f"floor({rank})")), "_hi": F.expr(at(f"ceil({rank})"))}
    ).withColumn("_q", F.expr(f"_lo + (_hi - _lo) * ({rank} - floor({rank}))"))
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(name) for i, name in enumerate(levels)]
    )
