"""Walk-forward folds: overlapping train blocks, adjacent test blocks.

Fold i trains on rows ``[i*s, i*s + w)`` and tests on the next ``s`` rows, with
``s = w // 4``. A fold whose test block reaches the last row is not used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of a train block, and its ratio to a test block.
TRAIN_ROWS = 126
TEST_SHARE = 4


def test_rows(train: int) -> int:
    return max(1, train // TEST_SHARE)


def fold_count_sql(rows: str, train: int, step: int) -> str:
    """Usable folds of a series with ``rows`` rows; none below two train blocks."""
    return f"if({rows} < {2 * train}, 0, CAST(floor(({rows} - {train} - 1) / {step}) AS INT))"


def folds(df: DataFrame, train: int = TRAIN_ROWS, step: int | None = None) -> DataFrame:
    """One copy of a row per fold it belongs to, with ``fold`` and ``is_train``.

    Needs ``idx`` and ``rows``. The folds of a row follow from its position, so
    this is a bounded explode (train / step + 1 copies), not a join.
    """
    s = step or test_rows(train)
    last = f"({fold_count_sql('rows', train, s)} - 1)"
    first_fit = f"greatest(0, CAST(floor((idx - {train} + {s}) / {s}) AS INT))"
    last_fit = f"least(CAST(floor(idx / {s}) AS INT), {last})"
    tested = f"CAST(floor((idx - {train}) / {s}) AS INT)"
    fits = (
        f"if({first_fit} <= {last_fit}, transform(sequence({first_fit}, {last_fit}),"
        " f -> struct(f AS fold, true AS is_train)), array())"
    )
    tests = (
        f"if(idx >= {train} AND {tested} <= {last},"
        f" array(struct({tested} AS fold, false AS is_train)), array())"
    )
    copies = df.withColumn("_copy", F.explode(F.expr(f"concat({fits}, {tests})")))
    return copies.select(*df.columns, "_copy.fold", "_copy.is_train")


def in_train(column: Column) -> Column:
    return F.when(F.col("is_train"), column)


def scale(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Standardise by the train rows of each fold (population deviation).

    A column without spread in the train rows is only centred. Folds are small,
    so this is a window over the fold and needs no join.
    """
    w = Window.partitionBy(*keys, "fold")
    fitted = {}
    for c in columns:
        fitted[f"_center_{c}"] = F.avg(in_train(F.col(c))).over(w)
        fitted[f"_spread_{c}"] = F.stddev_pop(in_train(F.col(c))).over(w)
    df = df.withColumns(fitted)
    scaled = {}
    for c in columns:
        spread = F.when(F.col(f"_spread_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_spread_{c}"))
        scaled[f"{c}_scaled"] = (F.col(c) - F.col(f"_center_{c}")) / spread
    return df.withColumns(scaled).drop(*fitted)
