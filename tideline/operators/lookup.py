"""Joining rows with a table of one row per series, whichever series the rows are in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.storage import materialize

#: Bytes of a table that go to every executor.
BROADCAST_BYTES = 64 << 20
#: A series is hot with more than this part of the rows, so there are fewer hot series than this.
HOT = 1_000


def lookup(
    df: DataFrame, table: DataFrame, keys: Sequence[str], cell_bytes: int = 16, limit: int = BROADCAST_BYTES,
    rows: int | None = None,
) -> DataFrame:
    """Inner join on ``keys`` with a table that is unique on them.

    The table is written once and its rows counted, unless it is written already and ``rows`` says how many. Up to ``limit`` bytes (rows x columns x ``cell_bytes``) it
    is broadcast. A larger one is split: rows of hot series meet their row of the table by broadcast, the others
    by a shuffle in which no series holds more than a thousandth of the rows. Rows without a key are left out.
    """
    keys = list(keys)
    if rows is None:
        table = materialize(table)
        rows = table.count()
    if rows * len(table.columns) * cell_bytes <= limit:
        return df.join(F.broadcast(table), keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_of"))
    counts = materialize(counts)
    total = counts.agg(F.sum("_of")).first()[0] or 0
    hot = materialize(counts.filter(F.col("_of") * HOT > total).select(*keys))
    warm = df.join(F.broadcast(table.join(F.broadcast(hot), keys, "left_semi")), keys)
    cold = df.join(F.broadcast(hot), keys, "left_anti").join(table.hint("merge"), keys)
    return warm.unionByName(cold)
