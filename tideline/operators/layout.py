"""How rows of long series are spread over tasks.

All operators work on *row positions* inside a series. Windowing by the series
key alone would put one whole series into one task, so a series that holds a
large part of the data would never finish. A layout avoids that:

* Series with at most ``chunk_rows`` rows stay whole; the plan is one shuffle on
  the series key and nothing else.
* Longer series are cut into chunks of about ``chunk_rows`` rows. Each chunk also
  receives the rows before (and after) it that its windows look at. Windows then
  run per ``(series, chunk)`` and the borrowed rows are dropped at the end.

The cut is made on calendar buckets. The row count per ``(series, bucket)`` is a
small table: its running sum per series gives the position of every bucket, and
from it the chunk of every bucket and the neighbours that must borrow its rows.
Only this table is ever windowed by series. Its rows per series are bounded by the
number of buckets in the time range, and it holds long series only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tideline.functions.scalars import MICROS_PER_SECOND, SECONDS_PER_DAY, clock, running
from tideline.operators.storage import materialize

BUCKET, CHUNK, HOME, OWN = "_bucket", "_chunk", "_home", "_own"
START, TOTAL = "_start", "_total"
NO_TIME = 2**62
BROADCAST_ROWS = 500_000
BUCKETS_PER_CHUNK = 8  # whole buckets are borrowed, so they must be small against a chunk


@dataclass(frozen=True)
class Series:
    """Names the key and time columns and the cutting sizes.

    ``bucket`` is the first width tried for the calendar buckets, in microseconds
    of the time column (or in units of an integer time column). It is narrowed
    until the rows of one long series in one bucket are a small part of a chunk.
    """

    keys: tuple[str, ...] = ("series_id",)
    time: str = "time"
    chunk_rows: int = 16_384
    bucket: int = 30 * SECONDS_PER_DAY * MICROS_PER_SECOND

    def bucket_of(self, df: DataFrame) -> Column:
        ticks = clock(self.time, df.schema[self.time].dataType.simpleString())
        slot = F.floor(ticks / F.lit(self.bucket)) if self.bucket > 1 else ticks
        return F.coalesce(slot, F.lit(NO_TIME)).cast("long")

    def order(self) -> Column:
        return F.col(self.time).asc_nulls_last()


@dataclass(frozen=True)
class Layout:
    """The cut of one table. ``index`` is None when no series needs cutting."""

    series: Series
    index: DataFrame | None = None
    small_index: bool = False
    carried: tuple[str, ...] = field(default=())

    @property
    def is_cut(self) -> bool:
        return self.index is not None

    @property
    def group(self) -> list[str]:
        return [*self.series.keys, CHUNK] if self.is_cut else list(self.series.keys)

    def window(self, variant: int = 0) -> WindowSpec:
        """Rows of a group in time order.

        Times are unique, so the repeated key of a ``variant`` decides nothing:
        it only keeps the Window nodes of different variants apart. A sort for a
        variant also serves all smaller ones.
        """
        ties = [F.col(self.series.keys[0])] * variant
        return Window.partitionBy(*self.group).orderBy(self.series.order(), *ties)

    def spread(self, df: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
        """Send every row to its chunk and to the chunks that look at it."""
        if not self.is_cut:
            return df
        keys = list(self.series.keys)
        cut = _neighbours(self.index, keys, before, after)
        if self.small_index:
            cut = F.broadcast(cut)
        rows = df.withColumn(BUCKET, self.series.bucket_of(df)).join(cut, [*keys, BUCKET], "left")
        return rows.withColumns(
            {
                CHUNK: F.explode(F.coalesce("_targets", F.array(F.lit(0)))),
                START: F.coalesce(START, F.lit(0).cast("long")),
            }
        ).withColumn(OWN, F.coalesce(F.col(HOME) == F.col(CHUNK), F.lit(True)))

    def own(self, df: DataFrame) -> DataFrame:
        """Drop borrowed rows and the bookkeeping columns."""
        if not self.is_cut:
            return df
        carried = [f"_carry_{c}" for c in self.carried]
        return df.filter(OWN).drop(BUCKET, CHUNK, HOME, OWN, START, TOTAL, "_targets", *carried)

    def is_own(self) -> Column:
        return F.col(OWN) if self.is_cut else F.lit(True)

    def position(self, variant: int = 0) -> Column:
        """Zero-based row position in the whole series."""
        w = self.window(variant)
        rank = F.row_number().over(w).cast("long") - F.lit(1)
        if not self.is_cut:
            return rank
        return F.first(START).over(running(w)) + rank

    def total(self) -> Column:
        """Rows in the whole series."""
        here = F.count(F.lit(1)).over(Window.partitionBy(*self.group))
        return F.coalesce(TOTAL, here) if self.is_cut else here

    def filled(self, column: str) -> Column:
        """Last non-null value at or before the row, across chunk borders."""
        inside = F.last(column, ignorenulls=True).over(running(self.window()))
        if not self.is_cut:
            return inside
        return F.coalesce(inside, F.first(f"_carry_{column}").over(running(self.window())))


def lay_out(df: DataFrame, series: Series = Series(), carry: Sequence[str] = ()) -> Layout:
    """Measure the table once and decide how to spread it.

    Counts the rows per series. If some series are long, their rows per bucket are
    counted too, with narrower buckets until each is small against a chunk. ``carry``
    names columns whose last non-null value must reach later chunks.
    """
    keys = list(series.keys)
    long_series = df.groupBy(*keys).count().filter(F.col("count") > series.chunk_rows)
    if long_series.isEmpty():
        return Layout(series)

    last_value = [
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(series.time))).alias(f"_last_{c}")
        for c in carry
    ]
    per_series = Window.partitionBy(*keys)
    by_bucket = per_series.orderBy(BUCKET)
    earlier = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    hot = materialize(long_series.drop("count"))
    if hot.count() <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    rows = df.join(hot, keys, "left_semi")
    share = max(1, series.chunk_rows // BUCKETS_PER_CHUNK)
    while True:
        counts = rows.groupBy(*keys, series.bucket_of(df).alias(BUCKET)).agg(
            F.count(F.lit(1)).alias("_rows"), *last_value
        )
        counts = materialize(counts)
        fullest = counts.agg(F.max("_rows")).first()[0]
        if fullest <= share or series.bucket <= 1:
            break
        # Narrow by the overfill, at least by half.
        narrower = series.bucket * share // fullest
        series = replace(series, bucket=max(1, min(narrower, series.bucket // 2)))
    counted = counts.withColumns(
        {
            "_end": F.sum("_rows").over(running(by_bucket)),
            TOTAL: F.sum("_rows").over(per_series),
            **{
                f"_carry_{c}": F.last(f"_last_{c}", ignorenulls=True).over(earlier) for c in carry
            },
        }
    ).withColumn(START, F.col("_end") - F.col("_rows"))
    slot = F.floor(F.col(START) / F.lit(series.chunk_rows))
    index = materialize(
        counted.withColumn(HOME, F.dense_rank().over(per_series.orderBy(slot)) - F.lit(1)).select(
            *keys, BUCKET, START, "_end", TOTAL, HOME, *[f"_carry_{c}" for c in carry]
        )
    )
    return Layout(series, index, index.count() <= BROADCAST_ROWS, tuple(carry))


def number_valid(df: DataFrame, layout: Layout, valid: Column) -> DataFrame:
    """Keep valid rows; add ``idx`` (position) and ``rows`` (series length).

    Both count valid rows only. ``df`` must be spread. With whole series they are
    sums over the partitioning already in place; a cut table is written once and
    measured again, since dropping rows moves the positions.
    """
    if layout.is_cut:
        return number_valid_rows(materialize(layout.own(df.filter(valid))), layout.series)
    df = df.withColumn("_valid", valid.cast("long"))
    whole = Window.partitionBy(*layout.group)
    return (
        df.withColumns(
            {
                "idx": F.sum("_valid").over(running(layout.window())) - F.lit(1),
                "rows": F.sum("_valid").over(whole),
            }
        )
        .filter(F.col("_valid") == 1)
        .drop("_valid")
    )


def number_valid_rows(kept: DataFrame, series: Series) -> DataFrame:
    """Add ``idx`` and ``rows`` to a written table whose incomplete rows are gone."""
    fresh = lay_out(kept, series)
    rows = fresh.spread(kept)
    return fresh.own(rows.withColumns({"idx": fresh.position(), "rows": fresh.total()}))


def with_positions(df: DataFrame, series: Series) -> DataFrame:
    """Number the rows of a table that has not been laid out yet."""
    layout = lay_out(df, series)
    rows = layout.spread(df).withColumns({"idx": layout.position(), "rows": layout.total()})
    return layout.own(rows)


def _neighbours(index: DataFrame, keys: list[str], before: int, after: int) -> DataFrame:
    """Add the list of chunks that need each bucket.

    A chunk starting at row s needs the rows from s - before on, so a bucket
    ending at row e is needed by every later chunk that starts before e + before.
    The mirror rule holds for rows after a chunk.
    """
    by_bucket = Window.partitionBy(*keys).orderBy(BUCKET)
    first, last = F.col(HOME), F.col(HOME)
    if before > 0:
        near = Window.partitionBy(*keys).orderBy("_end").rangeBetween(0, before - 1)
        last = F.max("_next").over(near)
    if after > 0:
        near = Window.partitionBy(*keys).orderBy(START).rangeBetween(-(after - 1), 0)
        first = F.min("_previous").over(near)
    return (
        index.withColumns(
            {
                "_next": F.coalesce(F.lead(HOME).over(by_bucket), HOME),
                "_previous": F.coalesce(F.lag(HOME).over(by_bucket), HOME),
            }
        )
        .withColumns({"_first": first, "_lastc": last})
        .withColumn("_targets", F.sequence("_first", "_lastc"))
        .drop("_next", "_previous", "_first", "_lastc", "_end")
    )
