"""Shared pieces: tables, written intermediate results, joins with hot keys, blocks of documents."""

from __future__ import annotations

import ctypes
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.storage import ensure_checkpoint_dir
from tideline.shipping import ship_package

#: ASCII white space; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"


class Codes(dict):
    """Numbers each new key in turn."""

    def __missing__(self, key):
        self[key] = code = len(self)
        return code


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{tag}-{uuid.uuid4().hex}"


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_of_id(doc_id: str) -> Column:
    """CRC-32 of a document id as text; a missing id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def join_counted(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, spread: Column) -> DataFrame:
    """Left join with a table that is unique on ``key`` and knows in ``rows`` how many left rows each key has.

    Keys with more than a thousandth of the ``total`` left rows are fewer than 1,000: those are broadcast.
    The others are shuffled, and left rows that already found their partner are dealt out by ``spread``.
    """
    out = [c for c in right.columns if c != key]
    hot = right.where(F.col(rows) * 1000 > F.lit(total)).select(
        F.col(key).alias("_hot"), F.struct(*out).alias("_found")
    )
    cold = right.where(F.col(rows) * 1000 <= F.lit(total)).select(
        F.col(key).alias("_cold"), F.lit(0).alias("_none"), F.struct(*out).alias("_other")
    )
    first = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull(), 1 + F.pmod(F.hash(spread), F.lit(1 << 20))).otherwise(F.lit(0))
    )
    both = first.join(cold, (F.col(key) == F.col("_cold")) & (F.col("_salt") == F.col("_none")), "left")
    got = F.coalesce(F.col("_found"), F.col("_other"))
    return both.select(*left.columns, *[got[c].alias(c) for c in out])


def join_matching(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """Inner join with a stored table that is unique on ``key`` and knows in ``rows`` how many left rows each key has.

    The keys with more than a thousandth of the ``total`` left rows, fewer than 1,000, are named in a filter: only their rows
    meet the broadcast, only the others are shuffled, and rows without a partner come out of no join.
    """
    hot = [r[0] for r in right.where(F.col(rows) * 1000 > F.lit(total)).select(key).collect()]
    if not hot:
        return left.join(right, key)
    often = F.col(key).isin(hot)
    return left.where(often).join(F.broadcast(right.where(often)), key).unionByName(left.where(~often).join(right.where(~often), key))


def text_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of the texts."""
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return rows, size


def to_blocks(
    docs: DataFrame, tag: str, size: int, block_bytes: int = 16 << 20, text: str = "text",
    derive: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: T.StructType | None = None,
) -> DataFrame:
    """Cut each partition into blocks of about ``block_bytes`` of text and write them.

    ``src`` numbers the block and ``place`` the row within it. The table is bucketed by ``src``, so grouping or
    cogrouping by it moves no text again. ``size`` is the text in all, which sets the number of buckets. A block holds
    whole documents, at least one. ``derive`` may turn batches into others of ``schema``, row by row.
    """
    spark = docs.sparkSession
    ship_package(spark)
    buckets = max(2, math.ceil(2 * size / block_bytes))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, filled, place = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            ids, places = np.empty((2, batch.num_rows), np.int64)
            for i, n in enumerate(lengths(batch.column(text))):
                n += 64  # a row is never free
                if filled and filled + n > block_bytes:
                    src, filled, place = src + 1, 0, 0
                ids[i], places[i] = src, place
                filled, place = filled + n, place + 1
            out = derive(batch) if derive else batch
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(places), *out.columns], names=["src", "place", *out.schema.names])

    shape = T.StructType.fromDDL("src long, place long")
    shape = T.StructType([*shape.fields, *(schema or docs.schema).fields])
    return bucketed(docs.mapInArrow(cut, shape), tag, buckets)


def bucketed(rows: DataFrame, tag: str, buckets: int) -> DataFrame:
    """Write ``rows`` once to the shared folder, bucketed by ``src``, and read them back."""
    spark = rows.sparkSession
    path, name = scratch(spark, tag), f"blocks_{uuid.uuid4().hex}"
    (
        rows.write.bucketBy(buckets, "src").option("compression", "zstd")
        .option("path", path).format("parquet").saveAsTable(name)
    )
    blocks = spark.table(name)
    blocks.schema  # noqa: B018  resolved, so that the name can go; the files stay
    spark.sql(f"DROP TABLE {name}")
    return blocks


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The same function of batches; at its end the worker, which goes on to other tasks, gives its freed memory back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def lengths(column: pa.Array) -> list[int]:
    """UTF-8 bytes of each text, 0 where missing."""
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], text: str | int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most about ``limit`` bytes of text."""
    for batch in batches:
        start, filled = 0, 0
        for i, n in enumerate(lengths(batch.column(text))):
            if filled and filled + n > limit:
                yield batch.slice(start, i - start)
                start, filled = i, 0
            filled += n
        if start < batch.num_rows:
            yield batch.slice(start)


def texts_of(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8, empty where missing."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
