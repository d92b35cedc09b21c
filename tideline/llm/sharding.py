"""Sharding by jump consistent hashing.

The shard of a row follows from its key and the number of shards alone. A linear congruential generator seeded with the key jumps from
shard to shard until it passes the last one; the last shard it touched is the row's. With one shard more, a row either
stays or moves to the new shard, and the expected share that moves is one in the new number of shards.

``slot`` numbers the rows of a shard without gaps. Rows are cut into blocks by a number derived from key and text; blocks
are counted, their first slots follow from the counts, and only rows of one block and shard are numbered together. The
order within a shard is pseudo-random and the same in every run. Rows without a key take the key 0. Null texts count as
empty ones. Equal rows take neighbouring slots; rows that are equal in everything are numbered by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the published algorithm.
FACTOR = 2862933555777941757
MODULUS = 2**64
#: Rows that one task numbers, about.
BLOCK_ROWS = 50_000


def _next(state: Column) -> Column:
    """The generator's next state; decimals hold the whole product, which 64 bits can't."""
    return ((state * F.lit(FACTOR).cast("decimal(19,0)") + F.lit(1)) % F.lit(str(MODULUS)).cast("decimal(20,0)")).cast("decimal(20,0)")


def seed_of(key: Column) -> Column:
    """A key as an unsigned 64-bit number."""
    wide = F.coalesce(key.cast("bigint"), F.lit(0)).cast("decimal(20,0)")
    return F.when(wide < 0, wide + F.lit(str(MODULUS)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def jump(key: Column, *shards: int) -> Column:
    """The shards of a key for each of several numbers of shards, as an array."""
    most = max(shards)
    start = F.struct(
        seed_of(key).alias("state"), F.lit(0).cast("bigint").alias("to"), F.array(*[F.lit(0).cast("bigint") for _ in shards]).alias("at")
    )

    def step(now: Column, _: Column) -> Column:
        state = _next(now["state"])
        top = F.floor(state / F.lit(2**33).cast("decimal(20,0)")).cast("double") + 1
        to = F.floor((now["to"] + 1).cast("double") * (F.lit(float(2**31)) / top)).cast("bigint")
        at = F.array(*[F.when(now["to"] < n, now["to"]).otherwise(now["at"][i]) for i, n in enumerate(shards)])
        moved = F.struct(state.alias("state"), to.alias("to"), at.alias("at"))
        return F.when(now["to"] >= most, now).otherwise(moved)

    # A jump reaches further by one shard at least, and nearly always far more: the second loop is for the rest.
    few = F.aggregate(F.sequence(F.lit(1), F.lit(min(most + 1, 64))), start, step)
    if most + 1 <= 64:
        return few["at"]
    all_ = F.aggregate(F.sequence(F.lit(1), F.lit(most + 1)), few, step)
    return F.when(few["to"] >= most, few["at"]).otherwise(all_["at"])


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc`` (the whole row) with ``size``, ``crc``, ``shard``, ``slot`` and ``grown`` (the shard with one shard more).

    Keys of integer types are their own numbers; others are hashed to 64 bits, and missing ones count as 0.
    """
    k, body = F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    whole = isinstance(docs.schema[key].dataType, T.IntegralType)
    number = k.cast("bigint") if whole else F.when(k.isNotNull(), F.xxhash64(k))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        k.alias("key"),
        number.alias("_number"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("crc"),
        jump(number, shards, shards + 1).alias("_at"),
    ).select(
        "*", F.col("_at")[0].cast("int").alias("shard"), F.col("_at")[1].cast("int").alias("grown"),
        F.floor(_next(seed_of(F.coalesce(F.col("_number").cast("bigint"), F.lit(0)).bitwiseXOR(F.col("crc")))) / F.lit(2**33).cast("decimal(20,0)")).cast("long").alias("spread"),
    ).drop("_at", "_number")
    blocks = max(1, docs.count() // BLOCK_ROWS)
    rows = rows.withColumn("block", F.floor(F.col("spread") * blocks / 2**31).cast("int"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard and block: smaller than the rows by about BLOCK_ROWS / shards
    first = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    first = first.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "block").orderBy("spread", "key", "crc", "size")
    return (
        rows.withColumn("_n", F.row_number().over(inside))
        .join(first, ["shard", "block"])
        .select("doc", "key", "size", "crc", "shard", (F.col("first") + F.col("_n") - 1).alias("slot"), "grown")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Whole rows as Parquet, a folder per shard, in the order of their slots within each file."""
    out = sharded.select("doc.*", "shard", "slot").sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").parquet(path)
