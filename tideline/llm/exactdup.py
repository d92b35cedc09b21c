"""Exact dedup by exchanging Golomb-coded fingerprints.

Texts are equal when they agree after each run of ASCII white space became one blank. Every block of documents sorts the
fingerprints of its texts (leading bits of their SHA-256), cuts them by ranges of values and sends each range to its
owner as Golomb-coded differences. An owner merges the lists it got and answers each block with a bitmap of the
fingerprints that some other block has too. Documents whose fingerprint is marked, or occurs twice in their own block, are suspects.
Only their texts are shuffled, grouped by all their bytes; fingerprints that agree by chance part there.

Null texts count as empty ones and are equal to them. The row with the least id stays, ids that are missing come last, and
among rows with equal ids the first in the table stays. Groups are pre-aggregated, and joined back by a join that
broadcasts the few largest, so a group may hold any share of the rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import join_counted, store, text_size, texts_of, to_blocks

#: Bits beyond those that number the rows: one fingerprint in 4,096 meets another by chance.
SPARE_BITS = 12
#: Fingerprints that one owner gets, about.
OWNED = 200_000
_BLANKS = b" \t\n\x0b\x0c\r"


def normal(text: bytes) -> bytes:
    """Each run of white space as one blank, at the ends too."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return (b" " if text[0] in _BLANKS else b"") + b" ".join(words) + (b" " if text[-1] in _BLANKS else b"")


def golomb_encode(values: np.ndarray, least: int, width: int) -> bytes:
    """Sorted different numbers from ``least`` on, below ``least + width``."""
    n = len(values)
    low = max(0, int(math.log2(max(1.0, 0.69 * width / n))))
    steps = np.diff(values.astype(np.int64) - least, prepend=-1) - 1
    marks = np.cumsum((steps >> low) + 1) - 1
    unary = np.zeros(int(marks[-1]) + 1, np.uint8)
    unary[marks] = 1
    rest = ((steps[:, None] >> np.arange(low)) & 1).astype(np.uint8).ravel()
    head = np.array([n, low, len(unary)], np.int64).tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def golomb_decode(code: bytes, least: int) -> np.ndarray:
    n, low, size = np.frombuffer(code, np.int64, 3).tolist()
    unary = np.unpackbits(np.frombuffer(code, np.uint8, (size + 7) // 8, 24), count=size)
    rest = np.unpackbits(np.frombuffer(code, np.uint8, offset=24 + (size + 7) // 8), count=n * low).reshape(n, low)
    steps = np.diff(np.flatnonzero(unary), prepend=-1) - 1
    steps = (steps << low) + (rest.astype(np.int64) << np.arange(low)).sum(1, dtype=np.int64)
    return np.cumsum(steps + 1) - 1 + least


def _prints(sha: pa.ChunkedArray | pa.Array, bits: int) -> np.ndarray:
    raw = b"".join(x[:8] for x in sha.to_pylist())
    return (np.frombuffer(raw, ">u8") >> np.uint64(64 - bits)).astype(np.int64)


def _ranges(bits: int, owners: int) -> np.ndarray:
    return np.array([(i << bits) // owners for i in range(owners + 1)], np.int64)


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of the normal text."""
    rows, size = text_size(docs, f"`{text}`")
    bits = min(62, max(1, rows).bit_length() + SPARE_BITS)
    owners = max(8, math.ceil(rows / OWNED))
    ranges = _ranges(bits, owners)
    named = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [normal(t) for t in texts_of(batch.column("text"))]
        sha = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.binary()).cast(pa.string()), sha], names=["key", "text", "sha"])

    shape = T.StructType([*named.schema.fields, T.StructField("sha", T.BinaryType())])
    blocks = to_blocks(named, "fingerprints", size, derive=digest, schema=shape)

    def send(block: pa.Table) -> pa.Table:
        prints = np.unique(_prints(block["sha"], bits))
        at = np.searchsorted(prints, ranges)
        full = [o for o in range(owners) if at[o] < at[o + 1]]
        codes = [golomb_encode(prints[at[o] : at[o + 1]], int(ranges[o]), int(ranges[o + 1] - ranges[o])) for o in full]
        return pa.table({"src": pa.array([block["src"][0].as_py()] * len(full), pa.int64()), "owner": pa.array(full, pa.int32()), "code": pa.array(codes, pa.binary())})

    def answer(lists: pa.Table) -> pa.Table:
        least = int(ranges[lists["owner"][0].as_py()])
        parts = [golomb_decode(c.as_py(), least) for c in lists["code"]]
        _, inverse, seen = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        marks = np.split(seen[inverse] > 1, np.cumsum([len(p) for p in parts])[:-1])
        some = [i for i, m in enumerate(marks) if m.any()]
        bitmaps = pa.array([np.packbits(marks[i]).tobytes() for i in some], pa.binary())
        return pa.table({"src": lists["src"].take(pa.array(some, pa.int64())), "owner": lists["owner"].take(pa.array(some, pa.int64())), "bitmap": bitmaps})

    def accuse(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return block.append_column("suspect", pa.array([], pa.bool_()))
        prints, inverse, seen = np.unique(_prints(block["sha"], bits), return_inverse=True, return_counts=True)
        marked, at = seen > 1, np.searchsorted(prints, ranges)
        for owner, bitmap in zip(answers["owner"].to_pylist(), answers["bitmap"].to_pylist(), strict=True):
            a, b = at[owner], at[owner + 1]
            marked[a:b] |= np.unpackbits(np.frombuffer(bitmap, np.uint8), count=b - a).astype(bool)
        suspect = marked[inverse]
        body = block["text"].combine_chunks()
        body = pc.if_else(pa.array(suspect), body, pa.scalar(None, body.type))
        return block.set_column(block.schema.get_field_index("text"), "text", body).append_column("suspect", pa.array(suspect))

    lists = blocks.select("src", "sha").groupBy("src").applyInArrow(send, "src long, owner int, code binary")
    answers = lists.groupBy("owner").applyInArrow(answer, "src long, owner int, bitmap binary")
    shape = T.StructType([*blocks.schema.fields, T.StructField("suspect", T.BooleanType())])
    found = store(blocks.groupBy("src").cogroup(answers.groupBy("src")).applyInArrow(accuse, shape), "suspects")
    suspects = found.where("suspect").withColumn("first", F.struct(F.col("key").isNull().alias("none"), "key", "src", "place"))
    groups = suspects.groupBy("text").agg(F.min("sha").alias("sha"), F.count(F.lit(1)).alias("group_size"), F.min("first").alias("least"))
    groups = groups.groupBy("sha").agg(
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two texts share a SHA-256"))).otherwise(F.max("group_size")).cast("long").alias("group_size"),
        F.min("least").alias("least"),
    )
    joined = join_counted(suspects.select("key", "sha", "first"), groups, "sha", "group_size", rows, F.struct("first"))
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    alone = found.where("NOT suspect").select("key", F.col("key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    grouped = joined.select("key", F.col("least.key").alias("keep_id"), "group_size", (F.col("first") == F.col("least")).alias("kept"), sha)
    return alone.union(grouped).withColumnRenamed("key", key)
