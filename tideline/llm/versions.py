"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A text is cut into paragraphs at line ends, and a paragraph into passages after words whose hash says so (one in four), so
that an edit inside a paragraph changes the passages around it only. Each passage has a 64-bit digest of its words; the
i-th equal one of a text counts as a digest of its own. A sketch has three ranges of cells, and adds each digest to one cell of each
range: a count, the exclusive or of the digests, and the exclusive or of a check value.

Sketches of two versions subtract cell by cell, and what both hold vanishes. A cell left with a single digest gives it away;
it is taken out of its other cells, which may free further ones. If cells are left over, both versions are
sketched again with four times the cells and other hashes, until all differing digests are known. From them follow the
shared ones, and the likeness: shared passages over all passages (Jaccard), exact but for 64-bit collisions.

All sketches of a batch are built and peeled together in numpy. Null texts count as empty, an empty text has an empty sketch, and two
empty texts have likeness 1. Equal texts have equal fingerprints; texts that differ in blanks within lines only have, too.

``edited_versions`` needs the next document of each by ascending key. Keys are ranked by range: missing ones last,
repeated ones by a hash of the text, and rows equal in both by their place, so that no key fills a range. The first row of
each range travels to the range before as well. The input must give the same rows in the same partitions each time it is
read, as file scans do; write it first otherwise. Very long texts are whole in one task, one at a time. Columns that are not
named are not read, so their names don't matter. Tables without rows give empty results.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tideline.llm.common import pieces, store, text_size, texts_of
from tideline.llm.hashing import RUN, mixed, powers, word_hashes
from tideline.shipping import ship_package

#: Cells of a fingerprint (three ranges), growth of a retry, one passage in so many words.
CELLS, GROWTH, PASSAGE = 48, 4, 4
#: Bytes of text that are sketched at once, about, and documents.
AT_ONCE, TOGETHER = 4 << 20, 512
#: Text of a range of keys, about, most ranges, and ranges that share a task: tasks get equal shares though ranges are dealt by hash.
RANGE_BYTES, MOST_RANGES, SHARING = 4 << 20, 50_000, 8
_CELL = np.dtype([("count", "<i4"), ("digest", "<u8"), ("check", "<u4")])


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the passages of all texts in turn, and how many each text has."""
    hashes, starts, ends, counts, data = word_hashes(texts)
    if not len(hashes):
        return hashes, counts
    first = np.zeros(len(hashes), bool)
    begin = (np.cumsum(counts) - counts)[counts > 0]
    lines = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.frombuffer(data, np.uint8) == 10)])
    first[1:] = (lines[starts[1:]] > lines[ends[:-1]]) | (hashes[:-1] % np.uint64(PASSAGE) == 0)
    first[begin] = True
    at = np.flatnonzero(first)
    sizes = np.diff(at, append=len(hashes))
    place = np.arange(len(hashes)) - np.repeat(at, sizes)
    digests = mixed(np.add.reduceat(hashes * powers(RUN, int(sizes.max()))[place], at))
    owner = np.searchsorted(np.cumsum(counts), at, side="right")
    order = np.lexsort((digests, owner))
    digests, owner = digests[order], owner[order]
    new = np.ones(len(at), bool)
    new[1:] = (digests[1:] != digests[:-1]) | (owner[1:] != owner[:-1])
    run = np.flatnonzero(new)
    nth = np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))
    return mixed(digests + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.bincount(owner, minlength=len(texts))


def _cells_of(digests: np.ndarray, cells: int) -> np.ndarray:
    """The three cells of each digest, one in each third; other sizes hash anew."""
    third = np.uint64(cells // 3)
    salted = mixed(digests ^ np.uint64(cells * 0x632BE5AB))
    return np.stack([i * (cells // 3) + ((salted >> np.uint64(21 * i)) % third).astype(np.int64) for i in range(3)])


def _checks(digests: np.ndarray) -> np.ndarray:
    return (mixed(digests ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def _add(table: np.ndarray, owner: np.ndarray, digests: np.ndarray, sign: np.ndarray | int) -> None:
    """Put digests into the sketches (rows of ``table``), or take them out."""
    cells = table.shape[1]
    checks, flat = _checks(digests), table.reshape(-1)
    for at in _cells_of(digests, cells):
        where = owner * cells + at
        np.add.at(flat["count"], where, sign)
        np.bitwise_xor.at(flat["digest"], where, digests)
        np.bitwise_xor.at(flat["check"], where, checks)


def sketches(digests: np.ndarray, counts: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """One sketch per text, given all its digests in turn."""
    table = np.zeros((len(counts), cells), _CELL)
    _add(table, np.repeat(np.arange(len(counts)), counts), digests, 1)
    return table


def subtract(new: np.ndarray, old: np.ndarray) -> np.ndarray:
    out = np.empty_like(new)
    out["count"] = new["count"] - old["count"]
    out["digest"] = new["digest"] ^ old["digest"]
    out["check"] = new["check"] ^ old["check"]
    return out


def peel(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all differences: whether a sketch was emptied; and owner, digest and sign of each digest found. Empties ``table``."""
    cells, flat = table.shape[1], table.reshape(-1)
    owners, digests, signs = [], [], []
    live = np.flatnonzero(flat["count"] != 0)
    while True:
        alone = live[np.abs(flat["count"][live]) == 1]
        alone = alone[_checks(flat["digest"][alone]) == flat["check"][alone]]
        if not len(alone):
            break
        owner, digest, sign = alone // cells, flat["digest"][alone], flat["count"][alone]
        order = np.lexsort((digest, owner))
        owner, digest, sign = owner[order], digest[order], sign[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1])
        owner, digest, sign = owner[new], digest[new], sign[new]
        _add(table, owner, digest, -sign)
        owners.append(owner)
        digests.append(digest)
        signs.append(sign)
        live = np.unique((owner * cells + _cells_of(digest, cells)).ravel())
        if sum(map(len, owners)) > table.size:  # a check value agreed by chance; the retry has other cells
            break
    empty = ((table["count"] == 0) & (table["digest"] == 0) & (table["check"] == 0)).all(1)
    none = np.empty(0, np.int64)
    return empty, *(np.concatenate([z, *x]).astype(t) for z, x, t in ((none, owners, np.int64), (none.astype(np.uint64), digests, np.uint64), (none, signs, np.int64)))


def _chosen(digests: np.ndarray, counts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests and their number of the texts ``which``, in that order."""
    n = counts[which]
    start = (np.cumsum(counts) - counts)[which]
    return digests[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)], n


def differences(
    digests: np.ndarray, counts: np.ndarray, new: np.ndarray, old: np.ndarray, base: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Differing digests of pairs of texts: owner (the pair), digest and sign of each (1: in the new one only), and cells used per pair.

    ``base`` has the sketches of all texts at ``CELLS``, if they are there already.
    """
    left, cells, used = np.arange(len(new)), CELLS, np.zeros(len(new), np.int64)
    found: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]]
    while len(left):
        later = []
        # a bounded number of cells at a time
        for part in np.array_split(left, max(1, math.ceil(len(left) * cells / (1 << 20)))):
            if base is not None and cells == CELLS:
                a, b = base[new[part]], base[old[part]]
            else:
                a, b = (sketches(*_chosen(digests, counts, side[part]), cells) for side in (new, old))
            empty, owner, digest, sign = peel(subtract(a, b))
            keep = empty[owner]
            for out, x in zip(found, (part[owner[keep]], digest[keep], sign[keep]), strict=True):
                out.append(x)
            used[part[empty]] = cells
            later.append(part[~empty])
        left, cells = np.concatenate(later), cells * GROWTH
    return *(np.concatenate(x) for x in found), used


def likeness(counts: np.ndarray, new: np.ndarray, old: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Shared passages over all passages of each pair, from the differing ones' owners."""
    differing = np.bincount(owner, minlength=len(new))
    both = counts[new] + counts[old]
    return np.where(both > 0, (both - differing) / np.maximum(1, both + differing), 1.0)


def fingerprint(sketch: np.ndarray) -> str:
    """The sketch as text: hexadecimal, and only the cells that hold something."""
    full = np.flatnonzero((sketch["count"] != 0) | (sketch["digest"] != 0))
    return f"{len(sketch)}:{np.packbits(np.isin(np.arange(len(sketch)), full)).tobytes().hex()}:{sketch[full].tobytes().hex()}"


def sketch_of(text: str) -> np.ndarray:
    """The sketch of a fingerprint."""
    cells, mask, body = text.split(":")
    out = np.zeros(int(cells), _CELL)
    out[np.unpackbits(np.frombuffer(bytes.fromhex(mask), np.uint8), count=len(out)).astype(bool)] = np.frombuffer(bytes.fromhex(body), _CELL)
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, ``n_passages`` and the ``fingerprint`` of the text."""
    ship_package(docs.sparkSession)
    named = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    shape = T.StructType([named.schema["key"], *T.StructType.fromDDL("n_passages long, fingerprint string").fields])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", AT_ONCE):
            digests, counts = passages(texts_of(batch.column("text")))
            made = [fingerprint(s) for s in sketches(digests, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(counts, pa.int64()), pa.array(made, pa.string())], names=shape.names)

    return named.mapInArrow(sketch, shape).withColumnRenamed("key", key)


def compare(versions: DataFrame, key: str = "doc_id", old: str = "old", new: str = "new") -> DataFrame:
    """Per row of two versions of a text: the key, digests ``added`` and ``removed``, ``likeness`` and the ``cells`` that were enough."""
    ship_package(versions.sparkSession)
    named = versions.select(F.col(f"`{key}`").alias("key"), F.col(f"`{old}`").alias("old"), F.col(f"`{new}`").alias("new"))
    shape = T.StructType([named.schema["key"], *T.StructType.fromDDL("added array<long>, removed array<long>, likeness double, cells long").fields])

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(pieces(batches, "old", AT_ONCE), "new", AT_ONCE):
            n = batch.num_rows
            digests, counts = passages(texts_of(batch.column("old")) + texts_of(batch.column("new")))
            a, b = np.arange(n, 2 * n), np.arange(n)
            owner, digest, sign, cells = differences(digests, counts, a, b)
            sides = []
            for s in (1, -1):
                mine = np.flatnonzero(sign == s)
                mine = mine[np.lexsort((digest[mine], owner[mine]))]
                ends = np.cumsum(np.bincount(owner[mine], minlength=n))
                sides.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(digest[mine].view(np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column("key"), *sides, pa.array(likeness(counts, a, b, owner)), pa.array(cells)], names=shape.names)

    return named.mapInArrow(differ, shape).withColumnRenamed("key", key)


def edited(text: str, following: str) -> str:
    """The text whose last half is replaced by as many first characters of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rank(key: Column) -> list[Column]:
    return [key.isNull().alias("none"), key.alias("key"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place")]


def edited_versions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row, by fingerprints: how much its text is like its edited version, and like the next document by ascending key.

    Gives the key, ``n_chars``, ``edited_sha256``, both fingerprints, ``near_edited`` and ``near_next``. The next of the last is the first.
    """
    spark = docs.sparkSession
    ship_package(spark)
    named = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows, size = text_size(named)
    key_type = named.schema["key"].dataType
    shape = T.StructType([
        T.StructField(key, key_type),
        *T.StructType.fromDDL("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").fields,
    ])
    if not rows:
        return spark.createDataFrame([], shape)
    ranked = named.select(*_rank(F.col("key")), "text")
    order = ["none", "key", "hash", "place"]
    wide = min(MOST_RANGES, max(1, math.ceil(size / RANGE_BYTES)))
    parts = store(ranked.select(*order).repartitionByRange(wide, *order).withColumn("part", F.spark_partition_id()), "ranks")
    # one row per range: the least rank in each, of which there are at most MOST_RANGES
    firsts = [tuple(r["least"]) for r in parts.groupBy("part").agg(F.min(F.struct(*order)).alias("least")).orderBy("part").collect()]
    starts = spark.sparkContext.broadcast(firsts)
    to = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("after", T.BooleanType()), *ranked.schema.fields])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = list(zip(*(batch.column(c).to_pylist() for c in order), strict=True))
            at = [bisect.bisect_right(starts.value, r) - 1 for r in ids]
            first = [i for i, (r, a) in enumerate(zip(ids, at, strict=True)) if starts.value[a] == r]
            ranges = pa.array(at + [(at[i] - 1) % len(starts.value) for i in first], pa.int32())
            after = pa.array([False] * len(ids) + [True] * len(first))
            both = batch.take(pa.array([*range(len(ids)), *first], pa.int64()))
            yield pa.RecordBatch.from_arrays([ranges, after, *both.columns], names=to.names)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Each row of a range with the text of the next."""
        last = None
        for batch in pieces(batches, "text", AT_ONCE):
            for row in zip(*(batch.column(c).to_pylist() for c in ("range", "after", "key", "text")), strict=True):
                if last and last[0] == row[0]:
                    yield last[2], last[3], row[3]
                last = None if row[1] else row

    def judge(chunk: list[tuple]) -> pa.RecordBatch:
        n = len(chunk)
        made = [edited(text, following).encode() for _, text, following in chunk]
        # a row's next text is mostly the text of the row behind it, and is digested once
        texts, index = [], {}
        for t in (x for _, text, following in chunk for x in (text, following)):
            if t not in index:
                index[t] = len(texts)
                texts.append(t.encode())
        own, after = (np.array([index[row[i]] for row in chunk]) for i in (1, 2))
        digests, counts = passages(texts + made)
        base = sketches(digests, counts)
        changed = np.arange(len(texts), len(texts) + n)
        near = []
        for other in (changed, after):
            owner, *_ = differences(digests, counts, other, own, base)
            near.append(pa.array(likeness(counts, other, own, owner)))
        out = [
            [k for k, *_ in chunk], [len(t) for _, t, _ in chunk], [hashlib.sha256(t).hexdigest() for t in made],
            [fingerprint(base[i]) for i in own], [fingerprint(base[i]) for i in changed],
        ]
        fields = to_arrow_schema(shape)
        return pa.RecordBatch.from_arrays([*(pa.array(x, f.type) for x, f in zip(out, fields, strict=False)), *near], schema=fields)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, filled = [], 0
        for pair in pairs(batches):
            chunk.append(pair)
            filled += len(pair[1])
            if filled > AT_ONCE or len(chunk) >= TOGETHER:
                yield judge(chunk)
                chunk, filled = [], 0
        if chunk:
            yield judge(chunk)

    dealt = ranked.mapInArrow(deal, to).repartition(max(1, wide // SHARING), "range").sortWithinPartitions("range", "after", *order)
    return dealt.select("range", "after", "key", "text").mapInArrow(sketch, shape)
