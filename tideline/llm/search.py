"""Ranked lexical search: best-first over document intervals, bounded by range maxima.

Documents are indexed in blocks. A block holds one posting list per query term, its documents in ascending order of their
ids, and the impact of the term on each. A sparse table over every list gives the place of the largest impact in any
stretch of it, from two entries. The sum of these maxima over the terms of a query bounds the score of each document in
an interval. The search takes the interval with the greatest bound, splits it at the document with the largest single
impact, scores that document exactly, and puts the two rests back, until no bound reaches the ``k``-th score so far.

Scores are integers, so nothing depends on an order of sums. Each task carries the best ``k`` documents of a query from
block to block; equal scores go by ascending id. What remains per task is ranked by a window, which Spark limits to ``k``
rows on the map side.

Null, empty and term-free texts are in no list and count in no statistic. Queries without terms, null ones included, find nothing. Equal
rows of queries count once; a query id with several texts is several queries, ranked apart.
Missing document ids come after all others; documents with equal ids and scores go by their place in the table. Very long
texts are cut between terms while they are counted. No other columns are read, so their names don't matter. Tables without
rows give an empty result.

Queries are searched in groups of about ``group_bytes`` of text, each with an index of its own terms. One group is broadcast at a time.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tideline.llm.common import Codes, pieces, store, text_size, texts_of
from tideline.shipping import ship_package

#: Text of a block, and of a piece of a text that is cut into terms at once, about.
BLOCK_BYTES, PIECE = 16 << 20, 1 << 20
#: Bytes of a term, lower-cased; all others separate terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Fixed values of the score: unit of a saturated term, weight unit, saturation in hundredths (12 / 10), length share in hundredths.
UNIT, WEIGHT, SATURATION, LENGTH_SHARE = 1_000_000_000, 1000, 12, 25


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, about ``PIECE`` bytes at a time."""
    data, start = text.translate(TERM_BYTES), 0
    while start < len(data):
        end = data.find(b" ", start + PIECE) if len(data) - start > PIECE else len(data)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def weight(docs: int, having: int) -> int:
    return math.floor(WEIGHT * math.log((2 * docs + 2) / (2 * having + 1)))


class Block:
    """The posting lists of one block with their impacts and sparse tables."""

    def __init__(self, terms: np.ndarray, sizes: np.ndarray, places: np.ndarray, counts: np.ndarray, lens: np.ndarray,
                 weights: np.ndarray, docs: int, length: int):
        self.n = len(lens)
        self.local = {int(t): i for i, t in enumerate(terms)}
        lists = np.repeat(np.arange(len(terms), dtype=np.int64), sizes)
        self.places = places
        self.keys = lists * self.n + places
        norm = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * int(x) * docs // max(1, length) for x in lens], np.int64)
        self.impacts = weights[terms][lists] * (UNIT * counts // (WEIGHT * counts + SATURATION * norm[places]))
        # argmax of each stretch of 2^j postings; stretches that leave their list are never asked for
        level, longest = np.arange(len(places), dtype=np.int32), int(sizes.max(initial=1))
        levels, step = [level], 1
        while 2 * step <= longest:
            nxt = level.copy()
            a, b = level[:-step], level[step:]
            nxt[: len(a)] = np.where(self.impacts[b] > self.impacts[a], b, a)
            levels.append(nxt)
            level, step = nxt, 2 * step
        self.table = np.concatenate(levels)
        self.logs = np.zeros(longest + 1, np.int64)
        for j in range(1, len(levels)):
            self.logs[1 << j :] = j

    def best(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Posting with the largest impact in each non-empty stretch ``a`` to ``b``."""
        j = self.logs[b - a]
        row = j * len(self.places)
        x, y = self.table[row + a], self.table[row + b - (1 << j)]
        return np.where(self.impacts[y] > self.impacts[x], y, x)

    def search(self, query: dict[int, int], order: list[tuple], best: Best) -> None:
        """Put the best documents for ``query`` into ``best``; ``order`` has their ranks among equal scores, ascending."""
        found = [(self.local[t], times) for t, times in query.items() if t in self.local]
        if not found:
            return
        lists, times = (np.array(x, np.int64) for x in zip(*found, strict=True))
        base = lists * self.n
        heap: list = []

        def push(lo: int, hi: int, base: np.ndarray, times: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
            full = b > a
            if not full.all():
                base, times, a, b = base[full], times[full], a[full], b[full]
            if len(base):
                top = self.best(a, b)
                parts = times * self.impacts[top]
                bound = int(parts.sum())
                if best.may_hold(bound, order[lo]):
                    heapq.heappush(heap, (-bound, lo, hi, int(self.places[top[parts.argmax()]]), base, times, a, b))

        push(0, self.n, base, times, np.searchsorted(self.keys, base), np.searchsorted(self.keys, base + self.n))
        while heap:
            bound, lo, hi, at, base, times, a, b = heapq.heappop(heap)
            if not best.may_hold(-bound, order[lo]):
                continue
            c = np.searchsorted(self.keys, base + at)
            hit = (c < b) & (self.keys[np.minimum(c, len(self.keys) - 1)] == base + at)
            best.offer(int((times[hit] * self.impacts[c[hit]]).sum()), order[at])
            if at > lo:
                push(lo, at, base, times, a, c)
            if at + 1 < hi:
                push(at + 1, hi, base, times, c + hit, b)


class Best:
    """The ``k`` highest scores above 0; equal ones by ascending rank."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def may_hold(self, score: int, rank: tuple) -> bool:
        return score > 0 and (len(self.rows) < self.k or (-score, rank) < self.rows[-1])

    def offer(self, score: int, rank: tuple) -> None:
        if self.may_hold(score, rank):
            bisect.insort(self.rows, (-score, rank))
            del self.rows[self.k :]


def _index(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """One row per block: its documents, and the posting lists of the terms of the vocabulary."""
    key_type = docs.schema["key"].dataType
    shape = T.StructType([
        *T.StructType.fromDDL("src long, docs long, length long, terms array<int>, sizes array<int>, places binary, counts binary, lens array<long>").fields,
        T.StructField("ids", T.ArrayType(key_type)),
    ])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, src = vocabulary.value, TaskContext.get().partitionId() << 32
        filled = n_docs = length = 0
        ids, lens, terms, places, counts, kind = [], [], [], [], [], None

        def flush() -> pa.RecordBatch:
            by_id = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i], i))
            rank = np.empty(len(ids), np.int32)
            rank[by_id] = np.arange(len(ids), dtype=np.int32)
            t, p, c = np.array(terms, np.int32), rank[np.array(places, np.int64)], np.array(counts, np.int64)
            by_term = np.lexsort((p, t))
            names, sizes = np.unique(t, return_counts=True)
            row = [
                [src], [n_docs], [length], [names], [sizes.astype(np.int32)], [p[by_term].tobytes()], [c[by_term].tobytes()],
                [[lens[i] for i in by_id]], [[ids[i] for i in by_id]],
            ]
            types = [pa.int64()] * 3 + [pa.list_(pa.int32())] * 2 + [pa.binary()] * 2 + [pa.list_(pa.int64()), pa.list_(kind)]
            return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(row, types, strict=True)], names=shape.names)

        for batch in pieces(batches, "text"):
            kind = batch.column("key").type
            for key, text in zip(batch.column("key").to_pylist(), texts_of(batch.column("text")), strict=True):
                if filled and filled + len(text) > BLOCK_BYTES:
                    yield flush()
                    src, filled, n_docs, length = src + 1, 0, 0, 0
                    ids, lens, terms, places, counts = [], [], [], [], []
                n, found = 0, Counter()
                for part in term_lists(text):
                    n += len(part)
                    found.update(map(wanted.get, part))
                found.pop(None, None)
                filled, n_docs, length = filled + len(text) + 1, n_docs + (n > 0), length + n
                if found:
                    places += [len(ids)] * len(found)
                    terms += found.keys()
                    counts += found.values()
                    ids.append(key)
                    lens.append(n)
        if filled:
            yield flush()

    return store(docs.mapInArrow(build, shape), "postings")


def _search_group(docs: DataFrame, items: list, k: int, item_type: T.DataType) -> DataFrame:
    """The best documents for a bounded list of (id, text)."""
    spark = docs.sparkSession.sparkContext
    codes, asked = Codes(), []
    for _, text in items:
        found = Counter(t for part in term_lists((text or "").encode()) for t in part)
        asked.append({codes[t]: n for t, n in found.items()})
    vocabulary, questions = spark.broadcast(dict(codes)), spark.broadcast([(i, q) for (i, _), q in zip(items, asked, strict=True)])
    index = _index(docs, vocabulary)
    n_docs, length = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    having = np.zeros(len(codes), np.int64)
    cells = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy("x.terms").agg(F.sum("x.sizes").alias("n"))
    for term, n in cells.collect():  # one row per term of a bounded group of queries
        having[term] = n
    weights = spark.broadcast(np.array([weight(n_docs, int(n)) for n in having], np.int64))
    key_type = docs.schema["key"].dataType
    shape = T.StructType([
        T.StructField("query", T.IntegerType()), T.StructField("item", item_type), T.StructField("key", key_type),
        *T.StructType.fromDDL("src long, place long, score long").fields,
    ])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = [Best(k) for _ in questions.value], None
        for batch in batches:
            kind = batch.column("ids").type.value_type
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                ids, src = row["ids"].as_py(), row["src"].as_py()
                block = Block(
                    row["terms"].values.to_numpy(), row["sizes"].values.to_numpy(), np.frombuffer(row["places"].as_py(), np.int32),
                    np.frombuffer(row["counts"].as_py(), np.int64), row["lens"].values.to_numpy(), weights.value, n_docs, length,
                )
                order = [(x is None, x, src, place) for place, x in enumerate(ids)]
                for top, (_, query) in zip(best, questions.value, strict=True):
                    block.search(query, order, top)
        out = [(q, item, *rank[1:], -score) for q, (top, (item, _)) in enumerate(zip(best, questions.value, strict=True)) for score, rank in top.rows]
        if out:
            fields = to_arrow_schema(shape)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    return index.mapInArrow(search, shape)


def search(
    docs: DataFrame, queries: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    group_bytes: int = 4 << 20,
) -> DataFrame:
    """Per query its ``k`` best documents: ``item``, ``rank`` from 1, ``key`` and ``score``, under the callers' names of both keys."""
    spark = docs.sparkSession
    ship_package(spark)
    named = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    asked = queries.select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").alias("text")).where("text IS NOT NULL").distinct()
    item_type, size = asked.schema["item"].dataType, text_size(asked)[1]
    groups = max(1, math.ceil(size / group_bytes))
    made = []
    for g in range(groups):
        mine = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g)
        rows = sorted(((r["item"], r["text"]) for r in mine.collect()), key=lambda r: (r[0] is None, r[0], r[1]))
        if rows:
            ranked = Window.partitionBy("query").orderBy(F.desc("score"), F.col("key").asc_nulls_last(), "src", "place")
            found = _search_group(named, rows, k, item_type).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            made.append(found.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score"))
    if not made:
        shape = T.StructType([T.StructField(item, item_type), *T.StructType.fromDDL("rank int").fields, T.StructField(key, named.schema["key"].dataType), *T.StructType.fromDDL("score long").fields])
        return spark.createDataFrame([], shape)
    return reduce(DataFrame.unionAll, made)
