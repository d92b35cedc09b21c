"""Benchmark decontamination by greedy string tiling.

Tokens are runs of characters other than white space and ASCII marks, in lower case. Documents and benchmark items meet on the
hashes of runs of ``seed`` tokens that they share. Each pair that meets is tiled: the longest match of tokens that are
unmarked on both sides is marked, again and again, until no match of ``seed`` tokens is left. Matches start from a running
Karp-Rabin hash of ``seed`` tokens and are compared token by token, so a hash that happens to agree is no match. Tiles may
lie in any order, which catches reordered passages. A document is contaminated by an item if the tiles cover at least
``threshold`` of the item's tokens.

Items with fewer than ``seed`` tokens need all their tokens in a row. Items without tokens, null ones too, and null or
empty documents match nothing. Equal pairs of ids, from repeated rows, are listed once with the largest coverage.

Seeds go to the executors with the items, at most ``BROADCAST`` tokens at a time: a larger benchmark is cut into as many groups
of items as that takes, and each group passes over all documents. ``clean`` judges rows, not ids: it keeps whole rows that hold no
item, whatever other rows have the same id or none.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tideline.llm.common import pieces, released, texts_of
from tideline.llm.hashing import run_hashes, word_hashes
from tideline.shipping import ship_package

SEED = 5
THRESHOLD = 0.6
#: Tokens of the benchmark that may go to every executor at once.
BROADCAST = 1_000_000
#: Pairs of texts and items that a task gathers before it sends them on.
PAIRS = 10_000
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def cleaned(text: bytes) -> bytes:
    return text.decode().lower().encode().translate(_PLAIN)


def tile(doc: list[bytes], item: list[bytes], seed: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in doc, place in item, length) of the tiles."""
    least = min(seed, len(item))
    if not least:
        return []
    # Karp-Rabin seeds: where runs of the least length agree
    where = defaultdict(list)
    for j, h in enumerate(run_hashes(word_hashes([b" ".join(item)])[0], least).tolist()):
        where[h].append(j)
    here = run_hashes(word_hashes([b" ".join(doc)])[0], least)
    known = [(i, int(here[i])) for i in np.flatnonzero(np.isin(here, np.fromiter(where, np.uint64, len(where)))).tolist()]
    taken_doc, taken_item = bytearray(len(doc)), bytearray(len(item))

    def matches() -> Iterator[tuple[int, int, int]]:
        """Length and places of the matches by place, as they stand when asked for: pairs of places are not listed."""
        reach = {}
        for i, h in known:  # of each diagonal in order, so a match is found from its first place
            for j in where[h]:
                if reach.get(i - j, -1) > i:
                    continue
                n = 0
                while i + n < len(doc) and j + n < len(item) and not taken_doc[i + n] and not taken_item[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                if n >= least:
                    reach[i - j] = i + n - least + 1
                    yield n, i, j

    tiles = []
    while longest := max((n for n, _, _ in matches()), default=0):
        # of the longest matches all that don't overlap; those that marks cut are shorter now and come in a later round
        for n, i, j in matches():
            if n == longest:
                taken_doc[i : i + n] = taken_item[j : j + n] = b"\1" * n
                tiles.append((i, j, n))
        known = [(i, h) for i, h in known if not taken_doc[i]]
        where = {h: [j for j in places if not taken_item[j]] for h, places in where.items()}
    return tiles


def _finder(items: list[tuple[object, bytes]], seed: int):
    """A function that goes through the texts that share a seed with items: place of the text and the items' numbers."""
    seeds = defaultdict(set)
    for number, (_, text) in enumerate(items):
        words = word_hashes([text])[0]
        n = min(seed, len(words))
        for h in run_hashes(words, n).tolist() if n else ():
            seeds[n, h].add(number)
    tables = {}
    for n in sorted({n for n, _ in seeds}):
        known = np.array(sorted(h for m, h in seeds if m == n), np.uint64)
        tables[n] = known

    def find(texts: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        words, _, _, counts, _ = word_hashes(texts)
        ends, met = np.cumsum(counts), [np.empty((3, 0), np.uint64)]
        for n, known in tables.items():
            h = run_hashes(words, n)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = np.flatnonzero(known[at] == h)
            owner = np.searchsorted(ends, hit, "right")
            hit, owner = (x[hit + n <= ends[owner]] for x in (hit, owner))
            met.append(np.array([owner, np.full(len(hit), n), h[hit]], np.uint64))
        owner, size, h = np.concatenate(met, 1)
        order = np.argsort(owner, kind="stable")
        # the items of one text at a time: a common seed pairs all texts with all items that hold it
        for part in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1) if len(order) else ():
            keys = set(zip(size[part].tolist(), h[part].tolist(), strict=True))
            yield int(owner[part[0]]), sorted(set().union(*(seeds[key] for key in keys)))

    return find


def _named(items: DataFrame, item: str, item_text: str) -> DataFrame:
    return items.select(F.col(f"`{item}`").alias("item_id"), F.col(f"`{item_text}`").alias("body")).where("body IS NOT NULL")


def _item_groups(docs: DataFrame, named: DataFrame) -> Iterator[list[tuple[object, bytes]]]:
    """The different items in groups of at most ``BROADCAST`` tokens, or one larger item; ships the package too."""
    ship_package(docs.sparkSession)
    part: list[tuple[object, bytes]] = []
    filled = 0
    for r in named.distinct().toLocalIterator():
        text = cleaned(r[1].encode())
        n = len(text.split())
        if part and filled + n > BROADCAST:
            yield part
            part, filled = [], 0
        part.append((r[0], text))
        filled += n
    yield part


def clean(
    docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    seed: int = SEED, threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of ``docs``, with all columns, that no item contaminates. Each group of items sees what the ones before left."""
    place, out = docs.columns.index(text), docs
    for part in _item_groups(docs, _named(items, item, item_text)):
        out = out.mapInArrow(_cleaner(part, place, seed, threshold), docs.schema)
    return out


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", seed: int = SEED, threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id``, ``item_id``, ``matched``, ``tokens`` and ``coverage`` of the contaminated pairs."""
    source = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("body"))
    named = _named(items, item, item_text)
    kinds = [source.schema["doc_id"].dataType.simpleString(), named.schema["item_id"].dataType.simpleString()]
    shape = "doc_id {}, item_id {}, matched long, tokens long".format(*kinds)
    arrow = to_arrow_type(named.schema["item_id"].dataType)
    out = None
    for part in _item_groups(docs, named):
        found = source.mapInArrow(_tiler(part, seed, arrow), shape)
        out = found if out is None else out.union(found)
    coverage = F.col("matched") / F.col("tokens")
    best = (
        out.withColumn("coverage", coverage).where(F.col("coverage") >= threshold).groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("coverage", "matched", "tokens")).alias("best"))
    )
    return best.select("doc_id", "item_id", "best.matched", "best.tokens", "best.coverage")


def _tiler(items: list[tuple[object, bytes]], seed: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(items, seed)
        tokens = [t.split() for _, t in items]
        ids = pa.array([i for i, _ in items], kind)
        for batch in pieces(batches, "body"):
            texts = [cleaned(t) for t in texts_of(batch.column("body"))]
            at, which, matched = [], [], []

            def told() -> pa.RecordBatch:
                total = pa.array([len(tokens[n]) for n in which], pa.int64())  # noqa: B023  called at once
                cols = [batch.column("doc_id").take(pa.array(at)), ids.take(pa.array(which)), pa.array(matched, pa.int64()), total]  # noqa: B023
                return pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "matched", "tokens"])

            for i, numbers in find(texts):
                words = texts[i].split()
                for number in numbers:
                    at.append(i)
                    which.append(number)
                    matched.append(sum(n for _, _, n in tile(words, tokens[number], seed)))
                    if len(at) == PAIRS:
                        yield told()
                        at, which, matched = [], [], []
            if at:
                yield told()

    return released(run)


def _cleaner(items: list[tuple[object, bytes]], place: int, seed: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(items, seed)
        tokens = [t.split() for _, t in items]
        for batch in pieces(batches, place):
            texts = [cleaned(t) for t in texts_of(batch.column(place))]
            kept = np.ones(len(texts), bool)
            for i, numbers in find(texts):
                words = texts[i].split()
                kept[i] = all(sum(n for _, _, n in tile(words, tokens[k], seed)) / len(tokens[k]) < threshold for k in numbers)
            yield batch.filter(pa.array(kept))

    return released(run)
