"""Near duplicates: an n-gram Jaccard join with a MinHash LSH forest and exact verification.

A text is the set of its runs of five words (a shorter text is one run). Texts with equal sets form a class first, so
copies are never compared. Each class has a signature: one label sequence of ``labels`` minimum hashes (16 bits each) per
tree, which is its path in that tree of the forest. Classes whose paths share a prefix meet in the node of that prefix.

Prefixes start at full length and are shortened by what the data shows: after each length the pairs found so far are known
exactly, and as long as pairs as unlike as the most unlike of them would meet in some tree with less than the target
probability, prefixes lose one more label. Without any pair the wanted similarity itself is asked for. The shortest length that
can come up (``depth_for``) gives that probability at the wanted similarity; classes that share no prefix of that length never
meet and leave the forest at its start, with their texts. A pair is compared at the longest prefix at which it meets only.

The pairs of a node are looked at inside one task and never written out. A pair belongs to the first tree in which it
meets at that length. A first pass over the labels finds the members that own pairs; only their texts are sent on, to be compared
exactly. A node larger than ``CELL`` is dealt out to the cells of a triangle, each holding two parts of its members.
A member leaves with its number of links and one edge to the smallest member it is connected with, so the rows stay
linear in the members. Edges are then joined to connected components in rounds of joins.

Texts without words, null ones too, form one class without links to others. Rows are told apart by their place in the
written table, so repeated and missing ids are fine: of each component the row with the least id (missing last) stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import join_counted, join_matching, pieces, released, store, texts_of
from tideline.llm.hashing import mixed, shingles
from tideline.shipping import ship_package

WORDS = 5
SIMILARITY = 0.8
TREES = 16
LABELS = 6
RECALL = 0.9999
#: Members of a node that one task compares; larger nodes are cut into parts of half that size.
CELL = 2048
#: Bytes of text that a task shingles at once, about, besides a larger group.
GROUPED = 4 << 20


def depth_for(similarity: float, trees: int, labels: int, recall: float) -> int:
    """Shorten the prefix until pairs of that similarity meet with the wanted probability."""
    depth = labels
    while depth > 1 and meeting(similarity, depth, trees) < recall:
        depth -= 1
    return depth


def meeting(similarity: float, depth: int, trees: int) -> float:
    """Probability that a pair shares a prefix of that length in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def _signatures(flat: np.ndarray, counts: np.ndarray, trees: int, labels: int) -> list[bytes]:
    """Minimum hashes, folded to 16 bits, trees in turn; texts without shingles get zeros."""
    random = np.random.Generator(np.random.PCG64(7))
    a = random.integers(0, 1 << 32, trees * labels, dtype=np.uint32) | np.uint32(1)
    b = random.integers(0, 1 << 32, trees * labels, dtype=np.uint32)
    out = np.zeros((len(counts), trees * labels), ">u2")
    some = counts > 0
    if some.any():
        begins = (np.cumsum(counts) - counts)[some]
        low = (flat >> np.uint64(32)).astype(np.uint32)
        for j in range(trees * labels):
            least = np.minimum.reduceat((low ^ b[j]) * a[j], begins)
            out[some, j] = (least ^ (least >> np.uint32(16))) & np.uint32(0xFFFF)
    return [row.tobytes() for row in out]


def _prefixes(signatures: pa.Array, trees: int, labels: int, depth: int) -> np.ndarray:
    """Prefixes of ``depth`` labels, packed into 64-bit numbers: members x trees x numbers."""
    paths = np.frombuffer(b"".join(signatures.to_pylist()), ">u2").reshape(-1, trees, labels)[:, :, :depth]
    out = np.zeros((*paths.shape[:2], (depth + 3) // 4), np.uint64)
    for k in range(depth):
        out[:, :, k // 4] |= paths[:, :, k].astype(np.uint64) << np.uint64(16 * (k % 4))
    return out


def sketch(docs: DataFrame, text: str, words: int, trees: int, labels: int) -> DataFrame:
    """Whole rows as ``doc``, with ``row``, ``body`` (text), ``n`` (shingles), ``set`` (its hash) and ``signature``."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in pieces(batches, "body"):
            flat, counts = shingles(texts_of(batch.column("body")), words)
            signatures = _signatures(flat, counts, trees, labels)
            total = np.zeros((len(counts), 2), np.uint64)
            if len(flat):
                owner = np.repeat(np.arange(len(counts)), counts)
                np.add.at(total[:, 0], owner, flat)
                np.add.at(total[:, 1], owner, mixed(flat + np.uint64(99)))
            sets = [f"{a:016x}{b:016x}{n:x}" for (a, b), n in zip(total.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(row + np.arange(len(counts))), pa.array(counts), pa.array(sets), pa.array(signatures, pa.binary())],
                names=["doc", "body", "row", "n", "set", "signature"],
            )
            row += len(counts)

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{text}`").alias("body"))
    more = "row long, n long, set string, signature binary"
    return packed.mapInArrow(released(run), T.StructType([*packed.schema.fields, *T.StructType.fromDDL(more).fields]))


def _groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows in batches that hold whole groups (equal node and cell)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows if least < 1 << 20 else b.nbytes for b in held) < least:
            continue
        all_ = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        node, cell = (all_.column(c).to_numpy() for c in ("node", "cell"))
        last = np.flatnonzero((node[1:] != node[:-1]) | (cell[1:] != cell[:-1]))
        held = [all_]
        if len(last):
            yield all_.slice(0, last[-1] + 1)
            held = [all_.slice(last[-1] + 1)]
    held = [b for b in held if b.num_rows]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


#: Trees and labels of the forest, and the length of its prefixes.
Shape = tuple[int, int, int]


def _owned_pairs(batch: pa.RecordBatch, shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a node that meet in no earlier tree and at no longer prefix, in runs of equal distance."""
    trees, labels, depth = shape
    node, cell, part, tree = (batch.column(c).to_numpy() for c in ("node", "cell", "part", "tree"))
    prefix = _prefixes(batch.column("signature"), trees, labels, depth)
    longer = _prefixes(batch.column("signature"), trees, labels, depth + 1) if depth < labels else None
    # in a cell of two different parts only pairs across them count
    across = (cell >> 20) != (cell & 0xFFFFF)
    start = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (cell[1:] != cell[:-1])])
    end = np.repeat(np.r_[start[1:], len(node)], np.diff(np.r_[start, len(node)]))
    rows = np.arange(len(node))
    offset = 1
    while len(rows := rows[rows + offset < end[rows]]):
        i, j = rows, rows + offset
        ok = ~across[i] | (part[i] != part[j])
        i, j = i[ok], j[ok]
        if len(i):
            equal = (prefix[i] == prefix[j]).all(2)
            own = equal[np.arange(len(i)), tree[i]] & (equal.argmax(1) == tree[i])
            i, j = i[own], j[own]
            if longer is not None and len(i):
                new = ~(longer[i] == longer[j]).all(2).any(1)
                i, j = i[new], j[new]
            yield i, j
        offset += 1


def _owners(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, 1 << 14):
            marked = np.zeros(batch.num_rows, bool)
            for i, j in _owned_pairs(batch, shape):
                marked[i] = marked[j] = True
            yield batch.filter(pa.array(marked))

    return run


def _verify(words: int, similarity: float, shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(pieces(batches, "body", GROUPED), GROUPED):
            flat, counts = shingles(texts_of(batch.column("body")), words)
            ends = np.cumsum(counts)
            ids, copies = batch.column("id").to_numpy(), batch.column("copies").to_numpy()
            links, root, least = np.zeros(len(ids), np.int64), np.arange(len(ids)), np.ones(len(ids))
            node, cell = (batch.column(c).to_numpy() for c in ("node", "cell"))
            start = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (cell[1:] != cell[:-1])])
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(ids)], strict=True):
                part = batch.slice(a, b - a)
                pairs = [p for p in _owned_pairs(part, shape) if len(p[0])]
                if not pairs:
                    continue
                i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
                n = counts[a:b]
                # the shingles that two members have, numbered; each member as a row of bits
                values, number, seen = np.unique(flat[ends[a] - counts[a] : ends[b - 1]], return_inverse=True, return_counts=True)
                shared = np.cumsum(seen > 1) - 1
                owner = np.repeat(np.arange(b - a), n)
                use = seen[number] > 1
                width = int(shared[-1] + 1) if len(shared) else 0
                del values
                bits = np.zeros((b - a, width // 64 + 1), np.uint64)
                col = shared[number[use]]
                np.bitwise_or.at(bits, (owner[use], col >> 6), np.uint64(1) << (col & 63).astype(np.uint64))
                step = max(1, (1 << 20) // bits.shape[1])
                for k in range(0, len(i), step):
                    x, y = i[k : k + step], j[k : k + step]
                    both = np.bitwise_count(bits[x] & bits[y]).sum(1, dtype=np.int64)
                    ok = both >= similarity * (n[x] + n[y] - both) - 1e-9
                    alike = (both / (n[x] + n[y] - both))[ok]
                    x, y = x[ok] + a, y[ok] + a
                    np.minimum.at(least, x, alike)
                    np.add.at(links, x, copies[y])
                    np.add.at(links, y, copies[x])
                    while len(x):  # hang the larger root below the smaller one until all pairs agree
                        rx, ry = root[x], root[y]
                        keep = rx != ry
                        if not keep.any():
                            break
                        x, y, rx, ry = x[keep], y[keep], rx[keep], ry[keep]
                        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
                        while True:
                            up = root[root]
                            if (up == root).all():
                                break
                            root = up
            linked = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[linked]), pa.array(ids[root[linked]]), pa.array(links[linked]), pa.array(least[linked])],
                names=["id", "to", "links", "least"],
            )

    return run


def forest(
    sets: DataFrame, docs: DataFrame, words: int, similarity: float, trees: int, labels: int, recall: float
) -> DataFrame:
    """Links of the classes: ``id``, ``to`` (a member it is connected with), ``links`` and ``least`` (lowest similarity), several rows each."""
    floor, width = depth_for(similarity, trees, labels, recall), 2 * labels
    paths = F.expr(f"transform(sequence(0, {trees - 1}), t -> substring(signature, t * {width} + 1, {width}))")
    filled = sets.where("n > 0")
    total = filled.count() * trees
    every = filled.select("id", F.posexplode(paths).alias("tree", "path"))

    def in_nodes(rows: DataFrame, depth: int, rows_at_most: int) -> DataFrame:
        """The rows that are not alone in their node of that depth, with the node and the ``count`` of its rows."""
        placed = rows.withColumn("node", F.xxhash64("tree", F.substring("path", 1, 2 * depth)))
        shared = store(placed.groupBy("node").count().where("count > 1"), "nodes")
        return join_matching(placed, shared, "node", "count", rows_at_most)

    tries = store(in_nodes(every, floor, total).select("id", "tree", "path"), "tries")
    size = tries.count()
    inside = tries.select("id").distinct()
    bodies = docs.select(F.col("row").alias("id"), "body")
    members = store(sets.select("id", "copies", "signature").join(inside, "id").join(bodies, "id"), "members")

    def layout(df: DataFrame) -> DataFrame:
        return df.repartition("node", "cell").sortWithinPartitions("node", "cell", "id")

    result = "id long, to long, links long, least double"
    found, lowest = docs.sparkSession.createDataFrame([], result), None
    for depth in range(labels, floor - 1, -1) if size else ():
        shape, parts = (trees, labels, depth), F.ceil(F.col("count") * 2 / CELL)
        dealt = (
            in_nodes(tries, depth, size)
            .withColumn("parts", F.when(F.col("count") > CELL, parts).otherwise(F.lit(1)))
            .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            .select("node", "id", "tree", "part", (F.shiftleft(F.least("part", "other"), 20) + F.greatest("part", "other")).alias("cell"))
        )
        met = layout(dealt.join(members.drop("body"), "id").select("node", "cell", "part", "tree", "id", "copies", "signature"))
        owners = store(met.mapInArrow(released(_owners(shape)), met.schema), "owners")
        texts = layout(owners.join(members.select("id", "body"), "id"))
        links = store(texts.mapInArrow(released(_verify(words, similarity, shape)), result), "links")
        found = found.union(links)
        lowest = min((x for x in (lowest, links.agg(F.min("least")).first()[0]) if x is not None), default=None)
        if lowest is not None and meeting(lowest, depth, trees) >= recall:
            break
    return found


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``comp``, the least id it is connected with, for all ids on edges (``id``, ``to``).

    An id may have most of the edges, and a component most of the ids: both are met with their counts.
    """
    pairs = edges.select("id", "to").where("id <> to")
    both = store(pairs.union(pairs.select(F.col("to").alias("id"), F.col("id").alias("to"))).distinct(), "edges")
    total = both.count()
    label = store(both.groupBy("id").agg(F.least("id", F.min("to")).alias("comp"), F.count(F.lit(1)).alias("degree")), "labels")
    ids = label.count()
    while True:
        far = label.select(F.col("id").alias("to"), "comp", "degree")
        near = join_counted(both, far, "to", "degree", total, F.col("id")).groupBy("id").agg(F.min("comp").alias("near"))
        step = label.join(near, "id").select("id", F.least("comp", "near").alias("next"), F.col("comp").alias("was"), "degree")
        step = store(step, "steps")
        up = label.select(F.col("id").alias("next"), F.col("comp").alias("up"))
        up = step.groupBy("next").agg(F.count(F.lit(1)).alias("below")).join(up, "next")
        new = join_counted(step, up, "next", "below", ids, F.col("id"))
        new = store(new.select("id", F.least("next", "up").alias("comp"), "was", "degree"), "labels")
        if new.where("comp <> was").isEmpty():
            return new.select("id", "comp")
        label = new.select("id", "comp", "degree")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY,
    trees: int = TREES, labels: int = LABELS, recall: float = RECALL,
) -> DataFrame:
    """All rows as ``doc``, each with ``class_id``, ``class_size``, ``n_links`` and ``kept``.

    ``class_id`` is the least id of the component, ``n_links`` the number of other documents at that similarity.
    """
    docs = store(sketch(docs, text, words, trees, labels), "sketch")
    total = docs.count()
    name = F.col(f"doc.`{key}`")
    first = F.struct(name.isNull().alias("none"), name.alias("key"), F.col("row").alias("row"))
    sets = store(
        docs.groupBy("set").agg(
            F.min("row").alias("id"), F.count(F.lit(1)).alias("copies"), F.min(first).alias("first"), F.max("n").alias("n"), F.min("signature").alias("signature")
        ),
        "sets",
    )
    found = forest(sets, docs, words, similarity, trees, labels, recall)
    comps = components(found)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    rows = sets.join(comps, "id", "left").join(links, "id", "left").select(
        "set", "copies", "first", F.coalesce("comp", "id").alias("comp"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    least = rows.groupBy("comp").agg(
        F.min("first").alias("least"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("sets")
    )
    named = join_counted(rows, least, "comp", "sets", sets.count(), F.col("set")).select(
        "set", "copies", F.col("least.key").alias("class_id"), F.col("least.row").alias("keep"), "class_size", "n_links"
    )
    out = join_counted(docs.select("doc", "row", "set"), named, "set", "copies", total, F.col("row"))
    return out.select("doc", "class_id", "class_size", "n_links", (F.col("row") == F.col("keep")).alias("kept"))
