"""Substring dedup with super-k-mers: words covered by a repeated window of ``WINDOW`` words are removed.

The minimiser of a window is the least hash of its runs of ``SEED`` words. Consecutive windows of a document that share
their minimiser travel as one packed string, the words they cover, to the bucket that the minimiser names. Equal windows
have equal minimisers, so each bucket sees all copies of its windows; it hashes them, sorts the hashes, compares the
words of neighbours that agree, and answers with a bit per window. Each block then takes the covered words out of its texts.

A block sends equal strings once, with a mark that they repeat. Minimisers are counted first, in ``SLOTS`` slots; where one slot
alone would fill a good part of a bucket, its windows travel singly, to buckets named by the whole window.

Null and empty texts have no words. Texts with fewer words than a window keep them all. Rows are told apart by their
place, so repeated rows repeat each other's windows like any two documents, and missing ids are fine.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import store, text_size, texts_of, to_blocks
from tideline.llm.hashing import mixed, run_hashes, word_hashes

WINDOW = 35
SEED = 4
SLOTS = 1 << 16
#: Bytes of packed strings that one bucket gets, about.
BUCKET = 12 << 20
#: Bytes of text in a block, about.
BLOCK = 8 << 20


@dataclass
class Strings:
    """The packed strings of a block: runs of windows by place of the first word, and where each goes."""

    texts: list[bytes]
    words: np.ndarray  # places in ``data`` of all words: start and end
    counts: np.ndarray
    data: bytes
    first: np.ndarray  # first window of a run
    size: np.ndarray  # windows of a run
    value: np.ndarray  # names the bucket
    slot: np.ndarray


def cut(texts: list[bytes], window: int, hot: np.ndarray) -> Strings:
    """Runs of windows with one minimiser; windows of hot slots by themselves."""
    texts = [b" ".join(t.split()) for t in texts]
    hashes, starts, ends, counts, data = word_hashes(texts)
    seeds = run_hashes(hashes, min(SEED, window))
    none = np.empty(0, np.int64)
    least, span = seeds, window - min(SEED, window) + 1
    width = 1
    while width * 2 <= span:  # the least of twice as many
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    last = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(max(0, len(hashes) - window + 1))
    place = place[place + window <= last[doc[place]]]
    if not len(place):
        return Strings(texts, np.stack([starts, ends], 1), counts, data, none, none, none.astype(np.uint64), none)
    value = least[place]
    slot = (mixed(value) & np.uint64(SLOTS - 1)).astype(np.int64)
    single = hot[slot]
    if single.any():
        value = np.where(single, run_hashes(hashes, window)[place], value)
    new = np.r_[True, (value[1:] != value[:-1]) | (place[1:] != place[:-1] + 1) | single[1:]]
    begin = np.flatnonzero(new)
    size = np.diff(np.r_[begin, len(place)])
    return Strings(texts, np.stack([starts, ends], 1), counts, data, place[begin], size, value[begin], slot[begin])


def packed(s: Strings, window: int) -> tuple[list[bytes], np.ndarray]:
    """The different strings in the order they are first met, and the number of each run's string."""
    a = s.words[s.first, 0].tolist()
    b = s.words[s.first + s.size + window - 2, 1].tolist()
    number: dict[bytes, int] = {}
    ids = [number.setdefault(s.data[x:y], len(number)) for x, y in zip(a, b, strict=True)]
    return list(number), np.array(ids, np.int64)


def repeated(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each string whether it starts anywhere else, and how many windows each string has."""
    hashes, starts, ends, counts, data = word_hashes(strings)
    sizes = counts - window + 1
    owner = np.repeat(np.arange(len(strings)), sizes)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = (np.cumsum(counts) - counts)[owner] + offset
    key = run_hashes(hashes, window)[place]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    x, y = order[same], order[same + 1]
    # neighbours in the order whose windows run along two strings side by side are compared in one piece
    along = np.lexsort((offset[x], offset[y] - offset[x], owner[y], owner[x]))
    x, y = x[along], y[along]
    if len(x):
        new = np.r_[True, (owner[x[1:]] != owner[x[:-1]]) | (owner[y[1:]] != owner[y[:-1]]) | (x[1:] != x[:-1] + 1) | (y[1:] != y[:-1] + 1)]
        head = np.flatnonzero(new)
        tail = np.r_[head[1:], len(x)] - 1
        spans = zip(starts[place[x[head]]].tolist(), ends[place[x[tail]] + window - 1].tolist(), starts[place[y[head]]].tolist(), ends[place[y[tail]] + window - 1].tolist(), strict=True)
        if not all(data[a:b] == data[c:d] for a, b, c, d in spans):
            return _by_bytes(data, starts[place], ends[place + window - 1]), sizes
    flags = np.zeros(len(key), bool)
    flags[x] = flags[y] = True
    return flags, sizes


def _by_bytes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same from the windows' bytes alone, for when hashes agree by chance."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(data[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    return np.bincount(ids)[ids] > 1


def remove_repeated(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, ``n_words``, ``n_removed`` and ``kept`` (the words that stay, joined by blanks) of every row."""
    _, size = text_size(docs, f"`{text}`")
    named = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    blocks = to_blocks(named, "windows", size, BLOCK)
    # packed strings hold a word about three times
    buckets = max(16, math.ceil(3 * size / BUCKET))
    cold = np.zeros(SLOTS, bool)

    def count(block: pa.Table) -> pa.Table:
        s = cut(texts_of(block["text"].combine_chunks()), window, cold)
        n = np.bincount(s.slot, s.size + window, minlength=SLOTS).astype(np.int64)
        used = np.flatnonzero(n)
        return pa.table({"slot": pa.array(used), "words": pa.array(n[used])})

    slots = blocks.select("src", "text").groupBy("src").applyInArrow(count, "slot long, words long").groupBy("slot").agg(F.sum("words").alias("words"))
    slots = store(slots, "slots")
    total = slots.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    hot = np.zeros(SLOTS, bool)
    hot[[r[0] for r in slots.where(F.col("words") * 4 * buckets > F.lit(total)).select("slot").collect()]] = True

    def send(block: pa.Table) -> pa.Table:
        s = cut(texts_of(block["text"].combine_chunks()), window, hot)
        strings, ids = packed(s, window)
        out: dict[str, list] = {"bucket": [], "src": [], "strings": [], "twice": []}
        for bucket, chosen, twice in _dealt(s, ids, len(strings), buckets):
            out["bucket"].append(bucket)
            out["src"].append(block["src"][0].as_py())
            out["strings"].append(pa.compress(b"\n".join([strings[i] for i in chosen.tolist()]), "zstd", asbytes=True))
            out["twice"].append(np.packbits(twice).tobytes())
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        sizes = [sum(len(strings[i]) + 1 for i in chosen.tolist()) - 1 for _, chosen, _ in _dealt(s, ids, len(strings), buckets)]
        cols = {n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds, strict=True)}
        return pa.table(cols | {"size": pa.array(sizes, pa.int64())})

    def answer(lists: pa.Table) -> pa.Table:
        parts = [pa.decompress(c, n, "zstd", asbytes=True).split(b"\n") for c, n in zip(lists["strings"].to_pylist(), lists["size"].to_pylist(), strict=True)]
        flags, sizes = repeated([x for p in parts for x in p], window)
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(p)) for t, p in zip(lists["twice"].to_pylist(), parts, strict=True)])
        flags |= np.repeat(twice.astype(bool), sizes)
        ends = np.cumsum(sizes)[np.cumsum([len(p) for p in parts]) - 1]
        bits = [np.packbits(f).tobytes() for f in np.split(flags, ends[:-1])]
        return pa.table({"src": lists["src"], "bucket": lists["bucket"], "bits": pa.array(bits, pa.binary())})

    def finish(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table({"key": block["key"], "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
        s = cut(texts_of(block["text"].combine_chunks()), window, hot)
        strings, ids = packed(s, window)
        windows = np.zeros(len(strings), np.int64)
        windows[ids] = s.size
        bits = dict(zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True))
        at = np.zeros(len(strings), np.int64)  # where a string's flags start
        flags, filled = [], 0
        for bucket, chosen, _ in _dealt(s, ids, len(strings), buckets):
            n = windows[chosen]
            at[chosen] = filled + np.cumsum(n) - n
            flags.append(np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=int(n.sum())))
            filled += int(n.sum())
        cover = np.zeros(int(s.counts.sum()) + 1, np.int64)
        if flags:
            flat = np.concatenate(flags).astype(bool)
            inside = np.arange(s.size.sum()) - np.repeat(np.cumsum(s.size) - s.size, s.size)
            hit = flat[np.repeat(at[ids], s.size) + inside]
            place = (np.repeat(s.first, s.size) + inside)[hit]
            np.add.at(cover, place, 1)
            np.add.at(cover, place + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        ends = np.cumsum(s.counts)
        removed = np.diff(np.r_[0, np.cumsum(gone)][np.r_[0, ends]])
        kept = []
        for t, end, n, r in zip(s.texts, ends.tolist(), s.counts.tolist(), removed.tolist(), strict=True):
            kept.append(b" ".join([w for w, g in zip(t.split(), gone[end - n : end].tolist(), strict=True) if not g]) if r else t)
        return pa.table({
            "key": block["key"], "n_words": pa.array(s.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    lists = blocks.select("src", "text").groupBy("src").applyInArrow(send, "bucket int, src long, strings binary, twice binary, size long")
    answers = lists.groupBy("bucket").applyInArrow(answer, "src long, bucket int, bits binary")
    shape = T.StructType([named.schema["key"], *T.StructType.fromDDL("n_words long, n_removed long, kept string").fields])
    out = blocks.groupBy("src").cogroup(answers.groupBy("src")).applyInArrow(finish, shape)
    return out.withColumnRenamed("key", key)


def _dealt(s: Strings, ids: np.ndarray, n: int, buckets: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per bucket in turn its strings and whether the block has them twice."""
    if not n:
        return []
    value = np.zeros(n, np.uint64)
    value[ids] = s.value
    bucket = (mixed(value + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
    twice = np.bincount(ids, minlength=n) > 1
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[c[0]]), c, twice[c]) for c in np.split(order, cuts)]
