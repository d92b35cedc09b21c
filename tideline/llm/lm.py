"""Language-model scores of whole texts: a unigram base and a gated recurrent model, both learned from the corpus.

Tokens are words in lower case (A to Z only) and one end per text. The words of a text are numbered once, in the order in which its
block of documents meets them; all later steps read the numbers and, once per block, its different words. Every block counts
these and sends them, packed, to the buckets that own them; buckets add the counts and answer each block with the counts of its
words, so no table of all words is gathered anywhere. The vocabulary of frequent words grows with the square root of the
training tokens (``vocabulary``); its words, found from the tops of all buckets by a count threshold, and the sums of the
others by kind go to the driver. The output has about the square root of the vocabulary in classes, so a token costs the
fourth root of the training tokens.

The recurrent model learns in ``ROUNDS`` rounds. Each training text is read once: a round takes its share of the blocks, every
block learns by itself from the same weights, and the weights are averaged by tokens. Scoring carries the state through each text to its end. A word
that is not frequent is predicted by its kind (length, closing mark, letters beyond ASCII) and, within the kind, by its
count plus one; a word never met in training counts as one more word of its kind.

Null texts count as empty ones: one token, the end. Missing ids count as an empty id text. Repeated rows are scored and counted each.
Without training texts all counts are zero and the model stays at its start.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import Codes, bucketed, crc_of_id, lengths, pieces, store, text_size, texts_of
from tideline.llm.hashing import word_hashes
from tideline.llm.recurrent import WINDOW, Layout, Trainer, score
from tideline.shipping import ship_package

#: Frequent words at the least.
FREQUENT = 1024
KINDS = 18
ROUNDS = 4
BLOCK = 12 << 20
#: Bytes of text for each bucket of words.
BUCKET = 24 << 20
OUT = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Numbers of a model in one row on the way to their mean.
CHUNK = 4096


def vocabulary(tokens: int) -> int:
    """Frequent words for that many training tokens."""
    return max(FREQUENT, math.isqrt(tokens) // 2)


def held_out() -> Column:
    return crc_of_id("key") % 7 == 2


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def kinds_of(words: list[bytes]) -> np.ndarray:
    """Kind of each word: three lengths, three endings, ASCII or not."""
    if not words:
        return np.empty(0, np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size)
    wide = np.add.reduceat((raw >= 128).astype(np.int64), ends - size) > 0
    last = raw[ends - 1]
    ending = np.where((last == ord(".")), 1, np.where(np.isin(last, np.frombuffer(b",;:!?%#$*&|", np.uint8)), 2, 0))
    length = np.digitize(size, (7, 11))
    return length * 6 + ending * 2 + wide


def _pack(data: bytes) -> bytes:
    return zlib.compress(data, 1)


class Sums:
    """Totals of the training tokens."""

    def __init__(self, answers: DataFrame, texts: int):
        rows = answers.where("src = -1").select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v")).collect()
        flat = np.zeros(2 * KINDS, np.int64)
        for i, v in rows:
            flat[i] = v
        tokens, words = flat.reshape(2, KINDS)
        self.texts = texts
        self.tokens, self.words = int(tokens.sum()) + texts, int(words.sum()) + (texts > 0)
        top = _most_frequent(answers, vocabulary(self.tokens))
        kind = kinds_of([w for w, _ in top])
        n = np.array([c for _, c in top], np.int64)
        # of the words that are not frequent
        self.other = tokens - np.bincount(kind, n, KINDS).astype(np.int64)
        self.other_words = words - np.bincount(kind, minlength=KINDS)
        listed = sorted([*top, (b"", texts)], key=lambda x: (-x[1], x[0]))  # the end is an empty word
        self.symbol = {w: i for i, (w, _) in enumerate(listed)}
        self.layout = Layout(np.array([c for _, c in listed], np.int64), round(math.sqrt(len(listed))), self.other)


def _most_frequent(answers: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The ``most`` most frequent words; of words with the count at the border the first ones."""
    tops = answers.where("src = -1").select(F.explode("top").alias("top")).select("top.word", "top.n")
    least, left = 0, most
    # different counts are few: they add up to the tokens
    for n, words in sorted(tops.groupBy("n").count().collect(), reverse=True):
        if words > left:
            least = n
            break
        left -= words
    found = tops.where(F.col("n") > least).collect()
    if least and left:
        found += tops.where(F.col("n") == least).orderBy("word").limit(left).collect()
    return [(bytes(r.word), r.n) for r in found]


def _numbers(text: bytes, number: Codes) -> np.ndarray:
    """Tokens of a text as numbers in the order they are first met (0: the end)."""
    words = words_of(text)
    words.append(b"")
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def numbered(docs: DataFrame, size: int, block_bytes: int = BLOCK) -> DataFrame:
    """Cut each partition into blocks of about ``block_bytes`` of ``text`` and write their tokens as numbers, bucketed by block.

    The rows of block ``src`` have their other columns and their ``tokens`` (packed numbers); one more row has only its ``words``,
    in the order of their numbers. A block holds whole documents, at least one. ``size`` is the text in all.
    """
    ship_package(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != "text"]
    shape = T.StructType.fromDDL("src long, tokens binary, words binary").fields
    shape = T.StructType([*shape, *(T.StructField(f.name, f.dataType) for f in kept)])  # all may be missing

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, filled, number, kinds = TaskContext.get().partitionId() << 32, 0, Codes({b"": 0}), None

        def words() -> pa.RecordBatch:
            cells = [pa.array([src], pa.int64()), pa.array([None], pa.binary()), pa.array([_pack(b"\n".join(number))], pa.binary())]
            return pa.RecordBatch.from_arrays([*cells, *(pa.nulls(1, k) for k in kinds.types)], names=shape.names)

        def rows(batch: pa.RecordBatch, tokens: list[bytes], to: int) -> pa.RecordBatch:
            n = len(tokens)
            cells = [pa.array([src] * n, pa.int64()), pa.array(tokens, pa.binary()), pa.nulls(n, pa.binary())]
            return pa.RecordBatch.from_arrays([*cells, *(c.slice(to - n, n) for c in batch.columns)], names=shape.names)

        for batch in pieces(batches, "text"):
            text, batch = batch.column("text"), batch.select(shape.names[3:])
            kinds, tokens = batch.schema, []
            for i, (t, n) in enumerate(zip(texts_of(text), lengths(text), strict=True)):
                n += 64  # a row is never free
                if filled and filled + n > block_bytes:
                    yield rows(batch, tokens, i)
                    yield words()
                    src, filled, number, tokens = src + 1, 0, Codes({b"": 0}), []
                tokens.append(_numbers(t, number).tobytes())
                filled += n
            yield rows(batch, tokens, batch.num_rows)
        if filled:
            yield words()

    return bucketed(docs.mapInArrow(cut, shape), "texts", max(2, math.ceil(2 * size / block_bytes)))


def _read(block: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, list[bytes]]:
    """Rows of a block's texts, their tokens as numbers, tokens of each text, and the block's words."""
    if "text" in block.column_names:  # not numbered before
        number = Codes({b"": 0})
        tokens, words = [_numbers(t, number) for t in texts_of(block["text"].combine_chunks())], list(number)
    else:
        listed = pc.is_valid(block["words"])
        words = [w for row in block.filter(listed)["words"].to_pylist() for w in zlib.decompress(row).split(b"\n")]
        words = words or [b""]
        block = block.filter(pc.invert(listed))
        tokens = [np.frombuffer(t, np.int32) for t in block["tokens"].to_pylist()]
    return block, np.concatenate([*tokens, np.empty(0, np.int32)]), np.array([len(t) for t in tokens], np.int64), words


def _symbol_of(words: list[bytes], symbol: dict[bytes, int]) -> np.ndarray:
    of = len(symbol) + np.r_[0, kinds_of(words[1:])]
    for i, w in enumerate(words):
        if w in symbol:
            of[i] = symbol[w]
    return of


def _tokens_of(blocks: DataFrame) -> list[str]:
    return ["text"] if "text" in blocks.columns else ["tokens", "words"]


def count(blocks: DataFrame, buckets: int, most: int) -> DataFrame:
    """Rows for each block and bucket (counts of the block's words, in its order) and one per bucket (``src`` -1: sums and its ``most`` top words).

    ``blocks`` are ``numbered``, or have their ``text``.
    """

    def send(block: pa.Table) -> pa.Table:
        block, flat, sizes, words = _read(block)
        learned = np.repeat(~np.array(block["held_out"].to_pylist(), bool), sizes)
        n = np.bincount(flat[learned], minlength=len(words))[1:]
        words = words[1:]
        parts = _parts(words, buckets)
        src = block["src"][0].as_py()
        return pa.table({
            "bucket": pa.array([b for b, _ in parts], pa.int32()), "src": pa.array([src] * len(parts), pa.int64()),
            "words": pa.array([_pack(b"\n".join(map(words.__getitem__, at.tolist()))) for _, at in parts], pa.binary()),
            "counts": pa.array([_pack(n[at].tobytes()) for _, at in parts], pa.binary()),
        })

    def add(lists: pa.Table) -> pa.Table:
        number, parts = Codes(), []
        for words in lists["words"].to_pylist():
            words = zlib.decompress(words).split(b"\n")
            parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        names, n = list(number), np.zeros(len(number), np.int64)
        for at, counts in zip(parts, lists["counts"].to_pylist(), strict=True):
            n[at] += np.frombuffer(zlib.decompress(counts), np.int64)  # a block names a word once
        kind = kinds_of(names)
        sums = np.r_[np.bincount(kind, n, KINDS), np.bincount(kind[n > 0], minlength=KINDS)].astype(np.int64)
        order = np.lexsort((np.arange(len(n)), -n))
        # ties by the word itself, as the driver breaks them
        least = n[order[min(most, len(n)) - 1]]
        top = sorted(((names[i], int(n[i])) for i in np.flatnonzero(n >= max(1, least))), key=lambda x: (-x[1], x[0]))[:most]
        bucket = lists["bucket"][0].as_py()
        answers = [_pack(n[at].tobytes()) for at in parts]
        kinds = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
        return pa.table({
            "src": pa.concat_arrays([lists["src"].combine_chunks(), pa.array([-1], pa.int64())]),
            "bucket": pa.array([bucket] * (len(parts) + 1), pa.int32()),
            "counts": pa.array([*answers, None], pa.binary()),
            "sums": pa.array([*[None] * len(parts), sums.tolist()], pa.list_(pa.int64())),
            "top": pa.array([*[None] * len(parts), [{"word": w, "n": c} for w, c in top]], kinds),
        })

    lists = blocks.select("src", "held_out", *_tokens_of(blocks)).groupBy("src").applyInArrow(send, "bucket int, src long, words binary, counts binary")
    shape = "src long, bucket int, counts binary, sums array<long>, top array<struct<word: binary, n: long>>"
    return store(lists.groupBy("bucket").applyInArrow(add, shape), "word-counts")


def _parts(words: list[bytes], buckets: int) -> list[tuple[int, np.ndarray]]:
    """Per bucket in turn: places of its words."""
    if not words:
        return []
    bucket = (word_hashes([b" ".join(words)])[0] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[p[0]]), p) for p in np.split(order, cuts)]


def _learner(model: dict[str, np.ndarray], layout: Layout, symbol: dict[bytes, int]):
    def learn(block: pa.Table) -> pa.Table:
        block, flat, sizes, words = _read(block)
        learned = ~np.array(block["held_out"].to_pylist(), bool)
        rows: dict[str, list] = {"chunk": [], "part": [], "tokens": [], "weights": []}
        if learned.any():
            number, sizes = flat[np.repeat(learned, sizes)], sizes[learned]
            learner = Trainer(model, layout)
            # enough lanes for speed, and enough steps to learn from a small block
            learner.learn(_symbol_of(words, symbol)[number], sizes, int(np.clip(len(number) // (WINDOW * 200), 4, 512)))
            new = np.concatenate([v.ravel() for v in learner.m.values()]).astype(np.float32)
            for i in range(0, len(new), CHUNK):
                rows["chunk"].append(i // CHUNK)
                rows["part"].append(block["src"][0].as_py() % 64)
                rows["tokens"].append(len(number))
                rows["weights"].append(new[i : i + CHUNK].tobytes())
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(rows.items(), kinds, strict=True)})

    return learn


def _merged(rows: pa.Table) -> pa.Table:
    tokens = rows["tokens"].to_pylist()
    total = sum(np.frombuffer(w, np.float32) * np.float64(n) for w, n in zip(rows["weights"].to_pylist(), tokens, strict=True))
    return pa.table({
        "chunk": rows["chunk"].slice(0, 1), "part": rows["part"].slice(0, 1),
        "tokens": pa.array([sum(tokens)], pa.int64()), "weights": pa.array([(total / sum(tokens)).astype(np.float32).tobytes()], pa.binary()),
    })


def train(blocks: DataFrame, sums: Sums, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights after all rounds."""
    layout, symbol = sums.layout, sums.symbol
    model = layout.start()
    for turn in range(rounds):
        flat = np.concatenate([v.ravel() for v in model.values()])

        shape = "chunk int, part long, tokens long, weights binary"
        share = blocks.where(F.pmod(F.hash("src"), F.lit(rounds)) == turn).select("src", "held_out", *_tokens_of(blocks))
        parts = share.groupBy("src").applyInArrow(_learner(model, layout, symbol), shape).groupBy("chunk", "part").applyInArrow(_merged, shape)
        done = parts.groupBy("chunk").applyInArrow(_merged, shape).collect()  # the size of one model
        if not done:
            continue
        for r in done:
            at = r.chunk * CHUNK
            mean = np.frombuffer(r.weights, np.float32)
            flat[at : at + len(mean)] = mean
        cuts = np.cumsum([v.size for v in model.values()])[:-1]
        model = {k: p.reshape(v.shape).astype(np.float32) for (k, v), p in zip(model.items(), np.split(flat, cuts), strict=True)}
    return model


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the key, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (both log10)."""
    rows, size = text_size(docs, f"`{text}`")
    named = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    blocks = numbered(named.withColumn("held_out", held_out()), size)
    buckets = max(8, -(-size // BUCKET))
    answers = count(blocks, buckets, vocabulary(size // 2 + 2 * rows))  # no text has more words than half its bytes, rounded up
    sums = Sums(answers, blocks.where("NOT held_out").count())
    model = train(blocks, sums)
    layout, symbol = sums.layout, sums.symbol
    shape = T.StructType([named.schema["key"], *T.StructType.fromDDL(OUT).fields])

    def rate(block: pa.Table, counts: pa.Table) -> pa.Table:
        block, flat, sizes, words = _read(block)
        got = dict(zip(counts["bucket"].to_pylist(), counts["counts"].to_pylist(), strict=True))
        c = np.zeros(len(words), np.int64)
        c[0] = sums.texts
        for bucket, at in _parts(words[1:], buckets) if block.num_rows else []:
            c[1 + at] = np.frombuffer(zlib.decompress(got[bucket]), np.int64)
        of = _symbol_of(words, symbol)
        kind = of - len(symbol)
        within = np.where(kind >= 0, np.log((c + 1.0) / (sums.other + sums.other_words + 1)[np.maximum(kind, 0)]), 0.0)
        logp = score(model, layout, of[flat], sizes) + within[flat]
        add = lambda v: np.add.reduceat(v, np.cumsum(sizes) - sizes) if len(sizes) else np.empty(0, v.dtype)
        base = add(np.log10(c + 1.0)[flat]) - sizes * np.log10(sums.tokens + sums.words + 1)
        return pa.table({
            "key": block["key"], "held_out": block["held_out"], "n_tokens": pa.array(sizes, pa.int64()),
            "n_known": pa.array(add((c > 0).astype(np.int64)[flat]), pa.int64()),
            "train_tokens": pa.array(np.full(len(sizes), sums.tokens), pa.int64()),
            "base_score": pa.array(base, pa.float64()), "score": pa.array(add(logp) / np.log(10), pa.float64()),
        })

    told = answers.where("src >= 0").select("src", "bucket", "counts")
    return blocks.groupBy("src").cogroup(told.groupBy("src")).applyInArrow(rate, shape).withColumnRenamed("key", key)
