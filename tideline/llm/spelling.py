"""Spelling variants: words one edit apart, found by one-edit neighbourhoods in a reduced alphabet.

Letters are hashed to a few symbols, so that words become reduced words. If two words differ by one inserted, deleted or
replaced code point, their reduced words are equal or differ by one symbol. So every word generates all reduced words
within one edit of its own, each once, and these are joined with the reduced words of the vocabulary. Pairs that meet are
verified on the original strings. Reduced words travel as 64-bit hashes, which only ever add candidates.

More symbols mean fewer words that share a reduced word but larger neighbourhoods. The alphabet is the smallest of
``ALPHABETS`` for which the words meet on average at most ``CROWD`` others in their own reduced word; the largest is the
whole alphabet, in which no two words meet. So crowded reduced words are parted by more symbols, and none is cut.

A word's form is its near word with the most occurrences (ties: the first by code points), if it has at least ``ratio`` times
the word's own; roots follow forms to the last. Forms grow by that factor, so chains are short.

Null and empty texts have no words, a missing id counts as an empty text, and equal rows count as often as they occur. Very long
texts are cut between runs of letters; a very long word sends its neighbours as hashes, not as strings. No other columns
are read, so their names don't matter. A table without rows gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import pieces, store, texts_of
from tideline.llm.hashing import mixed, powers
from tideline.shipping import ship_package

#: Letters of a run: A-Z, a-z and U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
#: Symbols tried, and words per reduced word that are accepted on average, besides the word itself.
ALPHABETS, CROWD = (4, 8, 16, 32, 128), 8.0
#: Distinct words counted before they leave a task, and bytes of words whose neighbours are computed at once, about.
COUNTED, AT_ONCE = 100_000, 1 << 16
#: Neighbours that a word sends per symbol, and that a task sends, about.
NEIGHBOURS, SENT = 10, 8_000_000
#: Text that is cut into runs at once, about.
PIECE = 1 << 20
#: Base of the hashes and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_SEEDS = np.random.Generator(np.random.PCG64(20240918)).integers(1, 1 << 63, 257, dtype=np.uint64)
#: The end of a word enters its hash like a symbol.
END = _SEEDS[256]


def runs(text: str, least: int) -> Iterator[list[str]]:
    """Maximal runs of at least ``least`` letters, about ``PIECE`` characters at a time."""
    found, gap, start = re.compile(f"[{LETTERS}]{{{least},}}"), re.compile(f"[^{LETTERS}]"), 0
    while start < len(text):
        at = gap.search(text, start + PIECE) if len(text) - start > PIECE else None
        end = at.start() if at else len(text)
        yield found.findall(text, start, end)
        start = end


def words_of(doc_id: object, text: str, least: int, noise: int) -> Counter:
    """Words of a document. One in ``noise`` of its distinct runs, by CRC-32, loses a letter."""
    out, head = Counter(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    seen = Counter()
    for part in runs(text, least):
        seen.update(part)
    for run, n in seen.items():
        h = zlib.crc32(run.encode(), head)
        if h % noise == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= least:
            out[run] += n
    return out


def count_words(docs: DataFrame, least: int, noise: int) -> DataFrame:
    """``word`` and ``n`` over all documents (``key``, ``text``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})
            total.clear()
            return out

        for batch in pieces(batches, "text"):
            for key, raw in zip(batch.column("key").to_pylist(), texts_of(batch.column("text")), strict=True):
                total.update(words_of(key, raw.lower().decode(), least, noise))
                if len(total) > COUNTED:
                    yield flush()
        if total:
            yield flush()

    named = docs.mapInArrow(count, "word string, n long")
    return named.groupBy("word").agg(F.sum("n").alias("n"))


def letter_symbols(symbols: int) -> np.ndarray:
    """The hashed symbol of each code point up to U+00FF; from 128 on each letter has its own."""
    return _SEEDS[np.arange(256) if symbols >= 128 else (mixed(_SEEDS[:256]) % np.uint64(symbols)).astype(np.int64)]


def flat_symbols(words: pa.Array, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words in one array, and the length of each word."""
    raw = "".join(words.to_pylist()).encode("latin-1")
    lens = np.array([len(w) for w in words.to_pylist()], np.int64)
    return letter_symbols(symbols)[np.frombuffer(raw, np.uint8)], lens


def _prefix_sums(flat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place within its word, powers of the base there, and the sum of the terms before and in all, per symbol."""
    ends = np.cumsum(lens)
    place = np.arange(len(flat)) - np.repeat(ends - lens, lens)
    power = powers(BASE, int(lens.max(initial=0)) + 2)
    terms = flat * power[place]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    first = sums[ends - lens]
    return place, power, sums[:-1] - np.repeat(first, lens), sums[ends] - first


def reduced_hashes(words: pa.Array, symbols: int) -> np.ndarray:
    """Hash of each reduced word."""
    flat, lens = flat_symbols(words, symbols)
    power = powers(BASE, int(lens.max(initial=0)) + 2)
    return mixed(_prefix_sums(flat, lens)[3] + power[lens] * END)


def neighbour_hashes(words: pa.Array, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of all reduced words within one edit of each word's own, each once, and the place of the word; a part per symbol.

    A run of equal symbols loses its first only, and a symbol is inserted only before a different one or at the end, so no
    neighbour is made twice.
    """
    flat, lens = flat_symbols(words, symbols)
    place, power, before, total = _prefix_sums(flat, lens)
    owner = np.repeat(np.arange(len(lens)), lens)
    letters = np.unique(letter_symbols(symbols)[[*range(97, 123), *range(0xC0, 0x100)]])
    here, base, back = power[place], np.uint64(BASE), np.uint64(INVERSE)
    rest = total[owner] - before  # the term here and all behind it
    starts = np.ones(len(flat), bool)
    starts[1:] = (flat[1:] != flat[:-1]) | (place[1:] == 0)
    every = np.arange(len(lens))
    yield mixed(total + power[lens] * END), every
    lost = before + (rest - flat * here) * back + power[lens[owner] - 1] * END
    yield mixed(lost[starts]), owner[starts]
    for s in letters:
        other = flat != s
        replaced = total[owner] + (s - flat) * here + power[lens[owner]] * END
        inserted = before + s * here + rest * base + power[lens[owner] + 1] * END
        appended = total + s * power[lens] + power[lens + 1] * END
        yield mixed(np.concatenate([replaced[other], inserted[other], appended])), np.concatenate([owner[other], owner[other], every])


def letters_of(words: pa.Array) -> np.ndarray:
    """64 bits per word that say which letters occur, some letters sharing a bit. One edit changes at most two bits."""
    flat, lens = flat_symbols(words, 64)
    bits = np.uint64(1) << (flat % np.uint64(64))
    return np.bitwise_or.reduceat(bits, np.cumsum(lens) - lens)


def crowd(vocabulary: DataFrame, symbols: int) -> tuple[int, float]:
    """Words, and the other words that one meets in its own reduced word, on average."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "word"):
            yield pa.RecordBatch.from_arrays([pa.array(reduced_hashes(batch.column("word"), symbols).view(np.int64))], names=["key"])

    met = vocabulary.select("word").mapInArrow(own, "key long").groupBy("key").count()
    words, pairs = met.agg(F.sum("count"), F.sum(F.col("count").cast("double") * F.col("count"))).first()
    return (words, pairs / words - 1) if words else (0, 0.0)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """Ordered pairs of near words of a stored vocabulary (id, word, n): ``id`` and the other's ``near``, ``near_n``.

    A word sends only neighbours that come after its own reduced word, or equal it: of two reduced words the first finds the second.
    Pairs that differ in more than two bits of their letters are dropped where they meet, the others verified on the words.
    """
    for symbols in ALPHABETS:
        words, met = crowd(vocabulary, symbols)
        if met <= CROWD:
            break

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "word"):
            keys, bits = reduced_hashes(batch.column("word"), symbols), letters_of(batch.column("word"))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(bits.view(np.int64)), batch.column("id")], names=["key", "other_bits", "other"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "word", AT_ONCE):
            own_keys, bits = reduced_hashes(batch.column("word"), symbols), letters_of(batch.column("word")).view(np.int64)
            ids = batch.column("id").to_numpy()
            for keys, who in neighbour_hashes(batch.column("word"), symbols):
                later = keys >= own_keys[who]
                keys, who = keys[later], who[later]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(bits[who]), pa.array(ids[who])], names=["key", "bits", "id"])

    tasks = max(8, math.ceil(words * symbols * NEIGHBOURS / SENT))
    spread = vocabulary.select("id", "word").repartition(tasks, "id")
    asked = spread.mapInArrow(around, "key long, bits long, id long")
    reduced = vocabulary.select("id", "word").mapInArrow(own, "key long, other_bits long, other long")
    # equal reduced words find each other from both sides, so one of the two is left out
    alike = (F.bit_count(F.col("bits").bitwiseXOR(F.col("other_bits"))) <= 2) & (F.col("id") != F.col("other"))
    met = asked.join(reduced, "key").where(alike).select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")).distinct()
    one = vocabulary.select("id", "word", "n")
    two = vocabulary.select(F.col("id").alias("other"), F.col("word").alias("other_word"), F.col("n").alias("other_n"))
    pairs = met.join(one, "id").join(two, "other").where(F.levenshtein("word", "other_word", 1) == 1)
    sides = F.array(
        F.struct("id", F.col("other_word").alias("near"), F.col("other_n").alias("near_n")),
        F.struct(F.col("other").alias("id"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )
    return pairs.select(F.inline(sides))


def roots(forms: DataFrame) -> DataFrame:
    """The last form of each word of ``forms`` (word, form); every step doubles the length of a followed chain."""
    links = store(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = links.join(further, "root", "left")
        links = store(ahead.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        if not links.where("moved").limit(1).count():
            return links.select("word", "root")
        links = links.select("word", "root")


def variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = 6, occurrences: int = 5, ratio: int = 5, noise: int = 199,
) -> DataFrame:
    """Per word of at least ``letters`` code points and ``occurrences``: ``n``, ``n_near``, ``form``, ``form_n`` and ``root``."""
    ship_package(docs.sparkSession)
    named = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    counted = count_words(named, letters, noise).where(F.col("n") >= occurrences)
    vocabulary = store(counted.withColumn("id", F.monotonically_increasing_id()).select("id", "word", "n"), "vocabulary")
    near = near_words(vocabulary).groupBy("id").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top")
    )
    strong = F.coalesce(-F.col("top.less") >= F.lit(ratio) * F.col("n"), F.lit(False))
    judged = store(
        vocabulary.join(near, "id", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("top.near")).alias("form"),
            F.when(strong, -F.col("top.less")).alias("form_n"),
        ),
        "spellings",
    )
    last = roots(judged.where("form IS NOT NULL"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
