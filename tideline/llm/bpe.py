"""Byte-pair encoding and decoding of whole texts with a given vocabulary, in batched numpy merge rounds.

The vocabulary file describes a word-level normaliser (NFC, lower case), a pattern that cuts words, byte symbols and
ranked merges; nothing is trained. All distinct words of a batch are merged together: their symbols lie in one flat
array, each round finds the rank of every neighbouring pair by binary search over the sorted pair keys, and every
word merges its lowest-ranked pair. Words are remembered from batch to batch up to ``CACHE`` of them.

Characters that are newer than Python's Unicode tables count as symbols, not as letters.

Null texts encode like empty ones: no ids, and an empty decoded text. Rows are independent, so repeated rows, ties and
extra columns need no rule; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tideline.llm.common import Codes, pieces
from tideline.shipping import ship_package

#: Words that a worker remembers; beyond them it starts anew.
CACHE = 200_000
#: A fixed value of the vocabulary's format: white space of its patterns.
BLANK = r"\t-\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free code point."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(kept))}
    return [moved.get(b, chr(b)) for b in range(256)]


def known_class(kind: str) -> str:
    """A pattern set for a general category, without characters that are newer than Python's tables."""
    own = regex.compile(rf"\p{{{kind}}}").match
    newer = [c for c in map(chr, range(sys.maxunicode + 1)) if own(c) and unicodedata.category(c)[0] != kind]
    return rf"[\p{{{kind}}}--[{''.join(map(regex.escape, newer))}]]" if newer else rf"\p{{{kind}}}"


def normal(text: str) -> str:
    """Composed and in lower case, each character by itself."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of ranges, one after the other."""
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - total + sizes, sizes)


class Vocabulary:
    """Tables of a vocabulary file, and the words met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.end = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        ids = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        tokens = [""] * size
        for token, i in [*ids.items(), *self.special.items()]:
            tokens[i] = token
        self.tokens, self.size = pa.array(tokens), size
        byte = byte_symbols()
        self.inner = np.array([ids[c] for c in byte], np.int32)
        self.last = np.array([ids[c + self.end] for c in byte], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] * size + ids[b] for a, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        # Merging every occurrence at once is the same as one by one if what a merge makes only meets later merges.
        first = np.full(size, len(merges), np.int64)
        np.minimum.at(first, keys // size, np.arange(len(merges)))
        np.minimum.at(first, keys % size, np.arange(len(merges)))
        self.together = bool((first[made] > np.arange(len(merges))).all())
        self.common = self._pattern(r"\p{L}", r"\p{N}")
        self.rare = self._pattern(known_class("L"), known_class("N"))  # far slower
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.forget()

    @staticmethod
    def _pattern(letter: str, number: str):
        cut = rf"'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|[^{BLANK}{letter}{number}]+"
        return regex.compile(cut, regex.V1).findall

    def words(self, run: str) -> list[str]:
        return (self.common if max(run) < "\u0530" else self.rare)(run)

    def forget(self) -> None:
        """Start with the special tokens alone."""
        self.code = Codes()
        self.flat, self.start, self.length = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        codes = [self.code["", token] for token in self.special]
        self._remember(np.array([*self.special.values()], np.int32), np.ones(len(codes), np.int64))

    def _remember(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.length = np.concatenate([self.length, sizes])
        self.flat = np.concatenate([self.flat, flat])

    def split(self, text: str) -> list:
        """Runs of a text without ASCII white space, which no word crosses; a special token stands as a pair."""
        if "<|" not in text:
            return normal(text).encode().split()
        out: list = []
        for i, part in enumerate(self.marks.split(text)):
            out += [("", part)] if i % 2 else normal(part).encode().split()
        return out

    def learn(self, runs: list[bytes]) -> None:
        """Merge the words of new runs."""
        cut = [self.words(r.decode()) for r in runs]
        code = Codes()
        owned = np.fromiter((code[w] for words in cut for w in words), np.int64)
        flat, sizes = self.merge(list(code)) if code else (np.empty(0, np.int32), np.empty(0, np.int64))
        starts = np.cumsum(sizes) - sizes
        per_run = np.zeros(len(runs), np.int64)
        np.add.at(per_run, np.repeat(np.arange(len(runs)), [len(w) for w in cut]), sizes[owned])
        self._remember(flat[ragged(starts[owned], sizes[owned])], per_run)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(x) for x in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols, ends = self.inner[data], np.cumsum(sizes) - 1
        symbols[ends] = self.last[data[ends]]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = np.full(len(symbols), len(self.keys), np.int32)  # of the pair that starts here
            pair = symbols[:-1].astype(np.int64) * self.size + symbols[1:]
            at = np.searchsorted(self.keys, pair)
            at[at == len(self.keys)] = 0
            found = (self.keys[at] == pair) & (word[1:] == word[:-1])
            rank[:-1][found] = self.ranks[at[found]]
            counts = np.diff(np.r_[begins, len(symbols)])
            least = np.repeat(np.minimum.reduceat(rank, begins), counts)
            hit = (rank == least) & (least < len(self.keys))
            if self.together:
                # in a row of overlapping hits (equal symbols) every second one counts, from the left
                follows = np.r_[False, hit[:-1]] & hit & np.r_[False, word[1:] == word[:-1]]
                heads = np.flatnonzero(hit & ~follows)
                places = np.flatnonzero(hit)
                hit[places] = (places - heads[np.searchsorted(heads, places, "right") - 1]) % 2 == 0
            else:
                places = np.flatnonzero(hit)
                hit[places[1:][word[places[1:]] == word[places[:-1]]]] = False
            active = least < len(self.keys)
            if not active.all():
                done.append((word[~active], symbols[~active]))
            places = np.flatnonzero(hit)
            symbols[places] = self.made[rank[places]]
            active[places + 1] = False
            symbols, word = symbols[active], word[active]
        owner, flat = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return flat[order], np.bincount(owner, minlength=len(words))

    def encode(self, texts: list[str]) -> pa.ListArray:
        if len(self.code) > CACHE:
            self.forget()
        codes: list[int] = []
        bounds = [0]
        known = len(self.code)
        for x in texts:
            codes += map(self.code.__getitem__, self.split(x))
            bounds.append(len(codes))
        if len(self.code) > known:
            self.learn(list(islice(self.code, known, None)))
        code = np.array(codes, np.int64)
        sizes = self.length[code]
        total = np.r_[0, np.cumsum(sizes)]
        flat = self.flat[ragged(self.start[code], sizes)]
        return pa.ListArray.from_arrays(pa.array(total[bounds].astype(np.int32)), pa.array(flat))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Tokens joined by a blank, as a vocabulary without a decoder has it."""
        flat = self.tokens.take(ids.flatten())
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, flat), " ")


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` and ``decoded`` of every text."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in pieces(batches, text, 2 << 20):
            ids = vocab.encode([x or "" for x in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(key), ids, vocab.decode(ids)], names=[key, "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")
