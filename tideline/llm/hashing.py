"""Hashes of words and of runs of words, computed for many texts at once."""

from __future__ import annotations

import numpy as np

#: Odd multipliers, derived from one seed.
_RANDOM = np.random.Generator(np.random.PCG64(20240917))
STEP, RUN = (int(x) | 1 for x in _RANDOM.integers(1 << 62, 1 << 63, 2, dtype=np.uint64))
#: Bytes that are hashed at once, about.
PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; different numbers stay different."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Of all words of all texts in turn: hash, start and end in the joined bytes; words per text; the joined bytes."""
    data = b"\n".join([*texts, b""])
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(texts), np.int64), data
    sizes = ends - starts
    power, hashes = powers(STEP, int(sizes.max())), np.empty(len(starts), np.uint64)
    # some words at a time: their bytes take many times their room
    cuts = np.unique(np.r_[np.searchsorted(starts, np.arange(0, len(raw), PIECE)), len(starts)])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        lo, hi, n = starts[a], ends[b - 1], sizes[a:b]
        begin = np.cumsum(n) - n
        inside = raw[lo:hi][~space[lo:hi]]
        place = np.arange(len(inside)) - np.repeat(begin, n)
        hashes[a:b] = np.add.reduceat((inside + np.uint64(1)) * power[place], begin)
    hashes = mixed(hashes)
    limits = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, limits), prepend=0)
    return hashes, starts, ends, counts, data


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` neighbouring words, at the place where it starts."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(length):
        out *= np.uint64(RUN)
        out += hashes[i : i + n]
    return mixed(out)


def shingles(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``length`` words per text, sorted within each text, and how many each text has.

    A text with fewer words has one shingle of all of them; one without words has none.
    """
    words, _, _, counts, _ = word_hashes(texts)
    ends = np.cumsum(counts)
    full = run_hashes(words, length)
    sizes = np.maximum(counts - length + 1, 0)
    starts = ends - counts
    owner = np.repeat(np.arange(len(texts)), sizes)
    flat = full[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner]]
    short = np.flatnonzero((counts > 0) & (counts < length))
    if len(short):
        extra = np.array([run_hashes(words[starts[i] : ends[i]], int(counts[i]))[0] for i in short], np.uint64)
        flat, owner = np.concatenate([flat, extra]), np.concatenate([owner, short])
    order = np.lexsort((flat, owner))
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    return flat[new], np.bincount(owner[new], minlength=len(texts))
