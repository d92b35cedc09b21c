"""Spelling variants, document fingerprints and ranked search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import prose

from tideline.llm import search, spelling, versions

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    """Whether the words differ by exactly one inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def spellings(rows, letters=6, occurrences=5, ratio=5, noise=199):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= letters:
                total[run] += 1
    total = {w: n for w, n in total.items() if n >= occurrences}
    out = {}
    for w, n in total.items():
        near = [v for v in total if one_edit(v, w)]
        top = min(near, key=lambda v: (-total[v], v), default=None)
        form = top if top and total[top] >= ratio * n else None
        out[w] = (n, len(near), form, total.get(form))

    def root(w):
        return root(out[w][2]) if out[w][2] else w

    return {w: (*v, root(w)) for w, v in out.items()}


def spelled(frame, **options):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(frame, **options).collect()}


def test_spelling_variants(spark):
    r = random.Random(7)
    base = ["".join(r.choices("abcdeéÿ", k=r.randint(6, 9))) for _ in range(60)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(40):
            w = base[int(len(base) * r.random() ** 3)]
            if r.random() < 0.3:
                at, c = r.randrange(len(w)), r.choice("abcdeéÿ")
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :], w[:at] + c + w[at:]])
            words.append(w.title() if r.random() < 0.1 else w)
        rows.append((None if i % 50 == 0 else i // 2, ", ".join(words) + " × 7"))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = spellings(rows, noise=19)
    assert spelled(frame, noise=19) == want
    assert any(v[2] and v[4] != v[2] for v in want.values()) and max(v[1] for v in want.values()) > 3


def test_spelling_odd_rows(odd, odd_rows, nothing):
    rows = [(i, t) for i, t, *_ in odd_rows]
    assert spelled(odd, letters=2, occurrences=1) == spellings(rows, 2, 1)
    assert spelled(odd) == spellings(rows)
    assert spelling.variants(nothing).collect() == []


def test_chains_of_forms(spark):
    texts = [("abcdef " * 500), ("abcdeg " * 100), ("abcdhg " * 20), ("abckhg " * 4)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = spelled(spark.createDataFrame(rows, "doc_id long, text string"), occurrences=4, noise=10**9)
    assert [got[w][4] for w in ("abcdeg", "abcdhg", "abckhg")] == ["abcdef"] * 3
    assert got["abckhg"][2] == "abcdhg" and got["abcdef"] == (500, 1, None, None, "abcdef")


@pytest.mark.parametrize("symbols", [4, 16, 128])
def test_neighbours_are_complete_and_single(symbols):
    word = "aabcéa"
    letters = [*"abcdefghijklmnopqrstuvwxyz", *map(chr, range(0xC0, 0x100))]
    around = {word[:i] + word[i + 1 :] for i in range(6)}
    around |= {word[:i] + c + word[i + d :] for i in range(7) for c in letters for d in (0, 1) if i + d <= 6}
    want = set(spelling.reduced_hashes(pa.array(sorted(around)), symbols).tolist())
    parts = [k for k, _ in spelling.neighbour_hashes(pa.array(["other", word]), symbols)]
    owners = [o for _, o in spelling.neighbour_hashes(pa.array(["other", word]), symbols)]
    mine = np.concatenate(parts)[np.concatenate(owners) == 1]
    assert len(mine) == len(set(mine.tolist())) and set(mine.tolist()) == want


def test_long_runs_are_whole():
    text = "ab " * 500_000 + "x" * 1_500_000 + " abcdefg"
    assert [len(w) for part in spelling.runs(text, 6) for w in part] == [1_500_000, 7]


def digests(text):
    return set(versions.passages([(text or "").encode()])[0].tolist())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_passages():
    text = " ".join(prose(5, 400))
    lines = text.replace(" ", "\n")
    assert len(digests(lines)) == 400 and len(digests("same\nsame\nsame")) == 3
    assert digests(text + " ") == digests(text) and len(digests(text)) < 200
    many = [b"", text.encode(), b"  ", lines.encode(), b"one"]
    flat, counts = versions.passages(many)
    assert counts.tolist() == [len(digests(t.decode())) for t in many]
    assert set(flat[: counts[1]].tolist()) == digests(text)


@pytest.mark.parametrize("changed", [0, 1, 10, 100, 2000])
def test_peeling_recovers_the_differences(changed):
    a = np.arange(1, 3001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b = np.concatenate([a[changed:], a[:changed] ^ np.uint64(1)])
    both, counts = np.concatenate([a, b]), np.array([3000, 3000])
    owner, digest, sign, cells = versions.differences(both, counts, np.array([1, 0]), np.array([0, 1]))
    for pair, new, old in ((0, b, a), (1, a, b)):
        mine = owner == pair
        assert set(digest[mine & (sign == 1)].tolist()) == set(new.tolist()) - set(old.tolist())
        assert set(digest[mine & (sign == -1)].tolist()) == set(old.tolist()) - set(new.tolist())
    assert (cells > versions.CELLS).all() == (changed >= 100)


def test_fingerprints_are_sketches(odd, odd_rows):
    made = {}
    for r, (_, t, *_) in zip(sorted(versions.fingerprints(odd).collect(), key=str), sorted(odd_rows, key=str), strict=True):
        made.setdefault(r.fingerprint, r)
    for r in made.values():
        sketch = versions.sketch_of(r.fingerprint)
        assert versions.fingerprint(sketch) == r.fingerprint and sketch["count"].sum() == 3 * r.n_passages
    texts = [" ".join(prose(1, 100)), " ".join(prose(1, 100)[:90] + prose(2, 5))]
    flat, counts = versions.passages([t.encode() for t in texts])
    a, b = (versions.sketch_of(versions.fingerprint(s)) for s in versions.sketches(flat, counts))
    empty, _, digest, _ = versions.peel(versions.subtract(a[None], b[None]))
    assert empty.all() and set(digest.tolist()) == digests(texts[0]) ^ digests(texts[1])


def test_compare_versions(spark, odd_rows):
    texts = [t for _, t, *_ in odd_rows]
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(texts, texts[1:] + texts[:1], strict=True))]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, old string, new string, key string, cells long").repartition(2)
    got = {r.doc_id: r for r in versions.compare(frame).collect()}
    for i, a, b in rows:
        a, b = ({x - 2**64 if x >= 2**63 else x for x in digests(t)} for t in (a, b))
        assert set(got[i].added) == b - a and set(got[i].removed) == a - b and got[i].likeness == pytest.approx(jaccard(a, b))
    assert versions.compare(frame.limit(0)).collect() == []


def test_edited_versions(spark, odd, odd_rows, nothing, monkeypatch):
    monkeypatch.setattr(versions, "RANGE_BYTES", 20_000)
    got = versions.edited_versions(odd).collect()
    assert len(got) == len(odd_rows) and versions.edited_versions(nothing).collect() == []
    # rows with equal ids follow in an order of their own, so only those with an id of their own have one right answer
    ids = Counter(i for i, *_ in odd_rows)
    order = sorted(((i, t or "") for i, t, *_ in odd_rows if i is not None))
    by_id = {r.doc_id: r for r in got}
    for (i, text), (j, following) in zip(order, order[1:], strict=False):
        r = by_id[i]
        assert r.n_chars == len(text)
        if ids[i] == ids[j] == 1:
            made = versions.edited(text, following)
            assert r.edited_sha256 == hashlib.sha256(made.encode()).hexdigest()
            assert r.near_edited == pytest.approx(jaccard(digests(text), digests(made)))
            assert r.near_next == pytest.approx(jaccard(digests(text), digests(following)))
    assert Counter(r.n_chars for r in got if r.doc_id is None) == Counter(len(t or "") for i, t, *_ in odd_rows if i is None)
    by_text = {}
    for i, t, *_ in odd_rows:
        if ids[i] == 1:
            assert by_text.setdefault(t or "", by_id[i].fingerprint) == by_id[i].fingerprint


def test_next_documents_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(versions, "RANGE_BYTES", 2_000)
    rows = [(i * 3 % 1009, " ".join(prose(i, 5 + i % 30))) for i in range(400)] + [(5000, "same text here")] * 200
    got = versions.edited_versions(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    order = sorted(rows)
    want = Counter((i, hashlib.sha256(versions.edited(t, n).encode()).hexdigest()) for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True))
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want


TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranking(docs, queries, k):
    terms = [(i, TERMS.findall((t or "").translate(LOWER))) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    n_docs, length = len(terms), sum(len(t) for _, t in terms)
    having = Counter(w for _, t in terms for w in set(t))
    out = {}
    for item, text in set(queries):
        scores = []
        for i, t in terms:
            tf, m = Counter(t), 75 + 25 * len(t) * n_docs // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * having[w] + 1))) * (1000000000 * tf[w] // (1000 * tf[w] + 12 * m))
                for w in TERMS.findall((text or "").translate(LOWER)) if w in tf
            )
            if score > 0:
                scores.append((-score, i is None, i))
        out[item, text] = [(i, -s) for s, _, i in sorted(scores)[:k]]
    return out


def test_ranked_search(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]

    def draw(n):
        return " ".join(vocabulary[int(300 * r.random() ** 2)] for _ in range(n))

    docs = [(i, draw(r.randint(1, 80))) for i in range(600)]
    docs += [(1000 + i, docs[7][1].upper()) for i in range(40)] + [(2000, "Ünï w1　w2, w3;W4"), (None, docs[7][1])]
    queries = [(i, draw(r.randint(1, 30)) + " w1 ünï w1") for i in range(12)] + [(50, docs[7][1]), (51, "nowhere"), (None, "w250 w251")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {}
    for row in search.search(frame, spark.createDataFrame(queries, "item_id long, text string"), 20).collect():
        got.setdefault(row.item_id, []).append((row["rank"], row.doc_id, row.score))
    for (item, _), want in ranking(docs, queries, 20).items():
        assert sorted(got.get(item, [])) == [(n + 1, *w) for n, w in enumerate(want)]


def test_ranked_search_in_small_blocks_and_groups(spark, monkeypatch):
    # the workers read the constant from the shipped module, so the groups are cut by the argument
    r = random.Random(4)
    docs = [(i, " ".join(f"t{r.randrange(60)}" for _ in range(r.randint(1, 25)))) for i in range(300)]
    queries = [(i, " ".join(f"t{r.randrange(60)}" for _ in range(8))) for i in range(9)]
    got = search.search(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string"), 5, group_bytes=60
    ).collect()
    want = {(item, n + 1, *w) for (item, _), ws in ranking(docs, queries, 5).items() for n, w in enumerate(ws)}
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_ranked_search_odd_rows(spark, odd, odd_rows, nothing):
    docs = [(i, t) for i, t, *_ in odd_rows]
    queries = [(1, "one two"), (2, None), (3, ""), (4, docs[0][1]), (5, "lost"), (5, "lost"), (6, "it's 12³ 漢字")]
    asked = spark.createDataFrame([(*q, 1, 2) for q in queries], "item_id long, text string, rank long, key long")
    got = Counter((x.item_id, x["rank"], x.doc_id, x.score) for x in search.search(odd, asked, 20).collect())
    want = Counter((item, n + 1, *w) for (item, _), ws in ranking(docs, queries, 20).items() for n, w in enumerate(ws))
    assert got == want
    assert search.search(nothing, asked).collect() == [] and search.search(odd, asked.limit(0)).collect() == []
    assert search.search(odd, asked).columns == ["item_id", "rank", "doc_id", "score"]


def test_best_first_equals_all_scores():
    r = np.random.default_rng(5)
    n, terms = 200, 30
    keys = np.unique(r.integers(0, n * terms, 1500))
    names, sizes = np.unique(keys // n, return_counts=True)
    counts, lens = r.integers(1, 4, len(keys)), r.integers(5, 60, n)
    weights = r.integers(0, 5000, terms)
    block = search.Block(names, sizes, (keys % n).astype(np.int32), counts, lens, weights, n, int(lens.sum()))
    order = [(False, i, 0, i) for i in range(n)]
    for _ in range(50):
        query = {int(t): int(r.integers(1, 3)) for t in r.integers(0, terms, 6)}
        scores = np.zeros(n, np.int64)
        for t, times in query.items():
            mine = keys // n == t
            np.add.at(scores, keys[mine] % n, times * block.impacts[mine])
        best = search.Best(10)
        block.search(query, order, best)
        want = sorted((-int(s), order[i]) for i, s in enumerate(scores) if s > 0)[:10]
        assert best.rows == want


