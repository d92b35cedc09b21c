"""The operators against brute force on rows with every odd case, and on the smallest given tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideline.llm import bpe, decontaminate, exactdup, lines, lm, neardup, quality, recurrent, sharding, substrings, warc
from tideline.llm.common import join_matching

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def jump(key, shards):
    at, to, key = -1, 0, key % 2**64
    while to < shards:
        at, key = to, (key * 2862933555777941757 + 1) % 2**64
        to = int((at + 1) * (2**31 / ((key >> 33) + 1)))
    return at


def test_shards(odd, odd_rows, nothing):
    got = sharding.shard(odd, 8).collect()
    assert Counter(r.key for r in got) == Counter(r[0] for r in odd_rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r["shard"] == jump(r.key or 0, 8) and r.grown == jump(r.key or 0, 9)
        assert r.crc == zlib.crc32((r.doc.text or "").encode()) and r["size"] == len((r.doc.text or "").encode()) + 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard(nothing, 8).count() == 0


def test_many_shards(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 987654321]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump(F.col("k"), 1, 3, 5000).alias("at")).collect()
    assert all(list(r.at) == [jump(r.k, n) for n in (1, 3, 5000)] for r in rows)


def test_near_duplicates(odd, odd_rows, nothing):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    sets = []
    for i, t, *_ in odd_rows:
        w = words(t)
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])))
    links = Counter()
    for a, (i, s) in enumerate(sets):
        n = sum(b != a and (s == q or bool(s and q and len(s & q) >= 0.8 * len(s | q))) for b, (_, q) in enumerate(sets))
        links[i, n] += 1
    assert Counter((r.doc.doc_id, r.n_links) for r in got) == links
    by = {r.doc.doc_id: r for r in got if r.doc.doc_id is not None}
    assert by[1].class_id == by[2].class_id == by[3].class_id == 1 and by[4].class_id == 4
    assert by[5].class_id == by[6].class_id == by[8].class_id == 5
    assert sum(r.kept for r in got) == 11 and by[1].kept and not by[3].kept
    assert neardup.near_duplicates(nothing).count() == 0


def test_large_nodes(spark, monkeypatch):
    """Groups that are cut into cells keep all their links."""
    monkeypatch.setattr(neardup, "CELL", 8)
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(base[: 3 * k + 5] + [f"x{k}"] + base[3 * k + 6 :])) for k in range(40)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.class_size, r.n_links) for r in got} == {(0, 40, 39)}


def test_lone_rows_come_out_of_no_join(spark, monkeypatch):
    plans, store = [], neardup.store

    def kept(df, tag):
        if tag == "tries":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return store(df, tag)

    monkeypatch.setattr(neardup, "store", kept)
    word = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, word(i)) for i in range(60)] + [(100 + i, f"{word(0)} more{i}") for i in range(8)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.class_size for r in got) == [1] * 59 + [9] * 9
    assert len(plans) == 1 and "Join Inner" in plans[0] and "LeftOuter" not in plans[0]


@pytest.mark.parametrize("often", [0, 5, 40])
def test_matching_with_hot_keys(spark, often):
    rows = [(k, i) for i, k in enumerate([7] * often + list(range(3000)))]
    few = [(7, often + 1, "hot"), (8, 1, "cold"), (-1, 0, "none")]
    left, right = spark.createDataFrame(rows, "k long, i long"), spark.createDataFrame(few, "k long, n long, what string")
    got = sorted(map(tuple, join_matching(left, right, "k", "n", len(rows)).select("k", "i", "n", "what").collect()))
    assert got == sorted((k, i, n, w) for k, i in rows for j, n, w in few if j == k)


def test_recall_decides_the_depth():
    assert neardup.depth_for(0.8, 16, 6, 0.9999) == 3 and neardup.depth_for(0.99, 16, 6, 0.9999) == 6


@pytest.mark.parametrize("changed", [range(1, 3), range(1, 9), ()])
def test_prefixes_are_shortened_by_the_data(spark, monkeypatch, changed):
    """Only unlike pairs, or none at all, ask for shorter prefixes; no link is lost either way."""
    looked, verify = [], neardup._verify
    monkeypatch.setattr(neardup, "_verify", lambda *a: looked.append(a[-1]) or verify(*a))
    rows = []
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(200)]
        rows.append((len(rows), base))
        for k in changed:  # so many words apart from one another are another
            rows.append((len(rows), [f"{w}x{k}" if i % 23 == 4 and i < 23 * k else w for i, w in enumerate(base)]))
    # without changes some pairs share enough to meet, but are unlike
    if not changed:
        rows += [(len(rows) + g, [*[f"g{g}w{i}" for i in range(150)], *[f"h{g}w{i}" for i in range(150)]]) for g in range(60)]
    sets = [(i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))) for i, w in rows]
    got = neardup.near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    links = {i: sum(a != i and len(s & q) >= 0.8 * len(s | q) for a, q in sets) for i, s in sets}
    assert {r.doc.doc_id: r.n_links for r in got} == links
    alike = [len(s & q) / len(s | q) for k, (_, s) in enumerate(sets) for _, q in sets[k + 1 :]]
    lowest = min((x for x in alike if x >= 0.8), default=0.8)
    last = max(d for d in range(1, 7) if 1 - (1 - lowest**d) ** 16 >= 0.9999)
    assert [depth for _, _, depth in looked] == list(range(6, last - 1, -1))
    assert last == {2: 6, 8: 4, 0: 3}[len(changed)]


def test_quality(spark, nothing):
    good = [(i, " ".join(["The", "of", *[f"w{(i * 7 + k) % 50}abc" for k in range(30)]]) + ".") for i in range(200)]
    bad = [(1000 + i, " ".join(f"W{(i + k) % 50}###" for k in range(30))) for i in range(60)]
    docs = spark.createDataFrame([*good, *bad, (5000, None), (5001, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 200, 2)] + [(1000 + i, 0) for i in range(0, 60, 2)] + [(0, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 263 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].score >= 0.3 for i, _ in good) and all(got[i].score < 0.3 for i, _ in bad)
    assert got[0].held_out == (zlib.crc32(b"0") % 5 == 0)
    rows = quality.classify_rows(docs, labels).select("doc.*", "score").collect()
    assert all(abs(got[r.doc_id].score - r.score) < 1e-9 for r in rows) and len(rows) == len(got)
    assert quality.classify(nothing, labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_tiles_are_found_in_any_order():
    item = [b"t%d" % i for i in range(30)]
    assert sum(n for *_, n in decontaminate.tile([b"x", *item[15:], b"y", *item[:15]], item)) == 30
    assert decontaminate.tile([b"t0", b"t1", b"t2", b"t3", b"z"] * 3, item) == []
    assert sum(n for *_, n in decontaminate.tile([b"a"] * 50, [b"a"] * 12)) == 12


def test_tiles_don_t_list_the_pairs_of_places():
    import tracemalloc

    tracemalloc.start()
    assert decontaminate.tile([b"a"] * 3000, [b"a"] * 60) == [(0, 0, 60)]
    at_most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at_most < 3 << 20  # a list of its 173,521 pairs of places took 12 MB


def test_pairs_of_texts_and_items_go_on_text_by_text(monkeypatch):
    import pyarrow as pa

    shared = " ".join(f"w{i}" for i in range(8))
    items = [(k, f"{shared} own{k}".encode()) for k in range(30)]
    find = decontaminate._finder(items, 5)([shared.encode()] * 20 + [b"none"])
    assert next(iter(find)) == (0, list(range(30)))  # nothing is listed ahead of the first text
    monkeypatch.setattr(decontaminate, "PAIRS", 7)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(21)), "body": [shared] * 20 + ["none"]})
    got = list(decontaminate._tiler(items, 5, pa.int64())(iter([batch])))
    assert max(b.num_rows for b in got) == 7
    rows = sorted((r["doc_id"], r["item_id"], r["matched"], r["tokens"]) for b in got for r in b.to_pylist())
    assert rows == [(i, k, 8, 9) for i in range(20) for k in range(30)]


def test_decontamination(spark, odd, nothing):
    item = [f"t{i}" for i in range(30)]
    rows = [
        (100, " ".join(["pre", *item, "post"])), (101, " ".join([*item[15:], "gap", *item[:15]]).upper()), (102, " ".join(item[:10])),
        (103, "say: t0, t1 t2"), (104, None), (None, " ".join(item)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    items = spark.createDataFrame([(1, " ".join(item)), (2, "t0 T1. t2"), (3, ""), (4, None), (2, "zz yy xx")], "item_id long, text string")
    got = decontaminate.contaminated(docs, items)
    want = {(100, 1), (101, 1), (None, 1), (100, 2), (101, 2), (102, 2), (103, 2), (None, 2)}
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and got.count() == len(want)
    assert decontaminate.contaminated(nothing, items).count() == 0 and decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_groups_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST", 20)
    items = [(k, " ".join(f"i{k}_{j}" for j in range(12))) for k in range(6)]
    docs = spark.createDataFrame([(10 + k, "a b " + t) for k, t in items], "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(10 + k, k) for k in range(6)}


def test_groups_of_items_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST", 30)
    items = [(k, " ".join(f"i{k}_{j}" for j in range(12))) for k in range(6)] + [(9, "again and again the same words")] * 40 + [(10, "x " * 50)]
    named = spark.createDataFrame(items, "item_id long, body string")
    groups = list(decontaminate._item_groups(named, named))
    assert sorted(i for g in groups for i, _ in g) == [0, 1, 2, 3, 4, 5, 9, 10]
    assert all(len(g) == 1 or sum(len(t.split()) for _, t in g) <= 30 for g in groups)


def test_substrings(odd, odd_rows, nothing):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeated(odd.select("doc_id", "text")).collect())
    seen = Counter(tuple(w[i : i + 35]) for _, t, *_ in odd_rows for w in [words(t)] for i in range(len(w) - 34))
    want = Counter()
    for key, t, *_ in odd_rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want[key, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)] += 1
    assert got == want and sum(n for _, _, n, _ in want) > 3000
    assert substrings.remove_repeated(nothing).count() == 0


def test_windows_of_hot_slots_travel_singly():
    texts = [" ".join(f"w{i % 90}" for i in range(400)).encode(), " ".join(f"w{i % 90}" for i in range(20, 100)).encode()]
    for hot in (np.zeros(substrings.SLOTS, bool), np.ones(substrings.SLOTS, bool)):
        s = substrings.cut(texts, 35, hot)
        assert s.size.sum() == 400 - 34 + 80 - 34 and (not hot[0] or (s.size == 1).all())
    flags, sizes = substrings.repeated([b" ".join([b"a%d" % i for i in range(40)])] * 2 + [b"b " * 35], 35)
    assert sizes.tolist() == [6, 6, 1] and flags.tolist() == [True] * 12 + [False]
    data = b"x y x y x"
    assert substrings._by_bytes(data, np.array([0, 2, 4]), np.array([1, 3, 5])).tolist() == [True, False, True]


def test_warc(spark, nothing):
    twice = "a\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"
    rows = [
        (5, "u", None), (4, None, ""), (7, "x\r\ny", twice), (3, "z", twice), (None, "q", "b"), (None, "q", "b"), (9, "r", "ü\r\n"), (9, "r", "ü\r\n"),
        (2, "s", "\r\n\r\n"), (11, "t", "b"), (12, "v", "<p>" * 50_000),
    ]
    shape = "page_id long, url string, html string"
    for pages in (spark.createDataFrame(rows, shape), spark.createDataFrame(rows, shape).repartition(5)):
        got = warc.deduplicated(pages).collect()
        groups = defaultdict(list)
        for i, _, h in rows:
            groups[h or ""].append(i)
        want = Counter()
        for h, ids in groups.items():
            ids.sort(key=lambda i: (i is None, i or 0))
            digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
            for n, i in enumerate(ids):
                want[i, len(h.encode()), digest, "revisit" if n else "response", ids[0] if n else None] += 1
        num = lambda x: None if x is None else int(x)
        assert Counter((num(r.source), r["size"], r.digest, r.type, num(r.origin)) for r in got) == want
    assert warc.deduplicated(spark.createDataFrame([], shape)).count() == 0
    least = warc.deduplicated(spark.createDataFrame(rows, shape), least=5).where("type = 'revisit'").collect()
    assert [int(r.source) for r in least] == [7]


def test_lines(spark, nothing):
    footer = "Posted by user{} on 2024-01-{:02d} at example.org"
    rows = [(i, "\n".join([f"unique line number {'abcdefghij'[i % 10] * (i + 1)} here", footer.format(i, i + 1), "Share this page", ""])) for i in range(12)]
    named = [(100 + i, f"alpha{'x' * i} beta\nOur team wrote this for {n} and friends of the house") for i, n in enumerate(["ann", "bob", "cid", "dan", "eva", "fay", "gus", "hal", "ida", "jon"])]
    copies = [(200 + i, "a text of its own\nwith two lines") for i in range(20)]
    docs = spark.createDataFrame([*rows, *named, *copies, (300, None), (301, ""), (302, "\n\n"), (None, "Share this page"), (None, "Share this page")], "doc_id long, text string")
    got = [(r.doc_id, r.text, r.n_dropped) for r in lines.drop_recurring_lines(docs).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == docs.count()
    assert by[3][1:] == ("unique line number dddd here\n", 2)
    assert by[104][1:] == ("alphaxxxx beta", 1)
    assert by[207][1:] == ("a text of its own\nwith two lines", 0)
    assert by[300][1] is None and by[301][1] == "" and by[302][1] == "\n\n"
    assert sorted(r[1:] for r in got if r[0] is None) == [("", 1)] * 2
    assert lines.drop_recurring_lines(nothing).count() == 0


def test_masking_takes_long_tokens_once(spark):
    import time

    long = "x" * 200_000  # trying each of its characters as a start takes 4e10 steps
    rows = ["a1 b www.c d", f"{long} 7 {long}", "mail a@b http://c x:y  9 www", "www.", " 1", "ab1cd ef"]
    began = time.time()
    made = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i long, line string").select("i", lines.masked(F.col("line")).alias("m"))
    got = [r.m for r in made.orderBy("i").collect()]
    assert time.time() - began < 30
    assert got == ["<*> b <*> d", f"{long} <*> {long}", "mail <*> <*> x:y <*> www", "<*>", "<*>", "<*> ef"]


def test_templates_of_one_leaf(spark):
    """Several templates under the same leading tokens, names that are frequent by themselves, and lines that only start alike."""
    word = lambda i: "abcdefghijklmnop"[i % 16] * (i // 16 + 2)
    first = [f"Read more about our great {word(i)} today and every single day" for i in range(12)]
    second = [f"Read more about our small {word(i)} offers before they all go" for i in range(12)]
    other = [f"Read more about our {' '.join(word(7 * i + k) for k in range(7))}" for i in range(6)]
    names = [f"Dear all of you {n} will {what} see" for n in ("ann", "bob", "cid") for what in ("go and then", "stay if we") for _ in range(6)]
    short = [f"It was one of {word(i)}" for i in range(12)]
    own = "\n".join(f"This text alone has {word(i)} in its many lines here" for i in range(12))
    lost, kept = [*first, *second, *names], [*other, *short, own]
    docs = spark.createDataFrame([(i, f"{word(i)} alone\n{t}") for i, t in enumerate([*lost, *kept])], "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in lines.drop_recurring_lines(docs).collect()}
    # one line of each may stay
    assert sum(got[i] for i in range(len(lost))) >= len(lost) - 8
    assert all(not got[i] for i in range(len(lost), len(lost) + len(kept)))


def test_long_lines_group_like_short_ones(spark, monkeypatch):
    """Two frequent names are left out of lines of any length, and both ways of finding them agree."""
    def rows(tokens):
        made = []
        for i in range(24):
            line = [f"word{k}" for k in range(tokens)]
            line[9], line[tokens - 6] = f"name{'abcde'[i % 5]}", f"city{'abcde'[i // 5]}"
            made.append((i, " ".join(line) + f"\nalone{chr(97 + i)} here"))
        # lines of the same leaf that differ in three places, or stand alone
        made += [(100 + i, " ".join("other" + chr(97 + i) if k in (7, 11, 15 + i) else f"word{k}" for k in range(tokens))) for i in range(12)]
        made += [(200 + i, " ".join(f"word{k}" if k < 4 else f"x{chr(97 + i)}y" + chr(97 + k % 26) for k in range(tokens))) for i in range(8)]
        return made

    def dropped(tokens, pairs, min_docs=4):
        monkeypatch.setattr(lines, "PAIRS", pairs)
        docs = spark.createDataFrame(rows(tokens), "doc_id long, text string")
        return sorted((r.doc_id, r.n_dropped, r.text) for r in lines.drop_recurring_lines(docs, min_docs).collect())

    def counts(result):
        return [(i, n) for i, n, _ in result]

    direct = dropped(81, 1000)
    assert dropped(81, 64) == direct and dropped(81, 4) == direct
    assert sum(n for i, n in counts(direct) if i < 100) == 23
    assert counts(dropped(60, 64)) == counts(direct)


def test_near_copies_leave_one_text(spark):
    """Lines that recur because a document has near copies stay in one of them."""
    base = [[f"{a}{b}{c}" for c in "stuvwxyz"] for a in "abc" for b in "klm"]
    texts = []
    for i in range(14):
        made = [list(t) for t in base]
        made[i % 9][i % 8] = "changed" + "abcdefghijklmn"[i]
        texts.append("\n".join(" ".join(t) for t in made))
    rows = [(None, texts[0] + "\nlast")] + [(20 - i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = lines.drop_recurring_lines(docs)
    got = {r.doc_id: r for r in made.collect()}
    assert got[7].text == texts[13] and got[7].n_dropped == 0
    assert all(r.n_dropped >= 7 for i, r in got.items() if i != 7)
    kept = [r.doc.text for r in neardup.near_duplicates(made.select("doc_id", "text")).where("kept").collect()]
    assert texts[13] in kept


def test_clashing_columns(odd):
    for made in (lines.drop_recurring_lines(odd).drop("n_lines", "n_dropped"), neardup.near_duplicates(odd).select("doc.*"), sharding.shard(odd, 3).select("doc.*")):
        assert made.columns == odd.columns and made.count() == odd.count()
        assert {tuple(r) for r in made.select("lang", "row", "doc", "set", "src").distinct().collect()} == {("en", "r", "d", 1, 3)}


def test_bpe(odd, odd_rows, nothing):
    library = Tokenizer.from_file(VOCABULARY)
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode(odd, VOCABULARY).collect())
    want = Counter()
    for i, t, *_ in odd_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    assert bpe.encode(nothing, VOCABULARY).count() == 0


@pytest.mark.parametrize("together", [True, False])
def test_merge_rounds(together):
    vocab, library = bpe.Vocabulary(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    vocab.together = together
    texts = ["a" * n for n in range(1, 40)] + ["abab" * 9, "'s't're", "ῼ ŉ ǰ Σας ΣΑΣ", "é é", "  <|endoftext|><|startoftext|>x<|end", "x y z\x85", "½ ² ٣"]
    assert vocab.encode(texts).to_pylist() == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_forgetting_words(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    vocab, library = bpe.Vocabulary(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for t in (["one two three four"], ["five six"], [""], ["one six"]):
        assert vocab.encode(t).to_pylist() == [library.encode(x, add_special_tokens=False).ids for x in t]


def test_language_model(odd, odd_rows, nothing):
    got = sorted(tuple(r) for r in lm.scores(odd.select("doc_id", "text").fillna(-1, ["doc_id"])).collect())
    rows = [(-1 if i is None else i, [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)] + [""]) for i, t, *_ in odd_rows]
    counts = Counter(w for i, tokens in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens)
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, tokens in rows:
        base = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        want.append((i, zlib.crc32(str(i).encode()) % 7 == 2, len(tokens), sum(counts[w] > 0 for w in tokens), n, base))
    assert [r[:5] for r in got] == [r[:5] for r in sorted(want)]
    assert np.allclose([r[5] for r in got], [r[5] for r in sorted(want)]) and all(np.isfinite(r[6]) and r[6] < 0 for r in got)
    assert lm.scores(nothing).count() == 0


def test_vocabulary_grows(spark, monkeypatch):
    assert lm.vocabulary(0) >= 1024 and lm.vocabulary(10**8) > lm.vocabulary(10**7) > 1024
    monkeypatch.setattr(lm, "FREQUENT", 40)
    random = np.random.default_rng(5)
    rows = [(i, [f"w{min(int(x), 3000)}" for x in random.zipf(1.3, 200)]) for i in range(150)]
    counts = Counter(w for _, t in rows for w in t)
    blocks = spark.createDataFrame([(i % 4, " ".join(t), False) for i, t in rows], "src long, text string, held_out boolean")
    sums = lm.Sums(lm.count(blocks, 3, 100), len(rows))
    assert sums.tokens == 30_150 and lm.vocabulary(sums.tokens) == 86
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))
    assert top[85][1] == top[86][1]  # a tie at the border
    assert set(sums.symbol) == {b"", *(w.encode() for w, _ in top[:86])}
    assert sums.tokens - len(rows) - sum(sums.other) == sum(n for _, n in top[:86])
    assert 5 <= sums.layout.first <= 10


def test_recurrent_gradient_and_windows():
    counts = np.array([40, 30, 20, 10, 5, 5, 2], np.int64)
    layout = recurrent.Layout(counts, 3, np.array([9, 4]))
    m = layout.start()
    random = np.random.default_rng(3)
    m = {k: (v + random.standard_normal(v.shape) * 0.2).astype(np.float32) for k, v in m.items()}
    sizes = np.array([5, 60, 1, 33])
    symbols = random.integers(0, 9, sizes.sum())
    # one lane or many, the state is carried through each text alone
    one = recurrent.score(m, layout, symbols, sizes, 1)
    assert np.allclose(one, recurrent.score(m, layout, symbols, sizes, 4), atol=1e-5)
    assert np.allclose(one[5:65], recurrent.score(m, layout, symbols[5:65], sizes[1:2], 1), atol=1e-5)
    # probabilities of all symbols after a text's start add up to one
    first = [recurrent.score(m, layout, np.array([s]), np.array([1]))[0] for s in range(9)]
    assert abs(np.exp(first).sum() - 1) < 1e-5
    # the gradient of one window agrees with differences
    trainer = recurrent.Trainer({k: v.astype(np.float64) for k, v in m.items()}, layout)
    kept = {}
    trainer._move = lambda grads, n: kept.update(grads)
    text = symbols[5:17]
    trainer.learn(text, np.array([7, 5]), 1)
    for name in m:
        for at in ([0] * m[name].ndim, [-1] * m[name].ndim, [m[name].shape[0] // 2] + [0] * (m[name].ndim - 1)):
            at, loss = tuple(at), []
            for eps in (1e-3, -1e-3):
                changed = {k: v.astype(np.float64) for k, v in m.items()}
                changed[name][at] += eps
                loss.append(-recurrent.score(changed, layout, text, np.array([7, 5]), 1).sum())
            assert abs((loss[0] - loss[1]) / 2e-3 - kept[name][at]) < 2e-3, (name, at)


def test_texts_are_numbered_once(spark, odd, odd_rows):
    docs = odd.select("doc_id", "text").withColumn("held_out", F.lit(False)).coalesce(1)
    blocks = lm.numbered(docs, 1, 2000)
    assert "text" not in blocks.columns
    got, learned = [], Counter()
    for src in {r.src for r in blocks.select("src").collect()}:
        rows = blocks.where(F.col("src") == src).toArrow()
        kept, flat, sizes, words = lm._read(rows)
        ids, said = kept["doc_id"].to_pylist(), [words[n] for n in flat]
        assert len(kept) == len(rows) - 1 and len(set(words)) == len(words) and words[0] == b""
        cuts = np.cumsum([0, *sizes])
        got += [(i, said[a:b]) for i, a, b in zip(ids, cuts[:-1], cuts[1:], strict=True)]
        learned.update(w for w in said if w)
    want = [(i, [*(t or "").encode().lower().split(), b""]) for i, t, *_ in odd_rows]
    assert sorted(got, key=str) == sorted(want, key=str) and blocks.select("src").distinct().count() > 5
    # the counts of numbered blocks and of blocks with their text
    sums = lm.Sums(lm.count(blocks, 3, 5000), len(got))
    plain = docs.withColumn("src", F.lit(7).cast("long"))
    other = lm.Sums(lm.count(plain, 3, 5000), len(got))
    assert sums.tokens == other.tokens == sum(learned.values()) + len(got)
    assert sums.symbol == other.symbol and (sums.other == other.other).all()


@pytest.mark.parametrize("size", [0.3, 12.0])
def test_scores_are_those_of_one_token_after_the_other(monkeypatch, size):
    counts = np.array([40, 30, 20, 10, 5, 5, 2], np.int64)
    layout = recurrent.Layout(counts, 3, np.array([9, 4]))
    random = np.random.default_rng(11)
    m = {k: (v + random.standard_normal(v.shape) * size).astype(np.float32) for k, v in layout.start().items()}
    sizes = np.array([1, 130, 7, 90, 300])
    symbols = random.integers(0, 9, sizes.sum())
    monkeypatch.setattr(recurrent, "TILE", 50)
    calls, output = [], recurrent.output
    monkeypatch.setattr(recurrent, "output", lambda *a, **k: calls.append(len(a[3])) or output(*a, **k))
    got, k = recurrent.score(m, layout, symbols, sizes, 2), recurrent.HIDDEN
    assert len(calls) <= 6 and sum(calls) == len(symbols)  # longest lane: 300 steps, 64 at a time
    w = {n: v.astype(np.float64) for n, v in m.items()}
    with np.errstate(over="ignore"):
        sigmoid = lambda x: 1 / (1 + np.exp(-np.maximum(x, -recurrent.LARGE)))
        at = 0
        for n in sizes:
            h, x = np.zeros(k), 9
            for s in symbols[at : at + n]:
                e, u = w["E"][x], h @ w["U"]
                z, r = sigmoid(e[:k] + u[:k]), sigmoid(e[k : 2 * k] + u[k : 2 * k])
                h = (1 - z) * np.tanh(e[2 * k :] + r * (u[2 * k :] + w["b"])) + z * h
                a, c = np.minimum(h @ w["C"] + w["c"], recurrent.LARGE), layout.of[s]
                want = a[c] - np.log(np.exp(a).sum())
                if c < layout.first:
                    lo, hi = layout.bounds[c], layout.bounds[c + 1]
                    a = np.minimum(w["W"][lo:hi] @ h + w["w"][lo:hi], recurrent.LARGE)
                    want += a[s - lo] - np.log(np.exp(a).sum())
                assert size > 1 or abs(got[at] - want) < 1e-4
                at, x = at + 1, s
    assert np.isfinite(got).all()


def test_learning_lowers_the_loss():
    layout = recurrent.Layout(np.array([100, 100, 100, 100], np.int64), 4, np.array([0]))
    symbols = np.tile([0, 1, 2, 3], 2000)
    m = layout.start()
    trainer = recurrent.Trainer(m, layout)
    trainer.learn(symbols, np.array([len(symbols)]), 8)
    before, after = (recurrent.score(x, layout, symbols[:400], np.array([400]), 1).mean() for x in (m, trainer.m))
    assert after > before + 0.7


def test_exact_duplicates(odd, odd_rows, nothing):
    groups = defaultdict(list)
    for i, t, *_ in odd_rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    got = exactdup.exact_duplicates(odd).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exactdup.exact_duplicates(nothing).count() == 0


@pytest.mark.parametrize("values", [[0], [7], [0, 1, 2, 3], [5, 1000, 2**40]])
def test_golomb_codes(values):
    v = np.array(values, np.int64) + 50
    assert exactdup.golomb_decode(exactdup.golomb_encode(v, 50, 2**41), 50).tolist() == v.tolist()
