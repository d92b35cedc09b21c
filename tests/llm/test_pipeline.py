"""The pipeline on the smallest given tables: each stage against its own input."""

import re
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tideline.llm import decontaminate
from tideline.llm.common import store, table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    if not Path(SMALL).is_dir():
        pytest.skip("the given tables are not here")
    docs = [table(spark, SMALL, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(store(stage(spark, docs[-1], SMALL), name.replace(" ", "-")))
    return docs


def test_documents_keep_their_columns(steps):
    assert all(d.columns == steps[0].columns for d in steps[:-1])
    sizes = [d.count() for d in steps]
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > sizes[4] == sizes[5] > 0


def test_junk_goes_and_good_texts_stay(spark, steps):
    kept = {r.doc_id for r in steps[1].collect()}
    labels = table(spark, SMALL, "labels").collect()
    good = [r.doc_id in kept for r in labels if r.quality == 1]
    bad = [r.doc_id in kept for r in labels if r.quality == 0]
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_one_of_each_group_stays(steps):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)])

    rows = {r.doc_id: shingles(r.text) for r in steps[2].collect()}
    parent = {i: i for i in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(rows[a] & rows[b]) >= 0.8 * len(rows[a] | rows[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    assert {r.doc_id for r in steps[3].collect()} == {top(i) for i in ids}


def test_benchmark_texts_are_gone(spark, steps):
    items = [re.sub(r"\W+", " ", r.text.lower()).strip() for r in table(spark, SMALL, "benchmark").collect()]
    held = {r.doc_id for r in steps[3].collect() if any(i in re.sub(r"\W+", " ", r.text.lower()) for i in items)}
    assert {r.doc_id for r in steps[3].collect()} - {r.doc_id for r in steps[4].collect()} == held


def test_rows_are_decontaminated_not_ids(spark, tmp_path, monkeypatch):
    items = [(k, " ".join(f"i{k}_{j}" for j in range(12))) for k in range(4)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, "a " + items[0][1]), (None, "clean one"), (None, None), (7, items[3][1] + " b"), (7, "clean two"), (7, "clean two"), (8, "")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    for most in (decontaminate.BROADCAST, 20):  # one group of items, several
        monkeypatch.setattr(decontaminate, "BROADCAST", most)
        made = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
        assert made.columns == docs.columns
        assert Counter(tuple(r) for r in made.collect()) == Counter((i, t, "en") for i, t in rows if "i0" not in (t or "") and "i3" not in (t or ""))


def test_tokens(steps):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    for r in steps[5].collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == library.decode(ids, skip_special_tokens=False) and r.n_tokens == len(ids)


def test_registered(spark):
    import __spark_entry__ as e

    names = [q for q in e.queries() if re.match(r"op\d+_|pipeline", q)]
    assert len(names) == 14  # the thirteen operators and the pipeline
    for name in names:
        if name.startswith(("op6", "op8", "op10", "op1_")):
            made = e.queries()[name](spark, SMALL)
            want = table(spark, SMALL, "pages" if "op6" in name else "documents").count()
            assert made.count() == want and made.select(F.countDistinct(made.columns[0])).first()[0] == want
