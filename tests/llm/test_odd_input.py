"""Keys and column names that broke earlier versions."""

from collections import Counter

import pytest

import corpus_pipeline
from tideline.llm import lines, neardup, quality, sharding, warc
from tideline.llm.common import store


def test_shards_of_text_keys(spark):
    rows = [("de", "a"), ("fr", "b"), (None, "c"), ("de", "a"), ("7", "d")] * 40
    got = sharding.shard(spark.createDataFrame(rows, "doc_id string, text string"), 4).collect()
    at = {}
    for r in got:
        assert at.setdefault(r.key, (r["shard"], r.grown)) == (r["shard"], r.grown) and r.grown in (r["shard"], 4)
    assert len(got) == 200 and at[None] == (0, 0)
    for s in range(4):
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_archives_keep_keys_with_line_ends(spark, tmp_path):
    keys = ["a\r\nX-Evil: 1", "b\n", "50%", "%0D", "%250A", None, ""]
    pages = spark.createDataFrame([(k, f"http://x/\r\n{i}", f"page {i % 4}", "r") for i, k in enumerate(keys)], "page_id string, url string, html string, row string")
    warc.write_archives(pages, str(tmp_path / "out"), "page_id", "url", "html")
    got = warc.read_archives(spark, str(tmp_path / "out")).collect()
    assert Counter(r.source for r in got) == Counter(keys) and all("\n" not in r.url for r in got)


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"line of words number {i} alone\nthis very line is in every text\nlast words here {i * 7}", "x", 5, 6, 0.5, i) for i in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string, doc string, n_lines long, n_dropped long, score double, row long")


def test_lines_of_tables_with_the_same_names(spark, clashing):
    with pytest.raises(ValueError, match="n_lines"):
        lines.drop_recurring_lines(clashing)
    got = lines.drop_recurring_lines(clashing, counts=False)
    assert got.columns == clashing.columns and all((r.n_lines, r.n_dropped) == (5, 6) for r in got.collect())
    staged = corpus_pipeline.drop_lines(spark, clashing, "")
    assert staged.columns == clashing.columns
    assert sum("this very line" in r.text for r in staged.collect()) == 1


def test_stages_of_tables_with_clashing_names(spark, clashing):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(30)], "doc_id long, quality int, toxic int")
    scored = quality.classify_rows(clashing, labels)
    assert scored.columns == ["doc", "score"] and scored.count() == 30
    by_id = {r.doc_id: r.score for r in quality.classify(store(clashing, "t"), labels).collect()}
    assert all(r.score == pytest.approx(by_id[r.doc.doc_id], abs=1e-5) for r in scored.collect())
    assert neardup.near_duplicates(clashing).select("doc.*").columns == clashing.columns


def test_scores_of_odd_rows(spark, odd, odd_rows, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (11, 0, 1)], "doc_id long, quality int, toxic int")
    scored = quality.classify_rows(odd, labels).collect()
    assert Counter(r.doc.text for r in scored) == Counter(t for _, t, *_ in odd_rows) and all(0 <= r.score <= 1 for r in scored)
    assert quality.classify_rows(nothing, labels).collect() == []
