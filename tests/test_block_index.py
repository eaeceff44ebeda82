"""Search by posting blocks against the plain search: appends, deletes, skipped blocks, odd pages."""

import random

import pytest
from pyspark.sql import functions as F

from tabguard.operators import corpus
from tabguard.operators.block_index import BlockIndex

SCHEMA = "filename string, page_number int, text string"


def some_pages(spark, n, seed, rare=()):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.choices(["alpha", "beta", "gamma", "delta", "the", "of"], weights=[1, 2, 4, 8, 30, 30], k=rng.randint(3, 60))
        rows.append((f"f{seed}-{i // 5}", i % 5 + 1, " ".join(words + (["needle"] * 5 if i in rare else []))))
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return [(r.rank, r.filename, r.page_number, round(r.score, 6), r.text) for r in sorted(df.collect(), key=lambda r: r.rank)]


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    index = BlockIndex(spark, str(tmp_path_factory.mktemp("blocks") / "index"), block_bits=3)
    index.create()
    first, second = some_pages(spark, 400, 1, rare=(7, 250)), some_pages(spark, 300, 2)
    index.append(first)
    index.append(second)
    gone = first.filter("filename like 'f1-1%'")
    index.delete(gone)
    back = gone.filter("page_number = 2")
    index.append(back)
    return index, first.unionByName(second).exceptAll(gone).unionByName(back)


@pytest.mark.parametrize("question, top_k", [("needle of alpha", 5), ("the alpha beta", 7), ("gamma", 3), ("nothing here", 5), ("", 5), ("alpha", 2000)])
def test_equals_the_plain_search(filled, question, top_k):
    index, live = filled
    assert found(index.search(live, question, top_k)) == found(corpus.search_pages(live, question, top_k))


def test_blocks_below_the_last_score_are_not_read(filled):
    index, live = filled
    best, read = index.ranked("needle alpha", 1, probed=2)
    assert best.count() == 1 and 0 < read.count() < 20 < index.ranked("needle alpha", 2000)[1].count()


def test_a_second_delete_changes_nothing_and_all_may_go(spark, tmp_path):
    index = BlockIndex(spark, str(tmp_path / "index"))
    index.create()
    odd = spark.createDataFrame([("a", 1, "alpha beta"), ("a", 1, "alpha beta"), ("b", 1, None), ("c", 1, ""), (None, 1, "alpha")], SCHEMA)
    assert index.search(odd, "alpha").count() == 0
    index.append(odd.filter("false"))
    index.append(odd)
    before = [tuple(r) for r in index.ranked("alpha")[0].collect()]
    assert len(before) == 3
    for _ in range(2):
        index.delete(odd.filter("filename = 'a'"))
    assert [r.filename for r in index.ranked("alpha")[0].collect()] == [None]
    index.delete(odd.filter("filename is not null"))
    assert index._manifest()["pages"] == 1


def test_terms_are_counted_in_their_row(spark):
    rows = [(1, ["b", "a", "b", "c", "a", "b"]), (2, []), (3, ["x"]), (4, None)]
    found = spark.createDataFrame(rows, "i int, w array<string>").select("i", F.inline(corpus.term_counts(F.col("w"))))
    assert {tuple(r) for r in found.collect()} == {(1, "a", 2), (1, "b", 3), (1, "c", 1), (3, "x", 1)}


@pytest.mark.parametrize("kind", ["postings", "blocks"])
def test_postings_are_shuffled_once(spark, tmp_path, monkeypatch, kind):
    """Two shuffles for the plain index and three for the blocks before."""
    pages = spark.createDataFrame([(f"f{i}", 1, f"some words {i % 7} of page {i}") for i in range(50)], "filename string, page_number int, text string")
    seen, ordered = [], type(pages).sortWithinPartitions
    monkeypatch.setattr(type(pages), "sortWithinPartitions", lambda df, *by: seen.append(df) or ordered(df, *by))
    if kind == "postings":
        corpus.build_index(pages, str(tmp_path / "index"))
    else:
        index = BlockIndex(spark, str(tmp_path / "blocks"))
        index.create()
        index.append(pages)
    assert len(seen) == 1
    plan = seen[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1
