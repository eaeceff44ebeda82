"""Ranked search against a score of every document, the Best Position Algorithm against exhaustive sums."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tabguard.llm.ranked import Shard, length_norms, rank_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    df = Counter(t for _, c in counted for t in c)
    big_n, big_l = len(counted), sum(sum(c.values()) for _, c in counted)
    queries = {}
    for item, text in items:
        queries.setdefault(item, set()).update(terms_of(text))
    rows = []
    for item, terms in queries.items():
        scores = []
        for i, c in counted:
            m = 10 + (90 * sum(c.values()) * big_n) // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0 and i is not None:
                scores.append((-score, i))
        rows += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(rows, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


ITEMS = [(1, "Plain short WORD1 word2"), (2, None), (3, "..."), (4, "nothing-like-this"), (5, "x"), (5, "tail日本語 the 日本語"), (None, "text end"), (6, "word1 " * 500)]


def test_odd_texts(spark, odd_docs, odd_texts):
    items = spark.createDataFrame([(i, t, "clash", 3) for i, t in ITEMS], "item_id long, text string, doc_id string, rank int")
    assert got(rank_documents(odd_docs, items)) == plain(odd_texts, ITEMS)


def test_ties_and_many_rows(spark):
    draw = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    docs = [(int(i), " ".join(draw.choice(words, draw.integers(0, 30)))) for i in draw.permutation(3000)] + [(5000 + i, "w1 w2 w3") for i in range(40)]
    items = [(i, " ".join(draw.choice(words, 6))) for i in range(20)] + [(99, "w1 w2 w3")]
    found = rank_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(9),
                           spark.createDataFrame(items, "item_id long, text string"))
    assert got(found) == plain(docs, items)


def test_empty_tables(spark, no_docs, odd_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rank_documents(no_docs, items).count() == 0
    assert rank_documents(odd_docs, items.where("false")).count() == 0
    assert rank_documents(odd_docs.selectExpr("doc_id", "cast(null as string) text"), items).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_best_positions_against_all_sums(seed):
    draw = np.random.default_rng(seed)
    n_docs, n_terms, k = 4000, 8, 10
    held = draw.random((n_terms, n_docs)) < draw.random((n_terms, 1)) * 0.6
    term, doc = np.nonzero(held)
    impact = (1 + draw.pareto(1.2, len(doc)) * 50).astype(np.int64) if seed % 2 else draw.integers(1, 4, len(doc))
    shuffled = draw.permutation(len(doc))
    shard = Shard(doc[shuffled], term[shuffled], impact[shuffled], n_terms, n_docs)
    totals = np.zeros(n_docs, np.int64)
    np.add.at(totals, doc, impact)
    expected = sorted(((-s, d) for d, s in enumerate(totals.tolist()) if s > 0))[:k]
    for worst in (0, -expected[-1][0]):
        docs, scores = shard.best(range(n_terms), k, worst)
        assert sorted(zip((-scores).tolist(), docs.tolist()))[:k] == expected
    if seed % 2:
        assert shard.depth < max(held.sum(axis=1))  # the tail of the lists is not read


def test_norms_beyond_64_bits():
    n = np.array([10**9, 7])
    assert length_norms(n, 10**11, 10**12).tolist() == [10 + 90 * 10**9 * 10**11 // 10**12, 10 + 90 * 7 * 10**11 // 10**12]
