from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tabguard.operators import top_values as tv


def brute(rows, at, top=5):
    seen = Counter(r[at] for r in rows if r[at] is not None)
    return [(v, n) for v, n in sorted(seen.items(), key=lambda x: (-x[1], x[0].encode()))[:top]]


def found(df, column, **options):
    rows = sorted((r for r in tv.top_values(df, **options).collect() if r.column == column), key=lambda r: r.rank)
    return [(r.value, r.n) for r in rows], {r.rounds for r in rows}


def test_near_unique_column_is_settled_by_counters(spark):
    draw = np.random.default_rng(2)
    rows = [(f"hot{draw.integers(0, 8)}" if i % 5 == 0 else f"id-{i}", "a" if i % 3 else None) for i in range(6000)]
    df = spark.createDataFrame(rows, "near string, few string").repartition(6)
    got, rounds = found(df, "near", counters=100)
    assert got == brute(rows, 0) and rounds <= {1, 2}
    assert found(df, "few", counters=100) == (brute(rows, 1), {1})


@pytest.mark.parametrize("counters", [2, 7, 64])
def test_equal_to_brute_force_whatever_the_counters(spark, counters):
    draw = np.random.default_rng(counters)
    rows = [(f"v{int(x)}", f"t{i % 40}") for i, x in enumerate(draw.zipf(1.3, 3000) % 900)]
    df = spark.createDataFrame(rows, "skewed string, tied string").repartition(4)
    for at, name in enumerate(("skewed", "tied")):
        assert found(df, name, counters=counters, most_counters=512)[0] == brute(rows, at)


def test_unique_column_is_counted_by_value(spark):
    rows = [(f"{i:05d}",) for i in range(3000)]
    got, rounds = found(spark.createDataFrame(rows, "u string"), "u", counters=10, most_counters=80)
    assert got == brute(rows, 0) and rounds == {0}


def test_counts_stay_between_their_bounds():
    draw = np.random.default_rng(7)
    kept, all_values = tv.Counters(20), []
    for _ in range(30):
        batch = [f"v{int(x)}" for x in draw.zipf(1.4, 200) % 300]
        all_values += batch
        kept.add(pd.Series(batch))
        true = Counter(all_values)
        assert len(kept.held) <= 20
        assert all(kept.held.get(v, 0) <= n <= kept.held.get(v, 0) + kept.lost for v, n in true.items())
    assert kept.rows == 6000


def test_empty_null_and_odd_columns(spark):
    df = spark.createDataFrame([(None, "x", 1), (None, "x", 2)], "`a.b` string, `c d` string, n int")
    assert [(r.column, r.rank, r.value, r.n, r.percentage) for r in tv.top_values(df).collect()] == [("c d", 1, "x", 2, 100.0)]
    assert tv.top_values(df.limit(0)).count() == 0
    assert tv.top_values(df.select("n")).count() == 0


def test_long_candidates_are_counted_by_value(spark, monkeypatch):
    monkeypatch.setattr(tv, "CANDIDATE_BYTES", 100)
    rows = [("y" * 50 + str(i % 7),) for i in range(70)]
    assert found(spark.createDataFrame(rows, "s string"), "s") == (brute(rows, 0), {0})
