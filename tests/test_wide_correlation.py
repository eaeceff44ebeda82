import numpy as np
import pytest
from pyspark.sql import functions as F

from tabguard.operators import fidelity
from tabguard.operators.wide_correlation import _merge, _moments, wide_correlation, wide_correlation_difference


def table(spark, rows=700, columns=9, seed=2):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(rows, columns)) @ draw.normal(size=(columns, columns)) + 1e6 * np.arange(columns)
    x[draw.random((rows, columns)) < 0.2] = np.nan
    x[:, 3], x[:, 5] = 7.25, np.nan
    data = [[None if np.isnan(v) else float(v) for v in r] for r in x]
    return x, spark.createDataFrame(data, ", ".join(f"`c.{i}` double" for i in range(columns))).repartition(6)


def test_equals_plain_correlation_with_missing_values(spark):
    x, df = table(spark)
    got = {(r.col_a, r.col_b): (r["corr"], r.n) for r in wide_correlation(df, block=4, most_bytes=1).collect()}
    assert len(got) == 36
    for i in range(9):
        for j in range(i + 1, 9):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            corr, n = got[f"c.{i}", f"c.{j}"]
            assert n == both.sum()
            if 3 in (i, j) or 5 in (i, j):
                assert corr is None
            else:
                assert corr == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)


def test_equals_the_narrow_operator(spark):
    _, df = table(spark)
    synth = df.select(*[(F.col(f"`{n}`") * 2 + F.rand(1)).alias(n) for n in df.columns if n != "c.1"])
    wide = {(r.col_a, r.col_b): r for r in wide_correlation_difference(df, synth, block=2).collect()}
    narrow = fidelity.correlation(df, synth).collect()
    assert len(wide) == len(narrow)
    for r in narrow:
        for side in ("real_corr", "synth_corr", "diff"):
            assert wide[r.col_a, r.col_b][side] == (r[side] if r[side] is None else pytest.approx(r[side], abs=1e-6))


def test_many_columns_in_one_scan(spark):
    draw = np.random.default_rng(1)
    rows = draw.normal(size=(300, 600))
    df = spark.createDataFrame([(r.tolist(),) for r in rows], "v array<double>").select(*[F.col("v")[i].alias(f"c{i}") for i in range(600)])
    found = wide_correlation(df)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1
    got = {(r.col_a, r.col_b): r["corr"] for r in found.collect()}
    want = np.corrcoef(rows.T)
    assert len(got) == 600 * 599 // 2
    assert max(abs(got[f"c{i}", f"c{j}"] - want[i, j]) for i in range(0, 600, 37) for j in range(i + 1, 600, 11)) < 1e-9


def test_partial_moments_merge(spark):
    draw = np.random.default_rng(3)
    x, y = draw.normal(1e7, 1, (500, 3)), draw.normal(-5, 2, (500, 2))
    x[draw.random((500, 3)) < 0.5] = np.nan
    merged = _moments(x[:1], y[:1])
    for a, b in ((1, 1), (1, 90), (90, 500)):
        merged = _merge(merged, _moments(x[a:b], y[a:b]))
    assert merged == pytest.approx(_moments(x, y), rel=1e-7, abs=1e-6)


def test_few_columns_and_no_rows(spark):
    assert wide_correlation(spark.createDataFrame([(1.0, "a")], "x double, s string")).count() == 0
    assert wide_correlation(spark.createDataFrame([], "x double, y double")).count() == 0
    assert [tuple(r) for r in wide_correlation(spark.createDataFrame([(1.0, 2.0)], "x double, y double")).collect()] == [("x", "y", None, 1)]
