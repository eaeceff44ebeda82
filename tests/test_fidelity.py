import random

import pytest
from pyspark.sql import functions as F

from tabguard.operators import detection, fidelity, ks
from tabguard.operators.cleaning import clean_table


def pair(spark):
    draw = random.Random(5)
    rows = [(draw.gauss(50, 10), draw.randrange(5), draw.choice("abc")) for _ in range(600)]
    real = spark.createDataFrame(rows, "x double, y int, z string")
    return real, real.withColumn("x", F.col("x") + 3).withColumn("z", F.when(F.col("y") == 1, "q").otherwise(F.col("z")))


def test_summary_matches_pandas(spark):
    real, synth = pair(spark)
    got = {r.column: r for r in fidelity.numeric_summary(real, synth).collect()}
    want = synth.toPandas()["x"].describe()
    row = got["x"]
    assert [row["mean"], row["std"], row["min"], row["p25"], row["p50"], row["p75"], row["max"]] == pytest.approx(
        [want[k] for k in ("mean", "std", "min", "25%", "50%", "75%", "max")])
    assert row.real_mean == pytest.approx(row["mean"] - 3)


def test_column_missing_on_the_synthetic_side(spark):
    real, synth = pair(spark)
    got = {r.column: r for r in fidelity.numeric_summary(real, synth.drop("x")).collect()}
    assert got["x"]["mean"] is None and got["x"].real_mean is not None
    tested = {r.column: r.asDict() for r in ks.ks_test(real, synth.drop("x")).collect()}
    assert set(tested) == {"x", "y"}
    assert {v for k, v in tested["x"].items() if k != "column"} == {None}


def test_same_table_is_similar(spark):
    real, _ = pair(spark)
    for row in ks.ks_test(real, real).collect():
        assert (row.ks_statistic, row.p_value, row.similar) == (0.0, 1.0, True)


def test_ks_statistic_against_direct_count(spark):
    draw = random.Random(9)
    a, b = [draw.gauss(0, 1) for _ in range(300)], [draw.gauss(0.4, 1) for _ in range(200)] + [None]
    row = ks.ks_test(spark.createDataFrame([(v,) for v in a], "x double"), spark.createDataFrame([(v,) for v in b], "x double")).first()
    b = b[:-1]
    want = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in a + b)
    assert row.ks_statistic == pytest.approx(want, abs=1e-4) and not row.similar


def test_constant_columns_have_no_correlation(spark):
    df = spark.range(50).selectExpr("id as a", "id * 2.0 as b", "7 as c")
    got = {(r.col_a, r.col_b): r.real_corr for r in fidelity.correlation(df, df).collect()}
    assert got[("a", "b")] == pytest.approx(1.0) and got[("a", "c")] is None


def test_histogram_counts_every_non_null_value(spark):
    df = spark.createDataFrame([(float(i),) for i in range(60)] + [(None,)], "x double")
    rows = fidelity.histogram(df, df).collect()
    assert len(rows) == 60 and sum(r.n for r in rows if r.side == "real") == 60
    flat = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    assert sorted(r.n for r in fidelity.histogram(flat, flat).collect())[-2:] == [2, 2]


def test_flip_needs_two_groups(spark):
    real, _ = pair(spark)
    with pytest.raises(ValueError, match="exactly two"):
        fidelity.flip_test(real, "z")
    with pytest.raises(ValueError):
        fidelity.flip_test(real, "absent")


def test_fairness_without_other_columns(spark):
    df = spark.createDataFrame([("a",), ("b",)], "g string")
    assert fidelity.fairness_score(fidelity.flip_test(df, "g")).first().fairness_score == 100.0


def test_cleaning_strategies(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (1, 1.0, "a"), (2, None, None), (None, 4.0, "b"), (5, 9.0, "b")], "i int, x double, s string")
    rows = {(r.i, r.x, r.s) for r in clean_table(df).collect()}
    assert rows == {(1.0, 1.0, "a"), (2.0, 4.0, "b"), (2.0, 4.0, "b"), (5.0, 9.0, "b")}
    assert clean_table(df, missing_strategy="drop").count() == 2
    assert clean_table(df, remove_duplicates=False, handle_missing=False).count() == 5
    assert {r.i for r in clean_table(df, missing_strategy="mode").collect()} == {1, 2, 5}


def test_clinical_names_and_codes(spark):
    df = spark.createDataFrame([("A00.1", 5.0, 1), ("B12", 700.0, 2), ("oops", 80.0, 3)], "dx string, `Fasting-Glucose` double, hba1c_bmi int")
    got = {r.column: r for r in detection.analyze_columns(df).collect()}
    assert got["dx"].is_icd10 and got["dx"].icd10_validity == 66.67
    assert got["Fasting-Glucose"].unit == "mg/dL" and got["hba1c_bmi"].rule == "bmi"
    assert {r.column: r.violations for r in detection.clinical_bounds(df).collect()} == {"Fasting-Glucose": 1, "hba1c_bmi": 3}


def test_quasi_identifiers(spark):
    named = spark.createDataFrame([(1, "M", 2)], "Race int, Gender string, other int")
    assert detection.quasi_identifiers(named) == ["Gender", "Race"]
    coded = spark.range(100).selectExpr("id", "id % 19 as `tumor-size`", "id % 20 as big", "cast(id as string) as note")
    assert detection.quasi_identifiers(coded, probe_rows=30) == ["tumor-size", "note"]


def test_roles(spark):
    df = spark.range(50).selectExpr("id", "id % 5 as grp", "cast(id % 3 as string) as kind", "id > 3 as flag", "current_date() as day")
    assert detection.column_roles(df) == {"id": "id", "grp": "numerical", "kind": "categorical", "flag": "boolean", "day": "datetime"}
    assert detection.column_roles(df, "grp")["grp"] == "id"
    with pytest.raises(ValueError):
        detection.column_roles(df, "absent")
