import pytest
from pyspark.sql import functions as F

from tabguard.operators import anonymity as a
from tabguard.operators import leakage

QI = ["Age", "Gender", "ZipCode"]
ROWS = [
    (25, "M", 10001, "Diabetes"), (25, "M", 10001, "Asthma"), (25, "M", 10001, "Healthy"),
    (30, "F", 10002, "Diabetes"), (30, "F", 10002, "Cancer"), (30, "F", 10002, "Healthy"),
    (35, "M", 10003, "Cancer"), (35, "M", 10003, "Cancer"), (40, "F", 10004, "Diabetes"),
]


@pytest.fixture
def patients(spark):
    return spark.createDataFrame(ROWS, "Age int, Gender string, ZipCode int, Diagnosis string")


def test_k_anonymity_of_the_small_table(patients):
    row = a.k_anonymity(patients, QI, 3).first()
    assert (row.total_groups, row.violating_groups, row.smallest_group_size, row.records_at_risk) == (4, 2, 1, 3)
    assert not row.satisfies_k_anonymity and row.k_anonymity_score == pytest.approx(66.6667, abs=1e-3)


def test_violating_groups_carry_a_risk_level(patients):
    rows = a.k_anonymity_violations(patients, QI, 3).collect()
    assert [(r.Age, r.group_size, r.risk_level) for r in rows] == [(35, 2, "HIGH"), (40, 1, "CRITICAL")]


def test_l_diversity(patients):
    row = a.l_diversity(patients, QI, ["Diagnosis", "absent"], 2).first()
    assert (row.violating_groups, row.records_at_risk) == (2, 3)


def test_t_closeness(patients):
    row = a.t_closeness(patients, QI, ["Diagnosis"], 0.2).first()
    assert row.max_distance == pytest.approx(2 / 3) and row.violating_groups == 3
    distances = sorted(r.distance for r in a.t_closeness_groups(patients, QI, ["Diagnosis"]).collect())
    assert distances == pytest.approx([1 / 9, 1 / 3, 2 / 3, 2 / 3])


def test_group_without_sensitive_values_has_distance_one_half(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (2, None)], "q int, s string")
    found = {r.q: r.distance for r in a.t_closeness_groups(df, ["q"], ["s"]).collect()}
    assert found == {1: 0.0, 2: 0.5}


def test_audit(patients):
    row = a.privacy_audit(patients, QI, ["Diagnosis"]).first()
    assert (row.metrics_satisfied, row.risk_level) == (0, "CRITICAL")
    loose = a.privacy_audit(patients, QI, ["Diagnosis"], k=1, l=1, t=0.9).first()
    assert (loose.metrics_satisfied, loose.risk_level) == (3, "LOW")


def test_audit_without_identifiers_or_attributes(patients):
    assert a.privacy_audit(patients, [], ["Diagnosis"]).first().risk_level == "CRITICAL"
    assert a.privacy_audit(patients, QI, [], k=1).first().metrics_satisfied == 1
    assert a.privacy_audit(patients, QI, ["absent"], k=1).first().metrics_satisfied == 3


def test_null_identifiers_form_no_group_unless_asked(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), (None, 1), (None, 2)], "q string, s int")
    row = a.k_anonymity(df, ["q"], 2).first()
    assert (row.total_groups, row.total_records, row.satisfies_k_anonymity) == (1, 4, True)
    assert a.k_anonymity(df, ["q"], 3, null_group=True).first().records_at_risk == 4
    assert a.t_closeness(df, ["q"], ["s"], null_group=True).first().total_groups == 2


def test_one_hot_group_and_hot_value(spark):
    """A third of the rows in one group with one value: same result as plain arithmetic."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("q"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 7).cast("string")).alias("s"))
    rows = df.toPandas()
    overall = rows["s"].value_counts(normalize=True)
    want = {q: g["s"].value_counts(normalize=True).reindex(overall.index, fill_value=0.0).sub(overall).abs().sum() / 2 for q, g in rows.groupby("q")}
    got = {r.q: r.distance for r in a.t_closeness_groups(df, ["q"], ["s"]).collect()}
    assert got == pytest.approx(want)


def test_leakage_counts_distinct_rows_and_ignores_nulls(spark):
    real = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None)], "x int, y string")
    synth = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (3.0, None), (9.0, "z")], "x double, y string")
    row = leakage.exact_leakage(real, synth).first()
    assert (row.total_real_rows, row.total_synthetic_rows, row.leaked_rows) == (4, 4, 1)
    assert row.leaked_percentage == pytest.approx(100 / 3)
    assert leakage.exact_leakage(real, synth, null_matches=True).first().leaked_rows == 2
