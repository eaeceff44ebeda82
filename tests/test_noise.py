import math

import pytest
from pyspark.sql import functions as F

from tabguard.operators import noise

ROWS = [(i, 25 + i * 50 / 9, 80 + i * 75 / 9, 60 + i * 22 / 9, 20.0 + i * 10 / 9) for i in range(10)]


@pytest.fixture
def labs(spark):
    return spark.createDataFrame(ROWS, "id int, Age double, Glucose double, BloodPressure double, BMI double")


def test_gaussian_ledger(labs):
    budget = noise.Budget(1.0, 1e-5, "gaussian")
    ledger = noise.noise_ledger(labs, budget, ["Age", "Glucose", "BloodPressure", "BMI"])
    rows = {r.column: r for r in ledger.collect()}
    factor = math.sqrt(2 * math.log(1.25e5)) / 0.25
    assert {n: rows[n].sensitivity for n in rows} == pytest.approx({"Age": 50, "Glucose": 75, "BloodPressure": 22, "BMI": 10})
    assert all(r.epsilon_used == 0.25 and r.noise_scale == pytest.approx(r.sensitivity * factor) for r in rows.values())
    report = noise.budget_report(ledger, budget).first()
    assert (report.budget_used, report.budget_remaining, report.utilization_percent) == (1.0, 0.0, 100.0)


def test_full_allocation_overruns_and_says_so(labs):
    budget = noise.Budget(1.0)
    report = noise.budget_report(noise.noise_ledger(labs, budget, ["Age", "BMI"], allocation="full"), budget).first()
    assert (report.budget_used, report.budget_remaining) == (2.0, 0.0)


def test_inverse_allocation_spends_the_budget(labs):
    rows = noise.noise_ledger(labs, noise.Budget(1.0), ["Age", "BMI"], {"Age": 4.0, "BMI": 1.0}, "inverse_sensitivity").collect()
    assert [r.epsilon_used for r in rows] == pytest.approx([0.2, 0.8])


def test_no_numeric_columns(spark):
    df = spark.createDataFrame([("a",)], "s string")
    ledger = noise.noise_ledger(df, noise.Budget(1.0))
    assert ledger.count() == 0 and noise.add_noise(df, ledger, ["s"]).collect() == df.collect()
    assert noise.budget_report(ledger, noise.Budget(1.0)).first().budget_remaining == 1.0


def test_noise_keeps_nulls_and_is_repeatable(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 5 != 0, F.lit(100.0)).alias("x"))
    noisy, ledger = noise.noisy_column(df, "x", noise.Budget(1.0), ["id"], sensitivity=1.0, seed=4)
    assert noisy.filter("x is null").count() == 100 and ledger.first().noise_scale == 1.0
    again, _ = noise.noisy_column(df.repartition(9), "x", noise.Budget(1.0), ["id"], sensitivity=1.0, seed=4)
    assert noisy.exceptAll(again).count() == 0


def test_noise_is_secret_unless_seeded(spark):
    df = spark.range(200).select("id", F.lit(100.0).alias("x"))
    ledger = noise.noise_ledger(df, noise.Budget(1.0), ["x"], {"x": 1.0})
    one, two = (noise.add_noise(df, ledger, ["id"]) for _ in range(2))
    assert one.join(two.withColumnRenamed("x", "y"), "id").filter("x = y").count() == 0
    assert one.exceptAll(one.repartition(7)).count() == 0


@pytest.mark.parametrize("arguments", [(0,), (-1,), (1, -0.1), (1, 1.0), (1, 0.1, "other"), (1, 0, "gaussian")])
def test_bad_budgets(arguments):
    with pytest.raises(ValueError):
        noise.Budget(*arguments)


@pytest.mark.parametrize("epsilon, word", [(0.1, "Very Strong"), (0.5, "Strong"), (1.5, "Moderate"), (5.0, "Weak")])
def test_labels(spark, epsilon, word):
    text = spark.range(1).select(noise.epsilon_label(F.lit(epsilon)).alias("t")).first().t
    assert text.startswith(word)


def test_rows_with_one_key_are_refused_or_numbered(spark):
    df = spark.createDataFrame([("a", 10.0, 1.0), ("a", 10.0, 1.0), ("a", 30.0, 1.0), (None, 10.0, 1.0)], "k string, x double, y double").repartition(3)
    ledger = noise.noise_ledger(df, noise.Budget(1.0), ["x", "y"], {"x": 1.0, "y": 1.0})
    with pytest.raises(ValueError, match="share"):
        noise.add_noise(df, ledger, ["k"])
    rows = noise.add_noise(df, ledger).collect()
    assert len({round(r.x - r.y, 6) for r in rows}) == 4 and len({r.x for r in rows}) == 4
    differences = {round(a.x - b.x, 6) % 10 for a in rows for b in rows if a is not b}
    assert 0 not in differences
    keyed = noise.add_noise(df.dropDuplicates(), ledger, ["k", "x"], seed=1)
    assert keyed.count() == 3 and keyed.columns == df.columns


@pytest.mark.parametrize("mechanism", ["laplace", "gaussian"])
def test_noise_of_many_columns_is_independent(spark, mechanism):
    """Twelve columns take two digests; scales, means and correlations are those of independent draws."""
    names = [f"c{i}" for i in range(12)]
    df = spark.range(4000).select("id", *[F.lit(0.0).alias(n) for n in names])
    ledger = noise.noise_ledger(df, noise.Budget(1.0, 1e-5, mechanism), names, dict.fromkeys(names, 1.0), "full")
    scale = ledger.first().noise_scale
    pdf = noise.add_noise(df, ledger, ["id"], seed=3).toPandas()[names] / scale
    spread = math.sqrt(2) if mechanism == "laplace" else 1.0
    assert (pdf.mean().abs() < 0.12).all() and ((pdf.std() - spread).abs() < 0.12).all()
    off = pdf.corr().to_numpy() - __import__("numpy").eye(12)
    assert abs(off).max() < 0.08


def test_keys_that_read_alike_have_their_own_noise(spark):
    df = spark.createDataFrame([("a", "b:c", 0.0), ("a1:b", "c", 0.0), ("ab", ":c", 0.0), (None, "-", 0.0), ("-", None, 0.0)], "k string, l string, x double")
    ledger = noise.noise_ledger(df, noise.Budget(1.0), ["x"], {"x": 1.0})
    assert len({r.x for r in noise.add_noise(df, ledger, ["k", "l"], seed=2).collect()}) == 5
