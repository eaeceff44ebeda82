import numpy as np
import pytest
from pyspark.sql import functions as F

from tabguard.functions.randoms import normal
from tabguard.operators import sequences, synthesis
from tabguard.operators.constraints import Profile, Range
from tabguard.operators.registry import fit_or_load, registry_rows
from tabguard.plans.experiment_run import ExperimentConfig, run_experiment


@pytest.fixture(scope="module")
def real(spark):
    a, b = normal(1, "a", F.col("id")), normal(1, "b", F.col("id"))
    return spark.range(4000).select(
        F.concat(F.lit("p"), F.col("id")).alias("pid"), (a * 10 + 50).alias("x"), F.rint(a * 8 + b * 6 + 20).cast("int").alias("y"),
        F.when(F.col("id") % 10 < 7, "A").when(F.col("id") % 10 < 9, "B").alias("g"), (F.col("id") % 2 == 0).alias("flag"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 365).cast("int")).alias("day"),
    )


def test_sample_follows_the_fitted_table(spark, real):
    model = synthesis.fit_copula(real)
    synth = synthesis.sample_rows(spark, model, 4000, seed=3)
    assert synth.dtypes == real.dtypes and synth.count() == 4000 and synth.select("pid").distinct().count() == 4000
    facts = [F.avg("x"), F.stddev("x"), F.avg("y"), F.corr("x", "y"), F.avg((F.col("g") == "A").cast("double")), F.avg(F.col("g").isNull().cast("double")),
             F.avg(F.col("flag").cast("double")), F.min("day").cast("string"), F.max("day").cast("string")]
    a, b = real.agg(*facts).first(), synth.agg(*facts).first()
    assert b[0] == pytest.approx(a[0], abs=1) and b[1] == pytest.approx(a[1], abs=0.6) and b[2] == pytest.approx(a[2], abs=1)
    assert b[3] == pytest.approx(a[3], abs=0.05)
    assert b[4] == pytest.approx(a[4], abs=0.04) and b[5] == pytest.approx(0.1, abs=0.02) and b[6] == pytest.approx(0.5, abs=0.04)
    assert "2020-01-01" <= b[7] and b[8] <= "2020-12-31"


def test_sample_is_repeatable_and_model_survives_saving(spark, real, tmp_path):
    model, key, cached = fit_or_load(real, str(tmp_path))
    again, same, hit = fit_or_load(real.repartition(3), str(tmp_path))
    assert not cached and hit and key == same
    one = synthesis.sample_rows(spark, model, 300, seed=5)
    assert one.exceptAll(synthesis.sample_rows(spark, again, 300, seed=5)).count() == 0
    assert one.exceptAll(synthesis.sample_rows(spark, model, 300, seed=6)).count() > 250


def test_a_broken_save_is_passed_over(spark, real, tmp_path, monkeypatch):
    def broken(self, spark, path):
        self.tables(spark)["columns"].write.parquet(f"{path}/columns")
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(synthesis.CopulaModel, "save", broken)
        with pytest.raises(OSError):
            fit_or_load(real, str(tmp_path))
    assert [fit_or_load(real, str(tmp_path))[2] for _ in range(2)] == [False, True]
    assert registry_rows(spark, str(tmp_path)).count() == 1


def test_many_categories_go_through_joins(spark):
    """More categories than are kept as literals, a third of the rows in one of them."""
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 2000).cast("string"))).alias("name"),
        normal(2, "v", F.col("id")).alias("v"))
    model = synthesis.fit_copula(df)
    assert model.marginals[0].categories > synthesis.FEW_CATEGORIES
    synth = synthesis.sample_rows(spark, model, 6000, seed=1)
    assert synth.count() == 6000
    assert synth.filter("name = 'hot'").count() / 6000 == pytest.approx(1 / 3, abs=0.03)
    assert synth.join(df.select("name").distinct(), "name", "left_anti").count() == 0


def test_single_value_and_empty_columns(spark):
    df = spark.range(50).selectExpr("id * 0.5 as v", "5.0D as c", "cast(null as double) as e", "cast(null as string) as s", "'only' as o")
    row = synthesis.sample_rows(spark, synthesis.fit_copula(df), 20).agg(
        F.count("v"), F.min("c"), F.max("c"), F.count("e"), F.count("s"), F.count_distinct("o")).first()
    assert tuple(row) == (20, 5.0, 5.0, 0, 0, 1)


def test_wrong_use(spark, real):
    with pytest.raises(ValueError, match="unknown method"):
        synthesis.fit_copula(real, method="other")
    with pytest.raises(RuntimeError):
        synthesis.sample_rows(spark, None, 5)
    with pytest.raises(ValueError):
        sequences.fit_sequences(real, None)
    with pytest.raises(ValueError):
        sequences.fit_sequences(real, "absent")


def test_matrix_repair():
    fixed = synthesis.positive_definite(np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1.0]]))
    assert np.linalg.eigvalsh(fixed).min() > 0 and np.allclose(np.diag(fixed), 1)


@pytest.mark.parametrize("piece_rows", [10**6, 100])
def test_sequences(spark, piece_rows):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 60).alias("who"),
        F.timestamp_seconds(F.col("id") * 60).alias("at"), F.sin(F.col("id") / 40.0).alias("v"), (F.col("id") % 4).cast("string").alias("k"))
    model = sequences.fit_sequences(df, "who", "at", piece_rows)
    assert model.persistence[0] > 0.2
    synth = sequences.sample_sequences(spark, model, 40, seed=2)
    assert synth.dtypes == df.dtypes and synth.select("who").distinct().count() == 40
    assert synth.filter("v < -1 or v > 1 or k not in ('0','1','2','3')").count() == 0
    assert synth.exceptAll(sequences.sample_sequences(spark, model, 40, seed=2)).count() == 0


def test_whole_run(spark, real):
    config = ExperimentConfig("e1", num_rows=500, sensitive_column="flag", epsilon=2.0)
    tables = run_experiment(spark, real, config, Profile("p", [Range("x", 40, 60)]))
    assert tables["synthetic"].count() == 500 and tables["synthetic"].filter("x < 40 or x > 60").count() == 0
    assert {r.section for r in tables["reports"].select("section").distinct().collect()} == {
        "clinical", "stats", "privacy", "ks", "dcr", "flip", "fairness", "compliance"}
    assert tables["ledger"].agg(F.sum("epsilon_used")).first()[0] == pytest.approx(2.0)
    assert [r.status for r in tables["status"].orderBy("seq").collect()] == ["pending", "running", "completed"]
