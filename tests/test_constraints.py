import pytest
from pyspark.sql import functions as F

from tabguard.operators import constraints as k

ROWS = [(1, 25, "M", 24, 85), (2, 30, "F", 27, 90), (3, -5, "X", 29, 700), (4, 150, "M", 31, 120), (5, 45, "Invalid", 34, 110)]
PROFILE = k.Profile("demo", [
    k.Range("Age", 0, 120, "int"), k.Categorical("Gender", ["M", "F"]), k.Range("Glucose", 50, 600), k.Statistical("BMI", 25.0, 5.0),
])


@pytest.fixture
def people(spark):
    return spark.createDataFrame(ROWS, "id int, Age int, Gender string, BMI int, Glucose int")


def test_compliance(people):
    found = {r.column: r for r in k.compliance_report(people, PROFILE).collect()}
    assert (found["Age"].below_min, found["Age"].above_max, found["Age"].violation_percentage) == (1, 1, 40.0)
    assert found["Gender"].violations == 2 and found["Gender"].invalid_values == ["Invalid", "X"]
    assert found["Glucose"].above_max == 1 and found["Glucose"].violation_percentage == 20.0
    assert found["BMI"].actual_mean == 29.0 and found["BMI"].mean_error_pct == pytest.approx(16.0) and not found["BMI"].valid


def test_application(people):
    rows = k.apply_profile(people, PROFILE, key=["id"]).orderBy("id").collect()
    assert [r.Age for r in rows] == [25, 30, 0, 120, 45]
    assert [r.Glucose for r in rows] == [85, 90, 600, 120, 110]
    assert all(r.Gender in "MF" for r in rows) and [rows[i].Gender for i in (0, 1, 3)] == ["M", "F", "M"]
    mean = sum(r.BMI for r in rows) / 5
    assert mean == pytest.approx(25.0) and (sum((r.BMI - mean) ** 2 for r in rows) / 4) ** 0.5 == pytest.approx(5.0)


def test_applied_table_validates_and_is_a_fixed_point(people):
    rules = k.Profile("p", [k.Range("Age", 0, 120, "int"), k.Categorical("Gender", ["M", "F"])])
    once = k.apply_profile(people, rules, key=["id"], seed=1)
    assert all(r.valid for r in k.compliance_report(once, rules).collect())
    assert k.apply_profile(once, rules, key=["id"], seed=2).exceptAll(once).count() == 0


def test_random_replacement_does_not_depend_on_partitioning(people):
    rule = k.Categorical("Gender", ["M", "F"])
    one = k.apply_constraint(people, rule, key=["id"], seed=3).orderBy("id").collect()
    two = k.apply_constraint(people.repartition(5, "Glucose"), rule, key=["id"], seed=3).orderBy("id").collect()
    assert one == two


def test_clip_keeps_nulls_and_rounds_half_to_even(spark):
    df = spark.createDataFrame([(25.0,), (-5.0,), (150.0,), (2.5,), (3.5,), (None,)], "x double")
    out = [r.x for r in k.apply_constraint(df, k.Range("x", 0, 120, "int")).collect()]
    assert out == [25, 0, 120, 2, 4, None]


def test_nulls_are_invalid_categories_but_no_range_violation(spark):
    df = spark.createDataFrame([(None, None), (1, "a")], "x int, y string")
    found = {r.column: r.violations for r in k.compliance_report(df, k.Profile("p", [k.Range("x", 0, 2), k.Categorical("y", ["a"])])).collect()}
    assert found == {"x": 0, "y": 1}


def test_mode_without_valid_value_is_an_error(spark):
    df = spark.createDataFrame([("x",)], "y string")
    with pytest.raises(ValueError, match="no valid value"):
        k.apply_constraint(df, k.Categorical("y", ["a"], replacement_strategy="mode"))


def test_unordered_nearest_reports_what_it_leaves(people):
    rule = k.Categorical("Gender", ["M", "F"], replacement_strategy="nearest")
    assert k.validate_constraint(k.apply_constraint(people, rule), rule).first().unresolved == 2


def test_zero_target_mean_gives_no_error(people):
    row = k.validate_constraint(people, k.Statistical("BMI", 0.0, 5.0)).first()
    assert row.mean_error_pct is None and not row.valid


@pytest.mark.parametrize("build", [
    lambda: k.Range("x", 5, 5), lambda: k.Categorical("x", []), lambda: k.Categorical("x", ["a"], replacement_strategy="other"),
    lambda: k.Statistical("x", 1, 0), lambda: k.Statistical("x", 1, 1, 0), lambda: k.Statistical("x", 1, 1, 1.5),
])
def test_bad_constraints(build):
    with pytest.raises(ValueError):
        build()


def test_conflicts(spark):
    profile = k.Profile("c", [k.Range("a", 0, 1), k.Range("a", 2, 3), k.Range("b", 0, 1), k.Statistical("b", 7.5, 1), k.Statistical("d", 1, 1)])
    rows = {(r.column, r.severity) for r in k.constraint_conflicts(k.profile_table(spark, profile)).collect()}
    assert rows == {("a", "ERROR"), ("b", "WARNING")}
    assert not k.constraints_valid(k.profile_table(spark, profile)).first().valid
    assert k.constraints_valid(k.profile_table(spark, k.clinical_labs())).first().valid


def test_profile_document_round_trip(spark, tmp_path):
    for profile in (k.clinical_labs(), k.demographics(), PROFILE):
        path = str(tmp_path / profile.name)
        k.profile_documents(k.profile_table(spark, profile)).select("document").write.text(path)
        back = k.profile_from_table(k.read_profiles(spark, path, multi_line=False), profile.name)
        assert back.constraints == profile.constraints


def test_unknown_constraint_types_are_left_out(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"name": "p", "constraints": [{"column": "a", "constraint_type": "magic", "params": {}},'
                                     '{"column": "b", "constraint_type": "range", "params": {"min": 0, "max": 1, "dtype": null, "unit": "x"}}]}')
    assert [r.column for r in k.read_profiles(spark, str(tmp_path / "p.json")).collect()] == ["b"]


def test_own_constraint_type(spark):
    class NotNegative(k.Constraint):
        kind = "not_negative"

        def __init__(self, column):
            self.column = column

        def aggregates(self):
            return {"n": F.count_if(F.col(self.column) < 0)}

        def result(self, get, rows):
            return {"valid": get("n") == 0, "violations": get("n")}

        def apply(self, value, stats, key, seed):
            return F.abs(value)

    df = spark.createDataFrame([(-1,), (2,)], "x int")
    assert k.validate_constraint(df, NotNegative("x")).first().violations == 1
    assert sorted(r.x for r in k.apply_constraint(df, NotNegative("x")).collect()) == [1, 2]
