"""Fitting and sampling synthetic tables, and patient resources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabguard.operators import constraints, fhir, sequences, synthesis
from tabguard.session import scratch_path
from workload.catalog import query, table
from workload.disclosure import rounded

CUSTOMER_SQL = """
WITH s AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
                  c_mktsegment FROM customer)
"""


def customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")))


@query(CUSTOMER_SQL + """
, k AS (
  SELECT 'c_nationkey' AS "column", 0.0::DOUBLE AS null_share,
     unnest(list_transform(range(0, 201), lambda i: list_sort(list(c_nationkey::DOUBLE))[greatest(1, ceil(i / 200.0::DOUBLE * count(c_nationkey)))::BIGINT])) AS value, unnest(range(0, 201)) AS knot FROM s WHERE c_nationkey IS NOT NULL
  UNION ALL
  SELECT 'c_acctbal', 1 - count(c_acctbal)::DOUBLE / count(*),
     unnest(list_transform(range(0, 201), lambda i: list_sort(list(c_acctbal) FILTER (c_acctbal IS NOT NULL))[greatest(1, ceil(i / 200.0::DOUBLE * count(c_acctbal)))::BIGINT])), unnest(range(0, 201)) FROM s)
SELECT "column", CAST(knot AS INT) AS knot, round(value, 6) AS value, round(null_share, 6) AS null_share FROM k
""")
def copula_marginals(spark, sf_dir):
    knots = synthesis.fit_copula(customers(spark, sf_dir)).tables(spark)["marginals"].filter(F.col("kind") == "numerical")
    return rounded(rounded(knots.select("column", "knot", "value", "null_share"), "value"), "null_share")


@query(CUSTOMER_SQL + """
SELECT 'c_mktsegment' AS "column", c_mktsegment AS value, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM s), 6) AS share
FROM s GROUP BY c_mktsegment
""")
def copula_categories(spark, sf_dir):
    return rounded(synthesis.fit_copula(customers(spark, sf_dir)).categories.select("column", "value", "n", "share"), "share")


@query("""
SELECT p_name AS value, count(*) AS n, TRUE AS ordered, TRUE AS covers FROM part GROUP BY p_name
""")
def category_intervals(spark, sf_dir):
    """Every category gets a non-empty interval of normal scores, and together they leave no gap."""
    cats = synthesis.category_table(table(spark, sf_dir, "part"), ["p_name"])
    ends = cats.select(F.col("upper").alias("lower"), F.lit(True).alias("follows"))
    covers = F.coalesce("follows", F.col("lower") == float("-inf"))
    return cats.join(ends, "lower", "left").select("value", "n", (F.col("upper") > F.col("lower")).alias("ordered"), covers.alias("covers"))


@query("""
SELECT count(*) AS rows, count(*) AS distinct_keys, TRUE AS mean_close, TRUE AS std_close, TRUE AS in_range, TRUE AS corr_close,
       TRUE AS shares_close FROM lineitem
""")
def sample_copula_rows(spark, sf_dir):
    """As many rows as the line items; means, deviations, ranges, correlation and shares agree."""
    real = table(spark, sf_dir, "lineitem").select(
        "l_quantity", (F.col("l_extendedprice") * F.col("l_quantity")).alias("value"), "l_returnflag", "l_shipdate"
    ).withColumn("key", F.monotonically_increasing_id())
    n = real.count()
    model = synthesis.fit_copula(real)
    synth = synthesis.sample_rows(spark, model, n, seed=11)

    def facts(df):
        return df.agg(
            F.avg("l_quantity"), F.stddev_samp("l_quantity"), F.min("value"), F.max("value"), F.corr("l_quantity", "value"),
            F.avg((F.col("l_returnflag") == "A").cast("double")), F.avg("value"), F.stddev_samp("value"),
        ).first()

    a, b = facts(real), facts(synth)
    return synth.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("key").alias("distinct_keys")).select(
        "rows", "distinct_keys",
        F.lit(abs(a[0] - b[0]) < 0.05 * a[0] and abs(a[6] - b[6]) < 0.05 * a[6]).alias("mean_close"),
        F.lit(abs(a[1] - b[1]) < 0.05 * a[1] and abs(a[7] - b[7]) < 0.05 * a[7]).alias("std_close"),
        F.lit(b[2] >= a[2] and b[3] <= a[3]).alias("in_range"),
        F.lit(abs(a[4] - b[4]) < 0.05).alias("corr_close"),
        F.lit(abs(a[5] - b[5]) < 0.02).alias("shares_close"),
    )


@query("""
SELECT count(*) AS rows, count(*) AS in_range, count(*) AS known_flag, count(*) AS known_name FROM part
""")
def sample_rows_constrained(spark, sf_dir):
    real = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    profile = constraints.Profile("parts", [
        constraints.Range("p_size", 10, 40, "int"), constraints.Categorical("p_brand", ["Brand#1", "Brand#2"]),
    ])
    path = scratch_path(spark, "model")
    synthesis.fit_copula(real).save(spark, path)
    model = synthesis.CopulaModel.load(spark, path)
    synth = synthesis.sample_rows(spark, model, real.count(), seed=2, profile=profile)
    names = real.select("p_name").distinct().withColumn("known", F.lit(True))
    return synth.join(names, "p_name", "left").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("p_size").between(10, 40)).alias("in_range"),
        F.count_if(F.col("p_brand").isin("Brand#1", "Brand#2")).alias("known_flag"), F.count_if("known").alias("known_name"),
    )


@query("""
SELECT count(DISTINCT user_id) AS entities, TRUE AS lengths_close, TRUE AS mean_close, TRUE AS types_known, TRUE AS ordered FROM events
""")
def sample_event_sequences(spark, sf_dir):
    real = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    model = sequences.fit_sequences(real, "user_id", "ts")
    n = real.select("user_id").distinct().count()
    synth = sequences.sample_sequences(spark, model, n, seed=4)
    a, b = (df.agg(F.count(F.lit(1)) / F.count_distinct("user_id"), F.avg("value"), F.min("value"), F.max("value")).first() for df in (real, synth))
    types = {r[0] for r in real.select("event_type").distinct().collect()}
    spans = synth.groupBy("user_id").agg((F.max("ts") >= F.min("ts")).alias("ordered"))
    return synth.agg(F.count_distinct("user_id").alias("entities"), F.count_if(~F.col("event_type").isin(*types)).alias("odd")).join(
        F.broadcast(spans.agg(F.bool_and("ordered").alias("ordered")))
    ).select(
        "entities", F.lit(abs(a[0] - b[0]) < 0.25 * a[0]).alias("lengths_close"),
        F.lit(abs(a[1] - b[1]) < 0.15 * abs(a[1]) and b[2] >= a[2] and b[3] <= a[3]).alias("mean_close"),
        (F.col("odd") == 0).alias("types_known"), "ordered",
    )


PATIENT_SQL = """
WITH p AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'M' WHEN 1 THEN 'Female' WHEN 2 THEN 'other' WHEN 3 THEN NULL WHEN 4 THEN 'x' ELSE 'F' END AS sex,
                  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE CAST(c_nationkey + 20 AS VARCHAR) || '.7' END AS age
           FROM customer)
, f AS (SELECT c_custkey, sha256(CAST(c_custkey AS VARCHAR)) AS h,
          CASE lower(sex) WHEN 'm' THEN 'male' WHEN 'f' THEN 'female' WHEN 'x' THEN NULL ELSE lower(sex) END AS gender,
          CASE WHEN age LIKE '%.7' THEN CAST(2024 - CAST(replace(age, '.7', '') AS INT) AS VARCHAR) || '-01-01' END AS birth
        FROM p)
, r AS (SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS patient_id,
          gender, birth AS "birthDate" FROM f)
"""


def patients(spark, sf_dir):
    k = F.col("c_custkey")
    sex = (F.when(k % 6 == 0, "M").when(k % 6 == 1, "Female").when(k % 6 == 2, "other").when(k % 6 == 4, "x").when(k % 6 == 5, "F"))
    age = F.when(k % 5 == 0, None).when(k % 7 == 0, "n/a").otherwise(F.concat((F.col("c_nationkey") + 20).cast("string"), F.lit(".7")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", sex.alias("Sex"), age.alias("AGE"))
    return fhir.patient_resources(rows, ["c_custkey"], as_of_year=2024)


@query(PATIENT_SQL + "SELECT * FROM r")
def fhir_patients(spark, sf_dir):
    return patients(spark, sf_dir)


@query(PATIENT_SQL + """
SELECT patient_id, '{"resource":{"resourceType":"Patient","id":"' || patient_id || '"' || CASE WHEN gender IS NULL THEN '' ELSE ',"gender":"' || gender || '"' END
  || CASE WHEN "birthDate" IS NULL THEN '' ELSE ',"birthDate":"' || "birthDate" || '"' END || '},"request":{"method":"POST","url":"Patient"}}' AS document
FROM r
""")
def fhir_bundle_entries(spark, sf_dir):
    return fhir.bundle_entries(patients(spark, sf_dir))
