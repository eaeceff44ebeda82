"""Constraint profiles over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabguard.operators import constraints as k
from tabguard.session import scratch_path
from workload.catalog import query, table
from workload.disclosure import rounded

ITEMS_SQL = """
WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
                  l_extendedprice, CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag
           FROM lineitem)
"""


def items(spark, sf_dir):
    key = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(key % 7 != 0, F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice", F.when(key % 13 != 0, F.col("l_returnflag")).alias("l_returnflag"),
    )


@query(ITEMS_SQL + """
, a AS (SELECT count(*) FILTER (l_quantity < 5) AS b, count(*) FILTER (l_quantity > 40) AS u, count(*) AS n FROM l)
SELECT 'l_quantity' AS "column", b + u = 0 AS valid, b + u AS violations, b AS below_min, u AS above_max,
       round((b + u) * 100.0::DOUBLE / n, 6) AS violation_percentage FROM a
""")
def range_validate(spark, sf_dir):
    report = k.validate_constraint(items(spark, sf_dir), k.Range("l_quantity", 5, 40))
    return rounded(report.select("column", "valid", "violations", "below_min", "above_max", "violation_percentage"), "violation_percentage")


@query(ITEMS_SQL + """
SELECT l_orderkey, l_linenumber, CAST(round_even(CASE WHEN l_quantity IS NOT NULL THEN least(greatest(l_quantity / 4, 2.5), 9.5) END, 0) AS BIGINT)
  AS l_quantity FROM l
""")
def range_apply_integer(spark, sf_dir):
    quarter = items(spark, sf_dir).withColumn("l_quantity", F.col("l_quantity") / 4)
    return k.apply_constraint(quarter, k.Range("l_quantity", 2.5, 9.5, dtype="int")).select("l_orderkey", "l_linenumber", "l_quantity")


@query(ITEMS_SQL + """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity IS NOT NULL THEN least(greatest(l_quantity, 5.0::DOUBLE), 40.0::DOUBLE) END AS l_quantity FROM l
""")
def range_apply_clip(spark, sf_dir):
    return k.apply_constraint(items(spark, sf_dir), k.Range("l_quantity", 5, 40, dtype="float")).select(
        "l_orderkey", "l_linenumber", "l_quantity"
    )


@query("""
WITH a AS (SELECT count(*) FILTER (p_name IS NULL OR p_name NOT IN ('small ring', 'red widget')) AS v, count(*) AS n FROM part)
SELECT 'p_name' AS "column", v = 0 AS valid, v AS violations, round(v * 100.0::DOUBLE / n, 6) AS violation_percentage,
       coalesce((SELECT list(p_name ORDER BY p_name) FROM (SELECT DISTINCT p_name FROM part
         WHERE p_name NOT IN ('small ring', 'red widget') ORDER BY p_name LIMIT 10)), []) AS invalid_values
FROM a
""")
def categorical_validate(spark, sf_dir):
    report = k.validate_constraint(table(spark, sf_dir, "part"), k.Categorical("p_name", ["small ring", "red widget"]))
    return rounded(report.select("column", "valid", "violations", "violation_percentage", "invalid_values"), "violation_percentage")


MODE_SQL = ITEMS_SQL + """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IN ('A', 'N') THEN l_returnflag ELSE
   (SELECT l_returnflag FROM l WHERE l_returnflag IN ('A', 'N') GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) END AS l_returnflag
FROM l
"""


@query(MODE_SQL)
def categorical_apply_mode(spark, sf_dir):
    rule = k.Categorical("l_returnflag", ["A", "N"], replacement_strategy="mode")
    return k.apply_constraint(items(spark, sf_dir), rule).select("l_orderkey", "l_linenumber", "l_returnflag")


@query(MODE_SQL)
def categorical_apply_nearest_ordered(spark, sf_dir):
    rule = k.Categorical("l_returnflag", ["A", "N"], ordered=True, replacement_strategy="nearest")
    return k.apply_constraint(items(spark, sf_dir), rule).select("l_orderkey", "l_linenumber", "l_returnflag")


@query(ITEMS_SQL + """
SELECT 'l_returnflag' AS "column", count(*) FILTER (l_returnflag IS NULL OR l_returnflag NOT IN ('A', 'N')) AS violations,
       count(*) FILTER (l_returnflag IS NULL OR l_returnflag NOT IN ('A', 'N')) AS unresolved
FROM l
""")
def categorical_apply_nearest_unordered(spark, sf_dir):
    rule = k.Categorical("l_returnflag", ["A", "N"], replacement_strategy="nearest")
    kept = k.apply_constraint(items(spark, sf_dir), rule)
    return k.validate_constraint(kept, rule).select("column", "violations", "unresolved")


@query(ITEMS_SQL + """
SELECT count(*) AS rows, count(*) AS valid_rows, count(*) FILTER (l_returnflag IN ('A', 'N')) AS unchanged_rows,
       count(*) FILTER (l_returnflag IS NULL OR l_returnflag NOT IN ('A', 'N')) > 0 AS both_drawn
FROM l
""")
def categorical_apply_random(spark, sf_dir):
    """Every row valid afterwards, valid rows unchanged, and both options really drawn."""
    rule = k.Categorical("l_returnflag", ["A", "N"])
    before = items(spark, sf_dir).withColumn("before", F.col("l_returnflag"))
    after = k.apply_constraint(before, rule, key=["l_orderkey", "l_linenumber", "l_extendedprice"], seed=7)
    allowed, changed = F.col("l_returnflag").isin("A", "N"), F.coalesce(~F.col("before").isin("A", "N"), F.lit(True))
    return after.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(allowed).alias("valid_rows"),
        F.count_if(F.col("before").isin("A", "N") & (F.col("before") == F.col("l_returnflag"))).alias("unchanged_rows"),
        (F.count_distinct(F.when(changed, F.col("l_returnflag"))) == 2).alias("both_drawn"),
    )


@query("""
WITH a AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer)
SELECT 'c_acctbal' AS "column", abs(m - 5000) / 5000 <= 0.1 AND abs(s - 2000) / 2000 <= 0.1 AS valid,
       round(m, 4) AS actual_mean, round(abs(m - 5000) / 5000 * 100, 4) AS mean_error_pct, abs(m - 5000) / 5000 <= 0.1 AS mean_valid,
       round(s, 4) AS actual_std, round(abs(s - 2000) / 2000 * 100, 4) AS std_error_pct, abs(s - 2000) / 2000 <= 0.1 AS std_valid
FROM a
""")
def statistical_validate(spark, sf_dir):
    report = k.validate_constraint(table(spark, sf_dir, "customer"), k.Statistical("c_acctbal", 5000, 2000))
    names = ["actual_mean", "mean_error_pct", "actual_std", "std_error_pct"]
    return rounded(report.select("column", "valid", "mean_valid", "std_valid", *names), *names, places=4)


@query("""
WITH a AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer)
SELECT c_custkey, round((c_acctbal - m) / s * 2000 + 5000, 4) AS c_acctbal FROM customer, a
""")
def statistical_apply(spark, sf_dir):
    fixed = k.apply_constraint(table(spark, sf_dir, "customer"), k.Statistical("c_acctbal", 5000, 2000))
    return rounded(fixed.select("c_custkey", "c_acctbal"), "c_acctbal", places=4)


PROFILE = k.Profile("orders", [
    k.Range("l_quantity", 5, 40, dtype="int"),
    k.Statistical("l_quantity", 20.0, 6.0),
    k.Range("l_quantity", 3, 38),
    k.Categorical("l_returnflag", ["A", "N"], replacement_strategy="mode"),
    k.Range("l_extendedprice", 2000, 50000, dtype="float"),
    k.Range("absent_column", 0, 1),
])


@query(ITEMS_SQL + """
, s1 AS (SELECT l_orderkey, l_linenumber, CAST(round_even(CASE WHEN l_quantity IS NOT NULL THEN least(greatest(l_quantity, 5), 40) END, 0) AS BIGINT) AS q,
         l_extendedprice, l_returnflag FROM l)
, m AS (SELECT avg(q) AS m, stddev_samp(q) AS s FROM s1)
SELECT l_orderkey, l_linenumber, round(CASE WHEN q IS NOT NULL THEN least(greatest((q - m) / s * 6 + 20, 3), 38) END, 4) AS l_quantity,
       least(greatest(l_extendedprice, 2000), 50000) AS l_extendedprice,
       CASE WHEN l_returnflag IN ('A', 'N') THEN l_returnflag ELSE
        (SELECT l_returnflag FROM l WHERE l_returnflag IN ('A', 'N') GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) END AS l_returnflag
FROM s1, m
""")
def apply_profile(spark, sf_dir):
    return rounded(k.apply_profile(items(spark, sf_dir), PROFILE), "l_quantity", places=4)


@query(ITEMS_SQL + """
, a AS (SELECT count(*) AS n, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s,
   count(*) FILTER (l_quantity < 5) AS b0, count(*) FILTER (l_quantity > 40) AS u0,
   count(*) FILTER (l_quantity < 3) AS b2, count(*) FILTER (l_quantity > 38) AS u2,
   count(*) FILTER (l_extendedprice < 2000) AS b4, count(*) FILTER (l_extendedprice > 50000) AS u4,
   count(*) FILTER (l_returnflag IS NULL OR l_returnflag NOT IN ('A', 'N')) AS c3 FROM l)
SELECT 'l_quantity' AS "column", 0 AS seq, 'range' AS type, b0 + u0 = 0 AS valid, b0 + u0 AS violations, b0 AS below_min, u0 AS above_max,
       round((b0 + u0) * 100.0::DOUBLE / n, 6) AS violation_percentage, CAST(NULL AS DOUBLE) AS actual_mean, CAST(NULL AS DOUBLE) AS actual_std FROM a
UNION ALL SELECT 'l_quantity', 1, 'statistical', abs(m - 20) / 20 <= 0.1 AND abs(s - 6) / 6 <= 0.1, NULL, NULL, NULL, NULL, round(m, 6), round(s, 6) FROM a
UNION ALL SELECT 'l_quantity', 2, 'range', b2 + u2 = 0, b2 + u2, b2, u2, round((b2 + u2) * 100.0::DOUBLE / n, 6), NULL, NULL FROM a
UNION ALL SELECT 'l_returnflag', 0, 'categorical', c3 = 0, c3, NULL, NULL, round(c3 * 100.0::DOUBLE / n, 6), NULL, NULL FROM a
UNION ALL SELECT 'l_extendedprice', 0, 'range', b4 + u4 = 0, b4 + u4, b4, u4, round((b4 + u4) * 100.0::DOUBLE / n, 6), NULL, NULL FROM a
""")
def compliance_report(spark, sf_dir):
    report = k.compliance_report(items(spark, sf_dir), PROFILE).select(
        "column", "seq", "type", "valid", "violations", "below_min", "above_max", "violation_percentage", "actual_mean", "actual_std"
    )
    return rounded(report, "violation_percentage", "actual_mean", "actual_std")


# One constraint per part: the brand plays the column, the part key the order in the list.
PARTS_SQL = """
WITH t AS (SELECT p_brand AS "column", p_partkey AS seq, CASE WHEN p_partkey % 3 = 0 THEN 'statistical' ELSE 'range' END AS type,
             CAST(p_size AS DOUBLE) AS min, CAST(p_size AS DOUBLE) + 10 AS max, CAST(p_size AS DOUBLE) + 0.5 AS target_mean
           FROM part)
, per AS (SELECT "column", count(*) FILTER (type = 'range') AS ranges,
            arg_min(min, seq) FILTER (type = 'range') AS lo, arg_min(max, seq) FILTER (type = 'range') AS hi,
            arg_min(target_mean, seq) FILTER (type = 'statistical') AS m FROM t GROUP BY 1)
, conflicts AS (
  SELECT "column", 'more than one range' AS issue, 'ERROR' AS severity FROM per WHERE ranges > 1
  UNION ALL SELECT "column", 'target mean ' || m || ' lies outside [' || lo || ', ' || hi || ']', 'WARNING' FROM per
  WHERE NOT (m BETWEEN lo AND hi))
"""


def part_constraints(spark, sf_dir):
    size = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("column"), F.col("p_partkey").alias("seq"),
        F.when(F.col("p_partkey") % 3 == 0, "statistical").otherwise("range").alias("type"),
        size.alias("min"), (size + 10).alias("max"), (size + 0.5).alias("target_mean"),
    )


@query(PARTS_SQL + "SELECT * FROM conflicts")
def constraint_conflicts(spark, sf_dir):
    return k.constraint_conflicts(part_constraints(spark, sf_dir))


@query(PARTS_SQL + "SELECT count(*) FILTER (severity = 'ERROR') = 0 AS valid, count(*) AS conflicts FROM conflicts")
def constraint_profile_valid(spark, sf_dir):
    return k.constraints_valid(part_constraints(spark, sf_dir))


@query("""
SELECT p_brand AS profile, p_type AS "column", CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS INT) AS seq,
       'range' AS type, min(p_retailprice) AS min, max(p_retailprice) + 1 AS max, 'float' AS dtype, 'usd' AS unit
FROM part GROUP BY p_brand, p_type
""")
def constraint_profile_roundtrip(spark, sf_dir):
    """A profile per brand, learned from the parts, saved as JSON documents and loaded again."""
    none = F.lit(None)
    learned = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("profile"), F.col("p_type").alias("column")).agg(
        F.min("p_retailprice").alias("min"), (F.max("p_retailprice") + 1).alias("max")
    )
    rows = learned.select(
        "profile", "column", F.col("column").alias("seq"), F.lit("range").alias("type"), "min", "max", F.lit("float").alias("dtype"),
        F.lit("usd").alias("unit"), none.cast("array<string>").alias("allowed_values"), none.cast("boolean").alias("ordered"),
        none.cast("string").alias("strategy"), none.cast("double").alias("target_mean"), none.cast("double").alias("target_std"),
        none.cast("double").alias("tolerance"),
    )
    path = scratch_path(spark, "profiles")
    k.profile_documents(rows).select("document").write.text(path)
    return k.read_profiles(spark, path, multi_line=False).select("profile", "column", "seq", "type", "min", "max", "dtype", "unit")
