"""Noise, ledger and budget on the given tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tabguard.operators import noise
from workload.catalog import query, table
from workload.disclosure import rounded

GAUSS = noise.Budget(1.0, 1e-5, "gaussian")
FACTOR = math.sqrt(2.0 * math.log(1.25 / 1e-5))
COLUMNS = ["c_nationkey", "c_acctbal"]
SEEN = ["column", "epsilon_used", "sensitivity", "noise_scale", "mechanism"]


def ledger_sql(epsilons, factor=FACTOR, mechanism="gaussian"):
    return "WITH s AS (SELECT max(c_nationkey) - min(c_nationkey) AS s0, max(c_acctbal) - min(c_acctbal) AS s1 FROM customer)" + \
        ", ledger AS (" + "\nUNION ALL ".join(
            f"SELECT {i} AS seq, '{n}' AS \"column\", ({e})::DOUBLE AS epsilon_used, s{i}::DOUBLE AS sensitivity, "
            f"s{i} * {factor!r}::DOUBLE / ({e})::DOUBLE AS noise_scale, '{mechanism}' AS mechanism FROM s"
            for i, (n, e) in enumerate(zip(COLUMNS, epsilons))
        ) + ")"


ROUNDED = """
SELECT "column", round(epsilon_used, 6) AS epsilon_used, round(sensitivity, 6) AS sensitivity, round(noise_scale, 4) AS noise_scale, mechanism
FROM ledger
"""


def shown(ledger):
    return rounded(rounded(ledger.select(*SEEN), "epsilon_used", "sensitivity"), "noise_scale", places=4)


def customers(spark, sf_dir):
    return table(spark, sf_dir, "customer")


@query(ledger_sql(["0.5", "0.5"]) + ROUNDED)
def noise_ledger_uniform(spark, sf_dir):
    return shown(noise.noise_ledger(customers(spark, sf_dir), GAUSS, COLUMNS))


@query(ledger_sql(["1.0", "1.0"], 1.0, "laplace") + ROUNDED)
def noise_ledger_full(spark, sf_dir):
    return shown(noise.noise_ledger(customers(spark, sf_dir), noise.Budget(1.0), COLUMNS, allocation="full"))


@query(ledger_sql(["(1.0::DOUBLE / s0) / (1.0::DOUBLE / s0 + 1.0::DOUBLE / s1)", "(1.0::DOUBLE / s1) / (1.0::DOUBLE / s0 + 1.0::DOUBLE / s1)"]) + ROUNDED)
def noise_ledger_inverse_sensitivity(spark, sf_dir):
    return shown(noise.noise_ledger(customers(spark, sf_dir), GAUSS, COLUMNS, allocation="inverse_sensitivity"))


@query(ledger_sql(["0.8", "0.8"]) + """
, u AS (SELECT sum(epsilon_used) AS u, count(*) AS n FROM ledger)
SELECT 1.0::DOUBLE AS epsilon, 0.00001::DOUBLE AS delta, 'gaussian' AS mechanism,
       'Strong Privacy - Balanced noise and utility (RECOMMENDED)' AS interpretation, n AS operations, round(u, 6) AS budget_used,
       greatest(0.0::DOUBLE, 1.0 - u) AS budget_remaining, round(u * 100, 6) AS utilization_percent
FROM u
""")
def budget_report(spark, sf_dir):
    ledger = noise.noise_ledger(customers(spark, sf_dir), GAUSS, COLUMNS, allocation="full", epsilon_fraction=0.8)
    return rounded(noise.budget_report(ledger, GAUSS), "budget_used", "utilization_percent")


@query(ledger_sql(["0.5", "0.5"]) + """
SELECT "column", round(sum(epsilon_used) OVER (ORDER BY seq), 6) AS budget_used,
       round(greatest(0.0::DOUBLE, 1.0 - sum(epsilon_used) OVER (ORDER BY seq)), 6) AS budget_remaining FROM ledger
""")
def running_budget(spark, sf_dir):
    ledger = noise.noise_ledger(customers(spark, sf_dir), GAUSS, COLUMNS)
    return rounded(noise.running_budget(ledger, GAUSS).select("column", "budget_used", "budget_remaining"), "budget_used", "budget_remaining")


@query("""
SELECT 'c_acctbal' AS "column", count(*) AS rows, count(*) FILTER (c_custkey % 7 = 0) AS nulls, TRUE AS others_unchanged,
       TRUE AS mean_close, TRUE AS spread_close FROM customer
""")
def noisy_column_laplace(spark, sf_dir):
    """Nulls stay null, the noise is centred and has the spread of its scale (4 standard errors)."""
    base = customers(spark, sf_dir).withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")))
    noisy, _ = noise.noisy_column(base.withColumn("before", F.col("c_acctbal")).withColumn("copy", F.col("c_nationkey")),
                                  "c_acctbal", noise.Budget(2.0), ["c_custkey"], sensitivity=1000.0, seed=3)
    drawn = F.col("c_acctbal") - F.col("before")
    scale = 500.0
    return noisy.agg(
        F.lit("c_acctbal").alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("c_acctbal").isNull()).alias("nulls"),
        (F.count_if(F.col("copy") != F.col("c_nationkey")) == 0).alias("others_unchanged"),
        (F.abs(F.avg(drawn)) < F.lit(4 * math.sqrt(2.0) * scale) / F.sqrt(F.count("c_acctbal"))).alias("mean_close"),
        (F.abs(F.avg(F.abs(drawn)) - scale) < F.lit(4 * scale) / F.sqrt(F.count("c_acctbal"))).alias("spread_close"),
    )


@query("""
SELECT count(*) AS rows, TRUE AS mean_close, TRUE AS spread_close, TRUE AS same_after_repartition FROM lineitem
""")
def noisy_table_gaussian(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    budget = noise.Budget(1.0, 1e-5, "gaussian")
    ledger = noise.noise_ledger(items, budget, ["l_extendedprice", "l_quantity"], {"l_extendedprice": 100.0, "l_quantity": 10.0})
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "b"]
    base = items.withColumn("b", F.col("l_extendedprice"))
    once = noise.add_noise(base, ledger, key, seed=5)
    sigma = 100.0 * FACTOR / 0.5
    drawn = F.col("l_extendedprice") - F.col("b")
    again = noise.add_noise(base.repartition(13, "l_partkey"), ledger, key, seed=5)
    digest = [df.agg(F.sum(F.xxhash64("l_extendedprice").cast("decimal(38,0)")).alias("s")).first()["s"] for df in (once, again)]
    return once.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.abs(F.avg(drawn)) < F.lit(4 * sigma) / F.sqrt(F.count(F.lit(1)))).alias("mean_close"),
        (F.abs(F.stddev_samp(drawn) - sigma) < F.lit(4 * sigma) / F.sqrt(2 * F.count(F.lit(1)))).alias("spread_close"),
        F.lit(digest[0] == digest[1]).alias("same_after_repartition"),
    )


@query(ledger_sql(["0.5", "0.5"]) + """
SELECT 2::BIGINT AS operation_count, round(sum(epsilon_used), 6) AS budget_used, round(max(noise_scale), 4) AS largest_scale FROM ledger
""")
def privacy_report_document(spark, sf_dir):
    document = noise.report_document(noise.noise_ledger(customers(spark, sf_dir), GAUSS, COLUMNS), GAUSS)
    parsed = document.select(F.from_json(
        "document", "operation_count long, budget_used double, operations array<struct<noise_scale:double>>").alias("d"))
    return parsed.select("d.operation_count", F.round("d.budget_used", 6).alias("budget_used"),
                         F.round(F.array_max("d.operations.noise_scale"), 4).alias("largest_scale"))
