import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabguard.functions.gaussian import inverse_normal
from tabguard.functions.randoms import laplace, normal, uniform
from tabguard.plans.lookups import lookup_join
from tabguard.plans.ordered import cut_points, lag_in_groups, previous_in_groups, running_totals, with_buckets, with_pieces
from tabguard.plans.quantiles import exact_quantiles, weighted_quantiles

PROBABILITIES = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def values(kind, n=5000):
    draw = random.Random(kind)
    if kind == "uniform":
        return [draw.random() for _ in range(n)]
    if kind == "tail":
        return [draw.paretovariate(0.7) for _ in range(n)]
    if kind == "hot":
        return [3.0 if draw.random() < 0.4 else draw.gauss(0, 10) for _ in range(n)]
    return [float(draw.randrange(4)) for _ in range(n)]


@pytest.mark.parametrize("kind", ["uniform", "tail", "hot", "few"])
@pytest.mark.parametrize("small", [10, 1_000_000])
def test_exact_quantiles_by_brackets_and_directly(spark, kind, small):
    data = values(kind)
    df = spark.createDataFrame([(v,) for v in data], "x double").repartition(7)
    found = exact_quantiles(df, ["x"], PROBABILITIES, small_rows=small)["x"]
    assert found == pytest.approx(list(np.quantile(data, PROBABILITIES)))


def test_quantiles_of_sorted_input(spark):
    """Partitions that hold a stretch of the values each: the buckets shrink all the same."""
    df = spark.range(0, 40_000, 1, 16).select(F.col("id").cast("double").alias("x"))
    found = exact_quantiles(df, ["x"], PROBABILITIES, small_rows=500)["x"]
    assert found == pytest.approx(list(np.quantile(np.arange(40_000.0), PROBABILITIES)))
    squeezed = spark.range(0, 20_000, 1, 8).select(F.exp(-F.col("id") / 50).alias("x"))
    found = exact_quantiles(squeezed, ["x"], PROBABILITIES, small_rows=100)["x"]
    assert found == pytest.approx(list(np.quantile(np.exp(-np.arange(20_000) / 50), PROBABILITIES)))


def test_cuts_of_uneven_partitions(spark):
    """Few rows in many partitions weigh what they are."""
    many = spark.range(0, 20_000, 1, 3).select(F.randn(1).alias("x"))
    few = spark.range(0, 200, 1, 20).select((F.randn(2) + 100).alias("x"))
    cuts = cut_points(many.unionByName(few), ["x"], 100)["x"]
    assert abs(cuts[49]) < 0.1 and cuts[97] < 4 and sum(x > 50 for x in cuts) <= 2


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]) == {"x": [None]}


def test_weighted_quantiles(spark):
    draw = random.Random(1)
    rows = [(draw.gauss(0, 1), draw.randrange(1, 6)) for _ in range(800)]
    df = spark.createDataFrame(rows, "v double, n long")
    whole = [v for v, n in rows for _ in range(n)]
    assert weighted_quantiles(df, "v", "n", PROBABILITIES) == pytest.approx(list(np.quantile(whole, PROBABILITIES)))


def test_running_totals_match_one_big_window(spark):
    draw = random.Random(2)
    df = spark.createDataFrame([(g, draw.paretovariate(1), draw.randrange(9)) for g in "ab" for _ in range(2000)], "g string, v double, n long")
    bucketed = with_buckets(df, cut_points(df, ["v"])).withColumn("bucket", F.col("_b0").cast("int"))
    assert bucketed.select("bucket").distinct().count() > 8
    for descending in (False, True):
        order = F.desc("v") if descending else F.asc("v")
        got = running_totals(bucketed, {"upto": "n"}, [order], ["g"], descending=descending)
        whole = Window.partitionBy("g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        assert got.select("g", "v", "upto").exceptAll(df.select("g", "v", F.sum("n").over(whole).alias("upto"))).count() == 0


def log(spark, n=3000):
    draw = random.Random(3)
    rows = [("hot" if draw.random() < 0.4 else f"k{draw.randrange(40)}", draw.randrange(500), i, draw.choice([None, "x", "y"])) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t int, i int, v string")


@pytest.mark.parametrize("piece_rows", [50, 10**6])
def test_lag_and_last_value_over_cut_groups(spark, piece_rows):
    df = log(spark)
    order = Window.partitionBy("k").orderBy("t", "i")
    got = lag_in_groups(df, ["k"], ["t", "i"], {"before": "t"}, piece_rows)
    assert got.exceptAll(df.withColumn("before", F.lag("t").over(order))).count() == 0
    last = F.last("v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    got = previous_in_groups(df, ["k"], ["t", "i"], F.col("v"), "seen", piece_rows)
    assert got.count() == df.count() and got.exceptAll(df.withColumn("seen", last)).count() == 0


def test_pieces_are_even_and_ordered(spark):
    pieced, cut = with_pieces(log(spark), ["k"], ["t", "i"], 100)
    assert cut
    spans = pieced.filter("k = 'hot'").groupBy("_piece").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n")).orderBy("_piece").collect()
    assert len(spans) > 5 and max(s.n for s in spans) < 200
    assert all(x.b <= y.a for x, y in zip(spans, spans[1:]))


def test_pieces_of_null_keys_single_moments_and_many_pieces(spark):
    null_key = spark.range(8000).select(F.lit(None).cast("string").alias("k"), F.lit(1).alias("t"), F.col("id").alias("i"))
    other = spark.range(100).select(F.lit("b").alias("k"), F.lit(1).alias("t"), F.col("id").alias("i"))
    df = null_key.unionByName(other)
    pieced, cut = with_pieces(df, ["k"], ["t", "i"], 50)
    sizes = pieced.groupBy("k", "_piece").agg(F.count("*").alias("n"), F.min("i").alias("a"), F.max("i").alias("b")).orderBy("a").collect()
    assert cut and pieced.count() == df.count()
    null_sizes = [r for r in sizes if r.k is None]
    assert len(null_sizes) > 128 and max(r.n for r in null_sizes) <= 150
    assert all(x.b < y.a and x["_piece"] < y["_piece"] for x, y in zip(null_sizes, null_sizes[1:]))
    got = lag_in_groups(df, ["k"], ["t", "i"], {"before": "i"}, 50)
    assert got.exceptAll(df.withColumn("before", F.lag("i").over(Window.partitionBy("k").orderBy("t", "i")))).count() == 0


def test_files_of_pieces_follow_the_rows(spark):
    """8,000 rows in pieces of 5: a file for each task, not one for each of 3,200 pieces."""
    df = spark.range(8000).select(F.lit("a").alias("k"), F.col("id").alias("i"))
    pieced, cut = with_pieces(df, ["k"], ["i"], 5)
    sizes = pieced.groupBy("_piece").agg(F.count("*").alias("n"), F.min("i").alias("a"), F.max("i").alias("b")).orderBy("_piece").collect()
    assert cut and sum(r.n for r in sizes) == 8000 and max(r.n for r in sizes) <= 5
    assert all(x.b < y.a for x, y in zip(sizes, sizes[1:]))
    assert len(pieced.filter("_piece > 0").inputFiles()) <= 16


def test_lookup_join_spreads_null_keys(spark):
    facts = spark.range(8000).select(F.when(F.col("id") % 4 == 0, F.lit("a")).alias("k"), F.col("id").alias("i"))
    table = spark.createDataFrame([("a", 5, "x" * 50), ("b", 1, None)], "k string, uses long, text string")
    joined = lookup_join(facts, table, ["k"], "uses", ["text"])
    assert joined.exceptAll(facts.join(table.select("k", "text"), "k", "left").select("k", "i", "text")).count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = lookup_join(facts, table, ["k"], "uses", ["text"]).filter("k is null").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(held) >= 6 and max(r["count"] for r in held) < 2000


def test_lookup_join_spreads_a_hot_key_without_adaptive_plans(spark):
    """The salt stays in the join's exchange, and rows of a key that is served from the broadcast spread by it."""
    facts = spark.range(8000).select(F.when(F.col("id") % 4 == 0, F.concat(F.lit("k"), F.col("id") % 40)).otherwise("hot").alias("k"), F.col("id").alias("i"))
    table = facts.groupBy("k").agg(F.count("*").alias("uses"), F.concat(F.lit("p"), F.max("i")).alias("text"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup_join(facts, table, ["k"], "uses", ["text"], hot_keys=1)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        held = joined.filter("k = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
        twice = lookup_join(joined, table.withColumnRenamed("text", "more"), ["k"], "uses", ["more"], hot_keys=1)
        assert twice.filter("text <=> more").count() == 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"hashpartitioning\(k#\d+, _salt#\d+", plan)) == 2
    assert len(held) >= 6 and max(r["count"] for r in held) < 2000


def test_lookup_join_keeps_large_documents_out_of_the_broadcast(spark):
    table = spark.createDataFrame([("a", 5, "x" * 40_000), ("b", 1, "y")], "k string, uses long, text string")
    facts = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    found = {r.k: len(r.text or "") for r in lookup_join(facts, table, ["k"], "uses", ["text"]).collect()}
    assert found == {"a": 40_000, "b": 1, "c": 0}


def test_lookup_join_with_hot_keys(spark):
    facts = log(spark).select("k", "i")
    table = facts.groupBy("k").agg(F.count("*").alias("uses"), F.max("i").alias("top")).filter("k <> 'k3'")
    plain = facts.join(table.select("k", "top"), "k", "left")
    for hot_keys in (1, 5, 1000):
        assert lookup_join(facts, table, ["k"], "uses", ["top"], hot_keys).exceptAll(plain).count() == 0


def test_hash_draws(spark):
    df = spark.range(20000).select(
        uniform(1, "u", F.col("id")).alias("u"), normal(1, "n", F.col("id")).alias("n"), laplace(1, "l", F.col("id")).alias("l"))
    row = df.agg(F.min("u"), F.max("u"), F.avg("u"), F.avg("n"), F.stddev("n"), F.avg("l"), F.avg(F.abs("l"))).first()
    assert row[0] > 0 and row[1] < 1 and abs(row[2] - 0.5) < 0.01
    assert abs(row[3]) < 0.03 and abs(row[4] - 1) < 0.03 and abs(row[5]) < 0.04 and abs(row[6] - 1) < 0.04


def test_inverse_normal(spark):
    from statistics import NormalDist

    p = [1e-9, 0.001, 0.02, 0.3, 0.5, 0.9, 0.99, 1 - 1e-9]
    got = [r.z for r in spark.createDataFrame([(x,) for x in p], "p double").select(inverse_normal(F.col("p")).alias("z")).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(x) for x in p], abs=1e-6)
    assert spark.range(1).select(inverse_normal(F.lit(0.0)).alias("z")).first().z is None
