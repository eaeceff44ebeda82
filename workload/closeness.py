"""Distance to the closest record, on parts and on line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabguard.operators import closest, closest_approximate
from tabguard.session import shuffle_files_removed, write_and_reread
from workload.catalog import query, table

PARTS_SQL = """
WITH r AS (SELECT p_size::DOUBLE AS a, p_retailprice AS b FROM part),
     y AS (SELECT p_partkey, (CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size + p_partkey % 3 END)::DOUBLE AS a,
                  p_retailprice + (p_partkey * 37) % 101 - 50.25 AS b FROM part),
     m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM r),
     rz AS (SELECT DISTINCT (a - ma) / sa AS a, (b - mb) / sb AS b FROM r, m),
     yz AS (SELECT p_partkey, (a - ma) / sa AS a, (b - mb) / sb AS b FROM y, m WHERE y.a IS NOT NULL),
     d AS (SELECT p_partkey, min(sqrt((yz.a - rz.a) * (yz.a - rz.a) + (yz.b - rz.b) * (yz.b - rz.b))) AS distance
           FROM yz, rz GROUP BY p_partkey)
"""
ORDERS_SQL = """
WITH o AS (SELECT o_orderkey, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS day, o_totalprice::DOUBLE AS price FROM orders),
     r AS (SELECT day::DOUBLE AS a, price AS b FROM o),
     y AS (SELECT o_orderkey AS p_partkey, (day + o_orderkey % 3)::DOUBLE AS a, price + (o_orderkey * 37) % 101 - 50.25 AS b FROM o),
     m AS""" + PARTS_SQL.split("m AS", 1)[1]
REPORT_SQL = """
SELECT round(min(distance), 4) AS min_distance, round(avg(distance), 4) AS mean_distance, round(max(distance), 4) AS max_distance,
       round(median(distance), 4) AS median_distance, round(least(100, avg(distance) * 20), 2) AS privacy_risk_score,
       round(least(100, avg(distance) * 20), 2) AS privacy_score,
       round(count(*) FILTER (distance < 0.05) * 100.0::DOUBLE / count(*), 2) AS too_close_percentage,
       count(*) FILTER (distance < 0.05) AS close_records, count(*) AS total_records, CAST(0.05 AS DOUBLE) AS threshold
FROM d
"""


def parts(spark, sf_dir):
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    return (
        part.select("p_size", "p_retailprice"),
        part.select("p_partkey", F.when(key % 11 != 0, F.col("p_size") + key % 3).alias("p_size"),
                    (F.col("p_retailprice") + (key * 37) % 101 - 50.25).alias("p_retailprice")),
    )


@query(PARTS_SQL + REPORT_SQL)
def closest_record_report(spark, sf_dir):
    return closest.closest_record_report(*parts(spark, sf_dir), threshold=0.05)


@query(PARTS_SQL + REPORT_SQL)
def closest_record_report_by_cells(spark, sf_dir):
    """Same result through the cell search that serves real tables too large to broadcast."""
    return closest.closest_record_report(*parts(spark, sf_dir), threshold=0.05, broadcast_bytes=64, group_points=500)


@query(PARTS_SQL + "SELECT p_partkey, round(distance, 6) AS distance FROM d")
def closest_record_rows(spark, sf_dir):
    return closest.closest_record_rows(*parts(spark, sf_dir), key=["p_partkey"]).withColumn("distance", F.round("distance", 6))


@query(ORDERS_SQL + REPORT_SQL)
def closest_record_orders(spark, sf_dir):
    """Every order against every order through the cell search, in two dimensions."""
    order, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    real = order.select(F.col("o_totalprice").alias("p_retailprice"), day.cast("double").alias("p_size"))
    synth = order.select((F.col("o_totalprice") + (key * 37) % 101 - 50.25).alias("p_retailprice"), (day + key % 3).cast("double").alias("p_size"))
    return closest.closest_record_report(real, synth, threshold=0.05, broadcast_bytes=64, group_points=2000)


@query()
def closest_record_lineitem(spark, sf_dir):
    """Four columns of every line item against every line item (SQL would compare all pairs)."""
    items = table(spark, sf_dir, "lineitem")
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    shifted = items.select(
        "l_quantity", (F.col("l_extendedprice") + (F.col("l_partkey") * 37) % 101 - 50).alias("l_extendedprice"), "l_discount", "l_tax"
    )
    return closest.closest_record_report(items.select(*columns), shifted)


@query()
def closest_record_approximate(spark, sf_dir):
    """Twelve columns of every line item and its part against a perturbed copy, approximately, with the measured recall."""
    items, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    wide = items.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "p_size", "p_retailprice"
    )
    # Joined once: both sides are read several times.
    with shuffle_files_removed(spark):
        wide = write_and_reread(wide, "wide")
    price = F.col("l_extendedprice")
    columns = {
        "quantity": F.col("l_quantity"), "price": price, "discount": F.col("l_discount"), "tax": F.col("l_tax"),
        "size": F.col("p_size").cast("double"), "retail": F.col("p_retailprice"), "line": F.col("l_linenumber").cast("double"),
        "day": F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double"),
        "part": F.col("l_partkey").cast("double"), "supplier": F.col("l_suppkey").cast("double"),
        "net": price * (1 - F.col("l_discount")), "order": F.col("l_orderkey").cast("double"),
    }
    real = wide.select(*[x.alias(n) for n, x in columns.items()])
    moved = {"price": price * (1 + F.col("l_partkey") % 7 / 100.0), "day": columns["day"] + F.col("l_orderkey") % 5}
    synth = wide.select(*[moved.get(n, x).alias(n) for n, x in columns.items()])
    return closest_approximate.approximate_record_report(real, synth)
