"""Anonymity checks on ``orders`` and leakage between ``customer`` and a shifted copy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabguard.operators import anonymity, leakage
from workload.catalog import query, table

QI = ["o_orderstatus", "o_orderpriority", "o_year", "o_month"]
SENSITIVE = ["price_band", "customer_band"]

# Every 7th order lacks its status; the price band of every 11th order is unknown.
ORDERS_SQL = """
WITH o AS (
  SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
         o_orderpriority, CAST(year(o_orderdate) AS INT) AS o_year, CAST(month(o_orderdate) AS INT) AS o_month,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL
              ELSE CAST(CAST(floor(o_totalprice / 50000) AS BIGINT) AS VARCHAR) END AS price_band,
         CAST(o_custkey % 13 AS VARCHAR) AS customer_band
  FROM orders)
"""


def orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        "o_orderpriority",
        F.year("o_orderdate").alias("o_year"),
        F.month("o_orderdate").alias("o_month"),
        F.when(F.col("o_orderkey") % 11 != 0, F.floor(F.col("o_totalprice") / 50000).cast("string")).alias("price_band"),
        (F.col("o_custkey") % 13).cast("string").alias("customer_band"),
    )


def rounded(df, *names, places=6):
    for name in names:
        df = df.withColumn(name, F.round(name, places))
    return df


K_SQL = """
, g AS (SELECT o_orderstatus, o_orderpriority, o_year, o_month, count(*) AS n FROM o
        WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL AND o_year IS NOT NULL AND o_month IS NOT NULL
        GROUP BY ALL)
, kk AS (SELECT count(*) AS total_groups, count(*) FILTER (n < {k}) AS violating_groups,
            min(n) AS smallest_group_size, CAST(coalesce(sum(n) FILTER (n < {k}), 0) AS BIGINT) AS records_at_risk,
            (SELECT count(*) FROM o) AS total_records FROM g)
"""


@query(ORDERS_SQL + K_SQL.format(k=12) + """
SELECT violating_groups = 0 AS satisfies_k_anonymity, 12 AS k, total_groups, violating_groups, smallest_group_size,
       records_at_risk, total_records,
       round((total_records - records_at_risk) * 100.0::DOUBLE / total_records, 6) AS k_anonymity_score
FROM kk
""")
def k_anonymity_summary(spark, sf_dir):
    return rounded(anonymity.k_anonymity(orders(spark, sf_dir), QI, k=12), "k_anonymity_score")


@query(ORDERS_SQL + """
SELECT count(*) = 0 OR min(n) >= 3 AS satisfies_k_anonymity, 3 AS k, count(*) AS total_groups,
       count(*) FILTER (n < 3) AS violating_groups, min(n) AS smallest_group_size,
       CAST(coalesce(sum(n) FILTER (n < 3), 0) AS BIGINT) AS records_at_risk, CAST(sum(n) AS BIGINT) AS total_records,
       round((sum(n) - coalesce(sum(n) FILTER (n < 3), 0)) * 100.0::DOUBLE / sum(n), 6) AS k_anonymity_score
FROM (SELECT o_orderstatus, o_orderpriority, o_year, o_month, count(*) AS n FROM o GROUP BY ALL)
""")
def k_anonymity_null_group(spark, sf_dir):
    return rounded(anonymity.k_anonymity(orders(spark, sf_dir), QI, k=3, null_group=True), "k_anonymity_score")


@query(ORDERS_SQL + """
SELECT o_orderstatus, o_orderpriority, o_year, o_month, count(*) AS group_size,
       CASE WHEN count(*) = 1 THEN 'CRITICAL' ELSE 'HIGH' END AS risk_level
FROM o WHERE o_orderstatus IS NOT NULL GROUP BY ALL HAVING count(*) < 25
ORDER BY o_orderstatus, o_orderpriority, o_year, o_month LIMIT 10
""")
def k_anonymity_violating_groups(spark, sf_dir):
    return anonymity.k_anonymity_violations(orders(spark, sf_dir), QI, k=25, top=10)


LONG_SQL = """
, s AS (SELECT 'price_band' AS attribute, o_orderstatus, o_orderpriority, o_year, o_month, price_band AS v FROM o
        UNION ALL
        SELECT 'customer_band', o_orderstatus, o_orderpriority, o_year, o_month, customer_band FROM o)
"""


@query(ORDERS_SQL + LONG_SQL + """
, d AS (SELECT attribute, count(DISTINCT v) AS dv, count(v) AS cv FROM s WHERE o_orderstatus IS NOT NULL
        GROUP BY attribute, o_orderstatus, o_orderpriority, o_year, o_month)
SELECT attribute, count(*) FILTER (dv < 8) = 0 AS satisfies_l_diversity, 8 AS l, count(*) AS total_groups,
       count(*) FILTER (dv < 8) AS violating_groups, CAST(coalesce(sum(cv) FILTER (dv < 8), 0) AS BIGINT) AS records_at_risk,
       round(((SELECT count(*) FROM o) - coalesce(sum(cv) FILTER (dv < 8), 0)) * 100.0::DOUBLE / (SELECT count(*) FROM o), 6)
         AS diversity_score
FROM d GROUP BY attribute
""")
def l_diversity_by_attribute(spark, sf_dir):
    return rounded(anonymity.l_diversity(orders(spark, sf_dir), QI, SENSITIVE, l=8), "diversity_score")


TV_SQL = """
, p AS (SELECT attribute, v, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY attribute) AS p
        FROM s WHERE v IS NOT NULL GROUP BY attribute, v)
, gs AS (SELECT attribute, o_orderstatus, o_orderpriority, o_year, o_month, count(v) AS ng FROM s
         WHERE o_orderstatus IS NOT NULL GROUP BY ALL)
, gv AS (SELECT attribute, o_orderstatus, o_orderpriority, o_year, o_month, v, count(*) AS n FROM s
         WHERE o_orderstatus IS NOT NULL AND v IS NOT NULL GROUP BY ALL)
, tv AS (SELECT gs.attribute, gs.o_orderstatus, gs.o_orderpriority, gs.o_year, gs.o_month,
            sum(abs(p.p - CASE WHEN ng = 0 THEN 0 ELSE coalesce(gv.n, 0)::DOUBLE / ng END)) / 2 AS distance
         FROM gs JOIN p ON p.attribute = gs.attribute
         LEFT JOIN gv ON gv.attribute = gs.attribute AND gv.v = p.v AND gv.o_orderstatus = gs.o_orderstatus
              AND gv.o_orderpriority = gs.o_orderpriority AND gv.o_year = gs.o_year AND gv.o_month = gs.o_month
         GROUP BY ALL)
"""


@query(ORDERS_SQL + LONG_SQL + TV_SQL + """
SELECT attribute, o_orderstatus, o_orderpriority, o_year, o_month, round(distance, 8) AS distance,
       distance > 0.35 AS violates
FROM tv
""")
def t_closeness_by_group(spark, sf_dir):
    return rounded(anonymity.t_closeness_groups(orders(spark, sf_dir), QI, SENSITIVE, t=0.35), "distance", places=8)


@query(ORDERS_SQL + LONG_SQL + TV_SQL + """
SELECT attribute, count(*) FILTER (distance > 0.35) = 0 AS satisfies_t_closeness, CAST(0.35 AS DOUBLE) AS t,
       count(*) AS total_groups,
       count(*) FILTER (distance > 0.35) AS violating_groups, round(max(distance), 6) AS max_distance,
       round(avg(distance), 6) AS avg_distance
FROM tv GROUP BY attribute
""")
def t_closeness_by_attribute(spark, sf_dir):
    return rounded(anonymity.t_closeness(orders(spark, sf_dir), QI, SENSITIVE, t=0.35), "max_distance", "avg_distance")


@query(ORDERS_SQL + LONG_SQL + K_SQL.format(k=3) + TV_SQL + """
, checks AS (
  SELECT (SELECT violating_groups = 0 FROM kk) AS k_ok,
         (SELECT coalesce(min(dv), 2) >= 2 FROM (
            SELECT count(DISTINCT v) AS dv FROM s WHERE o_orderstatus IS NOT NULL
            GROUP BY attribute, o_orderstatus, o_orderpriority, o_year, o_month)) AS l_ok,
         (SELECT count(*) FILTER (distance > 0.2) = 0 FROM tv) AS t_ok)
, m AS (SELECT *, CAST(k_ok AS INT) + CAST(l_ok AS INT) + CAST(t_ok AS INT) AS metrics_satisfied FROM checks)
SELECT k_ok AS satisfies_k_anonymity, l_ok AS satisfies_l_diversity, t_ok AS satisfies_t_closeness, metrics_satisfied,
       CASE metrics_satisfied WHEN 3 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level,
       CASE metrics_satisfied WHEN 3 THEN 'All three checks hold: fit for release under the usual agreements'
            WHEN 2 THEN 'One check fails: look at the groups listed before any release'
            WHEN 1 THEN 'Two checks fail: coarsen the identifying columns or synthesise again'
            ELSE 'No check holds: keep the table inside' END AS recommendation
FROM m
""")
def privacy_audit(spark, sf_dir):
    return anonymity.privacy_audit(orders(spark, sf_dir), QI, SENSITIVE)


# Synthetic copy: balances of four out of five customers are shifted; every 6th segment is unknown.
PAIR_SQL = """
WITH r AS (SELECT c_nationkey, c_acctbal, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
           FROM customer),
     y AS (SELECT c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal
                ELSE c_acctbal + ((c_custkey * 37) % 101 - 50) END AS c_acctbal,
                CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
           FROM customer)
"""


def customer_pair(spark, sf_dir):
    base = table(spark, sf_dir, "customer")
    segment = F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")).alias("c_mktsegment")
    shifted = F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal")).otherwise(
        F.col("c_acctbal") + ((F.col("c_custkey") * 37) % 101 - 50)
    )
    return (
        base.select("c_nationkey", "c_acctbal", segment),
        base.select("c_nationkey", shifted.alias("c_acctbal"), segment),
    )


@query(PAIR_SQL + """
SELECT (SELECT count(*) FROM r) AS total_real_rows, (SELECT count(*) FROM y) AS total_synthetic_rows,
       (SELECT count(*) FROM (SELECT * FROM r WHERE c_mktsegment IS NOT NULL INTERSECT SELECT * FROM y)) AS leaked_rows,
       round((SELECT count(*) FROM (SELECT * FROM r WHERE c_mktsegment IS NOT NULL INTERSECT SELECT * FROM y)) * 100.0::DOUBLE
         / (SELECT count(*) FROM (SELECT DISTINCT * FROM r)), 6) AS leaked_percentage
""")
def exact_row_leakage(spark, sf_dir):
    return rounded(leakage.exact_leakage(*customer_pair(spark, sf_dir)), "leaked_percentage")


@query(PAIR_SQL + """
SELECT (SELECT count(*) FROM r) AS total_real_rows, (SELECT count(*) FROM y) AS total_synthetic_rows,
       (SELECT count(*) FROM (SELECT * FROM r INTERSECT SELECT * FROM y)) AS leaked_rows,
       round((SELECT count(*) FROM (SELECT * FROM r INTERSECT SELECT * FROM y)) * 100.0::DOUBLE
         / (SELECT count(*) FROM (SELECT DISTINCT * FROM r)), 6) AS leaked_percentage
""")
def exact_row_leakage_null_matches(spark, sf_dir):
    return rounded(leakage.exact_leakage(*customer_pair(spark, sf_dir), null_matches=True), "leaked_percentage")
