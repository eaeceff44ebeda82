"""Fidelity of a shifted copy against the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabguard.operators import fidelity, ks, top_values, wide_correlation
from workload.catalog import query, table
from workload.disclosure import rounded

PAIR_SQL = """
WITH r AS (SELECT l_quantity, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
                  l_discount, CAST(7 AS INT) AS fixed, l_returnflag, l_linestatus
           FROM lineitem),
     y AS (SELECT l_quantity, CASE WHEN l_partkey % 5 = 0 THEN l_extendedprice
                ELSE l_extendedprice + ((l_partkey * 37) % 101 - 50) * 100 END AS l_extendedprice,
                  l_discount / 2 AS l_discount, CAST(7 AS INT) AS fixed,
                  CASE WHEN l_partkey % 4 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag, l_linestatus
           FROM lineitem)
"""
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "fixed"]


def pair(spark, sf_dir):
    base = table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey")
    real = base.select(
        "l_quantity", F.when(F.col("l_orderkey") % 9 != 0, F.col("l_extendedprice")).alias("l_extendedprice"),
        "l_discount", F.lit(7).alias("fixed"), "l_returnflag", "l_linestatus",
    )
    shifted = F.when(part % 5 == 0, F.col("l_extendedprice")).otherwise(F.col("l_extendedprice") + ((part * 37) % 101 - 50) * 100)
    synth = base.select(
        "l_quantity", shifted.alias("l_extendedprice"), (F.col("l_discount") / 2).alias("l_discount"), F.lit(7).alias("fixed"),
        F.when(part % 4 == 0, "X").otherwise(F.col("l_returnflag")).alias("l_returnflag"), "l_linestatus",
    )
    return real, synth


def union(parts):
    return "\nUNION ALL ".join(parts)


@query(PAIR_SQL + union(
    f"""SELECT '{n}' AS "column", '' AS unit, round(avg(y.{n}), 4) AS mean, round(stddev_samp(y.{n}), 4) AS std, min(y.{n})::DOUBLE AS min,
    round(quantile_cont(y.{n}::DOUBLE, 0.25), 4) AS p25, round(quantile_cont(y.{n}::DOUBLE, 0.5), 4) AS p50,
    round(quantile_cont(y.{n}::DOUBLE, 0.75), 4) AS p75, max(y.{n})::DOUBLE AS max,
    (SELECT round(avg({n}), 4) FROM r) AS real_mean, (SELECT round(stddev_samp({n}), 4) FROM r) AS real_std FROM y"""
    for n in NUMBERS
))
def numeric_summary(spark, sf_dir):
    return rounded(fidelity.numeric_summary(*pair(spark, sf_dir)), "mean", "std", "p25", "p50", "p75", "real_mean", "real_std", places=4)


CATEGORY_SQL = """
, v AS ({parts})
, n AS (SELECT side, "column", value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL)
, t AS (SELECT side, "column", sum(n) AS total, count(*) AS distinct_values FROM n GROUP BY ALL)
SELECT side, "column", CAST(row_number() OVER (PARTITION BY side, "column" ORDER BY n DESC, value) AS INT) AS rank, value,
       round(CAST(n * 100.0::DOUBLE / total AS DECIMAL(18, 8)), 2)::DOUBLE AS percentage, distinct_values
FROM n JOIN t USING (side, "column")
QUALIFY row_number() OVER (PARTITION BY side, "column" ORDER BY n DESC, value) <= 5
"""


@query(PAIR_SQL + CATEGORY_SQL.format(parts=union(
    f"SELECT '{side}' AS side, '{n}' AS \"column\", {n} AS value FROM {t}"
    for side, t in (("real", "r"), ("synth", "y")) for n in ("l_returnflag", "l_linestatus")
)))
def categorical_summary(spark, sf_dir):
    return fidelity.categorical_summary(*pair(spark, sf_dir))


@query("""
WITH r AS (SELECT p_name, p_brand, p_type FROM part),
     y AS (SELECT p_name, 'Brand#' || CAST(p_size AS VARCHAR) AS p_brand, p_type FROM part)
""" + CATEGORY_SQL.format(parts=union(
    f"SELECT '{side}' AS side, '{n}' AS \"column\", {n} AS value FROM {t}"
    for side, t in (("real", "r"), ("synth", "y")) for n in ("p_name", "p_brand", "p_type")
)))
def categorical_summary_many_values(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return fidelity.categorical_summary(
        part.select("p_name", "p_brand", "p_type"),
        part.select("p_name", F.concat(F.lit("Brand#"), F.col("p_size").cast("string")).alias("p_brand"), "p_type"),
    )


TOP_SQL = """
WITH v AS ({parts})
, n AS (SELECT "column", value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL)
, t AS (SELECT "column", sum(n) AS total FROM n GROUP BY ALL)
SELECT "column", CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INT) AS rank, value, n,
       round(CAST(n * 100.0::DOUBLE / total AS DECIMAL(18, 8)), 2)::DOUBLE AS percentage
FROM n JOIN t USING ("column")
QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) <= 5
"""


@query(TOP_SQL.format(parts="""
SELECT 'visit' AS "column", CASE WHEN user_id % 4 = 0 THEN 'user ' || (user_id % 40) ELSE event_type || ' ' || event_id END AS value FROM events
UNION ALL SELECT 'event_type', event_type FROM events
UNION ALL SELECT 'props', props FROM events"""))
def top_values_of_events(spark, sf_dir):
    """A column that is unique but for some users, one of few values, and JSON texts."""
    user = F.col("user_id")
    visit = F.when(user % 4 == 0, F.concat(F.lit("user "), (user % 40).cast("string"))).otherwise(F.concat_ws(" ", "event_type", "event_id"))
    return top_values.top_values(table(spark, sf_dir, "events").select(visit.alias("visit"), "event_type", "props")).drop("rounds")


@query(PAIR_SQL + """
, v AS (""" + union(
    f"SELECT '{side}' AS side, '{n}' AS \"column\", {n}::DOUBLE AS x FROM {t}"
    for side, t in (("real", "r"), ("synth", "y")) for n in NUMBERS
) + """)
, b AS (SELECT "column", min(x) AS lo, max(x) AS hi FROM v GROUP BY 1)
, h AS (SELECT side, v."column", CAST(least(floor((x - lo) * 30.0::DOUBLE / CASE WHEN hi = lo THEN 1 ELSE hi - lo END) + 1, 30) AS INT) AS bin, count(*) AS n
        FROM v JOIN b ON v."column" = b."column" WHERE x IS NOT NULL GROUP BY ALL)
SELECT s.side, b."column", CAST(g.bin AS INT) AS bin, round(lo + (hi - lo) * (g.bin - 1) / 30, 4) AS low,
       round(lo + (hi - lo) * g.bin / 30, 4) AS high, coalesce(h.n, 0) AS n
FROM b, range(1, 31) AS g(bin), (VALUES ('real'), ('synth')) AS s(side)
LEFT JOIN h ON h.side = s.side AND h."column" = b."column" AND h.bin = g.bin
""")
def histogram(spark, sf_dir):
    return rounded(fidelity.histogram(*pair(spark, sf_dir)), "low", "high", places=4)


PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1:]]


def sql_corr(a, b, t):
    if "fixed" in (a, b):
        return "CAST(NULL AS DOUBLE)"
    return f"(SELECT round(corr({a}, {b}), 6) FROM {t})"


@query(PAIR_SQL + ", m AS (" + union(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {sql_corr(a, b, 'r')} AS real_corr, {sql_corr(a, b, 'y')} AS synth_corr" for a, b in PAIRS
) + ") SELECT *, round(abs(real_corr - synth_corr), 5) AS diff FROM m")
def correlation_difference(spark, sf_dir):
    found = rounded(fidelity.correlation(*pair(spark, sf_dir)), "real_corr", "synth_corr")
    return found.withColumn("diff", F.round(F.abs(F.col("real_corr") - F.col("synth_corr")), 5))


MATRIX = ["l_quantity", "l_extendedprice", "l_discount"]


@query(PAIR_SQL + union(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, (SELECT round(corr({a}, {b}), 6) FROM r) AS corr" for a in MATRIX for b in MATRIX
))
def correlation_matrix(spark, sf_dir):
    return rounded(fidelity.correlation_matrix(pair(spark, sf_dir)[0].select(*MATRIX)), "corr")


WIDE_SQL = """
WITH p AS (SELECT i, j FROM range(1, 65) a(i), range(1, 65) b(j) WHERE i < j)
, v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN x > 0.1 THEN NULL ELSE x::DOUBLE END) AS r,
               list_transform(embedding, lambda x: x::DOUBLE * label) AS y FROM embeddings)
, m AS (SELECT i, j, corr(r[i], r[j]) AS r, corr(y[i], y[j]) AS y FROM v, p GROUP BY i, j)
SELECT 'e' || (i - 1) AS col_a, 'e' || (j - 1) AS col_b, round(r, 6) AS real_corr, round(y, 6) AS synth_corr, round(abs(r - y), 5) AS diff FROM m
"""


@query(WIDE_SQL)
def correlation_wide(spark, sf_dir):
    """64 columns with missing values against a scaled copy, in blocks of 16 columns and more than one scan."""
    vectors = table(spark, sf_dir, "embeddings")
    values = [F.col("embedding")[i] for i in range(64)]
    real = vectors.select(*[F.when(~(v > 0.1), v.cast("double")).alias(f"e{i}") for i, v in enumerate(values)])
    synth = vectors.select(*[(v.cast("double") * F.col("label")).alias(f"e{i}") for i, v in enumerate(values)])
    found = wide_correlation.wide_correlation_difference(real, synth, block=16, most_bytes=8 * 16 * 16 * 8 * 6)
    return rounded(found.withColumn("diff", F.round("diff", 5)), "real_corr", "synth_corr")


KS_SQL = PAIR_SQL + """
, v AS (""" + union(
    f"SELECT '{n}' AS \"column\", {n}::DOUBLE AS x, {a} AS a, {b} AS b FROM {t}"
    for n in NUMBERS for t, a, b in (("r", 1, 0), ("y", 0, 1))
) + """)
, g AS (SELECT "column", x, sum(a) AS a, sum(b) AS b FROM v WHERE x IS NOT NULL GROUP BY ALL)
, c AS (SELECT "column", sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY "column") AS na,
          sum(b) OVER (PARTITION BY "column") AS nb FROM g WINDOW w AS (PARTITION BY "column" ORDER BY x))
, d AS (SELECT "column", max(abs(ca::DOUBLE / na - cb::DOUBLE / nb)) AS d, max(na)::DOUBLE AS na, max(nb)::DOUBLE AS nb FROM c GROUP BY 1)
, l AS (SELECT *, d * sqrt(na * nb / (na + nb)) AS l FROM d)
, p AS (SELECT "column", d, CASE WHEN l < 0.2 THEN 1.0 ELSE greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101),
          lambda j: CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0::DOUBLE * j * j * l * l))))) END AS p FROM l)
SELECT "column", round(d, 4) AS ks_statistic, round(p, 4)::DOUBLE AS p_value, p > 0.05 AS similar FROM p
"""


@query(KS_SQL)
def ks_test(spark, sf_dir):
    return ks.ks_test(*pair(spark, sf_dir))


@query(KS_SQL.replace("FROM p\n", "FROM p WHERE \"column\" <> 'l_discount'\n") + " UNION ALL SELECT 'l_discount', NULL, NULL, NULL")
def ks_test_absent_column(spark, sf_dir):
    real, synth = pair(spark, sf_dir)
    return ks.ks_test(real, synth.drop("l_discount"))


EXACT_SQL = """
WITH RECURSIVE v AS (SELECT c_acctbal AS x, 1 AS a, 0 AS b FROM customer UNION ALL SELECT s_acctbal, 0, 1 FROM supplier)
, g AS (SELECT x, sum(a) AS a, sum(b) AS b FROM v WHERE x IS NOT NULL GROUP BY x)
, c AS (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS n, sum(b) OVER () AS m FROM g WINDOW w AS (ORDER BY x))
, d AS (SELECT max(abs(ca::DOUBLE / n - cb::DOUBLE / m)) AS d, CAST(max(abs(ca * m - cb * n)) AS BIGINT) AS gap,
               CAST(max(n) AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS m FROM c)
, walk AS (
    SELECT 0::BIGINT AS step, list_transform(range(0, m + 1), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS chance,
           0.0::DOUBLE AS strayed, n, m, gap FROM d
    UNION ALL
    SELECT step + 1, list_transform(range(0, m + 1), lambda i: CASE WHEN abs(i * n - (step + 1 - i) * m) >= gap THEN 0.0::DOUBLE ELSE moved[i + 1] END),
           strayed + list_sum(list_transform(range(0, m + 1), lambda i: CASE WHEN abs(i * n - (step + 1 - i) * m) >= gap THEN moved[i + 1] ELSE 0.0::DOUBLE END)),
           n, m, gap
    FROM (SELECT *, list_transform(range(0, m + 1), lambda i:
              chance[i + 1] * greatest(n - (step - i), 0) / (n + m - step)
              + CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE chance[i] * (m - (i - 1)) / (n + m - step) END) AS moved
          FROM walk WHERE step < n + m))
SELECT 'balance' AS "column", round(d, 4) AS ks_statistic, round(strayed, 4) AS p_value, strayed > 0.05 AS similar, true AS exact
FROM walk, d WHERE step = d.n + d.m
"""


@query(EXACT_SQL)
def ks_exact(spark, sf_dir):
    """Balances of customers against those of suppliers: few enough suppliers for the paths to be counted."""
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return ks.ks_exact(customers.select(F.col("c_acctbal").alias("balance")), suppliers.select(F.col("s_acctbal").alias("balance")))


FLIP_SQL = """
WITH s AS (SELECT CASE WHEN c_mktsegment = 'FURNITURE' THEN 'A' WHEN c_custkey % 50 = 1 THEN NULL ELSE 'B' END AS grp, c_nationkey,
                  c_acctbal * CASE WHEN c_mktsegment = 'FURNITURE' THEN 2 ELSE 1 END AS c_acctbal, c_custkey FROM customer)
, g AS (""" + union(
    f"""SELECT '{n}' AS "column", (SELECT count(*) FROM s WHERE grp = 'A') AS ca, (SELECT count(*) FROM s WHERE grp = 'B') AS cb,
    avg({n}) FILTER (grp = 'A') AS ma, avg({n}) FILTER (grp = 'B') AS mb, stddev_samp({n}) FILTER (grp = 'A') AS sa,
    stddev_samp({n}) FILTER (grp = 'B') AS sb FROM s""" for n in ("c_nationkey", "c_acctbal", "c_custkey")
) + ")"


def groups(spark, sf_dir):
    furniture = F.col("c_mktsegment") == "FURNITURE"
    return table(spark, sf_dir, "customer").select(
        F.when(furniture, "A").when(F.col("c_custkey") % 50 != 1, "B").alias("grp"), "c_nationkey",
        (F.col("c_acctbal") * F.when(furniture, 2).otherwise(1)).alias("c_acctbal"), "c_custkey",
    )


@query(FLIP_SQL + """
SELECT "column", 'A' AS group_a_value, ca AS group_a_count, 'B' AS group_b_value, cb AS group_b_count,
       round(ma, 2) AS group_a_mean, round(mb, 2) AS group_b_mean, round(abs(ma - mb), 2) AS mean_diff, round(sa, 2) AS group_a_std,
       round(sb, 2) AS group_b_std, round(abs(sa - sb), 2) AS std_diff,
       round(CASE WHEN ma = 0 THEN 0 ELSE abs(ma - mb) * 100 / abs(ma) END, 2) AS diff_percentage,
       CASE WHEN ma = 0 THEN FALSE ELSE abs(ma - mb) * 100 / abs(ma) > 20 END AS biased
FROM g
""")
def flip_test(spark, sf_dir):
    return fidelity.flip_test(groups(spark, sf_dir), "grp")


@query(FLIP_SQL + """
, b AS (SELECT CASE WHEN ma = 0 THEN FALSE ELSE abs(ma - mb) * 100 / abs(ma) > 20 END AS biased FROM g)
SELECT count(*) AS columns, count(*) FILTER (biased) AS total_biased_columns,
       round((count(*) - count(*) FILTER (biased)) * 100.0::DOUBLE / count(*), 2) AS fairness_score FROM b
""")
def fairness_score(spark, sf_dir):
    return fidelity.fairness_score(fidelity.flip_test(groups(spark, sf_dir), "grp"))
