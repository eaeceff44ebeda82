"""Sources, sinks, cleaning and column detection over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabguard.operators import cleaning, detection
from tabguard.session import scratch_path
from tabguard.sources import loader, sinks
from workload.catalog import query, table

# ------------------------------------------------------------------ sources and sinks


@query("""
SELECT 'l_orderkey' AS "column", 'bigint' AS dtype, count(*) AS rows, 0::BIGINT AS missing, count(*) * 8 AS bytes FROM lineitem
UNION ALL SELECT 'l_partkey', 'bigint', count(*), 0, count(*) * 8 FROM lineitem
UNION ALL SELECT 'l_suppkey', 'bigint', count(*), 0, count(*) * 8 FROM lineitem
UNION ALL SELECT 'l_linenumber', 'int', count(*), 0, count(*) * 4 FROM lineitem
UNION ALL SELECT 'l_quantity', 'double', count(*), 0, count(*) * 8 FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'double', count(*), 0, count(*) * 8 FROM lineitem
UNION ALL SELECT 'l_discount', 'double', count(*), 0, count(*) * 8 FROM lineitem
UNION ALL SELECT 'l_tax', 'double', count(*), 0, count(*) * 8 FROM lineitem
UNION ALL SELECT 'l_returnflag', 'string', count(*), 0, CAST(sum(strlen(l_returnflag)) AS BIGINT) FROM lineitem
UNION ALL SELECT 'l_linestatus', 'string', count(*), 0, CAST(sum(strlen(l_linestatus)) AS BIGINT) FROM lineitem
UNION ALL SELECT 'l_shipdate', 'timestamp_ntz', count(*), 0, count(*) * 8 FROM lineitem
""")
def load_parquet_profile(spark, sf_dir):
    return loader.column_profile(loader.load_table(spark, f"{sf_dir}/lineitem.parquet"))


@query("""
SELECT 'bigint' AS dtype, 2::BIGINT AS columns, count(*) AS rows, count(*) * 16 AS bytes FROM orders
UNION ALL SELECT 'string', 2, count(*), CAST(sum(strlen(o_orderstatus) + strlen(o_orderpriority)) AS BIGINT) FROM orders
UNION ALL SELECT 'double', 1, count(*), count(*) * 8 FROM orders
UNION ALL SELECT 'timestamp_ntz', 1, count(*), count(*) * 8 FROM orders
""")
def load_type_histogram(spark, sf_dir):
    return loader.type_histogram(loader.column_profile(loader.load_table(spark, f"{sf_dir}/orders.parquet")))


@query("SELECT c_custkey::BIGINT AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def load_csv_compressed(spark, sf_dir):
    path = scratch_path(spark, "customer") + ".csv.gz"
    table(spark, sf_dir, "customer").write.csv(path, header=True, compression="gzip")
    return loader.load_table(spark, path)


@query("""SELECT s_suppkey, s_name || ' "' || s_nationkey || '", ' || chr(92) || 'x' AS quoted FROM supplier""")
def load_csv_quotes(spark, sf_dir):
    """Quotes, separators and backslashes inside values survive the sink and the loader."""
    quoted = F.concat("s_name", F.lit(' "'), F.col("s_nationkey").cast("string"), F.lit('", \\x'))
    path = scratch_path(spark, "quotes")
    sinks.write_dataset(table(spark, sf_dir, "supplier").select("s_suppkey", quoted.alias("quoted")), path, "csv")
    return loader.load_csv(spark, path, schema="s_suppkey long, quoted string")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def load_json_lines(spark, sf_dir):
    path = scratch_path(spark, "supplier") + ".json"
    table(spark, sf_dir, "supplier").write.json(path)
    return loader.load_table(spark, path, lines=True)


# A document that is not line-based is read whole, so each holds one block of 500 keys.
def block():
    return F.floor(F.col("c_custkey") / 500).alias("block")


def write_blocks(blocks, path):
    blocks.select("value", "block").repartition("block").write.partitionBy("block").text(path)


@query("""SELECT c_custkey, c_acctbal, c_mktsegment,
    CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey::BIGINT END AS c_nationkey FROM customer""")
def load_json_records(spark, sf_dir):
    path = scratch_path(spark, "records") + ".json"
    c = table(spark, sf_dir, "customer")
    row = F.to_json(F.struct("c_custkey", "c_acctbal", "c_mktsegment",
                             F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")).alias("c_nationkey")))
    blocks = c.groupBy(block()).agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list(row)), F.lit("]")).alias("value"))
    write_blocks(blocks, path)
    return loader.load_json(spark, path + "/*/*.txt", orient="records").select(
        "c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey"
    )


@query("SELECT c_acctbal, c_custkey, c_mktsegment FROM customer")
def load_json_index(spark, sf_dir):
    path = scratch_path(spark, "index") + ".json"
    c = table(spark, sf_dir, "customer")
    body = F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string"), F.struct("c_custkey", "c_acctbal", "c_mktsegment"))))
    write_blocks(c.groupBy(block()).agg(F.to_json(body).alias("value")), path)
    return loader.load_json(spark, path + "/*/*.txt", orient="index")


@query("SELECT c_acctbal, c_custkey, c_mktsegment FROM customer")
def load_json_columns(spark, sf_dir):
    path = scratch_path(spark, "columns") + ".json"
    c = table(spark, sf_dir, "customer")

    def column(name):
        entry = F.struct(F.col("c_custkey").cast("string"), F.col(name))
        return F.map_from_entries(F.collect_list(entry)).alias(name)

    wide = c.groupBy(block()).agg(column("c_custkey"), column("c_acctbal"), column("c_mktsegment"))
    write_blocks(wide.select(F.to_json(F.struct("c_custkey", "c_acctbal", "c_mktsegment")).alias("value"), "block"), path)
    return loader.load_json(spark, path + "/*/*.txt", orient="columns")


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def load_feather(spark, sf_dir):
    path = scratch_path(spark, "part")

    def write(batches):
        import os
        import uuid

        import pyarrow as pa

        os.makedirs(path, exist_ok=True)
        for batch in batches:
            with pa.OSFile(f"{path}/{uuid.uuid4().hex}.feather", "wb") as sink, pa.ipc.new_file(sink, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows]})

    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice").repartition(4)
    parts.mapInArrow(write, "rows long").agg(F.sum("rows")).collect()
    return loader.load_table(spark, path + "/*.feather", format="feather")


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def dataset_preview(spark, sf_dir):
    return loader.preview(table(spark, sf_dir, "orders"), ["o_orderkey"])


@query("SELECT event_id, user_id, value, event_type AS experiment_id FROM events")
def dataset_sink_partitioned(spark, sf_dir):
    path = scratch_path(spark, "dataset")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.col("event_type").alias("experiment_id"))
    sinks.write_dataset(rows, path, partition_by="experiment_id")
    return spark.read.parquet(path).select("event_id", "user_id", "value", "experiment_id")


@query("SELECT event_id, user_id, value, event_type FROM events")
def dataset_sink_csv(spark, sf_dir):
    path = scratch_path(spark, "dataset-csv")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type")
    sinks.write_dataset(rows, path, format="csv")
    return loader.load_csv(spark, path, schema="event_id bigint, user_id bigint, value double, event_type string")


# ------------------------------------------------------------------ cleaning

DIRTY_SQL = """
WITH base AS (
  SELECT c_custkey % 10 = 0 AS again, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey,
         CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
         CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
         CAST(NULL AS VARCHAR) AS note
  FROM customer),
dirty AS (SELECT c_nationkey, c_acctbal, c_mktsegment, note FROM base
          UNION ALL SELECT c_nationkey, c_acctbal, c_mktsegment, note FROM base WHERE again),
d AS (SELECT DISTINCT * FROM dirty)
"""


def dirty(spark, sf_dir):
    k = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select(
        (k % 10 == 0).alias("again"),
        F.when(k % 7 != 0, F.col("c_nationkey")).alias("c_nationkey"),
        F.when(k % 5 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(k % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
        F.lit(None).cast("string").alias("note"),
    )
    return base.drop("again").unionAll(base.filter("again").drop("again"))


@query(DIRTY_SQL + "SELECT * FROM d")
def drop_duplicate_rows(spark, sf_dir):
    return cleaning.clean_table(dirty(spark, sf_dir), handle_missing=False)


@query(DIRTY_SQL + """SELECT DISTINCT c_nationkey, c_acctbal, c_mktsegment FROM dirty
WHERE c_nationkey IS NOT NULL AND c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL""")
def drop_incomplete_rows(spark, sf_dir):
    return cleaning.clean_table(dirty(spark, sf_dir).drop("note"), missing_strategy="drop")


FILL_SQL = DIRTY_SQL + """
SELECT coalesce(c_nationkey{cast}, (SELECT {nation})) AS c_nationkey, coalesce(c_acctbal, (SELECT {balance})) AS c_acctbal,
       coalesce(c_mktsegment, (SELECT c_mktsegment FROM d WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))
         AS c_mktsegment,
       'Unknown' AS note
FROM d
"""


@query(FILL_SQL.format(cast="::DOUBLE", nation="median(c_nationkey) FROM d", balance="median(c_acctbal) FROM d"))
def impute_median(spark, sf_dir):
    return cleaning.clean_table(dirty(spark, sf_dir))


@query(FILL_SQL.format(cast="::DOUBLE", nation="round(avg(c_nationkey), 6) FROM d", balance="round(avg(c_acctbal), 6) FROM d"))
def impute_mean(spark, sf_dir):
    filled = cleaning.clean_table(dirty(spark, sf_dir), missing_strategy="mean")
    return filled.withColumns({n: F.round(n, 6) for n in ("c_nationkey", "c_acctbal")})


@query(FILL_SQL.format(
    cast="",
    nation="c_nationkey FROM d WHERE c_nationkey IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1",
    balance="c_acctbal FROM d WHERE c_acctbal IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1",
))
def impute_mode(spark, sf_dir):
    return cleaning.clean_table(dirty(spark, sf_dir), missing_strategy="mode")


@query("""
WITH big AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 9007199254740993 + c_nationkey % 4 END AS big FROM customer)
SELECT c_custkey, coalesce(big, (SELECT big FROM big WHERE big IS NOT NULL GROUP BY big ORDER BY count(*) DESC, big LIMIT 1)) AS big FROM big
""")
def impute_mode_long(spark, sf_dir):
    """Whole numbers that a double can't tell apart."""
    big = F.when(F.col("c_custkey") % 5 != 0, F.lit(9007199254740993) + F.col("c_nationkey") % 4)
    return cleaning.clean_table(table(spark, sf_dir, "customer").select("c_custkey", big.alias("big")), missing_strategy="mode")


@query(DIRTY_SQL + """
SELECT 'c_nationkey' AS "column", count(*) FILTER (c_nationkey IS NULL) AS missing FROM dirty
UNION ALL SELECT 'c_acctbal', count(*) FILTER (c_acctbal IS NULL) FROM dirty
UNION ALL SELECT 'c_mktsegment', count(*) FILTER (c_mktsegment IS NULL) FROM dirty
UNION ALL SELECT 'note', count(*) FILTER (note IS NULL) FROM dirty
""")
def missing_value_counts(spark, sf_dir):
    return cleaning.missing_counts(dirty(spark, sf_dir))


# ------------------------------------------------------------------ detection

CODES_SQL = """
WITH p AS (
  SELECT p_partkey,
         CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE
           chr(CAST(65 + p_partkey % 26 AS INT)) || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0')
           || CASE WHEN p_partkey % 4 = 0 THEN '#' ELSE '.' END || CAST(p_partkey % 10 AS VARCHAR) END AS diagnosis,
         p_name AS comment,
         p_size * 2.0::DOUBLE AS "BMI_last", p_retailprice AS fasting_glucose, p_size AS "avg-heart_rate"
  FROM part)
"""


def coded(spark, sf_dir):
    k = F.col("p_partkey")
    code = F.concat(
        F.char(65 + k % 26), F.lpad((k % 100).cast("string"), 2, "0"),
        F.when(k % 4 == 0, "#").otherwise("."), (k % 10).cast("string"),
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.when(k % 9 != 0, code).alias("diagnosis"), F.col("p_name").alias("comment"),
        (F.col("p_size") * 2.0).alias("BMI_last"), F.col("p_retailprice").alias("fasting_glucose"),
        F.col("p_size").alias("avg-heart_rate"),
    )


@query(CODES_SQL + r"""
, share AS (SELECT avg(CASE WHEN regexp_full_match(diagnosis, '[A-Z][0-9][0-9AB](\.[0-9A-K]{1,4})?') THEN 1.0 ELSE 0.0 END) AS s
            FROM p WHERE diagnosis IS NOT NULL)
SELECT 'p_partkey' AS "column", NULL AS rule, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, NULL AS distribution,
       NULL AS unit, FALSE AS is_icd10, CAST(NULL AS DOUBLE) AS icd10_validity
UNION ALL SELECT 'diagnosis', NULL, NULL, NULL, NULL, NULL, s > 0.5, CASE WHEN s > 0.5 THEN round(s * 100, 2) END FROM share
UNION ALL SELECT 'comment', NULL, NULL, NULL, NULL, NULL, FALSE, NULL
UNION ALL SELECT 'BMI_last', 'bmi', 10, 60, 'lognorm', 'kg/m2', FALSE, NULL
UNION ALL SELECT 'fasting_glucose', 'glucose', 0, 600, 'gamma', 'mg/dL', FALSE, NULL
UNION ALL SELECT 'avg-heart_rate', 'heart_rate', 30, 220, 'gaussian', 'bpm', FALSE, NULL
""")
def clinical_column_analysis(spark, sf_dir):
    return detection.analyze_columns(coded(spark, sf_dir))


@query(CODES_SQL + """
, b AS (SELECT 'BMI_last' AS "column", 10.0::DOUBLE AS min, 60.0::DOUBLE AS max, count(*) FILTER ("BMI_last" < 10) AS below_min,
          count(*) FILTER ("BMI_last" > 60) AS above_max, count(*) AS n FROM p
        UNION ALL SELECT 'fasting_glucose', 0, 600, count(*) FILTER (fasting_glucose < 0), count(*) FILTER (fasting_glucose > 600), count(*) FROM p
        UNION ALL SELECT 'avg-heart_rate', 30, 220, count(*) FILTER ("avg-heart_rate" < 30), count(*) FILTER ("avg-heart_rate" > 220), count(*) FROM p)
SELECT "column", min, max, below_min, above_max, below_min + above_max AS violations,
       round((below_min + above_max) * 100.0::DOUBLE / n, 6) AS violation_percentage FROM b
""")
def clinical_bounds_check(spark, sf_dir):
    return detection.clinical_bounds(coded(spark, sf_dir)).withColumn("violation_percentage", F.round("violation_percentage", 6))


@query("""
WITH picked AS (
  SELECT 1 AS seq, 'o_orderkey' AS "column" FROM orders HAVING count(DISTINCT o_orderkey) < 20
  UNION ALL SELECT 2, 'o_custkey' FROM orders HAVING count(DISTINCT o_custkey) < 20
  UNION ALL SELECT 3, 'o_orderstatus'
  UNION ALL SELECT 4, 'o_totalprice' FROM orders HAVING count(DISTINCT o_totalprice) < 20
  UNION ALL SELECT 5, 'o_orderdate' FROM orders HAVING count(DISTINCT o_orderdate) < 20
  UNION ALL SELECT 6, 'o_orderpriority'
  UNION ALL SELECT 7, 'o_year' FROM orders HAVING count(DISTINCT year(o_orderdate)) < 20)
SELECT CAST(row_number() OVER (ORDER BY picked.seq) AS INT) AS position, "column" FROM picked
""")
def quasi_identifier_detection(spark, sf_dir):
    return detection.quasi_identifier_table(table(spark, sf_dir, "orders").withColumn("o_year", F.year("o_orderdate")))


@query("""
SELECT 'c_custkey' AS "column", CASE WHEN count(DISTINCT c_custkey) = count(c_custkey) THEN 'id' ELSE 'numerical' END AS role FROM customer
UNION ALL SELECT 'c_name', CASE WHEN count(DISTINCT c_name) >= 0.95 * count(c_name) THEN 'id' ELSE 'categorical' END FROM customer
UNION ALL SELECT 'c_nationkey', CASE WHEN count(DISTINCT c_nationkey) = count(c_nationkey) THEN 'id' ELSE 'numerical' END FROM customer
UNION ALL SELECT 'c_acctbal', 'numerical'
UNION ALL SELECT 'c_mktsegment', CASE WHEN count(DISTINCT c_mktsegment) >= 0.95 * count(c_mktsegment) THEN 'id' ELSE 'categorical' END FROM customer
UNION ALL SELECT 'rich', 'boolean'
""")
def column_role_detection(spark, sf_dir):
    return detection.role_table(table(spark, sf_dir, "customer").withColumn("rich", F.col("c_acctbal") > 5000))
