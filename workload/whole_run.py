"""A whole experiment from the customer table to its report."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tabguard.operators import registry
from tabguard.operators.constraints import Profile, Range
from tabguard.plans.experiment_run import ExperimentConfig, run_experiment
from tabguard.session import scratch_path
from workload.catalog import query, table


@query("""
SELECT 'privacy' AS section, 'total_real_rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM (SELECT DISTINCT * FROM customer)
UNION ALL SELECT 'privacy', 'total_synthetic_rows', CAST(count(*) AS VARCHAR) FROM customer
UNION ALL SELECT 'dcr', 'total_records', CAST(count(*) AS VARCHAR) FROM customer
UNION ALL SELECT 'compliance', 'violations', '0'
UNION ALL SELECT 'status', 'status', 'completed'
""")
def whole_experiment(spark, sf_dir):
    """The deterministic facts of a run: row counts, no violation after enforcement, final status."""
    real = table(spark, sf_dir, "customer")
    config = ExperimentConfig("exp_customer", num_rows=real.count(), sensitive_column="c_mktsegment", epsilon=1.5, seed=9)
    tables = run_experiment(spark, real, config, Profile("customer", [Range("c_acctbal", 0, 9000, "float")]))
    wanted = F.struct("section", "metric").isin(*[
        F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"))
        for s, m in (("privacy", "total_real_rows"), ("privacy", "total_synthetic_rows"), ("dcr", "total_records"), ("compliance", "violations"))
    ])
    status = tables["status"].agg(F.max_by("status", "seq").alias("value")).select(F.lit("status").alias("section"), F.lit("status").alias("metric"), "value")
    return tables["reports"].filter(wanted).select("section", "metric", "value").unionByName(status)


@query("""
WITH t AS (SELECT user_id, value, event_id % 7 AS code FROM events)
SELECT 'value' AS "column", 0.75::DOUBLE AS epsilon_used, round((max(value) - min(value))::DOUBLE, 6) AS sensitivity,
       round((max(value) - min(value)) / 0.75::DOUBLE, 6) AS noise_scale, count(DISTINCT user_id) AS entities FROM t
UNION ALL SELECT 'amount', 0.75, round((max(value) - min(value))::DOUBLE * 2, 6), round((max(value) - min(value)) * 2 / 0.75::DOUBLE, 6), count(DISTINCT user_id) FROM t
""")
def whole_experiment_sequences(spark, sf_dir):
    """A sequence fit with an epsilon: noise before the fit, its ledger, and as many entities as asked for."""
    real = table(spark, sf_dir, "events").select("user_id", "ts", F.col("value").cast("double").alias("value"), (F.col("value") * 2).cast("double").alias("amount"))
    wanted = real.select("user_id").distinct().count()
    config = ExperimentConfig("exp_events", method="PAR", num_rows=wanted, epsilon=1.5, sequence_key="user_id", sequence_index="ts", seed=4)
    tables = run_experiment(spark, real, config)
    entities = tables["synthetic"].select("user_id").distinct().count()
    return tables["ledger"].select("column", "epsilon_used", F.round("sensitivity", 6).alias("sensitivity"),
                                   F.round("noise_scale", 6).alias("noise_scale"), F.lit(entities).alias("entities"))


@query("SELECT 1::BIGINT AS models, TRUE AS sized, TRUE AS used_later, 'keep' AS action, 'expire' AS action_later FROM (SELECT count(*) FROM part)")
def fitted_model_registry(spark, sf_dir):
    """Fit, reuse and retention over the rows that they wrote."""
    real = table(spark, sf_dir, "part")
    root = scratch_path(spark, "models")
    for _ in range(2):
        registry.fit_or_load(real, root)
    rows = registry.registry_rows(spark, root)
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    plans = [registry.retention_plan(rows, now + dt.timedelta(days=d)).select("cache_key", F.col("action").alias(n)) for d, n in ((1, "action"), (60, "action_later"))]
    seen = rows.agg(F.count("cache_key").alias("models"), F.min(F.col("size_mb") > 0).alias("sized"), F.min(F.col("last_accessed") > F.col("cached_at")).alias("used_later"))
    return seen.join(F.broadcast(plans[0].join(plans[1], "cache_key"))).select("models", "sized", "used_later", "action", "action_later")


@query("SELECT TRUE AS same_key, FALSE AS first_from_cache, TRUE AS second_from_cache, count(*) AS rows FROM part")
def fitted_model_cache(spark, sf_dir):
    real = table(spark, sf_dir, "part")
    root = scratch_path(spark, "models")
    _, key, first = registry.fit_or_load(real, root, config={"epochs": 1})
    model, again, second = registry.fit_or_load(real.repartition(5), root, config={"epochs": 1})
    return spark.createDataFrame([(key == again, first, second, model.rows)], "same_key boolean, first_from_cache boolean, second_from_cache boolean, rows long")
