"""Exact-row leakage from a real into a synthetic table, and the compliance summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard.schema import c, percent


def _comparable(real: DataFrame, synth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows are compared by column position, numbers by value whatever their type."""
    if len(real.columns) != len(synth.columns):
        raise ValueError("both tables need the same number of columns")
    left, right = [], []
    for i, (a, b) in enumerate(zip(real.schema, synth.schema)):
        x, y = c(a.name), c(b.name)
        if a.dataType != b.dataType:
            both_numeric = isinstance(a.dataType, T.NumericType) and isinstance(b.dataType, T.NumericType)
            kind = "double" if both_numeric else "string"
            x, y = x.cast(kind), y.cast(kind)
        left.append(x.alias(f"_{i}"))
        right.append(y.alias(f"_{i}"))
    return real.select(*left), synth.select(*right)


def exact_leakage(real: DataFrame, synth: DataFrame, null_matches: bool = False) -> DataFrame:
    """One row: how many distinct real rows occur in the synthetic table.

    Both sides go through one grouping by the whole row, which needs a single shuffle, sums
    copies before it, and treats a hot row like any other. A row that holds a null never matches
    unless ``null_matches``.
    """
    left, right = _comparable(real, synth)
    both = left.withColumn("_r", F.lit(1)).withColumn("_s", F.lit(0)).unionByName(
        right.withColumn("_r", F.lit(0)).withColumn("_s", F.lit(1))
    )
    rows = both.groupBy(*left.columns).agg(F.sum("_r").alias("n_real"), F.sum("_s").alias("n_synth"))
    matched = (F.col("n_real") > 0) & (F.col("n_synth") > 0)
    if not null_matches:
        matched = matched & reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in left.columns])
    return rows.agg(
        F.coalesce(F.sum("n_real"), F.lit(0)).alias("total_real_rows"),
        F.coalesce(F.sum("n_synth"), F.lit(0)).alias("total_synthetic_rows"),
        F.count_if(F.col("n_real") > 0).alias("distinct_real_rows"),
        F.count_if(matched).alias("leaked_rows"),
    ).select(
        "total_real_rows", "total_synthetic_rows", "leaked_rows",
        percent(F.col("leaked_rows"), F.col("distinct_real_rows")).alias("leaked_percentage"),
    )


def compliance_summary(experiments: DataFrame, reports: DataFrame) -> DataFrame:
    """One row per experiment that has a report: status, leakage and smallest distance.

    ``reports`` is the long table ``(experiment_id, section, column, metric, value)``.
    """
    value = F.col("value").cast("double")
    measured = reports.groupBy("experiment_id").agg(
        F.coalesce(
            F.max(F.when((F.col("section") == "privacy") & (F.col("metric") == "leaked_rows"), value)), F.lit(0.0)
        ).cast("long").alias("leaked_rows"),
        F.max(F.when((F.col("section") == "dcr") & (F.col("metric") == "min_distance"), value)).alias("min_distance"),
    )
    return experiments.join(measured, "experiment_id").select(
        "experiment_id",
        F.col("timestamp").alias("date"),
        "method",
        "epsilon",
        F.when(F.col("leaked_rows") == 0, "PASSED").otherwise("WARNING: LEAKAGE DETECTED").alias("status"),
        "leaked_rows",
        "min_distance",
    )
