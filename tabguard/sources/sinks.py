"""Dataset, report and document sinks, and the JSON documents read back as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG_SCHEMA = (
    "experiment_id string, method string, timestamp string, num_rows bigint, sensitive_column string, "
    "epsilon double, epochs bigint, sequence_key string, sequence_index string, status string, error string"
)


def write_dataset(
    df: DataFrame, path: str, format: str = "parquet", partition_by: str | None = None, mode: str = "errorifexists"
) -> None:
    """Rows without an index column, as Parquet (default) or CSV with a header."""
    writer = df.write.mode(mode)
    if partition_by:
        # One shuffle puts a value into few files; AQE splits a value that holds very many rows.
        writer = df.hint("rebalance", partition_by).write.mode(mode).partitionBy(partition_by)
    if format == "csv":
        writer.csv(path, header=True, escape='"')
    elif format == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported sink format {format!r}")


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """All run configurations below ``path`` (a glob). Missing keys are null, broken files give no row."""
    configs = spark.read.schema(CONFIG_SCHEMA).json(path, multiLine=True, mode="PERMISSIVE")
    return configs.filter(F.col("experiment_id").isNotNull())


def report_documents(reports: DataFrame) -> DataFrame:
    """Long report rows -> one JSON document per row, ready for a text sink.

    Rows stay separate documents (keyed by experiment), so a long report never sits in one task.
    """
    return reports.select(
        "experiment_id",
        F.to_json(F.struct("section", "column", "metric", "value")).alias("document"),
    )


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON document per line (NDJSON)."""
    documents.select("document").write.text(path)
