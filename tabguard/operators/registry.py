"""Fitted-model registry: content fingerprint, expiry, retention and statistics."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabguard.operators.synthesis import CopulaModel, fit_copula
from tabguard.plans.ordered import bucket_count, running_totals
from tabguard.schema import c
from tabguard.session import write_and_reread

# Default limits.
MAX_AGE_DAYS = 30
MAX_GIGABYTES = 5.0


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: 16 hex characters from the rows, the column names and types; the order of rows does not matter.

    Row hashes are summed (copies count) and xor-ed, which any partitioning merges to the same value.
    """
    row = F.xxhash64(*[c(n) for n in df.columns])
    described = json.dumps([(f.name, f.dataType.simpleString()) for f in df.schema])
    return df.agg(
        F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).alias("total"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("mixed"),
        F.count(F.lit(1)).alias("rows"),
    ).select(
        F.substring(
            F.sha2(F.concat_ws("|", F.col("total").cast("string"), F.col("mixed").cast("string"), F.col("rows").cast("string"), F.lit(described)), 256),
            1, 16,
        ).alias("fingerprint"),
        "rows", F.lit(len(df.columns)).alias("columns"),
    )


def cache_key(df: DataFrame, method: str, config: dict | None = None) -> str:
    """``<fingerprint>_<hash of the sorted config, or default>_<method>``."""
    part = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:8] if config else "default"
    return f"{fingerprint(df).first()['fingerprint']}_{part}_{method}"


LOG_SCHEMA = "cache_key string, folder string, event string, at timestamp, size_mb double"


def _log(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(f"{root}/log")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LOG_SCHEMA)


def _note(spark: SparkSession, root: str, key: str, folder: str, event: str, size_mb: float | None) -> None:
    at = dt.datetime.now(dt.timezone.utc)
    spark.createDataFrame([(key, folder, event, at, size_mb)], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/log")


def registry_rows(spark: SparkSession, root: str) -> DataFrame:
    """The models of ``root``: cache_key, cached_at, last_accessed, size_mb. Only published models have a row."""
    saved = F.col("event") == "saved"
    return _log(spark, root).groupBy("cache_key").agg(
        F.max(F.when(saved, F.col("at"))).alias("cached_at"), F.max("at").alias("last_accessed"),
        F.max_by("size_mb", F.when(saved, F.col("at"))).alias("size_mb"),
    )


def _megabytes(spark: SparkSession, path: str) -> float:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength() / 2**20


def fit_or_load(df: DataFrame, root: str, method: str = "GaussianCopula", config: dict | None = None, **options) -> tuple[CopulaModel, str, bool]:
    """The model of this content and configuration from ``root``, fitted and saved there if new.

    A model is saved in a fresh folder and published by a row of the log, written last: what a broken
    save leaves behind is never read, and the next call saves anew. Each use adds a row too, which
    moves ``last_accessed`` in :func:`registry_rows`.
    """
    spark = df.sparkSession
    key = cache_key(df, method, config)
    saved = _log(spark, root).filter((F.col("cache_key") == key) & (F.col("event") == "saved")).orderBy(F.desc("at")).first()
    if saved is not None:
        model = CopulaModel.load(spark, f"{root}/{saved['folder']}")
        _note(spark, root, key, saved["folder"], "used", None)
        return model, key, True
    folder = f"{key}-{uuid.uuid4().hex}"
    model = fit_copula(df, method=method, **options)
    model.save(spark, f"{root}/{folder}")
    _note(spark, root, key, folder, "saved", _megabytes(spark, f"{root}/{folder}"))
    return model, key, False


def _moment(registry: DataFrame, at: dt.datetime) -> Column:
    """``at`` in the type of ``cached_at``, read in the session's time zone."""
    return F.lit(at.isoformat(sep=" ")).cast(registry.schema["cached_at"].dataType)


def _expired(registry: DataFrame, as_of: dt.datetime, max_age_days: int) -> Column:
    limit = _moment(registry, as_of - dt.timedelta(days=max_age_days))
    return F.coalesce(F.col("cached_at") < limit, F.lit(True))


def valid_entries(registry: DataFrame, as_of: dt.datetime, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """Every entry with ``valid``: not older than ``max_age_days``; unreadable metadata counts as expired."""
    return registry.withColumn("valid", ~_expired(registry, as_of, max_age_days))


def retention_plan(
    registry: DataFrame, as_of: dt.datetime, max_age_days: int = MAX_AGE_DAYS, max_gigabytes: float = MAX_GIGABYTES
) -> DataFrame:
    """Every entry with its ``action``: ``expire``, ``evict`` (least recently used beyond the limit) or ``keep``.

    Of the unexpired entries the most recent are kept while their sizes fit; one that was never used
    comes last, one without a size counts as empty. Their running size is summed in ranges of
    (access time, key), so that entries of one moment are spread too.
    """
    flagged = registry.withColumn("_expired", _expired(registry, as_of, max_age_days))
    live = flagged.filter(~F.col("_expired"))
    order = [F.col("last_accessed").desc_nulls_last(), F.col("cache_key").asc()]
    dealt = live.repartitionByRange(bucket_count(live), *order).withColumn("bucket", F.spark_partition_id()).withColumn("_all", F.lit(0))
    dealt = write_and_reread(dealt.withColumn("_size", F.coalesce("size_mb", F.lit(0.0))), "entries")
    ranked = running_totals(dealt, {"kept_mb": "_size"}, order, ["_all"])
    action = F.when(F.col("kept_mb") > max_gigabytes * 1024.0, "evict").otherwise("keep")
    names = [c(n) for n in registry.columns]
    return ranked.select(*names, action.alias("action")).unionByName(
        flagged.filter("_expired").select(*names, F.lit("expire").alias("action"))
    )


def registry_statistics(registry: DataFrame) -> DataFrame:
    """One row: entries, total size in GB, oldest and newest caching time."""
    return registry.agg(
        F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("size_mb") / 1024.0, F.lit(0.0)).alias("total_gb"),
        F.min("cached_at").alias("oldest"), F.max("cached_at").alias("newest"),
    )


def entry_ages(registry: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Every entry with its age in whole days."""
    return registry.withColumn("age_days", F.datediff(F.lit(as_of.date()), F.col("cached_at").cast("date")))
