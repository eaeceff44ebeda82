"""Approximate quantiles whose partial sketches never meet in a single task.

Input partitions are dealt round-robin to a fixed number of shards. Each shard merges its own KLL
sketches, and the shards' sketches, a few kilobytes each, are merged once more. A merged sketch knows
how many rows each part stands for, so uneven shards weigh what they hold. Callers use the values as a
layout or as a guess that they verify by counting; no result depends on them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 256


def merged_sketches(df: DataFrame, groups: list[str], value: Column, parts: int) -> DataFrame:
    """``(groups..., sketch)``: one KLL sketch of ``value`` for each group, merged in shards first."""
    size = max(200, min(8_000, 4 * parts))
    shard = F.pmod(F.spark_partition_id(), F.lit(SHARDS))
    keys = [F.col(g) for g in groups]
    staged = df.select(*keys, shard.alias("_shard"), value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    by_shard = staged.groupBy(*keys, "_shard").agg(F.kll_sketch_agg_double("_v", F.lit(size)).alias("_s"))
    return by_shard.groupBy(*keys).agg(F.kll_merge_agg_double("_s").alias("sketch"))


def even_cuts(df: DataFrame, values: list[Column], parts: int, rows_per_part: int | None = None) -> list[list[float]]:
    """For every value column about ``parts - 1`` cut points with similar numbers of rows between them.

    With ``rows_per_part`` there are as many more parts as the rows need.
    """
    if rows_per_part is not None:
        parts = max(parts, math.ceil(df.count() / rows_per_part))
    cells = F.array(*[F.struct(F.lit(i).alias("i"), v.cast("double").alias("v")) for i, v in enumerate(values)])
    sketches = merged_sketches(df.select(F.inline(cells)), ["i"], F.col("v"), parts)
    found = {r["i"]: r["cuts"] for r in sketches.select("i", inner_quantiles(parts).alias("cuts")).collect()}
    return [list(found.get(i) or []) for i in range(len(values))]


def inner_quantiles(parts: int) -> Column:
    """Of the column ``sketch``: the quantiles that make ``parts`` parts."""
    return F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / parts) for i in range(1, parts)]))


def finite(values) -> list[float]:
    return sorted({float(v) for v in values if v is not None and math.isfinite(v)})
