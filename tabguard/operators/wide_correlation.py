"""Pearson correlation of tables with very many columns, one scan a side.

A task keeps the moments of all column pairs as matrices, one per pair of column blocks: for blocks X and Y with
masks of their present values, products of the matrices give pairwise-complete counts, sums and
products at once. Partial matrices are merged block by block in a tree, by the formulas for centred
moments, so that neither large values nor many rows cost precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.schema import as_double, c, numeric_columns

#: Columns of a block; a matrix of one pair of blocks has the square of it.
BLOCK = 128
#: Bytes of moment matrices that a task holds; more columns take more scans.
MOMENT_BYTES = 512 << 20
#: Rows that are multiplied at a time.
ROWS_AT_ONCE = 4096
#: Partial matrices that one step of the tree merges; three steps serve its cube of tasks.
FAN = 64
_KINDS = 6  # n, mean x, mean y, centred x*x, y*y, x*y


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Centred moments (n, mx, my, xx, yy, xy) of two disjoint sets of rows."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy, weight = b[1] - a[1], b[2] - a[2], a[0] * share
    return np.stack([n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight, a[5] + b[5] + dx * dy * weight])


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Centred moments of all pairs of columns of two blocks with the same rows; NaN is missing."""
    here, there = ~np.isnan(x), ~np.isnan(y)
    # Shifted by about the mean of each column, so that the products stay exact enough.
    shift_x = np.divide(np.where(here, x, 0).sum(0), np.maximum(here.sum(0), 1))
    shift_y = np.divide(np.where(there, y, 0).sum(0), np.maximum(there.sum(0), 1))
    x, y = np.where(here, x - shift_x, 0.0), np.where(there, y - shift_y, 0.0)
    here, there = here.astype(float), there.astype(float)
    n = here.T @ there
    several = np.maximum(n, 1)
    mx, my = x.T @ there / several, here.T @ y / several
    xx, yy, xy = (x * x).T @ there - n * mx * mx, here.T @ (y * y) - n * my * my, x.T @ y - n * mx * my
    return np.stack([n, np.where(n > 0, mx + shift_x[:, None], 0), np.where(n > 0, my + shift_y[None, :], 0), np.maximum(xx, 0), np.maximum(yy, 0), xy])


def _pairs_of_blocks(columns: int, block: int, most_bytes: int):
    """Pairs of column blocks, in groups whose matrices fit ``most_bytes``."""
    starts = list(range(0, columns, block))
    pairs = [(a, b) for i, a in enumerate(starts) for b in starts[i:]]
    held = max(1, most_bytes // (block * block * 8 * _KINDS))
    return [pairs[i:i + held] for i in range(0, len(pairs), held)]


def pair_moments(df: DataFrame, columns: list[str], block: int = BLOCK, most_bytes: int = MOMENT_BYTES) -> DataFrame:
    """(a, b, moments): for each pair of column blocks, by their first columns, its merged moments as doubles."""
    narrow = df.select(F.array(*[as_double(n) for n in columns]).alias("v"))
    groups = _pairs_of_blocks(len(columns), block, most_bytes)
    d = len(columns)

    def scan(pairs):
        def run(batches):
            held = {}
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                    values = batch.column(0).slice(start, ROWS_AT_ONCE).flatten()
                    x = values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
                    for a, b in pairs:
                        found = _moments(x[:, a:a + block], x[:, b:b + block])
                        held[a, b] = _merge(held[a, b], found) if (a, b) in held else found
            shard = TaskContext.get().partitionId()
            for (a, b), found in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([b]), pa.array([shard]), pa.array([found.tobytes()], pa.binary())],
                                                 names=["a", "b", "shard", "moments"])

        return narrow.mapInArrow(run, "a long, b long, shard long, moments binary")

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = None
        for data in frame["moments"]:
            width = min(block, d - int(frame["b"].iloc[0]))
            found = np.frombuffer(data).reshape(_KINDS, -1, width)
            total = found if total is None else _merge(total, found)
        return pd.DataFrame({"a": frame["a"].iloc[:1], "b": frame["b"].iloc[:1], "shard": frame["shard"].iloc[:1], "moments": [total.tobytes()]})

    parts = [scan(pairs) for pairs in groups]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    schema = "a long, b long, shard long, moments binary"
    for _ in range(2):
        found = found.withColumn("shard", F.floor(F.col("shard") / FAN)).groupBy("a", "b", "shard").applyInPandas(add, schema)
    return found.groupBy("a", "b").applyInPandas(add, schema).drop("shard")


def wide_correlation(df: DataFrame, columns: list[str] | None = None, block: int = BLOCK, most_bytes: int = MOMENT_BYTES) -> DataFrame:
    """``(col_a, col_b, corr, n)`` for each pair of columns in their order, from the rows where both are present.

    Null for pairs where a column is constant on those rows. The table of pairs is made in tasks,
    one pair of blocks each. Null and NaN are missing; a table without rows gives no pairs.
    """
    columns = numeric_columns(df) if columns is None else columns
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double, n long")
    d = len(columns)

    def spell(batches):
        for batch in batches:
            for a, b, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n, mx, my, xx, yy, xy = np.frombuffer(data).reshape(_KINDS, -1, min(block, d - b))
                i, j = np.meshgrid(np.arange(n.shape[0]) + a, np.arange(n.shape[1]) + b, indexing="ij")
                # What rounding leaves of a constant column's spread is no spread.
                least = 1e-26
                flat = (xx <= least * n * mx * mx) | (yy <= least * n * my * my)
                with np.errstate(invalid="ignore", divide="ignore"):
                    corr = np.where(flat, np.nan, xy / np.sqrt(xx * yy))
                keep = i < j
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i[keep]), pa.array(j[keep]), pa.array(corr[keep], mask=np.isnan(corr[keep])), pa.array(n[keep].astype(np.int64))],
                    names=["i", "j", "corr", "n"])

    spelt = pair_moments(df, columns, block, most_bytes).mapInArrow(spell, "i long, j long, corr double, n long")
    names = F.array(*[F.lit(n) for n in columns])
    return spelt.select(F.get(names, F.col("i").cast("int")).alias("col_a"), F.get(names, F.col("j").cast("int")).alias("col_b"), "corr", "n")


def wide_correlation_difference(real: DataFrame, synth: DataFrame, block: int = BLOCK, most_bytes: int = MOMENT_BYTES) -> DataFrame:
    """As :func:`tabguard.operators.fidelity.correlation`, for any number of columns: both sides and the absolute difference."""
    columns = numeric_columns(real)
    one = wide_correlation(real, columns, block, most_bytes).select("col_a", "col_b", F.col("corr").alias("real_corr"))
    shared = [n for n in columns if n in synth.columns]
    other = wide_correlation(synth, shared, block, most_bytes).select("col_a", "col_b", F.col("corr").alias("synth_corr"))
    joined = one.join(other, ["col_a", "col_b"], "left")
    return joined.withColumn("diff", F.abs(F.col("real_corr") - F.col("synth_corr")))
