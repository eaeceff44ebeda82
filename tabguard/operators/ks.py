"""Two-sample Kolmogorov-Smirnov test for all numeric columns at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard.plans.ordered import cut_points, long_values, running_totals
from tabguard.schema import numeric_columns

SERIES_TERMS = 100
#: Values on the larger side up to which p is counted exactly (n x m steps on one row of results).
LARGEST_EXACT = 10_000


def ks_p_value(statistic: Column, n_real: Column, n_synth: Column) -> Column:
    """Asymptotic two-sided p by the alternating Kolmogorov series."""
    effective = n_real.cast("double") * n_synth / (n_real + n_synth)
    root = statistic * F.sqrt(effective)
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(SERIES_TERMS)),
        F.lit(0.0),
        lambda total, j: total + F.when(j % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(F.lit(-2.0) * j * j * root * root),
    )
    return F.when(root < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(2.0) * terms)))


def exact_p(gap: int, n: int, m: int) -> float:
    """P(D >= gap / (n m)) for samples of ``n`` and ``m`` values without ties, by lattice paths.

    All orders of the pooled values are equally likely, and an order is a path from (0, 0) to (n, m). The chance of
    every point is carried along the diagonals and taken out where the path first strays by ``gap``: only sums of
    positive numbers, so that small p keep their digits.
    """
    if gap <= 0:
        return 1.0
    n, m = max(n, m), min(n, m)
    i = np.arange(m + 1, dtype=np.int64)
    chance, strayed = np.zeros(m + 1), 0.0
    chance[0] = 1.0
    for step in range(n + m):
        left = n + m - step
        j = step - i
        # The next value is one of the n - j left of the larger sample, or of the m - i left of the other.
        move = chance * np.maximum(n - j, 0) / left
        move[1:] += chance[:-1] * (m - i[:-1]) / left
        out = np.abs(i * n - (j + 1) * m) >= gap
        strayed += float(move[out].sum())
        move[out] = 0.0
        chance = move
    return min(1.0, strayed)


@F.pandas_udf(T.DoubleType())
def _exact_p(gap: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([exact_p(int(g), int(a), int(b)) for g, a, b in zip(gap, n, m)], dtype=float)


def _worst_gaps(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, d, gap, t_r, t_s)``: the statistic, the same times both sizes as a whole number, and the sizes.

    Equal values are merged (map-side) into one row with a count per side. The running counts
    come from buckets of the value range plus offsets, so no column is sorted in one task.
    """
    cuts = cut_points(real, columns)
    both = (
        long_values(real, columns, cuts).withColumn("r", F.lit(1)).withColumn("s", F.lit(0))
        .unionByName(long_values(synth, columns, cuts).withColumn("r", F.lit(0)).withColumn("s", F.lit(1)))
    )
    merged = both.groupBy("column", "bucket", "value").agg(F.sum("r").alias("n_r"), F.sum("s").alias("n_s"))
    running = running_totals(merged, {"c_r": "n_r", "c_s": "n_s"}, [F.col("value")], ["column"])
    # Totals per column: one row each.
    totals = merged.filter(F.col("column").isNotNull() & F.col("bucket").isNotNull()).groupBy("column").agg(F.sum("n_r").alias("t_r"), F.sum("n_s").alias("t_s"))
    gap = F.abs(F.try_divide(F.col("c_r").cast("double"), F.col("t_r")) - F.try_divide(F.col("c_s").cast("double"), F.col("t_s")))
    whole = F.abs(F.col("c_r").cast("decimal(38,0)") * F.col("t_s") - F.col("c_s").cast("decimal(38,0)") * F.col("t_r"))
    return running.join(F.broadcast(totals), "column").groupBy("column").agg(
        F.max(gap).alias("d"), F.max(whole).alias("gap"), F.first("t_r").alias("t_r"), F.first("t_s").alias("t_s")
    )


def ks_test(real: DataFrame, synth: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row per numeric column of ``real``: D, p and whether p > ``alpha``; nulls for a column that ``synth`` lacks."""
    return _report(real, synth, alpha, ks_p_value(F.col("d"), F.col("t_r"), F.col("t_s")))


def ks_exact(real: DataFrame, synth: DataFrame, alpha: float = 0.05, largest: int = LARGEST_EXACT) -> DataFrame:
    """:func:`ks_test` with the exact p where both sides hold at most ``largest`` values, and whether it is (``exact``).

    Beyond that p is the series. Where one side holds no value, D and p are null. Equal values on both
    sides make the exact p an upper bound, as it takes all values for different.
    """
    sizes = F.greatest("t_r", "t_s")
    exact = (sizes <= largest) & (F.least("t_r", "t_s") > 0)
    # One row a column. The sizes reach the helper only where they are small: a branch would not hold it back.
    small = [F.when(exact, F.col(n)).otherwise(F.lit(0)).cast("long") for n in ("gap", "t_r", "t_s")]
    p = F.when(exact, _exact_p(*small)).otherwise(ks_p_value(F.col("d"), F.col("t_r"), F.col("t_s")))
    return _report(real, synth, alpha, p, exact)


def _report(real: DataFrame, synth: DataFrame, alpha: float, p: Column, exact: Column | None = None) -> DataFrame:
    columns = [n for n in numeric_columns(real) if n in synth.columns]
    more = "" if exact is None else ", exact boolean"
    absent = real.sparkSession.createDataFrame(
        [(n, None, None, None) + (() if exact is None else (None,)) for n in numeric_columns(real) if n not in columns],
        "column string, ks_statistic double, p_value double, similar boolean" + more)
    if not columns:
        return absent
    name = F.element_at(F.array(*[F.lit(n) for n in columns]), F.col("column") + 1)
    # Without a value on one side there is nothing to compare.
    return _worst_gaps(real, synth, columns).withColumn("p", F.when(F.col("d").isNotNull(), p)).select(
        name.alias("column"), F.round("d", 4).alias("ks_statistic"), F.round("p", 4).alias("p_value"), (F.col("p") > alpha).alias("similar"),
        *([] if exact is None else [exact.alias("exact")]),
    ).unionByName(absent)
