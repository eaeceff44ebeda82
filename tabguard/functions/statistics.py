"""Aggregate expressions that stay defined where ANSI arithmetic would raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pearson(a: Column, b: Column) -> Column:
    """Pairwise-complete correlation; null (not an error) for a constant column."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    # Merged means are rounded, so a constant column is told by its range, not by a deviation of 0.
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def zero_to_one(scale: Column) -> Column:
    """Divisor for standardising; a constant column is left unscaled."""
    return F.when(scale == 0, F.lit(1.0)).otherwise(scale)
