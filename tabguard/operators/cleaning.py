"""Duplicate removal and missing-value handling."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard.plans.quantiles import exact_quantiles
from tabguard.schema import as_double, c, melt_row, numeric_columns, string_columns
from tabguard.session import write_and_reread


def missing_counts(df: DataFrame) -> DataFrame:
    """One row per column with its number of nulls."""
    wide = df.agg(*[F.count_if(c(n).isNull()).alias(f"n{i}") for i, n in enumerate(df.columns)])
    return melt_row(wide, [{"column": F.lit(n), "missing": F.col(f"n{i}")} for i, n in enumerate(df.columns)])


def modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Most frequent non-null value per column, the smallest one on a tie; absent if all null.

    Values are counted with a map-side sum, so no task ever holds a column's value set.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    numeric = set(numeric_columns(df))
    none = F.lit(None)
    cells = F.array(
        *[
            F.struct(
                F.lit(n).alias("column"),
                # Numbers are ordered as numbers and, where a double can't tell them apart, as integers.
                (as_double(n) if n in numeric else none.cast("double")).alias("number"),
                (c(n).cast("decimal(38,0)") if isinstance(kinds[n], T.IntegralType) else none.cast("decimal(38,0)")).alias("whole"),
                c(n).cast("string").alias("text"),
            )
            for n in columns
        ]
    )
    counted = (
        df.select(F.inline(cells)).filter(F.col("text").isNotNull())
        .groupBy("column", "number", "whole", "text").agg(F.count(F.lit(1)).alias("n"))
    )
    best = counted.groupBy("column").agg(
        F.min_by("text", F.struct(-F.col("n"), F.col("number"), F.col("whole"), F.col("text"))).alias("best")
    )
    found = {r["column"]: r["best"] for r in best.collect()}
    return {n: _typed(found[n], kinds[n]) for n in columns if n in found}


def _typed(text: str, kind: T.DataType):
    """A value's text in the Python type of its column."""
    if isinstance(kind, T.IntegralType):
        return int(text)
    if isinstance(kind, T.DecimalType):
        return Decimal(text)
    return float(text) if isinstance(kind, T.FractionalType) else text


def clean_table(
    df: DataFrame,
    remove_duplicates: bool = True,
    handle_missing: bool = True,
    missing_strategy: str = "median",
    exact: bool = True,
) -> DataFrame:
    """Drop copies of rows, then drop or fill rows with nulls.

    ``drop`` removes incomplete rows. ``median`` and ``mean`` fill numeric columns (an integer
    column that had nulls becomes double); any other strategy fills their mode, 0 if there is
    none. Strings always get their mode, ``'Unknown'`` if there is none.
    """
    if not handle_missing:
        return df.dropDuplicates() if remove_duplicates else df
    if missing_strategy == "drop":
        complete = df.na.drop("any")
        return complete.dropDuplicates() if remove_duplicates else complete
    nulls = {r["column"] for r in missing_counts(df).filter(F.col("missing") > 0).collect()}
    numbers = [n for n in numeric_columns(df) if n in nulls]
    strings = [n for n in string_columns(df) if n in nulls]
    if remove_duplicates:
        df = df.dropDuplicates()
        if numbers or strings:
            # The fill values need passes over the distinct rows: shuffle them once, not per pass.
            df = write_and_reread(df, "distinct")
    if not numbers and not strings:
        return df
    fills: dict[str, object] = {}
    if missing_strategy == "median" and exact:
        fills |= {n: q[0] for n, q in exact_quantiles(df, numbers, [0.5]).items()}
    elif missing_strategy in ("median", "mean") and numbers:
        how = F.avg if missing_strategy == "mean" else lambda col: F.percentile_approx(col, 0.5, 10_000)
        row = df.agg(*[how(as_double(n)).alias(f"f{i}") for i, n in enumerate(numbers)]).first()
        fills |= {n: row[f"f{i}"] for i, n in enumerate(numbers)}
    by_mode = strings + (numbers if missing_strategy not in ("median", "mean") else [])
    if by_mode:
        found = modes(df, by_mode)
        fills |= {n: found.get(n, "Unknown" if n in strings else 0) for n in by_mode}
    kinds = {f.name: f.dataType for f in df.schema}

    def filled(name: str):
        if fills.get(name) is None:
            return c(name)
        kind = kinds[name]
        if name in numbers and missing_strategy in ("median", "mean") and isinstance(kind, T.IntegralType):
            kind = T.DoubleType()
        return F.coalesce(c(name).cast(kind), F.lit(fills[name]).cast(kind)).alias(name)

    return df.select(*[filled(n) for n in df.columns])
