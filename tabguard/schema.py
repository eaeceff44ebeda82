"""Column families and small helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def c(name: str) -> Column:
    """A column by its exact name (names may hold dots, dashes or spaces)."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType))]


def as_double(name: str) -> Column:
    return c(name).cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Float NaN and null mean the same missing value; keep null only."""
    fractional = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not fractional:
        return df
    return df.select(
        *[F.nanvl(c(n), F.lit(None)).alias(n) if n in fractional else c(n) for n in df.columns]
    )


def melt_row(wide: DataFrame, rows: Iterable[Mapping[str, Column]]) -> DataFrame:
    """One output row per mapping; meant for the one-row result of a wide aggregate."""
    structs = [F.struct(*[col.alias(name) for name, col in row.items()]) for row in rows]
    return wide.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))
