"""Clinical columns, diagnosis codes, quasi-identifiers and column roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard.schema import as_double, c, melt_row, numeric_columns, percent, string_columns

# Name part -> plausible range, distribution and unit.
CLINICAL_RULES = {
    "hba1c": (4.0, 14.0, "gaussian", "%"),
    "glucose": (0.0, 600.0, "gamma", "mg/dL"),
    "spo2": (50.0, 100.0, "beta", "%"),
    "heart_rate": (30.0, 220.0, "gaussian", "bpm"),
    "systolic_bp": (60.0, 250.0, "gaussian", "mmHg"),
    "diastolic_bp": (40.0, 140.0, "gaussian", "mmHg"),
    "bmi": (10.0, 60.0, "lognorm", "kg/m2"),
}
# Pattern of a diagnosis code, names of quasi-identifiers.
ICD10_PATTERN = r"^[A-Z][0-9][0-9AB](?:\.[0-9A-K]{1,4})?$"
QUASI_IDENTIFIER_NAMES = ("Age", "Gender", "ZipCode", "ZIP", "Race", "Ethnicity")
LOW_CARDINALITY = 20


def suggestion(name: Column) -> Column:
    """The rule whose key occurs in the lower-cased name, as a struct; the last one wins."""
    lowered = F.lower(name)
    options = [
        F.when(
            F.contains(lowered, F.lit(key)),
            F.struct(F.lit(key).alias("rule"), F.lit(low).alias("min"), F.lit(high).alias("max"),
                     F.lit(shape).alias("distribution"), F.lit(unit).alias("unit")),
        )
        for key, (low, high, shape, unit) in CLINICAL_RULES.items()
    ]
    return F.coalesce(*reversed(options))


def analyze_columns(df: DataFrame) -> DataFrame:
    """One row per column: suggested clinical rule, and the diagnosis-code share of string columns.

    ``icd10_validity`` (percent of the non-null values) is given where more than half match.
    """
    strings = set(string_columns(df))
    shares = {n: f"s{i}" for i, n in enumerate(df.columns) if n in strings}
    wide = df.agg(F.lit(1).alias("one"), *[F.avg(c(n).rlike(ICD10_PATTERN).cast("double")).alias(a) for n, a in shares.items()])
    rows = []
    for n in df.columns:
        share = F.col(shares[n]) if n in shares else F.lit(None).cast("double")
        is_code = F.coalesce(share > 0.5, F.lit(False))
        rows.append({
            "column": F.lit(n),
            "is_icd10": is_code,
            "icd10_validity": F.when(is_code, F.round(share * 100, 2)),
        })
    return melt_row(wide, rows).withColumn("s", suggestion(F.col("column"))).select(
        "column", F.col("s.rule").alias("rule"), F.col("s.min").alias("min"), F.col("s.max").alias("max"),
        F.col("s.distribution").alias("distribution"), F.col("s.unit").alias("unit"), "is_icd10", "icd10_validity",
    )


def clinical_bounds(df: DataFrame) -> DataFrame:
    """Values outside the suggested range, one row per numeric column that has a suggestion."""
    ranges = {}
    for n in numeric_columns(df):
        for key, rule in CLINICAL_RULES.items():
            if key in n.lower():
                ranges[n] = rule
    schema = "column string, min double, max double, below_min long, above_max long, violations long, violation_percentage double"
    if not ranges:
        return df.sparkSession.createDataFrame([], schema)
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, (n, (low, high, _, _)) in enumerate(ranges.items()):
        aggregates += [F.count_if(as_double(n) < low).alias(f"b{i}"), F.count_if(as_double(n) > high).alias(f"a{i}")]
    return melt_row(
        df.agg(*aggregates),
        [
            {
                "column": F.lit(n), "min": F.lit(low), "max": F.lit(high),
                "below_min": F.col(f"b{i}"), "above_max": F.col(f"a{i}"),
                "violations": F.col(f"b{i}") + F.col(f"a{i}"),
                "violation_percentage": percent(F.col(f"b{i}") + F.col(f"a{i}"), F.col("rows")),
            }
            for i, (n, (low, high, _, _)) in enumerate(ranges.items())
        ],
    )


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Distinct non-null values per column; one shuffle of map-side distinct ``(column, value)``."""
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(n).alias("column"), c(n).cast("string").alias("value")) for n in columns])
    counted = (
        df.select(F.inline(cells)).filter(F.col("value").isNotNull()).distinct()
        .groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    )
    found = {r["column"]: r["n"] for r in counted.collect()}
    return {n: found.get(n, 0) for n in columns}


def quasi_identifiers(df: DataFrame, probe_rows: int = 10_000) -> list[str]:
    """Known names in their fixed order; without any, string and low-cardinality columns.

    A few rows with LOW_CARDINALITY different values already prove that a column has too many;
    only the columns this leaves open are counted in full.
    """
    named = [n for n in QUASI_IDENTIFIER_NAMES if n in df.columns]
    if named:
        return named
    strings = set(string_columns(df))
    others = [n for n in df.columns if n not in strings]
    probed = distinct_counts(df.limit(probe_rows), others)
    open_ones = [n for n in others if probed[n] < LOW_CARDINALITY]
    counted = distinct_counts(df, open_ones)
    low = {n for n in open_ones if counted[n] < LOW_CARDINALITY}
    return [n for n in df.columns if n in strings or n in low]


def quasi_identifier_table(df: DataFrame) -> DataFrame:
    chosen = quasi_identifiers(df)
    rows = [(i + 1, n) for i, n in enumerate(chosen)]
    return df.sparkSession.createDataFrame(rows, "position int, column string")


def column_roles(df: DataFrame, sequence_key: str | None = None, id_share: float = 0.95) -> dict[str, str]:
    """Role of every column for synthesis: id, categorical, numerical, datetime or boolean.

    Our rule: the sequence key is an id; strings are ids when at least ``id_share`` of their
    non-null values are distinct; integers when all are; the rest follows from the type.
    """
    if sequence_key is not None and sequence_key not in df.columns:
        raise ValueError(f"sequence key {sequence_key!r} not found")
    kinds = {f.name: f.dataType for f in df.schema}
    open_ones = [n for n, k in kinds.items() if isinstance(k, (T.StringType, T.CharType, T.VarcharType, T.IntegralType))]
    # One scan with sketches; only columns that come near the share of an id are counted in full.
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c(n)).alias(f"n{i}") for i, n in enumerate(open_ones)],
                 *[F.approx_count_distinct(c(n), 0.02).alias(f"d{i}") for i, n in enumerate(open_ones)]).first()
    filled = {n: row[f"n{i}"] for i, n in enumerate(open_ones)}
    distinct = {n: row[f"d{i}"] for i, n in enumerate(open_ones)}
    distinct |= distinct_counts(df, [n for n in open_ones if distinct[n] >= 0.8 * id_share * filled[n]])
    roles = {}
    for n, kind in kinds.items():
        if n == sequence_key:
            roles[n] = "id"
        elif isinstance(kind, T.BooleanType):
            roles[n] = "boolean"
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            roles[n] = "datetime"
        elif isinstance(kind, T.IntegralType):
            roles[n] = "id" if filled[n] > 1 and distinct[n] == filled[n] else "numerical"
        elif isinstance(kind, T.NumericType):
            roles[n] = "numerical"
        elif n in distinct:
            roles[n] = "id" if filled[n] > 1 and distinct[n] >= id_share * filled[n] else "categorical"
        else:
            roles[n] = "other"
    return roles


def role_table(df: DataFrame, sequence_key: str | None = None) -> DataFrame:
    return df.sparkSession.createDataFrame(list(column_roles(df, sequence_key).items()), "column string, role string")
