"""Comparison of a real and a synthetic table: statistics, histograms, correlation, groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabguard.functions.statistics import pearson
from tabguard.plans.quantiles import exact_quantiles
from tabguard.schema import as_double, c, melt_row, numeric_columns, require_columns, string_columns

# Units of common medical measurements.
UNITS = {
    "Pregnancies": "count", "Glucose": "mg/dL", "BloodPressure": "mm Hg", "SkinThickness": "mm", "Insulin": "uU/mL",
    "BMI": "kg/m^2", "DiabetesPedigreeFunction": "score", "Age": "years", "Outcome": "0/1",
}
QUARTILES = [0.25, 0.5, 0.75]


def numeric_summary(real: DataFrame, synth: DataFrame, exact: bool = True) -> DataFrame:
    """One row per numeric column of ``real``. A column ``synth`` lacks has null synthetic metrics."""
    columns = numeric_columns(real)
    common = [n for n in columns if n in synth.columns]
    moments = ("mean", "std", "min", "max")

    def measure(df, names):
        if not names:
            return {}
        how = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "n": F.count}
        row = df.agg(*[how[m](as_double(n)).alias(f"{m}{i}") for i, n in enumerate(names) for m in how]).first()
        return {n: {m: row[f"{m}{i}"] for m in how} for i, n in enumerate(names)}

    of_real, of_synth = measure(real, columns), measure(synth, common)
    if exact:
        quartiles = exact_quantiles(synth, common, QUARTILES, rows={n: of_synth[n]["n"] for n in common})
    elif common:
        row = synth.agg(*[F.percentile_approx(as_double(n), QUARTILES, 10_000).alias(f"q{i}") for i, n in enumerate(common)]).first()
        quartiles = {n: list(row[f"q{i}"] or [None] * 3) for i, n in enumerate(common)}
    else:
        quartiles = {}
    rows = []
    for n in columns:
        s = of_synth.get(n, dict.fromkeys(moments))
        q = quartiles.get(n) or [None] * 3
        rows.append((n, UNITS.get(n, ""), s["mean"], s["std"], s["min"], *q, s["max"], of_real[n]["mean"], of_real[n]["std"]))
    return real.sparkSession.createDataFrame(
        rows,
        "column string, unit string, mean double, std double, min double, p25 double, p50 double, p75 double, max double, "
        "real_mean double, real_std double",
    )


def _value_counts(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    def cells(df, side):
        present = [n for n in columns if n in df.columns]
        array = F.array(*[F.struct(F.lit(n).alias("column"), c(n).cast("string").alias("value")) for n in present])
        return df.select(F.lit(side).alias("side"), F.inline(array)).filter(F.col("value").isNotNull())

    both = cells(real, "real").unionByName(cells(synth, "synth")) if any(n in synth.columns for n in columns) else cells(real, "real")
    return both.groupBy("side", "column", "value").agg(F.count(F.lit(1)).alias("n"))


def categorical_summary(real: DataFrame, synth: DataFrame, top: int = 5) -> DataFrame:
    """``top`` values per side and string column with their percentage, and the distinct counts.

    Ranking keeps ``top`` rows per task before its shuffle, so a column of unique strings is fine.
    """
    columns = string_columns(real)
    if not columns:
        return real.sparkSession.createDataFrame([], "side string, column string, rank int, value string, percentage double, distinct_values long")
    counts = _value_counts(real, synth, columns)
    totals = counts.groupBy("side", "column").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_values"))
    order = Window.partitionBy("side", "column").orderBy(F.desc("n"), "value")
    best = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    # totals has one row per side and column.
    return best.join(F.broadcast(totals), ["side", "column"]).select(
        "side", "column", "rank", "value", F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("percentage"), "distinct_values"
    )


def histogram(real: DataFrame, synth: DataFrame, bins: int = 30) -> DataFrame:
    """Counts per side, numeric column and bin over the joint range; empty bins are listed.

    A column that ``synth`` lacks has one row with null bin and count.
    """
    columns = [n for n in numeric_columns(real) if n in synth.columns]
    absent = real.sparkSession.createDataFrame(
        [("synth", n, None, None, None, None) for n in numeric_columns(real) if n not in columns], "side string, column string, bin int, low double, high double, n long")
    ranges = [
        df.agg(*[f(as_double(n)).alias(f"{a}{i}") for i, n in enumerate(columns) for a, f in (("lo", F.min), ("hi", F.max))]).first()
        for df in (real, synth)
    ]
    bounds = {}
    for i, n in enumerate(columns):
        lows = [r[f"lo{i}"] for r in ranges if r[f"lo{i}"] is not None]
        highs = [r[f"hi{i}"] for r in ranges if r[f"hi{i}"] is not None]
        if lows:
            bounds[n] = (min(lows), max(highs))

    def cells(df, side):
        entries = []
        for n, (low, high) in bounds.items():
            place = F.floor((as_double(n) - F.lit(low)) * F.lit(float(bins)) / F.lit((high - low) or 1.0))
            at = F.when(place.isNotNull(), F.least(place.cast("int") + F.lit(1), F.lit(bins)))
            entries.append(F.struct(F.lit(n).alias("column"), at.alias("bin")))
        return df.select(F.lit(side).alias("side"), F.inline(F.array(*entries))).filter(F.col("bin").isNotNull())

    schema = "side string, column string, bin int, low double, high double"
    spark = real.sparkSession
    frame = [
        (side, n, b, low + (high - low) * (b - 1) / bins, low + (high - low) * b / bins)
        for side in ("real", "synth") for n, (low, high) in bounds.items() for b in range(1, bins + 1)
    ]
    scaffold = spark.createDataFrame(frame, schema)
    if not bounds:
        return scaffold.withColumn("n", F.lit(0).cast("long")).unionByName(absent)
    counts = cells(real, "real").unionByName(cells(synth, "synth")).groupBy("side", "column", "bin").agg(F.count(F.lit(1)).alias("n"))
    return scaffold.join(F.broadcast(counts), ["side", "column", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0))).unionByName(absent)


def correlation(real: DataFrame, synth: DataFrame, pairs_per_scan: int = 500) -> DataFrame:
    """Pearson correlation of every column pair of ``real`` on both sides, and the absolute difference.

    A pair with a column that ``synth`` lacks has a null correlation there, and a null difference.

    One scan per side for up to ``pairs_per_scan`` pairs; wide tables take several scans, as
    one aggregate with thousands of expressions would leave generated code.
    """
    columns = numeric_columns(real)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]

    def matrix(df, side):
        parts = []
        for start in range(0, len(pairs), pairs_per_scan):
            chunk = pairs[start:start + pairs_per_scan]
            here = [a in df.columns and b in df.columns for a, b in chunk]
            wide = df.agg(*[pearson(as_double(a), as_double(b)).alias(f"r{i}") if ok else F.lit(None).cast("double").alias(f"r{i}")
                            for i, ((a, b), ok) in enumerate(zip(chunk, here))])
            parts.append(melt_row(wide, [
                {"col_a": F.lit(a), "col_b": F.lit(b), side: F.col(f"r{i}")} for i, (a, b) in enumerate(chunk)
            ]))
        return reduce(DataFrame.unionByName, parts)

    if not pairs:
        return real.sparkSession.createDataFrame([], "col_a string, col_b string, real_corr double, synth_corr double, diff double")
    # One row per column pair on both sides.
    joined = matrix(real, "real_corr").join(F.broadcast(matrix(synth, "synth_corr")), ["col_a", "col_b"])
    return joined.withColumn("diff", F.abs(F.col("real_corr") - F.col("synth_corr")))


def correlation_matrix(df: DataFrame) -> DataFrame:
    """Full symmetric matrix of one table as ``(col_a, col_b, corr)``, the diagonal included."""
    columns = numeric_columns(df)
    entries = [(a, b) for a in columns for b in columns]
    wide = df.agg(*[pearson(as_double(a), as_double(b)).alias(f"r{i}") for i, (a, b) in enumerate(entries)])
    return melt_row(wide, [{"col_a": F.lit(a), "col_b": F.lit(b), "corr": F.col(f"r{i}")} for i, (a, b) in enumerate(entries)])


def _group_moments(df: DataFrame, protected: str) -> tuple[list, list[str]]:
    require_columns(df, [protected])
    columns = [n for n in numeric_columns(df) if n != protected]
    present = df.filter(c(protected).isNotNull())
    found = [r[0] for r in present.select(c(protected)).distinct().limit(3).collect()]
    if len(found) != 2:
        raise ValueError(f"protected column {protected!r} needs exactly two values, found {'more' if len(found) > 2 else len(found)}")
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(columns):
        aggregates += [F.avg(as_double(n)).alias(f"m{i}"), F.stddev_samp(as_double(n)).alias(f"s{i}")]
    return present.groupBy(c(protected).alias("group")).agg(*aggregates).orderBy("group").collect(), columns


def flip_test(df: DataFrame, protected: str, bias_percentage: float = 20.0) -> DataFrame:
    """Group a (the smaller value) against group b, one row per other numeric column."""
    (a, b), columns = _group_moments(df, protected)
    rows = [(n, str(a["group"]), a["rows"], str(b["group"]), b["rows"], a[f"m{i}"], b[f"m{i}"], a[f"s{i}"], b[f"s{i}"])
            for i, n in enumerate(columns)]
    raw = df.sparkSession.createDataFrame(
        rows,
        "column string, group_a_value string, group_a_count long, group_b_value string, group_b_count long, "
        "ma double, mb double, sa double, sb double",
    )
    difference = F.abs(F.col("ma") - F.col("mb"))
    relative = F.coalesce(F.try_divide(difference * 100.0, F.abs(F.col("ma"))), F.lit(0.0))
    return raw.select(
        "column", "group_a_value", "group_a_count", "group_b_value", "group_b_count",
        F.round("ma", 2).alias("group_a_mean"), F.round("mb", 2).alias("group_b_mean"), F.round(difference, 2).alias("mean_diff"),
        F.round("sa", 2).alias("group_a_std"), F.round("sb", 2).alias("group_b_std"),
        F.round(F.abs(F.col("sa") - F.col("sb")), 2).alias("std_diff"),
        F.round(relative, 2).alias("diff_percentage"), (relative > bias_percentage).alias("biased"),
    )


def fairness_score(flipped: DataFrame) -> DataFrame:
    """One row from a :func:`flip_test` table: biased columns, and the share of unbiased ones."""
    biased = F.count_if("biased")
    return flipped.agg(
        F.count(F.lit(1)).alias("columns"), biased.alias("total_biased_columns"),
        F.round(F.coalesce(F.try_divide((F.count(F.lit(1)) - biased) * 100.0, F.count(F.lit(1))), F.lit(100.0)), 2).alias("fairness_score"),
    )
