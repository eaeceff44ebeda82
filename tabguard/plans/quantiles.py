"""Values at exact ranks, and quantiles by linear interpolation between them.

Sketches lay out buckets, a count finds the buckets that hold the wanted ranks, and those that are
still too large are cut again: by their own sketches, and in the middle of their range, so that each
round divides them whatever the sketches say. Only rows of the last buckets are shuffled, and no task
gets more than a bucket's distinct values.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabguard.plans.ordered import bucket_count, long_values
from tabguard.plans.sketches import even_cuts, finite, inner_quantiles, merged_sketches
from tabguard.schema import as_double, c

#: Rows that one task may sort: columns up to that size are one bucket.
SMALL_ROWS = 1_000_000


def values_at_ranks(
    df: DataFrame, ranks: dict[str, list[int]], rows: dict[str, int], small_rows: int = SMALL_ROWS, weight: str | None = None
) -> dict[str, dict[int, float]]:
    """For each column the values at the given places (from 0) of its sorted non-null values.

    ``rows`` are the columns' numbers of non-null values. With ``weight`` each row stands for that
    many equal rows, and places count those. NaN sorts behind all numbers.
    """
    columns = [n for n in ranks if ranks[n]]
    if not columns:
        return {}
    large = [n for n in columns if rows[n] > small_rows]
    found = even_cuts(df, [as_double(n) for n in large], bucket_count(df), small_rows) if large else []
    cuts = {n: [] for n in columns} | {n: finite(x) for n, x in zip(large, found)}
    long = _long(df, columns, cuts, weight)
    if large:
        for _ in range(80):
            profile = _profile(long)
            crowded = [b for b in _wanted(profile, columns, ranks) if b["rows"] > small_rows and b["low"] < b["high"]]
            if not crowded:
                break
            inside = long.join(F.broadcast(_table(df, [(b["column"], b["bucket"]) for b in crowded])), ["column", "bucket"])
            inner = merged_sketches(inside, ["column", "bucket"], F.col("value"), 16).select("column", "bucket", inner_quantiles(16).alias("cuts"))
            more = {(r["column"], r["bucket"]): r["cuts"] for r in inner.collect()}
            for b in crowded:
                middle = b["low"] + (b["high"] - b["low"]) / 2
                halves = middle if b["low"] < middle <= b["high"] else b["high"]
                name = columns[b["column"]]
                cuts[name] = finite([*cuts[name], halves, *(more.get((b["column"], b["bucket"])) or [])])
            long = _long(df, columns, cuts, weight)
    return _pick(df, long, _wanted(_profile(long), columns, ranks), columns)


def _long(df, columns, cuts, weight):
    if weight is None:
        return long_values(df, columns, cuts).withColumn("n", F.lit(1))
    return long_values(df, columns, cuts, weight).withColumnRenamed("weight", "n")


def _table(df, keys):
    return df.sparkSession.createDataFrame(keys, "column int, bucket int")


def _profile(long: DataFrame) -> list:
    """One row for each column and bucket: rows, weight, least and largest value."""
    return long.groupBy("column", "bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    ).orderBy("column", "bucket").collect()


def _wanted(profile: list, columns: list[str], ranks: dict[str, list[int]]) -> list[dict]:
    """The buckets that hold a wanted rank, with the ranks inside them."""
    out = []
    below = dict.fromkeys(range(len(columns)), 0)
    for row in profile:
        first = below[row["column"]]
        below[row["column"]] += row["n"]
        held = sorted({r - first for r in ranks[columns[row["column"]]] if first <= r < first + row["n"]})
        if held:
            out.append({**row.asDict(), "first": first, "held": held})
    return out


def _pick(df: DataFrame, long: DataFrame, wanted: list[dict], columns: list[str]) -> dict[str, dict[int, float]]:
    out: dict[str, dict[int, float]] = {n: {} for n in columns}
    several = []
    for b in wanted:
        if b["low"] == b["high"]:
            out[columns[b["column"]]].update({b["first"] + r: b["low"] for r in b["held"]})
        else:
            several.append((b["column"], b["bucket"], b["held"]))
    if not several:
        return out
    asked = df.sparkSession.createDataFrame(several, "column int, bucket int, held array<long>")
    # As many rows as ranks at most.
    counted = long.join(F.broadcast(asked.drop("held")), ["column", "bucket"]).groupBy("column", "bucket", "value").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("column", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("upto", F.sum("n").over(order)).join(F.broadcast(asked), ["column", "bucket"])
    hit = F.filter("held", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
    firsts = {(b["column"], b["bucket"]): b["first"] for b in wanted}
    for row in ranked.select("column", "bucket", "value", F.explode(hit).alias("rank")).collect():
        out[columns[row["column"]]][firsts[row["column"], row["bucket"]] + row["rank"]] = row["value"]
    return out


def _interpolated(found: dict[int, float], place: float) -> float:
    low, high = found[math.floor(place)], found[math.ceil(place)]
    return low + (high - low) * (place - math.floor(place)) if low != high else low


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], small_rows: int = SMALL_ROWS, rows: dict[str, int] | None = None
) -> dict[str, list[float | None]]:
    """Quantiles per column, None for a column without values. Nothing is approximate.

    ``rows``, if known, are the columns' numbers of non-null values; they cost a scan otherwise.
    """
    if not columns:
        return {}
    if rows is None:
        profile = df.agg(*[F.count(c(n)).alias(f"n{i}") for i, n in enumerate(columns)]).first()
        rows = {n: profile[f"n{i}"] for i, n in enumerate(columns)}
    places = {n: [p * (rows[n] - 1) for p in probabilities] for n in columns if rows[n]}
    ranks = {n: sorted({f(x) for x in at for f in (math.floor, math.ceil)}) for n, at in places.items()}
    found = values_at_ranks(df, ranks, rows, small_rows)
    return {n: [_interpolated(found[n], x) for x in places[n]] if n in places else [None] * len(probabilities) for n in columns}


def weighted_quantiles(df: DataFrame, value: str, weight: str, probabilities: list[float], small_rows: int = SMALL_ROWS) -> list[float | None]:
    """Exact quantiles of ``value`` where each row stands for ``weight`` equal rows."""
    row = df.filter(c(value).isNotNull()).agg(F.sum(c(weight)).alias("total"), F.count(F.lit(1)).alias("rows")).first()
    if not row["total"]:
        return [None] * len(probabilities)
    places = [p * (row["total"] - 1) for p in probabilities]
    ranks = sorted({f(x) for x in places for f in (math.floor, math.ceil)})
    found = values_at_ranks(df, {value: ranks}, {value: row["rows"]}, small_rows, weight)[value]
    return [_interpolated(found, x) for x in places]
