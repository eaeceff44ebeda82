"""The most frequent values of every string column without shuffling the column: candidates, then exact counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabguard.schema import c, string_columns
from tabguard.session import write_and_reread

#: Counters a task keeps for each column in the first round; each further round keeps eight times as many.
COUNTERS = 1_000
#: Counters, and bytes of candidate values, above which what is left open is counted value by value.
MOST_COUNTERS, CANDIDATE_BYTES = 64_000, 32 << 20


class Counters:
    """Misra-Gries counts of one column in one task: a value's count lies between ``held`` and ``held + lost``."""

    def __init__(self, size: int):
        self.size, self.lost, self.rows = size, 0, 0
        self.held = pd.Series(dtype="int64")

    def add(self, values: pd.Series) -> None:
        seen = values.value_counts()
        self.rows += int(seen.sum())
        self.held = self.held.add(seen, fill_value=0).astype("int64") if len(self.held) else seen.astype("int64")
        if len(self.held) > self.size:
            # Taking the (size + 1)-th largest count from all leaves at most ``size`` and is what a value can lose.
            cut = int(self.held.nlargest(self.size + 1).iloc[-1])
            self.lost += cut
            self.held = self.held[self.held > cut] - cut


def _summaries(df: DataFrame, columns: list[str], counters: int) -> DataFrame:
    """``(column, value, held, lost, rows)``: at most ``counters`` rows a task and column, and one with a null value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [Counters(counters) for _ in columns]
        for pdf in batches:
            for i, mine in enumerate(kept):
                mine.add(pdf[f"s{i}"].dropna())
        for i, mine in enumerate(kept):
            yield pd.DataFrame({"column": i, "value": [None, *mine.held.index], "held": [0, *mine.held], "lost": mine.lost, "rows": mine.rows})

    chosen = df.select(*[c(n).cast("string").alias(f"s{i}") for i, n in enumerate(columns)])
    return chosen.mapInPandas(run, "column int, value string, held long, lost long, rows long")


def _cells(df: DataFrame, columns: dict[int, str]) -> DataFrame:
    array = F.array(*[F.struct(F.lit(i).alias("column"), c(n).cast("string").alias("value")) for i, n in columns.items()])
    return df.select(F.inline(array)).filter(F.col("value").isNotNull())


def _ranked(counts: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def top_values(df: DataFrame, top: int = 5, counters: int = COUNTERS, most_counters: int = MOST_COUNTERS) -> DataFrame:
    """``(column, rank, value, n, percentage, rounds)``: the ``top`` most frequent values, ties to the smaller value.

    Exact. Each task keeps a bounded number of counters a column; a value kept nowhere has at most
    ``lost`` rows, the sum of what the tasks lost. The values that may be among the first are counted
    in a second scan, broadcast and added up before the shuffle. A column is settled if its ``top``-th count
    exceeds ``lost``, or if nothing was lost. The others go into another round with eight times the counters, and beyond
    ``most_counters``, or where the candidates are too long to broadcast, are counted value by value:
    such a column has no value that stands out. ``rounds`` says how many rounds a column took, 0 for that last way.
    Nulls are no values; a column without any has no row.
    """
    spark = df.sparkSession
    schema = "column int, rank int, value string, n long, total long, rounds int"
    names = string_columns(df)
    open_columns, settled, rounds = dict(enumerate(names)), [], 0
    while open_columns and counters <= most_counters:
        rounds += 1
        places = list(open_columns)
        found = write_and_reread(_summaries(df, [open_columns[i] for i in places], counters), "summaries")
        # One row a column: what a value can have lost in all tasks together, and the rows with a value.
        bounds = {r["column"]: r for r in found.filter("value is null").groupBy("column").agg(F.sum("lost").alias("lost"), F.sum("rows").alias("rows")).collect()}
        values = found.filter("value is not null").groupBy("column", "value").agg(F.sum("held").alias("held"))
        # The top-th largest lower bound: what cannot reach it is out.
        floor = values.withColumn("at", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("held")))).filter(F.col("at") <= top)
        least = {r["column"]: r["held"] for r in floor.groupBy("column").agg(F.min("held").alias("held"), F.count(F.lit(1)).alias("k")).filter(F.col("k") == top).collect()}
        reach = F.col("held") + F.element_at(F.array(*[F.lit(bounds[i]["lost"] if i in bounds else 0) for i in range(len(places))]), F.col("column") + 1)
        enough = F.element_at(F.array(*[F.lit(least.get(i, 0)) for i in range(len(places))]), F.col("column") + 1)
        wanted = write_and_reread(values.filter(reach >= enough).select("column", "value"), "candidates")
        size = wanted.agg(F.sum(F.octet_length("value") + 16)).first()[0] or 0
        if size > CANDIDATE_BYTES:
            break
        # Checked above: at most CANDIDATE_BYTES.
        cells = _cells(df, {at: open_columns[i] for at, i in enumerate(places)})
        exact = cells.join(F.broadcast(wanted), ["column", "value"]).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        best = _ranked(exact, top).collect()  # ``top`` rows a column
        for at, i in enumerate(places):
            mine = [r for r in best if r["column"] == at]
            lost = bounds[at]["lost"] if at in bounds else 0
            # A value without a counter has at most ``lost`` rows: it comes behind these.
            if not lost or (len(mine) == top and min(r["n"] for r in mine) > lost):
                settled += [(i, r["rank"], r["value"], r["n"], bounds[at]["rows"], rounds) for r in mine]
                del open_columns[i]
        counters *= 8
    result = spark.createDataFrame(settled, schema)
    if open_columns:
        counts = write_and_reread(_cells(df, open_columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), "values")
        totals = counts.groupBy("column").agg(F.sum("n").alias("total"))  # one row a column
        last = _ranked(counts, top).join(F.broadcast(totals), "column")
        result = result.unionByName(last.select("column", "rank", "value", "n", "total", F.lit(0).alias("rounds")))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("column") + 1) if names else F.lit(None).cast("string")
    return result.select(
        name.alias("column"), "rank", "value", "n", F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("percentage"), "rounds")
