"""Distance to the closest record, approximately: random projections hash records into cells of several tables.

The exact search (:mod:`tabguard.operators.closest`) nears all pairs in many dimensions. Here a record meets only the
real records that share its cell in one of the tables, and the result says how good that was.

Records are written once, with their cells in all tables; a search moves a part of one table's cells at a time and leaves
an id and a distance for each record, so that disk does not grow with the number of tables times the width of a record.
"""

from __future__ import annotations

import math

from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.functions.nearest import PointSet, improve_by_products
from tabguard.operators import closest
from tabguard.operators.closest import GROUP_POINTS, SAMPLE_PER_CELL, SAMPLE_POINTS
from tabguard.schema import numeric_columns
from tabguard.session import scratch_path, shuffle_files_removed, write_and_reread

#: Share of the records whose nearest real record must be found.
RECALL = 0.95
#: Real records a cell should hold; fewer cells are used where that misses the recall.
CELL_POINTS = 2_000
#: Tables to choose from, and records whose exact nearest one decides how many are used (half) and is reported (other half).
TABLES, ASKED_SAMPLE = 24, 2_000
#: Cells of all tables together: the driver holds one row for each.
MOST_CELLS = 1 << 18
#: Rows that are shuffled at a time. Larger tables take so many rounds, to merge copies and to search a table's cells;
#: a round's shuffle files are gone before the next, so a part of the records lies in them, whatever the number of tables.
ROUND_ROWS, MERGE_ROUNDS, SEARCH_ROUNDS = 1 << 24, 2, 4
#: Records of both sides in one group of small cells, and rows of one partition, which so gets many groups of like size.
BIN_POINTS, PARTITION_ROWS = 25_000, 500_000
#: Real records of a cell up to which all of its pairs are bounded by products; beyond, boxes rule out more.
PRODUCT_POINTS = 4_096
#: Rows up to which the distinct records are counted; of a larger table about as many are.
COUNTED_ROWS = 1 << 19


class ProjectionTable:
    """Binary code of a record: at each level one random direction, cut at the median of the sample in that cell.

    The first ``d`` bits of a code are the code at depth ``d``, so one fit serves every depth. Cells are about
    equally full wherever the records lie, which fixed widths would not give.
    """

    def __init__(self, sample: np.ndarray, depth: int, seed: int):
        self.depth = depth
        self.directions = np.random.default_rng(seed).normal(size=(depth, sample.shape[1]))
        self.cuts = [np.zeros(1 << level) for level in range(depth)]
        cell = np.zeros(len(sample), dtype=np.int64)
        for level, cuts in enumerate(self.cuts):
            along = sample @ self.directions[level]
            order = np.lexsort((along, cell))
            first = np.searchsorted(cell[order], np.arange(1 << level))
            size = np.bincount(cell, minlength=1 << level)
            held = size > 0
            cuts[held] = along[order[(first + size // 2)[held]]]
            cell = 2 * cell + (along >= cuts[cell])

    def cut_to(self, depth: int) -> "ProjectionTable":
        """Without the levels below ``depth``: these tables are broadcast."""
        self.depth, self.directions, self.cuts = depth, self.directions[:depth], self.cuts[:depth]
        return self

    def code(self, points: np.ndarray, depth: int) -> np.ndarray:
        cell = np.zeros(len(points), dtype=np.int64)
        for level in range(depth):
            cell = 2 * cell + (points @ self.directions[level] >= self.cuts[level][cell])
        return cell


def _share(df: DataFrame, names: list[str], tag: str, rows: int, total: int) -> np.ndarray:
    """About ``rows`` of the distinct records, by a hash of their values; at most a few times as many reach the driver."""
    if rows < total:
        limit = int(rows / total * (1 << 40))
        df = df.filter(F.pmod(F.xxhash64(F.lit(tag), *names), F.lit(1 << 40)) < limit)
    found = df.select(*names).distinct().toPandas().to_numpy(dtype=float)
    return found[np.lexsort(found.T)]


def _records(df: DataFrame, names: list[str], rows: int) -> int:
    """Distinct records; of many rows those in a share of the hashes are counted, as they only set the sizes of samples and cells."""
    parts = max(1, rows // COUNTED_ROWS)
    if parts > 1:
        counted = df.filter(F.pmod(F.xxhash64(F.lit("count"), *names), F.lit(parts)) == 0).distinct().count()
        if counted > 1_000:
            return counted * parts
    # A small table, or one of so many copies that all distinct records are as cheap to count.
    return df.distinct().count()


def _by_rounds(df: DataFrame, keys: list[str], rows: int, group: Callable[[DataFrame, int], DataFrame], tag: str) -> DataFrame:
    """``group`` of all rows, a part of the keys at a time, as a written table."""
    path, rounds = scratch_path(df.sparkSession, tag), min(MERGE_ROUNDS, max(1, -(-rows // ROUND_ROWS)))
    own = F.pmod(F.xxhash64(F.lit("round"), *keys), F.lit(rounds))
    for r in range(rounds):
        part = group(df.filter(own == r) if rounds > 1 else df, r)
        part.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(part.schema).parquet(path)


def _matrix(table: pa.RecordBatch | pa.Table, names: list[str]) -> np.ndarray:
    return np.column_stack([np.asarray(table.column(n)) for n in names])


def _one_of_copies(points: np.ndarray) -> np.ndarray:
    """Without copies, which all would be as near as each other; found by one projection and then compared."""
    _, first, at = np.unique(points @ np.sqrt(np.arange(2.0, points.shape[1] + 2)), return_index=True, return_inverse=True)
    alike = (points == points[first[at]]).all(axis=1)
    return points if len(first) == len(points) else np.vstack([points[first], points[~alike]])


def _exact_nearest(points: DataFrame, names: list[str], asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of all real records to each of ``asked``: a task keeps one candidate a record, then one group a record."""
    shared = points.sparkSession.sparkContext.broadcast(asked)

    def search(batches):
        want = shared.value
        best, where = np.full(len(want), np.inf), np.zeros((len(want), len(names)))
        for batch in batches:
            real, at = _one_of_copies(_matrix(batch, names)), np.full(len(want), -1)
            improve_by_products(real, want, best, at)
            where[at >= 0] = real[at[at >= 0]]
        if len(want):
            columns = [*where.T, np.arange(len(want)), best]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=[*names, "q", "square"])

    held = points.select(*names).mapInArrow(search, closest._schema(names, "q long", "square double"))
    nearest = held.groupBy("q").agg(F.min_by(F.struct("square", *names), F.struct("square", *names)).alias("b")).select("q", "b.*")
    found = nearest.orderBy("q").toPandas()
    return found[names].to_numpy(dtype=float), np.sqrt(found["square"].to_numpy(dtype=float))


def _choose(table: Callable[[int], ProjectionTable], depth: int, asked: np.ndarray, nearest: np.ndarray, recall: float) -> tuple[int, int]:
    """Depth and number of tables with the least work (tables x share of a cell) that reach ``recall`` on these records.

    Of equal work the deeper choice, with more tables, as its misses come closer. At depth 0 one cell holds everything, so there always is a choice.
    """
    best, least = (0, 1), 1.0
    codes = []
    for d in range(1, depth + 1):
        met = np.zeros(len(asked), dtype=bool)
        for used in range(1, TABLES + 1):
            if (used << d) > MOST_CELLS or used / (1 << d) > least:
                break
            if used > len(codes):  # few tables are ever tried, and the driver fits them
                codes.append((table(used - 1).code(asked, depth), table(used - 1).code(nearest, depth)))
            met |= (codes[used - 1][0] >> (depth - d)) == (codes[used - 1][1] >> (depth - d))
            if met.mean() >= recall:
                best, least = (d, used), used / (1 << d)
                break
    return best


def approximate_distances(
    real: DataFrame,
    synth: DataFrame,
    columns: list[str] | None = None,
    recall: float = RECALL,
    cell_points: int = CELL_POINTS,
    seed: int = 17,
) -> tuple[DataFrame, dict]:
    """``(x0.., n, distance)`` as :func:`closest.closest_distances` gives it, and how it was reached.

    Both tables are read several times: what is dear to compute should be written first.
    A distance is that of some real record: never below the exact one, and equal to it for about ``recall`` of the
    records. Every record has one: those that met no real record in any table are searched exactly. Copies are merged,
    and a cell with many records is cut into chunks, as in the exact search. The dictionary holds ``tables``, ``depth``,
    ``measured_recall`` and the relative errors over records that had no part in the choice of tables, and
    ``sample_records``, their number; without complete synthetic rows the measures are None.
    """
    asked, best, told = _distances(real, synth, columns, recall, cell_points, seed)
    return asked.join(best.select("id", "distance"), "id").drop("id"), told


def _distances(
    real: DataFrame, synth: DataFrame, columns: list[str] | None = None, recall: float = RECALL, cell_points: int = CELL_POINTS, seed: int = 17
) -> tuple[DataFrame, DataFrame, dict]:
    """Written tables ``(id, x0.., n)`` of the distinct records and ``(id, n, distance)``, and how they were reached."""
    columns = columns or [n for n in numeric_columns(real) if n in synth.columns]
    if not columns:
        raise ValueError("no numeric column in common")
    with shuffle_files_removed(real.sparkSession):
        scaled, names = closest.standardised(real, synth, columns)
        rows, asked_rows = real.count(), synth.count()
        real, synth = (side.select(*scaled).na.drop("any") for side in (real, synth))
        total, wanted = _records(real, names, rows), _records(synth, names, asked_rows)
        told = {"tables": 0, "depth": 0, "measured_recall": None, "mean_relative_error": None, "max_relative_error": None, "sample_records": 0}
        if not wanted:
            none = synth.withColumns({"id": F.lit(0).cast("long"), "n": F.lit(0).cast("long"), "distance": F.lit(None).cast("double")})
            return none.drop("distance"), none.drop(*names), told

        depth = min(int(math.log2(MOST_CELLS)), max(0, math.ceil(math.log2(total / cell_points))))
        sample = _share(real, names, "shape", max(SAMPLE_POINTS, SAMPLE_PER_CELL << depth), total)
        fitted = cache(lambda i, depth=depth: ProjectionTable(sample, depth, seed + i))
        trial = _share(synth, names, "trial", ASKED_SAMPLE, wanted)
        nearest, apart = _exact_nearest(real, names, trial)
        # Records are distinct and picked by a hash, but they come in order: deal them out.
        order = np.random.default_rng(seed).permutation(len(trial))
        fit, held = (order[::2], order[1::2]) if len(trial) > 1 else (order, order)
        depth, used = _choose(fitted, depth, trial[fit], nearest[fit], recall)
        tables = [fitted(i).cut_to(depth) for i in range(used)]

        points, asked = _placed(real, synth, names, tables, depth, rows, asked_rows)
        found = _search(points, asked, names, used, depth)
        # A record is found once by each table, and by each chunk of a large cell.
        nearer = [F.first("n").alias("n"), F.min("distance").alias("distance")]
        best = _by_rounds(found, ["id"], used * asked_rows, lambda part, _: part.groupBy("id").agg(*nearer), "approximate")
        if best.count() < asked.count():
            alone = write_and_reread(asked.join(best.select("id"), "id", "left_anti").select("id", "n", *names), "alone")
            # The id takes the place of the number of rows, which the exact search only hands on.
            rest = closest.nearest_of(points.select(*names), alone.select(*names, F.col("id").alias("n")), names)
            rest = rest.select(F.col("n").alias("id"), "distance").join(alone.select("id", "n"), "id")
            best = write_and_reread(best.unionByName(rest), "approximate")

        # One row for each record of the trial: bounded by ASKED_SAMPLE.
        exact = pd.DataFrame(trial[held], columns=names).assign(exact=apart[held])
        tried = asked.join(F.broadcast(asked.sparkSession.createDataFrame(exact)), names).select("id", "exact")
        compared = best.join(F.broadcast(tried), "id").select("exact", "distance").toPandas()
    error = compared["distance"] - compared["exact"]
    hit = error <= 1e-9 * (1 + compared["exact"])
    # Where the exact distance is 0 a miss has no relative error: it counts in the recall.
    relative = (error / compared["exact"])[compared["exact"] > 0].clip(lower=0)
    told |= {
        "tables": used, "depth": depth, "measured_recall": float(hit.mean()), "sample_records": len(compared),
        "mean_relative_error": float(relative.mean()) if len(relative) else 0.0,
        "max_relative_error": float(relative.max()) if len(relative) else 0.0,
    }
    return asked.select("id", *names, "n"), best, told


def _placed(
    real: DataFrame, synth: DataFrame, names: list[str], tables: list[ProjectionTable], depth: int, rows: int, asked_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Distinct records of both sides with their cells ``c0..`` in the tables; those of ``synth`` with an id and their rows."""
    shared = real.sparkSession.sparkContext.broadcast(tables)
    codes = [f"c{i} int" for i in range(len(tables))]

    def place(batches):
        for batch in batches:
            values = _matrix(batch, names)
            cells = [pa.array(table.code(values, depth).astype(np.int32)) for table in shared.value]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cells], names=[*batch.schema.names, *[f"c{i}" for i in range(len(cells))]])

    def distinct(part, _):
        return part.distinct().mapInArrow(place, closest._schema(names, *codes))

    def counted(part, r):
        merged = part.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).mapInArrow(place, closest._schema(names, "n long", *codes))
        # The rounds' numbers begin far apart, above those of 2^22 partitions.
        return merged.withColumn("id", F.monotonically_increasing_id() + F.lit(r << 55))

    return _by_rounds(real, names, rows, distinct, "points"), _by_rounds(synth, names, asked_rows, counted, "asked")


def _plan(real_size: np.ndarray, asked_size: np.ndarray, limit: int) -> pd.DataFrame:
    """One row for each cell with records on both sides: its chunks ``rc`` and ``ac``, its ``bin`` and ``round``.

    Cells next to each other share a bin, which is one group. A cell with more than GROUP_POINTS records of a side is cut into
    chunks, every one of which meets every chunk of the other side. Where that moves more than ``limit`` rows, the chunks of
    the asked side take turns: ``low`` to ``high`` - 1 of them in one row.
    """
    cell = np.flatnonzero((real_size > 0) & (asked_size > 0))
    real, asked = real_size[cell], asked_size[cell]
    rc, ac = -(-real // GROUP_POINTS), -(-asked // GROUP_POINTS)
    turns = np.minimum(ac, -(-(real * ac + asked * rc) // limit))
    at = np.repeat(np.arange(len(cell)), turns)
    turn = np.arange(len(at)) - np.repeat(np.cumsum(turns) - turns, turns)
    low, high = turn * ac[at] // turns[at], (turn + 1) * ac[at] // turns[at]
    moved = real[at] * (high - low) + asked[at] * rc[at] * (high - low) // ac[at]
    weight = np.minimum(real, GROUP_POINTS) + np.minimum(asked, GROUP_POINTS)
    return pd.DataFrame({
        "cell": cell[at].astype(np.int32), "rc": rc[at], "ac": ac[at], "low": low, "high": high,
        "bin": (np.cumsum(weight) // BIN_POINTS)[at], "round": (np.cumsum(moved) - moved) // limit, "moved": moved,
    })


def _search(points: DataFrame, asked: DataFrame, names: list[str], used: int, depth: int) -> DataFrame:
    """``(id, n, distance)``: every record against the real records of its cell, by table and by ranges of cells."""
    spark = points.sparkSession
    path, schema = scratch_path(spark, "found"), "id long, n long, distance double"
    spark.createDataFrame([], schema).write.parquet(path)
    for i in range(used):
        ours, theirs = points.select(*names, F.col(f"c{i}").alias("cell")), asked.select("id", "n", *names, F.col(f"c{i}").alias("cell"))
        real_size, asked_size = (closest._cell_table(side.select("cell"), 1 << depth)[0] for side in (ours, theirs))
        limit = max(ROUND_ROWS, -(-int(real_size.sum() + asked_size.sum()) // SEARCH_ROUNDS))
        for _, cells in _plan(real_size, asked_size, limit).groupby("round"):
            _search_cells(ours, theirs, names, cells).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _search_cells(points: DataFrame, asked: DataFrame, names: list[str], cells: pd.DataFrame) -> DataFrame:
    between = F.col("cell").between(int(cells["cell"].min()), int(cells["cell"].max()))

    def planned(side: DataFrame) -> DataFrame:
        # One row a cell with records on both sides: at most MOST_CELLS, and a few more for large cells.
        plan = side.sparkSession.createDataFrame(cells[["cell", "rc", "ac", "low", "high", "bin"]])
        return side.filter(between).join(F.broadcast(plan), "cell")

    left, right, keys = planned(points), planned(asked), ["bin"]
    if (cells["rc"] * cells["ac"] > 1).any():
        keys = ["bin", "r", "a"]
        chunk = F.xxhash64(*names)
        left = left.withColumn("r", F.pmod(chunk, "rc")).withColumn("a", F.explode(F.sequence("low", F.col("high") - 1)))
        right = right.withColumn("a", F.pmod(chunk, "ac")).filter("a >= low AND a < high").withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rc") - 1)))

    def search(real: pa.Table, wanted: pa.Table) -> pa.Table:
        values, queries = _matrix(real, names), _matrix(wanted, names)
        here, there = real.column("cell").to_numpy(), wanted.column("cell").to_numpy()
        by, of = np.argsort(here, kind="stable"), np.argsort(there, kind="stable")
        best = np.full(len(there), np.inf)
        starts = np.flatnonzero(np.diff(there[of], prepend=-1))
        for start, end in zip(starts, np.r_[starts[1:], len(of)]):
            low, high = np.searchsorted(here, [there[of[start]], there[of[start]] + 1], sorter=by)
            points, asked = values[by[low:high]], queries[of[start:end]]
            if len(points) > PRODUCT_POINTS:
                best[of[start:end]] = PointSet(points).nearest(asked)
            else:
                squares = np.full(len(asked), np.inf)
                improve_by_products(points, asked, squares)
                best[of[start:end]] = np.sqrt(squares)
        # Without a real record in this group: another one has them, or the record is alone.
        met = best < np.inf
        return pa.table({"id": wanted.column("id").to_numpy()[met], "n": wanted.column("n").to_numpy()[met], "distance": best[met]})

    partitions = max(closest._partitions(points), -(-int(cells["moved"].sum()) // PARTITION_ROWS))
    left, right = left.select(*keys, "cell", *names), right.select(*keys, "cell", "id", "n", *names)
    left, right = (side.repartition(partitions, *keys).groupBy(*keys) for side in (left, right))
    return left.cogroup(right).applyInArrow(search, "id long, n long, distance double")


def approximate_record_report(real: DataFrame, synth: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """:func:`closest.closest_record_report` from approximate distances, with the measured recall and errors.

    Distances are never too short, so ``close_records`` is a lower bound and the score an upper one.
    """
    _, best, told = _distances(real, synth, **options)
    with shuffle_files_removed(best.sparkSession):
        report = closest.report_of(best.select("n", "distance"), threshold)
    return report.select(
        "*",
        F.lit(told["tables"]).alias("tables"),
        F.lit(told["depth"]).alias("depth"),
        *[F.lit(told[m]).cast("double").alias(m) for m in ("measured_recall", "mean_relative_error", "max_relative_error")],
        F.lit(told["sample_records"]).cast("long").alias("sample_records"),
    )
