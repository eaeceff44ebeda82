"""Distance from every synthetic record to the closest real record, exact at any size."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabguard.functions.nearest import PointSet, SplitTree
from tabguard.plans.lookups import lookup_join
from tabguard.plans.quantiles import weighted_quantiles
from tabguard.schema import as_double, numeric_columns
from tabguard.session import write_and_reread

#: Real side that may be broadcast, in bytes; its distinct rows are counted first.
BROADCAST_BYTES = 32 << 20
#: Points per side that one group of the cell search holds.
GROUP_POINTS = 50_000
#: Rows that leave the spreading of points over chunks at once.
SPREAD_ROWS = 16_384
#: Least size of the sample that shapes the cells, and its points per cell.
SAMPLE_POINTS, SAMPLE_PER_CELL = 65_536, 4
#: The driver holds one row per cell: 2^18 of them serve 1.3e10 distinct points; beyond that, cells are cut into chunks.
MAX_DEPTH = 18


def standardised(real: DataFrame, synth: DataFrame, columns: list[str]) -> tuple[list[Column], list[str]]:
    """z-scores by the real side's mean and population deviation (1 for a constant column)."""
    complete = real.select(*[as_double(n).alias(f"x{i}") for i, n in enumerate(columns)]).na.drop("any")
    row = complete.agg(
        *[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(columns))],
        *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(len(columns))],
    ).first()
    if row["m0"] is None:
        raise ValueError("the real table has no complete numeric row")
    names = [f"x{i}" for i in range(len(columns))]
    scaled = [
        ((as_double(n) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0)).alias(f"x{i}") for i, n in enumerate(columns)
    ]
    return scaled, names


def closest_distances(
    real: DataFrame,
    synth: DataFrame,
    columns: list[str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    group_points: int = GROUP_POINTS,
) -> DataFrame:
    """``(x0.., n, distance)``: one row per distinct standardised synthetic record, with its row count.

    Copies are merged on both sides first, so a group of copies costs as much as one record. A real
    side below ``broadcast_bytes`` (counted) goes to every task; a larger one is cut into cells.
    """
    columns = columns or [n for n in numeric_columns(real) if n in synth.columns]
    if not columns:
        raise ValueError("no numeric column in common")
    scaled, names = standardised(real, synth, columns)
    points = write_and_reread(real.select(*scaled).na.drop("any").distinct(), "points")
    asked = synth.select(*scaled).na.drop("any").groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    asked = write_and_reread(asked, "asked")
    return nearest_of(points, asked, names, broadcast_bytes, group_points)


def nearest_of(
    points: DataFrame, asked: DataFrame, names: list[str], broadcast_bytes: int = BROADCAST_BYTES, group_points: int = GROUP_POINTS
) -> DataFrame:
    """Exact search of distinct records ``asked`` (names, n) in distinct ``points``; both are written tables."""
    limit = max(1, broadcast_bytes // (8 * len(names)))
    if points.count() <= limit:
        return _against_broadcast(points, asked, names)
    return _against_cells(points, asked, names, group_points)


def _schema(names: list[str], *extra: str) -> str:
    return ", ".join([f"{n} double" for n in names] + list(extra))


def _against_broadcast(points: DataFrame, asked: DataFrame, names: list[str]) -> DataFrame:
    built = PointSet(points.toPandas().to_numpy(dtype=float))
    shared = points.sparkSession.sparkContext.broadcast(vars(built))

    def search(batches):
        index = PointSet.of_parts(shared.value)
        for pdf in gathered(batches):
            yield pdf.assign(distance=index.nearest(pdf[names].to_numpy(dtype=float)))

    # Neighbouring records in one task search the same blocks. The records are distinct, so the
    # ranges come out even, and a fixed number of them keeps AQE from merging costly tasks.
    sorted_out = asked.repartitionByRange(_partitions(asked), *names)
    return sorted_out.mapInPandas(search, _schema(names, "n long", "distance double"))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def gathered(batches, rows: int = 131_072):
    """Join small batches: the more records are searched together, the closer together they lie."""
    held, size = [], 0
    for pdf in batches:
        held.append(pdf)
        size += len(pdf)
        if size >= rows:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _cell_table(df: DataFrame, cells: int, axes: list[Column] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows per cell, and the box of its points along ``axes``; at most 2^MAX_DEPTH rows reach the driver."""
    d = len(axes or [])
    boxes = [f(x).alias(f"{a}{i}") for i, x in enumerate(axes or []) for a, f in (("l", F.min), ("h", F.max))]
    size = np.zeros(cells, dtype=np.int64)
    low, high = np.full((cells, d), np.inf), np.full((cells, d), -np.inf)
    for row in df.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), *boxes).collect():
        size[row["cell"]] = row["rows"]
        for i in range(d):
            low[row["cell"], i], high[row["cell"], i] = row[f"l{i}"], row[f"h{i}"]
    return size, low, high


def _turned(names: list[str], turn: np.ndarray) -> list[Column]:
    """The coordinates along the columns of ``turn``."""
    return [sum((F.col(n) * F.lit(float(turn[i, j])) for i, n in enumerate(names)), F.lit(0.0)) for j in range(turn.shape[1])]


def _search_groups(points: DataFrame, asked: DataFrame, names: list[str], real_size, asked_size, group_points: int) -> DataFrame:
    """Search each asked record in the real points of its cell.

    A cell with many records is cut on both sides into chunks, and every chunk of one side meets
    every chunk of the other: no group holds more than about ``group_points`` points per side.
    """
    real_chunks = np.maximum(1, -(-real_size // group_points))
    asked_chunks = np.maximum(1, -(-asked_size // group_points))

    def spread(own: np.ndarray, other: np.ndarray, own_name: str, other_name: str):
        def run(batches):
            for pdf in batches:
                cell = pdf["cell"].to_numpy()
                slot = (pdf.pop("h").to_numpy() & 0x7FFFFFFF) % own[cell]
                copies = other[cell]  # 0 drops real points nobody asks for
                ends = np.cumsum(copies)
                # A point may go to very many chunks: so many rows leave at a time, whatever their number.
                for start in range(0, int(ends[-1]) if len(ends) else 0, SPREAD_ROWS):
                    copy = np.arange(start, min(start + SPREAD_ROWS, int(ends[-1])))
                    at = np.searchsorted(ends, copy, side="right")
                    yield pdf.iloc[at].assign(**{own_name: slot[at], other_name: copy - (ends - copies)[at]})

        return run

    hashed = F.xxhash64(*names).alias("h")
    left = points.select(*names, "cell", hashed).mapInPandas(
        spread(real_chunks, np.where(asked_size > 0, asked_chunks, 0), "rc", "ac"), _schema(names, "cell int", "rc int", "ac int")
    )
    right = asked.select(*names, "n", "bound", "cell", hashed).mapInPandas(
        spread(asked_chunks, real_chunks, "ac", "rc"), _schema(names, "n long", "bound double", "cell int", "ac int", "rc int")
    )

    def search(real_pdf: pd.DataFrame, asked_pdf: pd.DataFrame) -> pd.DataFrame:
        if asked_pdf.empty:
            return asked_pdf[[*names, "n"]].assign(distance=pd.Series(dtype=float))
        index = PointSet(real_pdf[names].to_numpy(dtype=float))
        found = index.nearest(asked_pdf[names].to_numpy(dtype=float), asked_pdf["bound"].to_numpy(dtype=float))
        return asked_pdf[[*names, "n"]].assign(distance=found)

    keys = ["cell", "rc", "ac"]
    left, right = (side.repartition(_partitions(asked), *keys) for side in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, _schema(names, "n long", "distance double"))


def _best(df: DataFrame, names: list[str]) -> DataFrame:
    return df.groupBy(*names).agg(F.first("n").alias("n"), F.min("distance").alias("distance"))


def _against_cells(points: DataFrame, asked: DataFrame, names: list[str], group_points: int) -> DataFrame:
    """Own cell first, then only the cells whose box is nearer than the distance found there.

    The split points come from a bounded sample, so cells are about equally full wherever the data
    is dense. The sample shapes the cells only; every record is searched.
    """
    total = points.count()
    depth = min(MAX_DEPTH, max(1, math.ceil(math.log2(total / group_points))))
    # A hash threshold takes about as many points as wanted without sorting anything.
    share = min(1.0, max(SAMPLE_POINTS, SAMPLE_PER_CELL << depth) / total)
    chosen = points if share == 1.0 else points.filter(F.pmod(F.xxhash64(F.lit("cells"), *names), F.lit(1 << 40)) < int(share * (1 << 40)))
    sample = chosen.toPandas().to_numpy(dtype=float)
    tree = SplitTree(sample, depth)

    def assign(batches):
        for pdf in batches:
            yield pdf.assign(cell=tree.cell(pdf[names].to_numpy(dtype=float)).astype("int32"))

    real_cells = write_and_reread(points.mapInPandas(assign, _schema(names, "cell int")), "cells")
    real_size, low, high = _cell_table(real_cells, 1 << depth, _turned(names, tree.turn))
    boxes = tree.boxes(low, high)

    home = asked.withColumn("bound", F.lit(math.inf)).mapInPandas(assign, _schema(names, "n long", "bound double", "cell int"))
    home_size, _, _ = _cell_table(home, 1 << depth)
    first = _search_groups(real_cells, home, names, real_size, home_size, group_points)
    first = write_and_reread(_best(first, names), "home")

    def others(batches):
        for pdf in batches:
            pdf = pdf[~tree.alone(pdf[names].to_numpy(dtype=float), pdf["distance"].to_numpy(dtype=float), boxes)]
            # Few rows at a time: in many dimensions a row may have to visit most cells.
            for start in range(0, len(pdf), 1024):
                part = pdf.iloc[start:start + 1024]
                values, reach = part[names].to_numpy(dtype=float), part["distance"].to_numpy(dtype=float)
                own = tree.cell(values)
                row, cell = tree.cells_within(values, reach, boxes)
                keep = own[row] != cell
                row, cell = row[keep], cell[keep]
                yield part.iloc[row][[*names, "n"]].assign(bound=reach[row], cell=cell.astype("int32"))

    more = write_and_reread(first.mapInPandas(others, _schema(names, "n long", "bound double", "cell int")), "candidates")
    more_size, _, _ = _cell_table(more, 1 << depth)
    second = _search_groups(real_cells, more, names, real_size, more_size, group_points)
    return _best(first.unionByName(second), names)


def closest_record_rows(real: DataFrame, synth: DataFrame, key: list[str], **options) -> DataFrame:
    """The key of every complete synthetic row with its distance."""
    columns = [n for n in numeric_columns(real) if n in synth.columns and n not in key]
    scaled, names = standardised(real, synth, columns)
    distances = write_and_reread(closest_distances(real, synth, columns, **options), "distances")
    rows = synth.select(*key, *scaled).na.drop("any", subset=names)
    return lookup_join(rows, distances, names, "n", ["distance"]).select(*key, "distance")


def closest_record_report(real: DataFrame, synth: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """One row: spread of the distances, records nearer than ``threshold``, and the score.

    ``privacy_risk_score`` grows with the mean distance (higher is safer); ``privacy_score`` is
    the same number under a name that says so.
    """
    return report_of(write_and_reread(closest_distances(real, synth, **options).select("n", "distance"), "distances"), threshold)


def report_of(distances: DataFrame, threshold: float) -> DataFrame:
    """The report of a written table ``(n, distance)``."""
    median = weighted_quantiles(distances, "distance", "n", [0.5])[0]
    near = F.sum(F.when(F.col("distance") < threshold, F.col("n")).otherwise(F.lit(0)))
    mean = F.try_divide(F.sum(F.col("distance") * F.col("n")), F.sum("n"))
    score = F.round(F.least(F.lit(100.0), mean * 20.0), 2)
    return distances.agg(
        F.round(F.min("distance"), 4).alias("min_distance"),
        F.round(mean, 4).alias("mean_distance"),
        F.round(F.max("distance"), 4).alias("max_distance"),
        F.round(F.lit(median), 4).alias("median_distance"),
        score.alias("privacy_risk_score"),
        score.alias("privacy_score"),
        F.round(F.try_divide(near * 100.0, F.sum("n")), 2).alias("too_close_percentage"),
        near.alias("close_records"),
        F.sum("n").alias("total_records"),
        F.lit(threshold).alias("threshold"),
    )
