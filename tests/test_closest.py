import numpy as np
import pytest
from pyspark.sql import functions as F

from tabguard.functions.nearest import PointSet, SplitTree
from tabguard.operators import closest


def brute(real, synth):
    mean, std = real.mean(axis=0), real.std(axis=0)
    std[std == 0] = 1.0
    a, b = (real - mean) / std, (synth - mean) / std
    return np.sqrt(((b[:, None, :] - a[None, :, :]) ** 2).sum(axis=2)).min(axis=1)


def cases():
    draw = np.random.default_rng(0)
    yield "normal 2d", draw.normal(size=(900, 2)), draw.normal(size=(700, 2)) * 1.5
    yield "normal 5d", draw.normal(size=(800, 5)), draw.normal(size=(400, 5))
    yield "ties", draw.integers(0, 4, size=(600, 3)).astype(float), draw.integers(-2, 7, size=(500, 3)).astype(float)
    clump = np.vstack([np.tile([[1.0, 2.0]], (400, 1)), draw.normal(size=(400, 2)) * 100])
    yield "a third in one place", clump, np.vstack([clump[::2] + 0.25, draw.normal(size=(200, 2))])
    yield "constant column", np.column_stack([draw.normal(size=500), np.full(500, 7.0)]), np.column_stack([draw.normal(size=300), np.full(300, 9.0)])
    yield "far away", draw.normal(size=(500, 2)), draw.normal(size=(200, 2)) + 50


@pytest.mark.parametrize("case", list(cases()), ids=lambda c: c[0])
@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 16, "group_points": 60}], ids=["broadcast", "cells"])
def test_equal_to_brute_force(spark, case, options):
    _, real, synth = case
    names = [f"c{i}" for i in range(real.shape[1])]
    schema = ", ".join(f"{n} double" for n in names)
    r = spark.createDataFrame([tuple(map(float, x)) for x in real], schema)
    s = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(synth)], "id int, " + schema)
    want = brute(real, synth)
    got = {row.id: row.distance for row in closest.closest_record_rows(r, s, ["id"], **options).collect()}
    assert [got[i] for i in range(len(synth))] == pytest.approx(list(want), abs=1e-9)
    report = closest.closest_record_report(r, s.drop("id"), **options).first()
    assert report.median_distance == pytest.approx(np.median(want), abs=1e-4)
    assert report.close_records == (want < 0.5).sum() and report.total_records == len(synth)


def test_table_against_itself(spark):
    df = spark.range(300).selectExpr("id * 1.5 as a", "id % 7 as b")
    row = closest.closest_record_report(df, df).first()
    assert (row.max_distance, row.close_records, row.privacy_risk_score) == (0.0, 300, 0.0)


def test_incomplete_rows_are_left_out(spark):
    real = spark.createDataFrame([(1.0, 1.0), (2.0, None), (3.0, 5.0)], "a double, b double")
    synth = spark.createDataFrame([(1.0, 1.0), (None, 2.0)], "a double, b double")
    assert closest.closest_record_report(real, synth).first().total_records == 1


def test_known_bound_is_kept():
    index = PointSet(np.array([[0.0], [10.0]]))
    assert index.nearest(np.array([[4.0]]), np.array([1.0]))[0] == 1.0
    assert PointSet(np.empty((0, 1))).nearest(np.array([[4.0]]), np.array([2.0]))[0] == 2.0


def test_points_on_a_tilted_sheet_open_few_leaves():
    """Queries far off a sheet: along its own axes most leaves are ruled out, along the columns hardly any were."""
    draw = np.random.default_rng(2)
    along, across = draw.normal(size=20_000), draw.normal(size=20_000)
    points = np.stack([along, along, across], axis=1)
    asked = draw.normal(size=(300, 3)) * 5
    index, opened = PointSet(points), []
    improve = index._improve
    index._improve = lambda queries, best, rows, leaf: opened.append(len(rows)) or improve(queries, best, rows, leaf)
    found = index.nearest(asked)
    want = np.sqrt(((asked[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)).min(axis=1)
    assert np.allclose(found, want, rtol=0, atol=1e-12)
    assert sum(opened) < 30 * len(asked)


def test_queries_beside_their_point_measure_few_boxes():
    """What lies beyond a far cut needs no box: the way down settles most queries."""
    draw = np.random.default_rng(4)
    points = np.round(draw.normal(size=(20_000, 3)), 2)
    asked = np.concatenate([points[:500] + draw.normal(size=(500, 3)) * 1e-4, draw.normal(size=(100, 3)) * 4, points[500:600]])
    index, measured = PointSet(points), []
    gaps = index._gaps
    index._gaps = lambda turned, node: measured.append(len(node)) or gaps(turned, node)
    beside = index.nearest(asked[:500])
    assert sum(measured) < 5 * 500
    want = np.sqrt(((asked[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)).min(axis=1)
    assert np.allclose(beside, want[:500], rtol=0, atol=1e-12) and np.allclose(index.nearest(asked), want, rtol=0, atol=1e-12)


def test_cells_of_a_tilted_sheet_are_flat():
    draw = np.random.default_rng(3)
    along, across = draw.normal(size=20_000), draw.normal(size=20_000)
    points = np.stack([along, along, across], axis=1)
    tree = SplitTree(points, 8)
    cell, turned = tree.cell(points), points @ tree.turn
    low = np.array([turned[cell == i].min(axis=0) for i in range(256)])
    high = np.array([turned[cell == i].max(axis=0) for i in range(256)])
    asked = draw.normal(size=(200, 3)) * 5
    want = np.sqrt(((asked[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
    row, met = tree.cells_within(asked, want.min(axis=1) * (1 + 1e-9), tree.boxes(low, high))
    assert len(row) < 4 * len(asked)
    assert {(i, cell[j]) for i, j in enumerate(want.argmin(axis=1))} <= set(zip(row.tolist(), met.tolist()))


def test_alone_is_who_meets_no_other_cell():
    draw = np.random.default_rng(5)
    points = np.round(draw.normal(size=(5000, 2)), 1)
    tree = SplitTree(points[:3000], 6)
    cell, turned = tree.cell(points), points @ tree.turn
    low, high = np.full((64, 2), np.inf), np.full((64, 2), -np.inf)
    np.minimum.at(low, cell, turned)
    np.maximum.at(high, cell, turned)
    boxes = tree.boxes(low, high)
    asked = np.concatenate([points[:500], draw.normal(size=(500, 2)) * 2])
    for reach in (np.full(1000, 0.0), draw.exponential(0.05, 1000), np.full(1000, np.inf)):
        alone, (row, met) = tree.alone(asked, reach, boxes), tree.cells_within(asked, reach, boxes)
        assert not alone[row[met != tree.cell(asked)[row]]].any()
        assert alone.mean() > 0.4 or np.isinf(reach).all()


def test_points_spread_over_many_chunks_leave_in_slices(spark):
    """One real cell against very many asked records: no batch holds a copy of the cell for each chunk of them."""
    real = spark.range(400).select((F.col("id") % 20).cast("double").alias("a"), (F.col("id") / 20).cast("double").alias("b"))
    synth = spark.range(3000).select((F.col("id") % 60 / 3).alias("a"), (F.col("id") / 150).alias("b"))
    whole = {tuple(r) for r in closest.closest_distances(real, synth).collect()}
    held, closest.SPREAD_ROWS = closest.SPREAD_ROWS, 7
    try:
        cut = {tuple(r) for r in closest.closest_distances(real, synth, broadcast_bytes=64, group_points=50).collect()}
    finally:
        closest.SPREAD_ROWS = held
    assert cut == whole
