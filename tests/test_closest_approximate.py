import time

import numpy as np
import pandas as pd
import pytest

from tabguard import session
from tabguard.functions.nearest import improve_by_products
from tabguard.operators import closest_approximate as approximate
from tests.test_closest import brute


def tables(spark, real, synth):
    names = ", ".join(f"c{i} double" for i in range(real.shape[1]))
    return tuple(spark.createDataFrame([tuple(map(float, x)) for x in side], names) for side in (real, synth))


def cases():
    draw = np.random.default_rng(3)
    mixed = draw.normal(size=(4, 12)) @ np.diag(np.linspace(0.2, 2, 12))
    clusters = mixed[draw.integers(0, 4, 2400)] * 3 + draw.normal(size=(2400, 12))
    yield "12 columns", clusters[:1500], clusters[1500:]
    yield "near copies", clusters[:1500], clusters[:600] + draw.normal(size=(600, 12)) * 0.01
    yield "ties", draw.integers(0, 3, (1200, 4)).astype(float), draw.integers(-1, 4, (500, 4)).astype(float)
    one_place = np.vstack([np.zeros((500, 3)), draw.normal(size=(700, 3))])
    yield "a third in one place", one_place, np.vstack([np.zeros((300, 3)), draw.normal(size=(500, 3)), np.full((2, 3), 40.0)])


@pytest.mark.parametrize("case", list(cases()), ids=lambda c: c[0])
def test_recall_against_brute_force(spark, case):
    _, real, synth = case
    found, told = approximate.approximate_distances(*tables(spark, real, synth), cell_points=100)
    mean, std = real.mean(axis=0), real.std(axis=0)
    want = {tuple(np.round((x - mean) / std, 6)): d for x, d in zip(synth, brute(real, synth))}
    names = [f"x{i}" for i in range(real.shape[1])]
    rows = found.collect()
    assert sum(r.n for r in rows) == len(synth) and len(rows) == len(want)
    hits = 0
    for r in rows:
        exact = want[tuple(np.round([r[n] for n in names], 6))]
        assert r.distance >= exact - 1e-6
        hits += r.distance <= exact + 1e-6
    assert hits / len(rows) >= 0.9 and told["measured_recall"] >= 0.9
    # The trial holds all records here, one half of which is reported.
    assert abs(told["measured_recall"] - hits / len(rows)) < 0.06


def test_cells_are_used(spark):
    """Near copies need few real records each: the chosen cells hold a small share of the table."""
    _, real, synth = list(cases())[1]
    _, told = approximate.approximate_distances(*tables(spark, real, synth), cell_points=100)
    assert told["depth"] >= 3 and told["tables"] / 2 ** told["depth"] < 0.5


def test_code_prefix_is_the_code_of_a_lower_depth():
    sample = np.random.default_rng(0).normal(size=(500, 5))
    table = approximate.ProjectionTable(sample, 6, 1)
    assert (table.code(sample, 6) >> 2 == table.code(sample, 4)).all()
    assert np.bincount(table.code(sample, 6), minlength=64).min() >= 5
    flat = approximate.ProjectionTable(np.ones((20, 2)), 3, 1)
    assert len(set(flat.code(np.ones((4, 2)), 3))) == 1


def test_records_without_a_cell_are_searched_exactly(spark):
    """All real records are one point: codes of other records may lead to empty cells."""
    real, synth = np.ones((300, 2)), np.random.default_rng(5).normal(size=(200, 2)) * 9
    synth[0] = 1.0
    r, s = tables(spark, np.vstack([real, [[1.0, 2.0]]]), synth)
    found, told = approximate.approximate_distances(r, s, cell_points=1)
    assert all(row.distance < np.inf for row in found.collect()) and told["sample_records"] == 100


def test_report_and_empty_sides(spark):
    real, synth = (np.random.default_rng(i).normal(size=(300, 3)) for i in (1, 2))
    r, s = tables(spark, real, synth)
    row = approximate.approximate_record_report(r, s, cell_points=50).first()
    assert row.total_records == 300 and row.measured_recall >= 0.85 and row.max_relative_error >= row.mean_relative_error >= 0
    none = approximate.approximate_record_report(r, s.limit(0)).first()
    assert (none.total_records, none.measured_recall, none.sample_records) == (None, None, 0)
    with pytest.raises(ValueError):
        approximate.approximate_distances(r.limit(0), s)
    with pytest.raises(ValueError):
        approximate.approximate_distances(r, s.selectExpr("c0 as other"))


def test_exact_neighbours_of_the_trial_by_products(spark):
    """Far from the origin, with copies and near ties: the distances are exact."""
    draw = np.random.default_rng(4)
    real = np.vstack([draw.normal(size=(6000, 5)) + 1000, np.full((1, 5), 1000.0)])
    asked = np.vstack([real[:50], real[50:100] + 1e-7, draw.normal(size=(50, 5)) + 1000])
    names = [f"x{i}" for i in range(5)]
    points = spark.createDataFrame(pd.DataFrame(real, columns=names))
    where, apart = approximate._exact_nearest(points, names, asked)
    want = np.sqrt(((asked[:, None, :] - real[None, :, :]) ** 2).sum(axis=2))
    assert np.array_equal(apart, want.min(axis=1)) or np.allclose(apart, want.min(axis=1), rtol=1e-12, atol=0)
    assert np.array_equal(where, real[want.argmin(axis=1)])


def shuffle_files(spark):
    """Bytes of the session's shuffle files, by name."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_")}


def test_disk_holds_each_record_once(spark, monkeypatch):
    """Not once a table: no shuffle files stay behind, and written tables hold a record and its distances."""
    monkeypatch.setattr(approximate, "_choose", lambda *_: (4, 6))
    draw = np.random.default_rng(8)
    real, synth = draw.normal(size=(4000, 12)), draw.normal(size=(4000, 12))
    r, s = tables(spark, real, synth)
    spark._jvm.System.gc()
    before, paths = shuffle_files(spark), []
    monkeypatch.setattr(session, "_scopes", [paths])
    row = approximate.approximate_record_report(r, s, cell_points=100).first()
    assert (row.tables, row.depth, row.total_records) == (6, 4, 4000)
    wide = 0
    for path in paths:
        written = spark.read.parquet(path)
        wide += written.count() * ("x0" in written.columns)
    assert wide == 8000
    for _ in range(50):  # they go in the background
        if (left := sum(size for name, size in shuffle_files(spark).items() if name not in before)) < 50_000:
            break
        time.sleep(0.2)
    assert left < 50_000


def test_rounds_and_chunks_give_the_same(spark, monkeypatch):
    """Copies, cells in many rounds, and cells cut into chunks that take turns."""
    draw = np.random.default_rng(9)
    real = np.vstack([draw.normal(size=(900, 4)), np.repeat(draw.normal(size=(3, 4)), 200, axis=0)])
    synth = np.vstack([real[:400] + 0.05, np.repeat(real[:2], 150, axis=0), np.full((1, 4), 30.0)])
    r, s = tables(spark, real, synth)
    read = lambda found: sorted((*[round(x, 9) for x in row[:4]], row.n, round(row.distance, 9)) for row in found.collect())
    found, told = approximate.approximate_distances(r, s, cell_points=200)
    want = read(found)
    assert sum(x[4] for x in want) == 701 and len(want) == 403
    monkeypatch.setattr(approximate, "ROUND_ROWS", 100)
    monkeypatch.setattr(approximate, "GROUP_POINTS", 30)
    monkeypatch.setattr(approximate, "COUNTED_ROWS", 1)
    cut, again = approximate.approximate_distances(r, s, cell_points=200)
    assert read(cut) == want and again == told


def test_plan_meets_every_pair_of_chunks_once(monkeypatch):
    monkeypatch.setattr(approximate, "GROUP_POINTS", 10)
    plan = approximate._plan(np.array([5, 0, 95, 7, 12, 9]), np.array([8, 9, 41, 0, 3, 10]), 150)
    assert sorted(set(plan["cell"])) == [0, 2, 4, 5]
    pairs = [(p.cell, r, a) for p in plan.itertuples() for r in range(p.rc) for a in range(p.low, p.high)]
    assert len(pairs) == len(set(pairs)) == 1 + 10 * 5 + 2 + 1
    assert plan["moved"].max() <= 300 and plan["round"].nunique() > 1 and plan["round"].is_monotonic_increasing


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e18])
def test_products_find_the_nearest(scale):
    draw = np.random.default_rng(10)
    points = np.vstack([draw.normal(size=(3000, 6)), np.ones((50, 6)), draw.normal(size=(20, 6)) + 1e4]) * scale
    asked = np.vstack([points[:300], points[300:600] + 1e-9 * scale, draw.normal(size=(300, 6)) * scale, points[-5:] + 0.1 * scale])
    best, nearest = np.full(len(asked), np.inf), np.full(len(asked), -1)
    improve_by_products(points[:1500], asked, best, nearest)
    first = best.copy()
    improve_by_products(points[1500:], asked, best)
    want = ((asked[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    assert np.allclose(first, want[:, :1500].min(axis=1), rtol=1e-12, atol=0) and np.array_equal(nearest, want[:, :1500].argmin(axis=1))
    assert np.allclose(best, want.min(axis=1), rtol=1e-12, atol=0)


def test_points_closer_together_than_single_precision_tells(monkeypatch):
    """Bounds in double precision keep the pairs that are measured few; copies are left out by the trial."""
    draw, measured = np.random.default_rng(11), []
    points = np.vstack([draw.normal(size=(4000, 6)) * 1e-5 + 3, draw.normal(size=(50, 6))])
    asked = np.vstack([points[:200] + 1e-6, draw.normal(size=(200, 6))])
    best, einsum = np.full(len(asked), np.inf), np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: measured.append(len(a)) or einsum(how, a, b))
    improve_by_products(points, asked, best)
    want = ((asked[:, None, :] - points[None, :, :]) ** 2).sum(axis=2).min(axis=1)
    assert np.allclose(best, want, rtol=1e-9, atol=0) and sum(measured) < 0.05 * len(points) * len(asked)
    copies = np.vstack([np.repeat(points[:3], 500, axis=0), points[:100]])[draw.permutation(1600)]
    kept = approximate._one_of_copies(copies)
    assert sorted(map(tuple, kept)) == sorted(map(tuple, points[:100]))
