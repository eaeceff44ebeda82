"""The vector index against a scan of all vectors."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabguard.operators import vector_index
from tabguard.operators.corpus import nearest_vectors
from tabguard.operators.vector_index import build_vector_index, nearest_exactly, search_vector_index


def clustered(rows=3000, dims=22, seed=4):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(25, dims)) * 2
    return (centres[draw.integers(0, 25, rows)] + draw.normal(size=(rows, dims))).astype(np.float32)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(clustered())]
    rows += [(5000, None, "x"), (5001, [0.0] * 22, "x"), (5002, [1.0, 2.0], "x"), (5003, rows[0][1], "copy"), (5004, rows[0][1], "copy"), (5005, [None] * 22, "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list string").repartition(5)
    return path, vectors, build_vector_index(vectors, path)


def asked(vectors, condition):
    return vectors.filter(condition).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def pairs(df):
    return {(r.query_id, r.key) for r in df.collect()}


def test_probed_lists_reach_the_recall_and_are_all_that_is_read(spark, index):
    path, vectors, figures = index
    assert figures["rows"] == 3006 and figures["probes"] < figures["lists"] and figures["recall"] >= 0.97
    queries = asked(vectors, "vec_id % 20 = 0 and vec_id < 3000")
    found = search_vector_index(spark, path, queries, top_k=10)
    exact = nearest_exactly(vectors.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector")), queries, 10)
    assert len(pairs(found) & pairs(exact)) >= 0.95 * exact.count()
    one = search_vector_index(spark, path, asked(vectors, "vec_id = 40"), top_k=5, probes=2)
    read = one._jdf.queryExecution().optimizedPlan().toString()
    assert "list" in read and one.count() == 5
    folders = spark.read.parquet(path + "/lists").select("list").distinct().count()
    assert folders == figures["lists"]


@pytest.mark.parametrize("probes", [1, None])
def test_exact_mode_equals_a_scan(spark, index, probes):
    path, vectors, _ = index
    chosen = [0, 7, 1234, 5003]
    found = search_vector_index(spark, path, asked(vectors, F.col("vec_id").isin(chosen)), top_k=12, probes=probes, exact=True)
    got = {q: [] for q in chosen}
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.key, r.score))
    for q in chosen:
        wanted = vectors.filter(F.col("vec_id") == q).first()["embedding"]
        want = [(r.vec_id, r.score) for r in nearest_vectors(vectors.filter("vec_id <> 5005"), wanted, 12).collect()]
        assert [k for k, _ in got[q]] == [k for k, _ in want]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want], abs=1e-7)
    assert [k for k, _ in got[0][:3]] == [0, 5003, 5004]


def test_all_rows_are_indexed_and_odd_vectors_score_zero(spark, index):
    path, vectors, _ = index
    assert spark.read.parquet(path + "/lists").count() == 3006
    few = search_vector_index(spark, path, asked(vectors, "vec_id in (5000, 5001)"), top_k=3, exact=True).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.key, r.score) for r in few] == [(q, k, 0.0) for q in (5000, 5001) for k in (0, 1, 2)]


def test_few_vectors(spark, tmp_path):
    tiny = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.9, 0.1, 0.0])], "vec_id long, embedding array<float>")
    build_vector_index(tiny, str(tmp_path / "i"))
    found = search_vector_index(spark, str(tmp_path / "i"), asked(tiny, "vec_id = 1"), top_k=10, exact=True)
    assert [r.key for r in found.orderBy("rank").collect()] == [1, 3, 2]
    assert search_vector_index(spark, str(tmp_path / "i"), asked(tiny, "false")).count() == 0
    with pytest.raises(ValueError):
        build_vector_index(tiny.filter("false"), str(tmp_path / "none"))


def test_codewords_are_fitted_without_a_table_of_all_products():
    """20,000 points and 256 codewords: 41 MB of products at once before, a fifth of that now."""
    points = np.random.default_rng(6).normal(size=(20_000, 4))
    tracemalloc.start()
    words = vector_index._k_means(points, 256, 2, 1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert words.shape == (256, 4) and most < 32e6
