"""Vector index for page search: partitioned lists of product-quantised residuals with an exact re-rank.

Below its path lie ``lists`` (one folder a list: key, code, error and the vector itself), ``centroids``,
``codewords`` and ``figures``. A search reads the codes of the lists nearest to a query, ranks them by
the approximate cosine, and computes the exact cosine of the best from their vectors. In exact mode it
then reads those lists, and those rows of them, that the kept error bounds do not rule out.

The measure is that of :func:`tabguard.operators.corpus.nearest_vectors`: the cosine, 0 for a vector that is null,
zero or of another length than the commonest; equal scores (at nine digits) by key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabguard.schema import c
from tabguard.session import write_and_reread

#: Vectors that centroids and codewords are fitted on, at most; every vector is indexed.
SAMPLE_VECTORS = 200_000
#: Lists of an index, at most. A table of centroids is held by each task.
MOST_LISTS = 8192
#: Components a code byte stands for, and codewords a byte tells apart.
PART, WORDS = 4, 256
#: Held-out queries that the number of probed lists is measured with, and the recall asked for.
TRIALS, RECALL = 100, 0.97
#: Candidates by code whose vectors are read, for each result asked for.
RERANK = 20
#: Products of points and centres that a task holds at once.
PRODUCTS = 1 << 20
#: Queries searched at once.
QUERY_BLOCK = 256


def _unit(vectors: np.ndarray) -> np.ndarray:
    size = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def _matrix(column, dims: int) -> np.ndarray:
    """Rows of a list column as doubles; zeros for null and for other lengths."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dims).all():
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
    else:
        flat = np.array([v if v is not None and len(v) == dims else [0.0] * dims for v in column.to_pylist()], dtype=float).reshape(-1, dims)
    # A vector with a missing component counts as zero, as its product with anything is unknown.
    flat[np.isnan(flat).any(axis=1)] = 0.0
    return flat


def _k_means(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's rounds on the few points of one subspace."""
    draw = np.random.default_rng(seed)
    centres = points[draw.permutation(len(points))[:k]]
    for _ in range(rounds):
        nearest = _nearest_list(points, centres)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _nearest_list(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The list of each point, so many points at a time that their products with all centres stay small."""
    size, step = (centres * centres).sum(1), max(1, PRODUCTS // len(centres))
    return np.concatenate([np.argmin(size - 2 * points[i:i + step] @ centres.T, axis=1) for i in range(0, len(points), step)] or [np.empty(0, int)])


class Coder:
    """Codewords of each part of a residual."""

    def __init__(self, words: list[np.ndarray], dims: int):
        self.words, self.dims = words, dims
        self.starts = list(range(0, dims, PART))

    def encode(self, residuals: np.ndarray) -> np.ndarray:
        codes = np.empty((len(residuals), len(self.starts)), dtype=np.uint8)
        for j, (start, words) in enumerate(zip(self.starts, self.words)):
            codes[:, j] = np.argmin((words * words).sum(1) - 2 * residuals[:, start:start + PART] @ words.T, axis=1)
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([w[codes[:, j]] for j, w in enumerate(self.words)], axis=1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Product of each query's parts with all codewords: (queries, parts, words)."""
        held = np.zeros((len(queries), len(self.starts), WORDS))
        for j, (start, words) in enumerate(zip(self.starts, self.words)):
            held[:, j, :len(words)] = queries[:, start:start + PART] @ words.T
        return held


def build_vector_index(vectors: DataFrame, path: str, lists: int | None = None, key: str = "vec_id", column: str = "embedding",
                       recall: float = RECALL, top_k: int = 10, seed: int = 7) -> dict:
    """Write the index of all ``vectors`` below ``path`` and return its figures.

    Lists number about the square root of the rows unless given. Centroids come from MLlib's k-means,
    codewords from one task a subspace, both on a bounded sample by a hash of the key. The number of lists to probe is measured
    on held-out vectors against their exact neighbours in the whole table, for ``recall`` at ``top_k``.
    """
    spark = vectors.sparkSession
    chosen = vectors.select(c(key).cast("long").alias("key"), c(column).cast("array<float>").alias("vector"))
    sizes = chosen.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").collect()
    total = sum(r["count"] for r in sizes)
    dims = next((r["size"] for r in sizes if r["size"] is not None and r["size"] > 0), 0)
    if not total or not dims:
        raise ValueError("an index needs vectors")
    lists = max(1, min(lists or round(total ** 0.5), MOST_LISTS))
    share = min(1.0, SAMPLE_VECTORS / total)
    draw = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1_000_000))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    sample = chosen.filter((F.size("vector") == dims) & (draw < F.lit(share * 1_000_000))).withColumn("norm", norm).filter("norm > 0")
    sample = write_and_reread(sample.limit(2 * SAMPLE_VECTORS).select("key", F.transform("vector", lambda x: x.cast("double") / F.col("norm")).alias("unit")), "index-sample")
    if sample.isEmpty():
        centres = np.zeros((1, dims))
    else:
        model = KMeans(k=lists, maxIter=10, seed=seed, featuresCol="features").fit(sample.select(array_to_vector("unit").alias("features")))
        centres = np.array(model.clusterCenters())
    starts = list(range(0, dims, PART))

    def residual_parts(batches):
        for batch in batches:
            points = _matrix(batch.column(0), dims)
            rest = points - centres[_nearest_list(points, centres)]
            for j, start in enumerate(starts):
                parts = rest[:, start:start + PART]
                yield pa.RecordBatch.from_arrays([pa.array([j] * len(parts), pa.int32()), pa.array(parts.tolist(), pa.list_(pa.float64()))], names=["part", "values"])

    def fit_part(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        # A fixed order, so that the words do not depend on how the rows arrived.
        points = np.unique(np.stack(frame["values"].to_numpy()), axis=0)
        words = _k_means(points, min(WORDS, len(points)), 8, seed + part)
        return pd.DataFrame({"part": part, "word": np.arange(len(words)), "values": words.tolist()})

    # A part's sample is at most 2 * SAMPLE_VECTORS times PART numbers: a few MB for one task.
    fitted = sample.select("unit").mapInArrow(residual_parts, "part int, values array<double>").groupBy("part").applyInPandas(
        fit_part, "part int, word int, values array<double>")
    words = {}
    for r in fitted.orderBy("part", "word").collect():
        words.setdefault(r["part"], []).append(r["values"])
    coder = Coder([np.array(words.get(j, [[0.0] * min(PART, dims - s)])) for j, s in enumerate(starts)], dims)

    def place(batches):
        for batch in batches:
            points = _unit(_matrix(batch.column(1), dims))
            at = _nearest_list(points, centres)
            rest = points - centres[at]
            codes = coder.encode(rest)
            gaps = np.sqrt(((rest - coder.decode(codes)) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), batch.column(0), pa.array([bytes(x) for x in codes], pa.binary()), pa.array(gaps),
                 pa.array(np.sqrt((rest * rest).sum(1))), batch.column(1)], names=["list", "key", "code", "error", "spread", "vector"])

    placed = chosen.mapInArrow(place, "list int, key long, code binary, error double, spread double, vector array<float>")
    placed.hint("rebalance", "list").sortWithinPartitions("list", "key").write.partitionBy("list").parquet(f"{path}/lists")
    spreads = {r["list"]: r["s"] for r in spark.read.parquet(f"{path}/lists").groupBy("list").agg(F.max("spread").alias("s")).collect()}
    rows = [(i, x.tolist(), spreads[i]) for i, x in enumerate(centres) if i in spreads]
    spark.createDataFrame(rows, "list int, centre array<double>, spread double").coalesce(1).write.parquet(f"{path}/centroids")
    flat = [(j, n, w.tolist()) for j, held in enumerate(coder.words) for n, w in enumerate(held)]
    spark.createDataFrame(flat, "part int, word int, values array<double>").coalesce(1).write.parquet(f"{path}/codewords")
    figures = {"rows": total, "dims": dims, "lists": len(rows), "probes": len(rows), "rerank": RERANK, "recall": 1.0}
    figures |= _measured(spark, path, figures, chosen, recall, top_k, seed)
    spark.createDataFrame([tuple(figures.values())], "rows long, dims int, lists int, probes int, rerank int, recall double").coalesce(1).write.parquet(f"{path}/figures")
    return figures


def _measured(spark: SparkSession, path: str, figures: dict, chosen: DataFrame, recall: float, top_k: int, seed: int) -> dict:
    """Probes and candidates that reach ``recall`` for held-out queries, with the recall that was found."""
    trials = chosen.filter(F.size("vector") == figures["dims"]).orderBy(F.xxhash64("key", F.lit(seed + 1))).limit(TRIALS)
    asked = write_and_reread(trials.select(F.col("key").alias("query_id"), "vector"), "trials")
    exact = nearest_exactly(chosen, asked, top_k)
    truth = {(r["query_id"], r["key"]) for r in exact.select("query_id", "key").collect()}
    probes, rerank, found = 1, figures["rerank"], 0.0
    while truth:
        got = search_vector_index(spark, path, asked, top_k, probes=probes, rerank=rerank, figures=figures)
        found = len(truth & {(r["query_id"], r["key"]) for r in got.select("query_id", "key").collect()}) / len(truth)
        if found >= recall or (probes >= figures["lists"] and rerank > 16 * RERANK):
            break
        if probes >= figures["lists"]:
            rerank *= 2
        probes = min(figures["lists"], 2 * probes if probes < figures["lists"] // 4 else probes + max(1, figures["lists"] // 8))
    return {"probes": probes, "rerank": rerank, "recall": found}


def _query_blocks(queries: DataFrame, dims: int):
    ids, held = [], []
    for row in queries.select(F.col("query_id").cast("long"), "vector").toLocalIterator():
        ids.append(row[0])
        held.append(row[1] if row[1] is not None and len(row[1]) == dims else [0.0] * dims)
        if len(ids) == QUERY_BLOCK:
            yield np.array(ids), _unit(np.array(held, dtype=float))
            ids, held = [], []
    if ids:
        yield np.array(ids), _unit(np.array(held, dtype=float))


class _Top:
    """The best keys of each query that a task has seen, by score at nine digits and key."""

    def __init__(self, queries: int, size: int):
        self.size, self.held = size, [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)) for _ in range(queries)]

    def add(self, query: int, keys: np.ndarray, scores: np.ndarray, lists: np.ndarray) -> None:
        old = self.held[query]
        keys, scores, lists = np.concatenate([old[0], keys]), np.concatenate([old[1], scores]), np.concatenate([old[2], lists])
        best = np.lexsort((keys, -np.round(scores, 9)))[:self.size]
        self.held[query] = keys[best], scores[best], lists[best]

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        counts = [len(k) for k, _, _ in self.held]
        keys, scores, lists = (np.concatenate([h[i] for h in self.held]) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(keys), pa.array(scores), pa.array(lists.astype(np.int32))],
                                          names=["query_id", "key", "score", "list"])


_FOUND = "query_id long, key long, score double, list int"


def _best(found: DataFrame, size: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def nearest_exactly(vectors: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """(query_id, key, score, rank) by a scan of ``(key, vector)`` for a block of queries at a time: what the index is measured against."""
    dims = next((len(r["vector"]) for r in queries.filter("vector is not null").limit(1).collect()), 0)
    result = None
    for ids, units in _query_blocks(queries, dims):

        def scan(batches, ids=ids, units=units):
            top = _Top(len(ids), top_k)
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                scores = units @ _unit(_matrix(batch.column(1), dims)).T
                for q in range(len(ids)):
                    top.add(q, keys, scores[q], np.zeros(len(keys), np.int64))
            yield top.batch(ids)

        part = _best(vectors.select("key", "vector").mapInArrow(scan, _FOUND), top_k)
        result = part if result is None else result.unionByName(part)
    if result is None:
        return vectors.sparkSession.createDataFrame([], _FOUND + ", rank int").drop("list")
    return result.drop("list")


def search_vector_index(spark: SparkSession, path: str, queries: DataFrame, top_k: int = 10, probes: int | None = None, rerank: int | None = None,
                        exact: bool = False, figures: dict | None = None) -> DataFrame:
    """(query_id, rank, key, score): the nearest vectors of each ``(query_id, vector)``.

    ``probes`` lists are read for a query (default: as measured when the index was built) and the
    exact cosine is taken of its ``top_k * rerank`` best by code. ``exact`` adds whatever the bounds
    leave open: a list whose centroid and spread, and a row whose code and error, allow a score
    up to the last one found. Queries are searched ``QUERY_BLOCK`` at a time; a query of another
    length, or null, is a zero vector. Only folders of probed lists are read.
    """
    figures = figures or spark.read.parquet(f"{path}/figures").first().asDict()
    dims, probes, rerank = figures["dims"], probes or figures["probes"], rerank or figures["rerank"]
    cells = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r["list"])
    names, centres = np.array([r["list"] for r in cells]), np.array([r["centre"] for r in cells])
    spreads = np.array([r["spread"] for r in cells])
    words = {}
    for r in sorted(spark.read.parquet(f"{path}/codewords").collect(), key=lambda r: (r["part"], r["word"])):
        words.setdefault(r["part"], []).append(r["values"])
    coder = Coder([np.array(words[j]) for j in sorted(words)], dims)
    lists = spark.read.schema("key long, code binary, error double, vector array<float>, list int").parquet(f"{path}/lists")
    result = None
    for ids, units in _query_blocks(queries, dims):
        found = _search_block(lists, ids, units, names, centres, spreads, coder, top_k, min(probes, len(names)), rerank, exact)
        result = found if result is None else result.unionByName(found)
    if result is None:
        return spark.createDataFrame([], "query_id long, rank int, key long, score double")
    return result.select("query_id", "rank", "key", "score")


def _search_block(lists, ids, units, names, centres, spreads, coder, top_k, probes, rerank, exact) -> DataFrame:
    spark, dims, tables = lists.sparkSession, coder.dims, coder.tables(units)
    products = units @ centres.T  # the part of the cosine that a list's rows share
    # Unit vectors: the nearest centroid has the largest product less half its square.
    order = np.argsort(-(products - (centres * centres).sum(1) / 2), axis=1, kind="stable")[:, :probes]
    probed = np.zeros(products.shape, dtype=bool)
    np.put_along_axis(probed, order, True, axis=1)
    place = {int(n): i for i, n in enumerate(names)}

    def groups(batch, column):
        """(row numbers, index of the list) of each list in a batch."""
        held = batch.column(column).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.diff(held)) + 1
        for a, b in zip([0, *edges], [*edges, len(held)]):
            if b > a:
                yield slice(int(a), int(b)), place[int(held[a])]

    def by_code(queries, codes, at):
        """Approximate cosines (queries, rows) of one list."""
        total = np.repeat(products[queries, at][:, None], len(codes), axis=1)
        for j in range(codes.shape[1]):
            total += tables[queries, j][:, codes[:, j]]
        return total

    def codes_of(column):
        return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)

    def candidates(batches):
        top = _Top(len(ids), top_k * rerank)
        for batch in batches:
            keys, codes = batch.column(0).to_numpy(zero_copy_only=False), codes_of(batch.column(1))
            for rows, at in groups(batch, 2):
                queries = np.flatnonzero(probed[:, at])
                scores = by_code(queries, codes[rows], at)
                for n, q in enumerate(queries):
                    top.add(q, keys[rows], scores[n], np.full(rows.stop - rows.start, names[at]))
        yield top.batch(ids)

    wanted = [int(n) for n in names[probed.any(axis=0)]]
    rough = _best(lists.filter(F.col("list").isin(wanted)).select("key", "code", "list").mapInArrow(candidates, _FOUND), top_k * rerank)
    # At most QUERY_BLOCK * top_k * rerank rows: the vectors of the candidates, from their own lists.
    picked = rough.select("query_id", "key", "list")
    vectors = lists.filter(F.col("list").isin(wanted)).select("key", "list", "vector")
    row_of = {int(q): n for n, q in enumerate(ids)}

    def exactly(batches):
        for batch in batches:
            points = _unit(_matrix(batch.column(3), dims))
            rows = np.array([row_of[q] for q in batch.column(0).to_pylist()], dtype=int)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((units[rows] * points).sum(1)), batch.column(2)],
                                             names=["query_id", "key", "score", "list"])

    joined = vectors.join(F.broadcast(picked), ["key", "list"]).select("query_id", "key", "list", "vector")
    best = _best(joined.mapInArrow(exactly, _FOUND), top_k)
    if not exact:
        return best
    best = write_and_reread(best, "neighbours")
    last = {r["query_id"]: r["score"] for r in best.filter(F.col("rank") == top_k).collect()}
    # A hair below the last score: bounds and scores are rounded.
    least = np.array([last.get(int(q), -2.0) for q in ids]) - 1e-8
    length = np.sqrt((units * units).sum(1))
    open_lists = products + length[:, None] * spreads[None, :] >= least[:, None]
    wanted = [int(n) for n in names[open_lists.any(axis=0)]]
    if not wanted:
        return best

    def complete(batches):
        top = _Top(len(ids), top_k)
        for batch in batches:
            keys, codes = batch.column(0).to_numpy(zero_copy_only=False), codes_of(batch.column(1))
            errors = batch.column(2).to_numpy(zero_copy_only=False)
            points = _unit(_matrix(batch.column(3), dims))
            for rows, at in groups(batch, 4):
                queries = np.flatnonzero(open_lists[:, at])
                bound = by_code(queries, codes[rows], at) + length[queries][:, None] * errors[rows][None, :]
                for n, q in enumerate(queries):
                    possible = np.flatnonzero(bound[n] >= least[q])
                    if len(possible):
                        top.add(q, keys[rows][possible], points[rows][possible] @ units[q], np.full(len(possible), names[at]))
        yield top.batch(ids)

    scanned = lists.filter(F.col("list").isin(wanted)).select("key", "code", "error", "vector", "list")
    return _best(scanned.mapInArrow(complete, _FOUND), top_k)
