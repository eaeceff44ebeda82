"""Approximate nearest neighbours by inner product: an inverted index with adaptive dimension scans.

Vectors are put on a sphere (one more dimension makes all norms equal, so that the nearest is the one
with the largest inner product) and turned by a random rotation. Centroids are fitted on a sample
that grows with them; every vector is indexed under its nearest centroid. A query scans the lists of its nearest
centroids column block by column block: from the partial squared distance over ``d`` of ``D`` turned
dimensions a hypothesis test (``partial * D / d > (bound * (1 + EPSILON / sqrt(d)))**2``) abandons a
candidate early. The bound is the query's distance to its k-th neighbour in its own list. How many
lists are scanned is measured on held-out vectors against their exact neighbours in the whole table,
so that the wanted recall is reached; a query whose lists hold too few vectors scans on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabguard.llm.common import query, table
from tabguard.session import write_and_reread

#: Vectors of the sample that centroids are fitted on, at least and for each list; held-out queries that measure the recall.
SAMPLE, PER_LIST, PROBE_QUERIES = 20_000, 40, 256
#: Vectors of a list on average and in one task; wanted recall; columns of a block; the test's width.
LIST, BLOCK, RECALL, COLUMNS, EPSILON = 2048, 4096, 0.97, 16, 2.1
#: Queries that one task compares with a block of candidates at once.
QUERIES_AT_ONCE = 256
#: Queries of a list in one task; (query, list) or (point, list) pairs that are held at once.
QUERIES, PAIRS = 16_384, 1 << 16


def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(64).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Candidates on the sphere of the longest vector, turned."""
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0.0))
    return np.hstack([vectors, rest[:, None]]) @ rotation(vectors.shape[1] + 1)


def asked(vectors: np.ndarray) -> np.ndarray:
    """Queries as unit vectors with nothing in the added dimension, turned: their length changes no order."""
    unit = vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    return np.hstack([unit, np.zeros((len(unit), 1))]) @ rotation(vectors.shape[1] + 1)


def fit_centroids(points: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(1)
    centres = points[rng.choice(len(points), min(lists, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(points, centres)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, points)
        used = counts > 0
        centres[used] = sums[used] / counts[used, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half, step = 0.5 * (centres**2).sum(axis=1), max(1, 64 * PAIRS // len(centres))
    return np.concatenate([(points[low : low + step] @ centres.T - half).argmax(axis=1) for low in range(0, max(1, len(points)), step)])


def lists_in_order(queries: np.ndarray, centres: np.ndarray, longest: float) -> np.ndarray:
    """Lists of each query, nearest first; queries are brought to the sphere's radius."""
    return (-(longest * queries @ centres.T - 0.5 * (centres**2).sum(axis=1))).argsort(axis=1, kind="stable")


def lists_needed(order: np.ndarray, queries: np.ndarray, lists: np.ndarray, recall: float) -> int:
    """Lists to scan until neighbours, given by their query and the list that holds them, are found often enough."""
    size = order.shape[1]
    if not len(queries):
        return size
    reached = np.cumsum(np.bincount(order.argsort(axis=1)[queries, lists], minlength=size)) / len(queries)
    return int(min(size, np.searchsorted(reached, recall) + 1))


def targets(order: np.ndarray, sizes: np.ndarray, probes: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, list, whether its nearest) of the filled lists to scan: ``probes`` lists, and on until they hold ``least`` vectors."""
    held = sizes[order]
    wanted = np.maximum(probes, (np.cumsum(held, axis=1) < least).sum(axis=1) + 1)
    row, at = np.nonzero((np.arange(order.shape[1]) < wanted[:, None]) & (held > 0))
    return row, order[row, at], at == (held > 0).argmax(axis=1)[row]


def parted(keys: list[str], digits: slice, parts: np.ndarray) -> np.ndarray:
    """The part of each key, by its digits, where ``parts`` says how many there are."""
    return np.array([int(key[digits], 16) for key in keys], np.int64) % np.maximum(parts, 1)


def repeated(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number from 0) of each row as often as ``times`` says."""
    return np.repeat(np.arange(len(times)), times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


def scan(queries: np.ndarray, bounds: np.ndarray, points: np.ndarray, longest: float):
    """(query, point, squared distance) of the pairs that no test abandoned; queries are unit vectors, bounds squared."""
    size = points.shape[1]
    scaled = (queries * longest).astype(np.float32)
    points = points.astype(np.float32)
    rows = cols = partial = None
    for low in range(0, size, COLUMNS):
        high = min(size, low + COLUMNS)
        if rows is None:
            a, b = scaled[:, :high], points[:, :high]
            first = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T
            limit = _limit(bounds, high, size)
            rows, cols = np.nonzero(first <= limit[:, None])
            partial = first[rows, cols]
        else:
            partial = partial + ((scaled[rows, low:high] - points[cols, low:high]) ** 2).sum(axis=1)
            keep = partial <= _limit(bounds, high, size)[rows]
            rows, cols, partial = rows[keep], cols[keep], partial[keep]
    return rows, cols, partial


def _limit(bounds, done, size):
    width = 1.0 if done == size else (1 + EPSILON / np.sqrt(done)) ** 2 * done / size
    return bounds * width * (1 + 1e-4) + 1e-5


def _vectors(binary, kind) -> np.ndarray:
    """Rows of equal length from binary values."""
    values = binary.to_pylist() if isinstance(binary, pa.Array) else list(binary)
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64)


def _merged(rows: DataFrame, most: int, kind: str) -> DataFrame:
    """(key, v, ids): distinct vectors with their smallest ids; copies meet within the partition first."""

    def run(batches):
        import xxhash

        held: dict[bytes, list] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = (np.array(x, kind) + np.array(0, kind)).tobytes()  # -0 and 0 are the same
                ids = held.setdefault(v, [])
                ids.append(i)
                if len(ids) > 8 * most:
                    held[v] = sorted(set(ids))[:most]
            if len(held) > 50_000:
                yield _out(held, most, xxhash)
                held = {}
        yield _out(held, most, xxhash)

    part = rows.mapInArrow(run, "key string, v binary, ids array<long>")
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most)
    return part.groupBy("key", "v").agg(least.alias("ids"))


def _out(held, most, xxhash):
    return pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_hexdigest(v) for v in held], pa.string()), pa.array(list(held), pa.binary()),
                                       pa.array([sorted(set(ids))[:most] for ids in held.values()], pa.list_(pa.int64()))], names=["key", "v", "ids"])


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, x) of the rows that take part: not null, not zero, all components finite, the most common length."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("x")).where("id is not null and x is not null")
    good = ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("x", lambda c: c != 0)
    rows = rows.where(good)
    sizes = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("x") == (sizes["n"] if sizes else 0))


def search(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = RECALL, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of each row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    Nearest first by inner product of the original vectors in double precision, ties to the smaller
    id; a row is no neighbour of its own id. Rows with a null id or vector, a null, infinite or NaN
    component, or only zeros take no part, nor do vectors of another than the most common length.
    Copies of a vector share one search. Rows that repeat id and vector count once. An empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column)
    kind = "<f4" if vectors.schema[vector_column].dataType.elementType.simpleString() == "float" else "<f8"
    distinct = write_and_reread(_merged(rows, k + 1, kind), "vectors")
    total = distinct.count()
    none = "query_id long, rank int, vec_id long, score double"
    if total == 0:
        return spark.createDataFrame([], none)
    norms = distinct.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays(
        [pa.array(np.sqrt((_vectors(b.column(0), kind) ** 2).sum(axis=1)))], names=["n"]) for b in (x.select(["v"]) for x in batches) if b.num_rows), "n double")
    longest = norms.agg(F.max("n")).first()[0]
    # The least hashes are held out, those above them up to a threshold are the sample: bounded, whatever the total.
    lists = int(np.clip(total // LIST, 16, 16_384))
    wanted_sample = max(SAMPLE, PER_LIST * lists)
    hashed = distinct.select("key", "v", F.pmod(F.xxhash64("key"), F.lit(1 << 30)).alias("h"))
    held_out = hashed.orderBy("h", "key").limit(min(PROBE_QUERIES, max(1, total // 10))).collect()
    cut = held_out[-1].h
    taken = hashed.where((F.col("h") > cut) & (F.col("h") <= cut + int(min(1.0, wanted_sample / total) * (1 << 30)) + 1)).select("v").orderBy("v").limit(2 * wanted_sample)
    probing = _vectors([bytes(r.v) for r in held_out], kind)
    sample = [bytes(r.v) for r in taken.collect()]
    centres = fit_centroids(lifted(_vectors(sample, kind) if sample else probing, longest), lists)
    sent = spark.sparkContext.broadcast((centres, longest))

    def assign(batches):
        centres, longest = sent.value
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest(lifted(_vectors(b.column(1), kind), longest), centres).astype(np.int32))], names=[*b.schema.names, "list"])

    indexed = write_and_reread(distinct.mapInArrow(assign, "key string, v binary, ids array<long>, list int"), "lists")
    # As many rows as lists: the vectors of each, and the blocks that it is cut into.
    counted = {r["list"]: r["count"] for r in indexed.groupBy("list").count().collect()}
    sizes = np.array([counted.get(i, 0) for i in range(len(centres))], np.int64)
    blocks = -(-sizes // BLOCK)
    probes = lists_needed(lists_in_order(asked(probing), centres, longest), *_exact(indexed, [r.key for r in held_out], asked(probing), longest, k, kind), recall)
    layout = spark.sparkContext.broadcast((sizes, blocks))
    wanted = rows.where(F.col("id") % every == 0)
    asking = write_and_reread(_merged(wanted, 1, kind).select("key", "v"), "queries")

    def asked_lists(batches):
        """Slices of the queries with their targets."""
        centres, longest = sent.value
        step = max(1, PAIRS // len(centres))
        for whole in batches:
            for low in range(0, whole.num_rows, step):
                b = whole.slice(low, step)
                order = lists_in_order(asked(_vectors(b.column(b.schema.names.index("v")), kind)), centres, longest)
                yield b, *targets(order, layout.value[0], probes, k + 1)

    def count(batches):
        total = np.zeros((2, len(sent.value[0])), np.int64)
        for _, _, lists, home in asked_lists(batches):
            total += [np.bincount(x, minlength=total.shape[1]) for x in (lists[home], lists)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1], dtype=np.int32)), *map(pa.array, total)], names=["list", "home", "n"])

    # As many rows as lists: the queries of each, and the parts that they are cut into.
    asks = asking.mapInArrow(count, "list int, home long, n long").groupBy("list").agg(F.sum("home").alias("home"), F.sum("n").alias("n")).collect()
    parts = np.zeros((2, len(centres)), np.int64)
    for r in asks:
        parts[:, r["list"]] = -(-r["home"] // QUERIES), -(-r["n"] // QUERIES)
    parts_of = spark.sparkContext.broadcast(parts)

    def place(everything):
        """Each vector in its block, once for each part of the list's queries."""

        def run(batches):
            for whole in batches:
                for low in range(0, whole.num_rows, 4096):
                    b = whole.slice(low, 4096)
                    lists = b.column(3).to_numpy(zero_copy_only=False)
                    block = parted(b.column(0).to_pylist(), slice(0, 8), layout.value[1][lists])
                    times = parts_of.value[int(everything)][lists]
                    row, part = repeated(times if everything else np.where(block == 0, times, 0))
                    out = b.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(block[row].astype(np.int32)), pa.array(part.astype(np.int32))], names=[*b.schema.names, "block", "part"])

        return indexed.mapInArrow(run, "key string, v binary, ids array<long>, list int, block int, part int")

    def probe(everything):
        """Each query with its nearest list's first block, or with all blocks but that."""

        def run(batches):
            for b, row, lists, home in asked_lists(batches):
                if not everything:
                    row, lists, home = row[home], lists[home], home[home]
                at, block = repeated(layout.value[1][lists] if everything else np.ones(len(lists), np.int64))
                if everything:
                    other = ~(home[at] & (block == 0))
                    at, block = at[other], block[other]
                row, lists = row[at], lists[at]
                part = parted([b.column(0)[i].as_py() for i in range(b.num_rows)], slice(8, 16), np.ones(b.num_rows, np.int64) << 32)[row] % parts_of.value[int(everything)][lists]
                out = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*out.columns, *(pa.array(x.astype(np.int32)) for x in (lists, block, part))], names=[*b.schema.names, "list", "block", "part"])

        return run

    def compare(most):
        def run(key, left, right):
            import pandas as pd

            found = []
            if len(left) and len(right):
                longest = sent.value[1]
                mine, theirs = _vectors(left["v"], kind), _vectors(right["v"], kind)
                points = lifted(theirs, longest)
                for low in range(0, len(left), QUERIES_AT_ONCE):
                    part = mine[low : low + QUERIES_AT_ONCE]
                    i, j, d = scan(asked(part), left["bound"].to_numpy()[low : low + QUERIES_AT_ONCE], points, longest)
                    # Of each query the nearest `most` distinct vectors, which hold its nearest `most` ids.
                    order = np.lexsort((d, i))
                    i, j, d = i[order], j[order], d[order]
                    place = np.arange(len(i)) - np.searchsorted(i, i, "left")
                    near = place < most
                    i, j, d = i[near], j[near], d[near]
                    score = (part[i] * theirs[j]).sum(axis=1)
                    found.append(pd.DataFrame({"qkey": left["key"].to_numpy()[low + i], "ids": right["ids"].to_numpy()[j], "score": score, "d": d.astype(float)}))
            return pd.concat(found) if found else pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("qkey", object), ("ids", object), ("score", float), ("d", float))})

        return run

    result = "qkey string, ids array<long>, score double, d double"
    shape = "key string, v binary, bound double, list int, block int, part int"
    group = ["list", "block", "part"]
    # The nearest list gives each query a bound: the distance of its (k + 1)-th neighbour there.
    home = asking.withColumn("bound", F.lit(float("inf"))).mapInArrow(probe(False), shape)
    near = write_and_reread(home.groupBy(*group).cogroup(place(False).groupBy(*group)).applyInPandas(compare(k + 1), result), "near")
    bound = near.groupBy("qkey").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).select("qkey", F.when(F.col("n") > k, F.col("d")).alias("d"))
    bounded = write_and_reread(asking.join(bound, asking["key"] == bound["qkey"], "left").select("key", "v", F.coalesce("d", F.lit(float("inf"))).alias("bound")), "bounds")
    spread = bounded.mapInArrow(probe(True), shape)
    found = spread.groupBy(*group).cogroup(place(True).groupBy(*group)).applyInPandas(compare(k + 1), result).unionByName(near)
    single = found.select("qkey", "score", F.explode("ids").alias("id"))
    ranked = single.withColumn("at", F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("score"), "id"))).where(F.col("at") <= k + 1)
    # A list of at most k + 1 for each distinct query vector, handed to each row that asked with it.
    listed = ranked.groupBy("qkey").agg(F.array_sort(F.collect_list(F.struct("at", "id", "score"))).alias("near"))
    named = _keyed(wanted, kind).join(listed, F.col("key") == F.col("qkey"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return named.select(F.col("id").alias("query_id"), F.posexplode(others).alias("p", "x")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def _exact(indexed: DataFrame, keys: list[str], queries: np.ndarray, longest: float, k: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(query, list) of the ``k`` nearest vectors of each query in the whole table, itself left out."""
    sent = indexed.sparkSession.sparkContext.broadcast(({key: i for i, key in enumerate(keys)}, queries))

    def run(batches):
        own, queries = sent.value
        score, held = np.zeros((len(queries), 0)), np.zeros((len(queries), 0), np.int32)
        for b in batches:
            if not b.num_rows:
                continue
            mine = queries @ lifted(_vectors(b.column(1), kind), longest).T
            for j, key in enumerate(b.column(0).to_pylist()):
                if key in own:
                    mine[own[key], j] = -np.inf
            score = np.hstack([score, mine])
            held = np.hstack([held, np.broadcast_to(b.column(3).to_numpy(zero_copy_only=False), mine.shape)])
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            score, held = np.take_along_axis(score, top, axis=1), np.take_along_axis(held, top, axis=1)
        q, at = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(score[q, at]), pa.array(held[q, at].astype(np.int32))], names=["q", "score", "list"])

    near = indexed.mapInArrow(run, "q int, score double, list int")
    best = near.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "list"))).where(F.col("at") <= k).select("q", "list").collect()
    return np.array([r.q for r in best], np.int64), np.array([r["list"] for r in best], np.int64)


def _keyed(rows: DataFrame, kind: str) -> DataFrame:
    """(id, key) of each row, without repeats of both."""

    def run(batches):
        import xxhash

        for b in batches:
            keys = [xxhash.xxh3_128_hexdigest((np.array(x, kind) + np.array(0, kind)).tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.string())], names=["id", "key"])

    return rows.mapInArrow(run, "id long, key string").distinct()


@query()
def op7_neighbours(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"))
