"""Gaussian-copula synthesis: marginals and dependence are fitted by Spark, rows are sampled by row id."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard.functions import randoms
from tabguard.functions.gaussian import inverse_normal
from tabguard.functions.statistics import pearson
from tabguard.operators.constraints import Profile, apply_profile
from tabguard.operators.detection import column_roles
from tabguard.operators.noise import Budget, add_noise, noise_ledger
from tabguard.plans.lookups import lookup_join
from tabguard.plans.ordered import running_totals
from tabguard.plans.quantiles import values_at_ranks
from tabguard.schema import c
from tabguard.session import write_and_reread

METHODS = ("GaussianCopula", "PAR")
KNOTS = 200
#: Categories of one column that are kept as literals; larger columns go through joins.
FEW_CATEGORIES = 1_000


@dataclass
class Marginal:
    """One modelled column. ``values`` and ``scores`` are the knots of value against normal score."""

    column: str
    kind: str  # "numerical" or "categorical"
    dtype: str
    null_share: float
    values: list[float]
    scores: list[float]
    categories: int = 0


@dataclass
class CopulaModel:
    """A fitted table: marginals and correlation are small; the category table stays in Spark."""

    columns: list[tuple[str, str, str]]  # name, role, type in output order
    marginals: list[Marginal]
    categories: DataFrame | None  # column, value, n, share, lower, upper, middle (normal scores)
    correlation: np.ndarray
    rows: int

    def names(self) -> list[str]:
        return [m.column for m in self.marginals]

    # ---- the three tables a model consists of

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        knots = [
            (m.column, m.kind, m.dtype, m.null_share, i, v, z)
            for m in self.marginals for i, (v, z) in enumerate(zip(m.values or [None], m.scores or [None]))
        ]
        names = self.names()
        pairs = [(a, b, float(self.correlation[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
        return {
            "marginals": spark.createDataFrame(
                knots, "column string, kind string, dtype string, null_share double, knot int, value double, score double"),
            "correlation": spark.createDataFrame(pairs, "col_a string, col_b string, corr double"),
            "columns": spark.createDataFrame(
                [(i, *column, self.rows) for i, column in enumerate(self.columns)],
                "position int, column string, role string, dtype string, rows long"),
        }

    def save(self, spark: SparkSession, path: str) -> None:
        for name, df in self.tables(spark).items():
            df.write.parquet(f"{path}/{name}")
        if self.categories is not None:
            self.categories.write.parquet(f"{path}/categories")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "CopulaModel":
        columns = spark.read.parquet(f"{path}/columns").orderBy("position").collect()
        knots = spark.read.parquet(f"{path}/marginals").orderBy("knot").collect()
        pairs = {(r["col_a"], r["col_b"]): r["corr"] for r in spark.read.parquet(f"{path}/correlation").collect()}
        has_categories = any(r["kind"] == "categorical" for r in knots)
        categories = spark.read.parquet(f"{path}/categories") if has_categories else None
        marginals = []
        for r in columns:
            own = [k for k in knots if k["column"] == r["column"]]
            if own:
                filled = [k for k in own if k["score"] is not None]
                marginals.append(Marginal(r["column"], own[0]["kind"], own[0]["dtype"], own[0]["null_share"],
                                          [k["value"] for k in filled], [k["score"] for k in filled]))
        if categories is not None:
            counts = {r["column"]: r["count"] for r in categories.groupBy("column").count().collect()}
            for m in marginals:
                m.categories = counts.get(m.column, 0)
        names = [m.column for m in marginals]
        matrix = np.array([[pairs[a, b] for b in names] for a in names]).reshape(len(names), len(names))
        return CopulaModel([(r["column"], r["role"], r["dtype"]) for r in columns], marginals, categories, matrix,
                           columns[0]["rows"] if columns else 0)


# ---------------------------------------------------------------- fit


def as_number(name: str, kind: T.DataType) -> Column:
    """Numbers as double; dates and timestamps as (fractional) seconds."""
    if isinstance(kind, T.DateType):
        return F.unix_date(c(name)).cast("double") * F.lit(86400.0)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c(name).cast("timestamp")).cast("double") / F.lit(1e6)
    return c(name).cast("double")


def from_number(value: Column, dtype: str) -> Column:
    if dtype == "date":
        return F.date_from_unix_date(F.floor(value / 86400.0).cast("int"))
    if dtype.startswith("timestamp"):
        return F.timestamp_micros(F.rint(value * 1e6).cast("long")).cast(dtype)
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        return F.rint(value).cast(dtype)
    return value.cast(dtype)


def normal_scores(probabilities: list[float], rows: int) -> list[float]:
    edge = 0.5 / max(rows, 1)
    return [NormalDist().inv_cdf(min(max(p, edge), 1.0 - edge)) for p in probabilities]


def fit_knots(df: DataFrame, columns: list[str], counts: dict[str, int]) -> dict[str, tuple[list[float], list[float]]]:
    """Quantile knots of every column: the value at exactly the rank of each probability, at any size."""
    probabilities = [k / KNOTS for k in range(KNOTS + 1)]
    filled = [n for n in columns if counts[n] > 0]
    # The place of a probability: the first value that this share of the values doesn't exceed.
    places = {n: [max(1, math.ceil(k / KNOTS * counts[n])) - 1 for k in range(KNOTS + 1)] for n in filled}
    values = values_at_ranks(df, {n: sorted(set(at)) for n, at in places.items()}, counts)
    found = {n: ([values[n][r] for r in places[n]], normal_scores(probabilities, counts[n])) for n in filled}
    return {n: found.get(n, ([], [])) for n in columns}


def category_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts, shares and normal-score intervals of every category, in hash order per column.

    Hash order gives buckets of equal size without cut points, so a column with very many
    categories is laid out in parallel.
    """
    cells = F.array(*[F.struct(F.lit(n).alias("column"), c(n).cast("string").alias("value")) for n in columns])
    place = F.xxhash64("value")
    counted = (
        df.select(F.inline(cells)).filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("place", place)
    )
    counted = write_and_reread(counted, "category-counts")
    # Buckets of hash order with about a hundred thousand categories each, 1,024 at least.
    bits = max(10, (counted.count() // 100_000).bit_length())
    counted = counted.withColumn("bucket", F.shiftright("place", 64 - bits))
    running = running_totals(counted, {"upto": "n"}, [F.col("place"), F.col("value")], ["column"])
    totals = counted.groupBy("column").agg(F.sum("n").alias("total"))
    below, upto = (F.col("upto") - F.col("n")) / F.col("total"), F.col("upto") / F.col("total")
    return running.join(F.broadcast(totals), "column").select(
        "column", "value", "n", (F.col("n") / F.col("total")).alias("share"),
        F.coalesce(inverse_normal(below), F.lit(-math.inf)).alias("lower"),
        F.coalesce(inverse_normal(upto), F.lit(math.inf)).alias("upper"),
        inverse_normal((below + upto) / 2).alias("middle"),
    )


def _interpolate(df: DataFrame, source: str, target: str, xs: list[float], ys_at: list[float], ys_from: list[float], ys_to: list[float]) -> DataFrame:
    """``target`` = linear interpolation of ``source`` over sorted distinct ``xs``.

    At a knot the result is ``ys_at``; between knots i and i+1 it runs from ``ys_from[i]`` to
    ``ys_to[i + 1]``; outside it is the value of the end knot.
    """
    m = len(xs)
    if m == 1:
        return df.withColumn(target, F.when(c(source).isNotNull(), F.lit(ys_at[0])))
    index = f"_i_{target}"
    df = Bucketizer(splits=[-math.inf, *xs, math.inf], inputCol=source, outputCol=index, handleInvalid="keep").transform(df)
    # Bucket b holds [xs[b-1], xs[b]); bucket 0 lies below all knots, bucket m at or above the last.
    starts = [ys_at[0], *ys_from[:-1], ys_at[-1]]
    slopes = [0.0, *[(ys_to[i + 1] - ys_from[i]) / (xs[i + 1] - xs[i]) for i in range(m - 1)], 0.0]
    lefts = [xs[0], *xs]
    at = F.least(c(index).cast("int") + F.lit(1), F.lit(m + 1))

    def pick(values):
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), at)

    value = pick(starts) + (c(source) - pick(lefts)) * pick(slopes)
    if any(a != f for a, f in zip(ys_at[:-1], ys_from[:-1])):
        value = F.when(c(source) == pick(lefts), pick([ys_at[0], *ys_at])).otherwise(value)
    else:
        # Infinite sources would turn the flat end pieces into infinity * 0.
        value = F.when(c(index) == 0, F.lit(ys_at[0])).when(c(index) >= m, F.lit(ys_at[-1])).otherwise(value)
    return df.withColumn(target, F.when(c(source).isNotNull(), value)).drop(index)


def _runs(xs_in: list[float], ys: list[float]):
    """Distinct sorted ``xs`` with the first, last and mean ``y`` of each run of equal ones."""
    xs, first, last = [], [], []
    for x, y in zip(xs_in, ys):
        if xs and x <= xs[-1]:
            last[-1] = y
        else:
            xs.append(x)
            first.append(y)
            last.append(y)
    return xs, first, last, [(a + b) / 2 for a, b in zip(first, last)]


def score_columns(df: DataFrame, marginals: list[Marginal], categories: DataFrame | None) -> DataFrame:
    """Add ``z0, z1, ...``: the normal score of every modelled column (numbers are in ``v0, v1, ...``)."""
    for i, m in enumerate(marginals):
        if m.kind == "numerical":
            xs, first, last, middle = _runs(m.values, m.scores)
            df = _interpolate(df, f"v{i}", f"z{i}", xs, middle, last, first) if xs else df.withColumn(f"z{i}", F.lit(None).cast("double"))
            continue
        table = categories.filter(F.col("column") == m.column).select(
            F.col("value").alias(f"s{i}"), F.col("n").alias(f"_n{i}"), F.col("middle").alias(f"z{i}")
        )
        if m.categories <= FEW_CATEGORIES:
            df = df.join(F.broadcast(table.drop(f"_n{i}")), f"s{i}", "left")
        else:
            df = lookup_join(df, table, [f"s{i}"], f"_n{i}", [f"z{i}"])
    return df


def prepared(df: DataFrame, marginals: list[tuple[str, str]]) -> DataFrame:
    """Numeric view ``v<i>`` of numerical and text view ``s<i>`` of categorical columns."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(
        "*",
        *[as_number(n, kinds[n]).alias(f"v{i}") if kind == "numerical" else c(n).cast("string").alias(f"s{i}")
          for i, (n, kind) in enumerate(marginals)],
    )


def fit_marginals(df: DataFrame, modelled: list[tuple[str, str]]) -> tuple[list[Marginal], DataFrame | None, int]:
    kinds = {f.name: f.dataType for f in df.schema}
    view = prepared(df, modelled)
    profile = view.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c(n)).alias(f"n{i}") for i, (n, _) in enumerate(modelled)]).first()
    rows = profile["rows"]
    counts = {f"v{i}": profile[f"n{i}"] for i, _ in enumerate(modelled)}
    numerical = [f"v{i}" for i, (_, kind) in enumerate(modelled) if kind == "numerical"]
    knots = fit_knots(view, numerical, counts) if numerical else {}
    categorical = [n for n, kind in modelled if kind == "categorical"]
    categories, sizes = None, {}
    if categorical:
        categories = write_and_reread(category_table(df, categorical), "categories")
        sizes = {r["column"]: r["count"] for r in categories.groupBy("column").count().collect()}
    marginals = [
        Marginal(n, kind, kinds[n].simpleString(), 1.0 - profile[f"n{i}"] / rows if rows else 0.0,
                 *knots.get(f"v{i}", ([], [])), categories=sizes.get(n, 0))
        for i, (n, kind) in enumerate(modelled)
    ]
    return marginals, categories, rows


def positive_definite(matrix: np.ndarray) -> np.ndarray:
    """Nearest usable correlation matrix: undefined entries 0, eigenvalues kept above a small floor."""
    matrix = np.nan_to_num(np.array(matrix, dtype=float))
    np.fill_diagonal(matrix, 1.0)
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    repaired = vectors @ np.diag(np.maximum(values, 1e-6)) @ vectors.T
    scale = 1.0 / np.sqrt(np.diag(repaired))
    return repaired * np.outer(scale, scale)


def score_correlation(scored: DataFrame, d: int, pairs_per_scan: int = 500) -> np.ndarray:
    matrix = np.eye(d)
    pairs = [(i, j) for i in range(d) for j in range(i)]
    for start in range(0, len(pairs), pairs_per_scan):
        chunk = pairs[start:start + pairs_per_scan]
        row = scored.agg(*[pearson(c(f"z{i}"), c(f"z{j}")).alias(f"r{i}_{j}") for i, j in chunk]).first()
        for i, j in chunk:
            matrix[i, j] = matrix[j, i] = row[f"r{i}_{j}"] or 0.0
    return positive_definite(matrix) if d else matrix


def modelled_columns(roles: dict[str, str]) -> list[tuple[str, str]]:
    kinds = {"numerical": "numerical", "datetime": "numerical", "categorical": "categorical", "boolean": "categorical"}
    return [(n, kinds[r]) for n, r in roles.items() if r in kinds]


def fit_copula(
    df: DataFrame, epsilon: float | None = None, key: list[str] | None = None, seed: int | None = None, method: str = "GaussianCopula"
) -> CopulaModel:
    """Fit marginals (one scan each for numbers and categories) and the correlation of normal scores.

    With ``epsilon`` the numeric columns are noised first (their ledger is :func:`noise_ledger`).
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {METHODS}")
    roles = column_roles(df)
    if epsilon is not None:
        numbers = [n for n, r in roles.items() if r == "numerical"]
        if numbers:
            df = add_noise(df, noise_ledger(df, Budget(epsilon), numbers), key, seed)
    modelled = modelled_columns(roles)
    marginals, categories, rows = fit_marginals(df, modelled)
    view = prepared(df, modelled)
    view = view.select(*[n for n in view.columns[len(df.columns):]])
    correlation = score_correlation(score_columns(view, marginals, categories), len(marginals))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return CopulaModel([(n, r, kinds[n]) for n, r in roles.items()], marginals, categories, correlation, rows)


# ---------------------------------------------------------------- sample


def values_of_scores(df: DataFrame, marginals: list[Marginal], categories: DataFrame | None, keys: list[str], seed: int) -> DataFrame:
    """Replace the normal scores ``z<i>`` by values of the modelled columns; ``keys`` identify a row."""
    key_columns = [c(k) for k in keys]
    for i, m in enumerate(marginals):
        if m.kind == "numerical":
            if not m.values:
                df = df.withColumn(f"o{i}", F.lit(None).cast(m.dtype)).drop(f"z{i}")
                continue
            scores, first, last, middle = _runs(m.scores, m.values)
            df = _interpolate(df, f"z{i}", f"_v{i}", scores, middle, last, first)
            df = df.withColumn(f"o{i}", from_number(F.col(f"_v{i}"), m.dtype)).drop(f"_v{i}", f"z{i}")
        else:
            df = _draw_categories(df, i, m, categories)
        if m.null_share > 0:
            keep = randoms.uniform(seed, f"null/{m.column}", *key_columns) >= m.null_share
            df = df.withColumn(f"o{i}", F.when(keep, F.col(f"o{i}")))
    return df


def _draw_categories(df: DataFrame, i: int, m: Marginal, categories: DataFrame) -> DataFrame:
    """``o<i>``: the category whose interval of normal scores holds ``z<i>``.

    The FEW_CATEGORIES largest categories are literals, found by binary search. Rows that fall
    between them meet the rest in a join on cells of the score range.
    """
    own = categories.filter(F.col("column") == m.column)
    large = sorted(own.orderBy(F.desc("n"), "value").limit(FEW_CATEGORIES).collect(), key=lambda r: r["lower"])
    if not large:
        return df.withColumn(f"o{i}", F.lit(None).cast(m.dtype)).drop(f"z{i}")
    # Piece k of the score range starts at starts[k] and belongs to values[k] (None: a gap).
    starts, values = [-math.inf], [None]
    for r in large:
        for start, value in ((r["lower"], r["value"]), (r["upper"], None)):
            if start == starts[-1]:
                values[-1] = value
            elif start > starts[-1] and start < math.inf:
                starts.append(start)
                values.append(value)
    index = f"_i{i}"
    if len(starts) > 1:
        df = Bucketizer(splits=[*starts, math.inf], inputCol=f"z{i}", outputCol=index, handleInvalid="keep").transform(df)
    else:
        df = df.withColumn(index, F.lit(0.0))
    found = F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), F.col(index).cast("int") + 1)
    if m.categories <= FEW_CATEGORIES:
        return df.withColumn(f"o{i}", found.cast(m.dtype)).drop(index, f"z{i}")
    # One cell per category: a row meets about two of them. No category left has more than
    # 1/FEW_CATEGORIES of the rows, hence none spans many cells.
    cells = m.categories
    rest = own.join(F.broadcast(own.orderBy(F.desc("n"), "value").limit(FEW_CATEGORIES).select("value")), "value", "left_anti")
    spread = rest.select(
        F.explode(F.sequence(_cell(F.col("lower"), cells), _cell(F.col("upper"), cells))).alias("_cell"),
        "lower", "upper", F.col("value").alias("_rest"),
    )
    # Rows that are served already get cells that do not exist, spread over all partitions.
    elsewhere = -F.lit(1) - F.pmod(F.xxhash64(f"z{i}"), F.lit(4096))
    placed = df.withColumn("_large", found).withColumn(
        "_at", F.when(F.col("_large").isNotNull(), elsewhere).otherwise(_cell(F.col(f"z{i}"), cells))
    )
    inside = (F.col("_at") == F.col("_cell")) & (F.col(f"z{i}") >= F.col("lower")) & (F.col(f"z{i}") < F.col("upper"))
    joined = placed.join(spread, inside, "left")
    return joined.withColumn(f"o{i}", F.coalesce("_large", "_rest").cast(m.dtype)).drop(
        index, "_large", "_rest", "_at", "_cell", "lower", "upper", f"z{i}"
    )


def _cell(score: Column, cells: int) -> Column:
    """Cell of a normal score. The logistic curve is close enough to the normal one to fill the
    cells evenly; all that matters for the result is that it rises with the score."""
    share = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-1.702) * score))
    return F.least(F.floor(share * F.lit(float(cells))), F.lit(cells - 1)).cast("long")


def correlated_scores(df: DataFrame, correlation: np.ndarray, key: Column, seed: int) -> DataFrame:
    """``z<i>``: normal scores with the given correlation, drawn from the row key."""
    factor = np.linalg.cholesky(correlation) if len(correlation) else correlation
    d = len(correlation)
    drawn = df.select("*", *[randoms.normal(seed, f"score/{i}", key).alias(f"e{i}") for i in range(d)])
    combined = []
    for i in range(d):
        total = F.lit(0.0)
        for j in range(i + 1):
            if factor[i, j] != 0.0:
                total = total + F.lit(float(factor[i, j])) * F.col(f"e{j}")
        combined.append(total.alias(f"z{i}"))
    return drawn.select(*df.columns, *combined)


def sample_rows(
    spark: SparkSession, model: CopulaModel | None, count: int, seed: int = 0, profile: Profile | None = None, keep_row_id: bool = False
) -> DataFrame:
    """``count`` synthetic rows with the fitted table's columns.

    A row depends on its number and the seed alone, so a lost task repeats the same rows and the
    partitioning does not matter. Id columns are numbered afresh. ``profile`` is applied last.
    """
    if model is None:
        raise RuntimeError("fit a model before sampling")
    base = spark.range(count).withColumnRenamed("id", "_row")
    df = correlated_scores(base, model.correlation, F.col("_row"), seed)
    df = values_of_scores(df, model.marginals, model.categories, ["_row"], seed)
    at = {m.column: i for i, m in enumerate(model.marginals)}

    def output(name, role, dtype):
        if name in at:
            return F.col(f"o{at[name]}").alias(name)
        if role == "id" and dtype == "string":
            return F.concat(F.lit(f"{name}-"), F.col("_row").cast("string")).alias(name)
        if role == "id":
            return F.col("_row").cast(dtype).alias(name)
        return F.lit(None).cast(dtype).alias(name)

    rows = df.select("_row", *[output(*column) for column in model.columns])
    if profile is not None:
        rows = apply_profile(rows, profile, key=["_row"], seed=seed)
    return rows if keep_row_id else rows.drop("_row")
