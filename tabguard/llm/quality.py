"""Quality by hierarchical empirical Bayes.

A document classifier (logistic regression on the make-up of the text) gives evidence for each
document. Its probabilities are summed by path and by host. A host's rate of good documents is
shrunk towards the global rate, a path's towards its host's; how strongly follows from how much the
groups differ beyond chance (moments over all groups), so that sparse sites lean on the level above.
A document's posterior is its own evidence with the prior odds of its path, itself left out.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabguard.llm.common import query, small_batches, table
from tabguard.session import write_and_reread

#: Labelled rows that the classifier is fitted on at most, in expectation.
FIT_ROWS = 20_000
#: Bounds of the number of documents that a prior is worth, and the least distance of a rate from 0 and 1.
WEAKEST, STRONGEST, EDGE = 1.0, 1e6, 1e-4
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t\r", "line": b"\n", "point": b".,;:'\"-()",
           "loud": b"!?", "bar": b"|", "symbol": b"#$%&*+/<=>@[\\]^_`{}~"}


def _class_of() -> np.ndarray:
    out = np.zeros(256, np.int64)
    for number, members in enumerate(CLASSES.values(), 1):
        out[list(members)] = number
    out[:32][out[:32] == 0] = len(CLASSES) + 1
    return out


def make_up(text: bytes, class_of: np.ndarray) -> list[float]:
    """Shares of character classes and of repeated words, word length and size of a text."""
    n = len(text)
    shares = np.bincount(class_of[np.frombuffer(text, np.uint8)], minlength=len(CLASSES) + 2) / max(n, 1)
    words = text.split()
    counts = Counter(words)
    top = max(counts.values(), default=0) / max(len(words), 1)
    runs = sum(a == b for a, b in zip(words, words[1:])) / max(len(words), 1)
    return [*shares.tolist(), len(counts) / max(len(words), 1) ** 0.9 if words else 0.0, top, runs,
            min(n / max(len(words), 1), 40.0) / 10, np.log1p(len(words)) / 10]


def _logistic(x, y, ridge: float = 1.0, rounds: int = 50):
    """Weights, means and spreads of a logistic regression by Newton's steps; without both labels, the prior alone."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    beta = np.zeros(z.shape[1])
    penalty = np.full(len(beta), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * beta)
        beta -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return beta, mean, spread


def fit_classifier(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", fit_rows: int = FIT_ROWS):
    """Weights learnt from labelled rows outside the fold with crc32(id) mod 3 = 1, thinned by a hash to the bound."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_column).alias("i"), F.col("quality").cast("int").alias("y")).where("i is not null and y in (0, 1)")
    known = known.where(F.crc32(F.col("i").cast("string")) % 3 != 1).groupBy("i").agg(F.max("y").alias("y"))
    share = min(1.0, fit_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("i", F.lit("quality")), F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1.0))
    texts = docs.select(F.col(id_column).alias("i"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("t"))
    # About fit_rows rows of two numbers.
    train = texts.join(F.broadcast(chosen), "i").select("t", "y")

    def run(batches):
        class_of = _class_of()
        for batch in batches:
            found = [make_up(t, class_of) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    rows = train.mapInArrow(run, "x array<double>, y int").collect()
    if len({r.y for r in rows}) < 2:
        return None
    return _logistic(np.array([r.x for r in rows]), np.array([r.y for r in rows], float))


def evidence(docs: DataFrame, fitted, id_column: str, text_column: str, host: Column, path: Column) -> DataFrame:
    """(id, host, path, p): the classifier's probability that a document is good; one half where nothing was fitted."""
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("t"),
                         host.cast("string").alias("host"), path.cast("string").alias("path"))
    kind = chosen.schema["id"].dataType.simpleString()

    def run(batches):
        class_of = _class_of()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            if fitted is None:
                p = np.full(len(texts), 0.5)
            else:
                beta, mean, spread = fitted
                x = np.array([make_up(t, class_of) for t in texts]).reshape(len(texts), len(mean))
                p = 1 / (1 + np.exp(-np.clip((x - mean) / spread @ beta[:-1] + beta[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(p)], names=["id", "host", "path", "p"])

    return chosen.mapInArrow(run, f"id {kind}, host string, path string, p double")


def _clipped(rate: Column) -> Column:
    return F.least(F.greatest(rate, F.lit(EDGE)), F.lit(1 - EDGE))


def _logit(rate: Column) -> Column:
    return F.log(_clipped(rate) / (1 - _clipped(rate)))


def prior_strength(groups: DataFrame, rate: str) -> float:
    """How many documents the prior ``rate`` is worth for groups (n, s = sum of p, q = sum of p squared): by moments.

    Groups vary around the rate by chance (the variance within, over n) and by nature (the rest).
    """
    row = groups.where("n > 1").select("n", (F.col("s") / F.col("n") - F.col(rate)).alias("off"), _clipped(F.col(rate)).alias("r"),
                                       F.greatest(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2, F.lit(0.0)).alias("within"))
    row = row.agg(F.sum(F.col("n")).alias("n"), F.sum(F.col("n") * F.col("off") ** 2).alias("between"),
                  F.sum("within").alias("chance"), F.sum(F.col("n") * F.col("r") * (1 - F.col("r"))).alias("spread")).first()
    if not row["n"]:
        return STRONGEST
    nature = (row["between"] - row["chance"]) / row["n"]
    binomial = row["spread"] / row["n"]
    return float(min(STRONGEST, max(WEAKEST, binomial / nature - 1))) if nature > 0 else STRONGEST


def posteriors(found: DataFrame) -> DataFrame:
    """``found`` (id, host, path, p) with the rates of host and path and the posterior of each row.

    A null host or path is a group of its own. The busiest host is summed within partitions first.
    """
    sums = [F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")]
    paths = write_and_reread(found.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    # Half a good and half a bad document keep the global rate off its ends.
    base = ((total["s"] or 0.0) + 0.5) / ((total["n"] or 0) + 1.0)
    hosts = hosts.withColumn("base", F.lit(base))
    m_host = prior_strength(hosts, "base")
    hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("n_host"), ((F.col("s") + m_host * base) / (F.col("n") + m_host)).alias("host_rate"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    m_path = prior_strength(paths, "host_rate")
    paths = paths.select(F.col("host").alias("h"), F.col("path").alias("u"), F.col("n").alias("n_path"), "s", "n_host", "host_rate")
    joined = found.join(paths, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("u")))
    others = (F.col("s") - F.col("p") + m_path * F.col("host_rate")) / (F.col("n_path") - 1 + m_path)
    path_rate = (F.col("s") + m_path * F.col("host_rate")) / (F.col("n_path") + m_path)
    odds = _logit(F.col("p")) + _logit(others) - F.lit(float(np.log(base / (1 - base))))
    return joined.select("id", "host", "path", F.col("p").alias("evidence"), "n_host", "n_path", "host_rate", path_rate.alias("path_rate"),
                         (1 / (1 + F.exp(-odds))).alias("posterior"))


def classify_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.5, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """One row for each row of ``docs``: evidence, rates of its site, ``posterior`` and ``keep``.

    Null and empty texts are judged by their make-up (no words) like any other. Repeated rows count
    and are judged each. Without labels of both kinds the evidence is one half. Other columns of
    ``docs`` are not read; an empty table gives no rows.
    """
    fitted = fit_classifier(docs, labels, id_column, text_column)
    found = write_and_reread(evidence(docs, fitted, id_column, text_column, host, path), "evidence")
    return posteriors(found).withColumn("keep", F.col("posterior") >= threshold).withColumnRenamed("id", id_column)


def host_and_path(url: Column, depth: int = 1) -> tuple[Column, Column]:
    """Host of a URL, and its first ``depth`` path segments; null where there is none."""
    path = F.try_parse_url(url, F.lit("PATH"))
    return F.lower(F.try_parse_url(url, F.lit("HOST"))), F.substring_index(path, "/", depth + 1)


@query()
def op2_quality(spark, sf_dir):
    """Documents have no URL: their source is the host, and the language of the source the path below it."""
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
