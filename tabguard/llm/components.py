"""Connected components of a graph given as links, without gathering it anywhere.

Rounds of large-star and small-star: every vertex's neighbours are pointed at the smallest one, first
the larger neighbours, then the smaller ones. Each star is a map-side combined minimum and a join
back, so a hub's links are spread over tasks. Rounds end when the links form stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.session import write_and_reread


def _smallest(links: DataFrame) -> DataFrame:
    """For (u, v): every v with the smallest of u and all v of its u."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return links.join(least, links["u"] == least["k"]).select("u", "v", "m")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    near = _smallest(down)
    ends = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
    return ends.where("u != v").distinct()


def connected(links: DataFrame, first: str, second: str) -> DataFrame:
    """(vertex, root) for every vertex with a link to another one; root is the smallest vertex of its component.

    Nulls and links of a vertex to itself are passed over; repeated links count once.
    """
    current = links.select(F.col(first).alias("u"), F.col(second).alias("v")).where("u is not null and v is not null and u != v").distinct()
    current = write_and_reread(current, "links")
    total = _digest(current)
    while total[0]:
        stars = write_and_reread(_small_star(_large_star(current)), "links")
        after = _digest(stars)
        if after == total:
            break
        current, total = stars, after
    return current.select(F.col("u").alias("vertex"), F.col("v").alias("root"))


def _digest(links: DataFrame) -> tuple:
    """Number and order-free checksum of the links: equal once a round changes nothing."""
    row = links.agg(F.count("u").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["x"], row["s"]
