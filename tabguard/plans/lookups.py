"""Join of a large table with a lookup table whose keys may be very unevenly used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard.schema import c

#: The most used keys, served from a broadcast; every other key has below 1/HOT_KEYS of the rows.
HOT_KEYS = 1_000
#: Bytes that the broadcast may hold; a key whose payload is above its share is left to the shuffle join.
HOT_BYTES = 16 << 20


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    keys: list[str],
    usage: str | None,
    payload: list[str],
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Left join ``facts`` to ``table`` (unique on ``keys``), adding ``payload``.

    ``usage`` is the column of ``table`` with the number of facts per key (None: count them).
    The ``hot_keys`` keys with the largest ``usage`` come from a broadcast of that many rows.
    Their fact rows, and those with a null key, get a random-looking salt for the second join, where
    they match nothing and so spread over all partitions. The facts are read once, so lookups may be
    chained. No join hint there: AQE broadcasts a side it measured as small.
    """
    if usage is None:
        # Counted with map-side sums: one row per key and task is shuffled.
        used = facts.groupBy(*[c(k) for k in keys]).agg(F.count(F.lit(1)).alias("_uses"))
        table, usage = table.join(used, keys), "_uses"
    hot = table.orderBy(c(usage).desc(), *[c(k) for k in keys]).limit(hot_keys)
    heavy = [p for p in payload if not isinstance(table.schema[p].dataType, (T.NumericType, T.BooleanType, T.DatetimeType))]
    if heavy:
        size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.to_json(F.struct(c(p)))), F.lit(0)) for p in heavy])
        hot = hot.filter(size <= HOT_BYTES // max(1, hot_keys))
    hot = hot.select(*[c(k) for k in keys], *[c(p).alias(f"_hot_{p}") for p in payload], F.lit(True).alias("_hot"))
    # Always -1, but taken from the keys: a literal would leave the join key, and with it the salt.
    same = F.pmod(F.xxhash64(*[c(k) for k in keys]), F.lit(1)).cast("int") - 1
    cold = table.select(*[c(k) for k in keys], same.alias("_salt"), *[c(p).alias(f"_cold_{p}") for p in payload])
    spread = F.pmod(F.xxhash64(*[c(n) for n in facts.columns]), F.lit(4096)).cast("int")
    # A null key matches nothing: its rows are spread like those of hot keys.
    no_match = reduce(lambda a, b: a | b, [c(k).isNull() for k in keys])
    salted = facts.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot") | no_match, spread).otherwise(F.lit(-1))
    )
    joined = salted.join(cold, [*keys, "_salt"], "left")
    return joined.select(
        *[c(n) for n in facts.columns],
        *[F.when(F.col("_hot"), F.col(f"_hot_{p}")).otherwise(F.col(f"_cold_{p}")).alias(p) for p in payload],
    )
