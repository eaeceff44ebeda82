"""Structured Streaming forms of request admission and of the request count."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.operators.admission import DEFAULT_LIMIT, WINDOW_SECONDS, decide_in_order, limit_column, micros
from tabguard.schema import c


def admit_stream(
    requests: DataFrame,
    keys: list[str],
    ts: str,
    order_id: str,
    limit: int | str = DEFAULT_LIMIT,
    window_seconds: int = WINDOW_SECONDS,
    lateness: str = "1 minute",
) -> DataFrame:
    """Stream of ``(key, order_id, ts, admitted, in_window, remaining)``; ``key`` is the JSON of ``keys``.

    The state of a key is its at most ``limit`` admitted times. It is dropped once the watermark has
    passed the window of the last one. A request is judged when it arrives, against what was admitted
    before: requests in time order get the decisions of the batch form, and one that comes late, but
    inside the watermark, is judged after later ones that came first. Requests later than the watermark
    are dropped by Spark and show up in the query's progress (``numRowsDroppedByWatermark``). Set the
    source's rate option (such as ``maxFilesPerTrigger``): a key's rows of one micro-batch are in one task.
    """
    span = window_seconds * 1_000_000
    timed = requests.select(
        F.to_json(F.struct(*[c(k) for k in keys])).alias("key"), c(ts).cast("timestamp").alias("ts"), micros(ts).alias("t"),
        c(order_id).cast("long").alias("order_id"), limit_column(limit).alias("limit"),
    ).withWatermark("ts", lateness)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(batches)).sort_values(["t", "order_id"])
        times, limits = rows["t"].tolist(), rows["limit"].tolist()
        admitted, used = np.zeros(len(rows), dtype=bool), rows["limit"].to_numpy(copy=True)
        for at, count in decide_in_order(times, limits, 0, len(times), recent, span):
            admitted[at], used[at] = True, count
        state.update((list(recent),))
        if recent:
            wake = (recent[-1] + span) // 1000 + 1
            state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({
            "key": key[0], "order_id": rows["order_id"].to_numpy(), "t": rows["t"].to_numpy(), "admitted": admitted, "in_window": used,
            "limit": rows["limit"].to_numpy(),
        })

    decided = timed.groupBy("key").applyInPandasWithState(
        step, "key string, order_id long, t long, admitted boolean, in_window int, limit int", "recent array<long>", "append", "EventTimeTimeout"
    )
    return decided.select(
        "key", "order_id", F.timestamp_micros("t").alias("ts"), "admitted", "in_window",
        F.greatest(F.lit(0), F.col("limit") - F.col("in_window")).alias("remaining"),
    )


def request_counts(
    requests: DataFrame, keys: list[str], ts: str, window: str = "60 seconds", slide: str = "10 seconds", lateness: str = "1 minute"
) -> DataFrame:
    """Requests per key and sliding window, emitted when the watermark has passed the window."""
    timed = requests.withColumn(ts, c(ts).cast("timestamp")).withWatermark(ts, lateness)
    return timed.groupBy(F.window(c(ts), window, slide).alias("w"), *[c(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("requests")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c(k) for k in keys], "requests")
