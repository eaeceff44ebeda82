"""Request admission in event time: late requests are judged in their place, as in the batch form."""

from __future__ import annotations

from collections import defaultdict, deque
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tabguard.operators.admission import DEFAULT_LIMIT, WINDOW_SECONDS, decide_in_order, limit_column, micros
from tabguard.schema import c

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DECIDED = "key string, order_id long, t long, admitted boolean, in_window int, limit int"
_WAITING = {"key": object, "t": "int64", "order_id": "int64", "limit": "int32"}
#: Groups that keys are dealt to; the requests of one that wait are in one task's memory.
KEY_GROUPS = 256


@contextmanager
def rocksdb_state(spark: SparkSession):
    """State stores of queries started inside the block are of the kind that timers and lists need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class _InOrder(StatefulProcessor):
    """Holds the requests of a group of keys until the watermark has passed them, then admits each key's in time order.

    State: ``waiting``, the requests not judged yet, and ``recent``, the admitted times that still count
    (at most ``limit`` a key), both as columns of the whole group; ``wake``, the moment of the one timer that is set.
    A call reads and writes them once, whatever the number of keys: each access is a round trip to the state store.
    """

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "key array<string>, t array<long>, order_id array<long>, limit array<int>")
        self.recent = handle.getValueState("recent", "key array<string>, t array<long>")
        self.wake = handle.getValueState("wake", "at long")

    def _set_timer(self, at: int | None) -> None:
        held = self.wake.get()[0] if self.wake.exists() else None
        if held == at:
            return
        if held is not None:
            self.handle.deleteTimer(held)
        if at is None:
            self.wake.clear()
        else:
            self.handle.registerTimer(at)
            self.wake.update((at,))

    def _judge(self, arrived: list[pd.DataFrame], passed: int) -> pd.DataFrame:
        held = dict(zip(_WAITING, self.waiting.get())) if self.waiting.exists() else {n: [] for n in _WAITING}
        rows = pd.concat([pd.DataFrame(held).astype(_WAITING), *[frame[list(_WAITING)] for frame in arrived]], ignore_index=True)
        # Requests of the watermark's own millisecond wait: another one of it may come.
        due = rows["t"] // 1000 + 1 <= passed
        later, due = rows[~due], rows[due]
        numbers, found = pd.factorize(due["key"])
        order = np.lexsort((due["limit"], due["order_id"], due["t"], numbers))
        due, numbers = due.iloc[order], numbers[order]
        recent = defaultdict(deque)
        for key, t in zip(*self.recent.get()) if self.recent.exists() else ():
            recent[key].append(t)
        times, limits = due["t"].tolist(), due["limit"].tolist()
        admitted, used = np.zeros(len(due), dtype=bool), due["limit"].to_numpy(copy=True)
        edges = np.searchsorted(numbers, np.arange(len(found) + 1)).tolist()
        for key, first, last in zip(found, edges, edges[1:]):
            for at, count in decide_in_order(times, limits, first, last, recent[key], self.span):
                admitted[at], used[at] = True, count
        recent = {key: kept for key, kept in recent.items() if kept and kept[-1] + self.span > passed * 1000}
        if recent:
            self.recent.update(([key for key, kept in recent.items() for _ in kept], [t for kept in recent.values() for t in kept]))
        else:
            self.recent.clear()
        if len(later):
            self.waiting.update(tuple(later[n].tolist() for n in _WAITING))
            self._set_timer(int(later["t"].min()) // 1000 + 1)
        else:
            self.waiting.clear()
            # Nothing to judge: wake up to forget.
            self._set_timer((max(kept[-1] for kept in recent.values()) + self.span) // 1000 + 1 if recent else None)
        return due.assign(admitted=admitted, in_window=used)[["key", "order_id", "t", "admitted", "in_window", "limit"]]

    def handleInputRows(self, key, rows, timerValues):
        yield self._judge(list(rows), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.wake.clear()
        yield self._judge([], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def admit_stream_in_order(
    requests: DataFrame,
    keys: list[str],
    ts: str,
    order_id: str,
    limit: int | str = DEFAULT_LIMIT,
    window_seconds: int = WINDOW_SECONDS,
    lateness: str = "1 minute",
    key_groups: int = KEY_GROUPS,
) -> DataFrame:
    """Stream of ``(key, order_id, ts, admitted, in_window, remaining)``; ``key`` is the JSON of ``keys``.

    A request is judged once the watermark has passed it, ``lateness`` behind the newest one, after all
    earlier ones, in whatever order they came: its decision is that of
    :func:`tabguard.operators.admission.admit_requests` over the log without the requests that came
    behind the watermark (dropped by Spark, ``numRowsDroppedByWatermark``). Requests that the
    watermark has not passed stay in the state: of each key, its requests of about ``lateness`` and at most ``limit``
    times. Keys share their state in ``key_groups`` groups by a hash, so that a batch costs state accesses by the group and
    not by the key; the number is part of the checkpoint and must stay. Start the query inside :func:`rocksdb_state`.
    """
    timed = requests.select(
        F.to_json(F.struct(*[c(k) for k in keys])).alias("key"), c(ts).cast("timestamp").alias("ts"), micros(ts).alias("t"),
        c(order_id).cast("long").alias("order_id"), limit_column(limit).alias("limit"),
    ).withColumn("key_group", F.pmod(F.xxhash64("key"), F.lit(key_groups))).withWatermark("ts", lateness)
    decided = timed.groupBy("key_group").transformWithStateInPandas(_InOrder(window_seconds * 1_000_000), _DECIDED, "append", "EventTime")
    return decided.select(
        "key", "order_id", F.timestamp_micros("t").alias("ts"), "admitted", "in_window",
        F.greatest(F.lit(0), F.col("limit") - F.col("in_window")).alias("remaining"),
    )
