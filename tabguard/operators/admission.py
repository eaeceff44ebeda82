"""Sliding-window request admission over a finished log, and the trailing request count."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabguard.plans.ordered import PIECE_ROWS, same_keys, with_pieces
from tabguard.schema import c
from tabguard.session import write_and_reread

WINDOW_SECONDS = 60
DEFAULT_LIMIT = 10


def micros(ts: str) -> Column:
    return F.unix_micros(c(ts).cast("timestamp"))


def admit_requests(
    requests: DataFrame,
    keys: list[str],
    ts: str,
    order_id: str,
    limit: int | str = DEFAULT_LIMIT,
    window_seconds: int = WINDOW_SECONDS,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """``(keys..., order_id, ts, admitted, in_window, remaining, reset_at, limit)`` for every request.

    ``limit`` is a number, or the column that holds each key's own (null: the default; if a key has
    several, that of a request holds for the request).

    A request is admitted if fewer than ``limit`` admitted ones lie less than ``window_seconds``
    before it; rejected ones are not remembered, so the decision is a replay in time order. Rows are
    sorted by key and time inside partitions and stream through with at most ``limit`` remembered
    times. A very busy key is cut into pieces by time, and the pieces replay in parallel: each starts
    from an assumed state, and only those whose predecessor ended differently are replayed, until
    nothing changes. That fixed point is the sequential result.
    """
    span = window_seconds * 1_000_000
    names = [f"_k{i}" for i in range(len(keys))]
    rows = requests.select(*[c(k).alias(n) for k, n in zip(keys, names)], micros(ts).alias("_t"), c(order_id).cast("long").alias("_id"),
                           limit_column(limit).alias("_limit"))
    pieced, cut = with_pieces(rows, names, ["_t", "_id"], piece_rows)
    events = pieced.select(*names, "_piece", F.lit(1).alias("_kind"), "_t", "_id", "_limit")
    if cut:
        # Only the busy keys are read several times, so only they are written.
        busy = write_and_reread(events.filter(F.col("_piece") > 0), "requests")
        states = _entry_states(busy, names, span, max(1, PIECE_ROWS // piece_rows))
        events = events.filter(F.col("_piece") == 0).unionByName(busy).unionByName(states)

    def decide(batches):
        yield from _replay(batches, names, span, states=False)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    decided = _in_time_order(events, names).mapInPandas(decide, schema + ", admitted boolean, in_window int")
    kinds = {f.name: f.dataType for f in requests.schema}
    return decided.select(
        *[c(n).alias(k) for k, n in zip(keys, names)],
        F.col("_id").cast(kinds[order_id]).alias(order_id),
        F.timestamp_micros("_t").cast(kinds[ts]).alias(ts),
        "admitted", "in_window",
        F.greatest(F.lit(0), F.col("_limit") - F.col("in_window")).alias("remaining"),
        F.timestamp_micros(F.col("_t") + span).cast(kinds[ts]).alias("reset_at"),
        F.col("_limit").alias("limit"),
    )


def limit_column(limit: int | str) -> Column:
    return F.coalesce(c(limit).cast("int"), F.lit(DEFAULT_LIMIT)) if isinstance(limit, str) else F.lit(limit)


def _in_time_order(events: DataFrame, names: list[str], chained: bool = False) -> DataFrame:
    # A fixed number of partitions: the replay is worth more tasks than its bytes suggest to AQE.
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = events.repartition(parts, *names) if chained else events.repartition(parts, *names, "_piece")
    return dealt.sortWithinPartitions(*names, "_piece", "_kind", "_t", "_id")


def decide_in_order(times: list[int], limits: list[int], first: int, last: int, recent: deque, span: int) -> list[tuple[int, int]]:
    """Admit from ``times[first:last]`` in order; returns ``(position, in_window)`` of the admitted.

    A full window rejects everything of that limit until its oldest time expires, so the walk jumps there.
    """
    admitted, at = [], first
    alike = first < last and min(limits[first:last]) == max(limits[first:last])
    while at < last:
        while recent and recent[0] <= times[at] - span:
            recent.popleft()
        limit = limits[at]
        if len(recent) < limit:
            recent.append(times[at])
            admitted.append((at, len(recent)))
            at += 1
        elif not recent:
            at += 1  # a limit of 0
        else:
            full = bisect_left(times, recent[0] + span, at, last)
            at = full if alike else next((i for i in range(at + 1, full) if limits[i] > limit), full)
    return admitted


def _replay(batches, names: list[str], span: int, states: bool, chained: bool = False):
    """Walk sorted rows; yield decisions, or the remembered times at the start and the end of every piece.

    ``chained`` pieces of a key start with what the one before left.
    """
    import numpy as np
    import pandas as pd

    group_columns = [*names, "_piece"]
    current, recent, before = None, deque(), []
    for pdf in batches:
        kind, times, limits = pdf["_kind"].to_numpy(), pdf["_t"].tolist(), pdf["_limit"].tolist()
        changed = np.zeros(max(len(pdf) - 1, 0), dtype=bool)
        for name in group_columns:
            values, missing = pdf[name].to_numpy(), pdf[name].isna().to_numpy()
            changed |= (values[1:] != values[:-1]) & ~(missing[1:] & missing[:-1])
        starts = [0, *(np.flatnonzero(changed) + 1).tolist()]
        groups = pdf[group_columns].iloc[starts].astype(object)
        groups = list(groups.where(groups.notna(), None).itertuples(index=False, name=None))
        admitted, used, ends = np.zeros(len(pdf), dtype=bool), pdf["_limit"].to_numpy(copy=True), []
        for group, first, last in zip(groups, starts, [*starts[1:], len(pdf)]):
            if group != current:
                if states and current is not None:
                    ends.append((*current, before, list(recent)))
                if not chained or current is None or group[:-1] != current[:-1]:
                    recent = deque()
                current, before = group, list(recent)
            while first < last and kind[first] == 0:
                recent.append(times[first])
                before.append(times[first])
                first += 1
            for at, count in decide_in_order(times, limits, first, last, recent, span):
                admitted[at], used[at] = True, count
        if states:
            if ends:
                yield pd.DataFrame(ends, columns=[*group_columns, "_in", "_end"])
        else:
            decided = pdf[[*names, "_t", "_id", "_limit"]].assign(admitted=admitted, in_window=used)
            yield decided[kind == 1]
    if states and current is not None:
        yield pd.DataFrame([(*current, before, list(recent))], columns=[*group_columns, "_in", "_end"])


def _entry_states(events: DataFrame, names: list[str], span: int, most: int) -> DataFrame:
    """Rows of kind 0: the remembered times at the start of every piece, one per row.

    All pieces replay from an empty state first. Then those whose predecessor ended differently
    from what they assumed replay again: twice all of them, which settles every piece that holds a
    quiet moment. From then on the first of each key replays together with the pieces behind it, one
    after the other in one task, four times as many in each round up to ``most`` (about a million rows
    are one task's work at most): a key that is always full takes a round for each ``most`` of its
    pieces. The state table has one row per piece and key that was cut; what is due is joined by a
    shuffle where it is large.
    """

    pieces = [*names, "_piece"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.select(*pieces).schema) + ", _in array<long>, _end array<long>"

    def run(part: DataFrame, chained: bool = False) -> DataFrame:
        def finish(batches):
            yield from _replay(batches, names, span, states=True, chained=chained)

        return _in_time_order(part, names, chained).mapInPandas(finish, schema)

    def as_rows(states: DataFrame, state: str) -> DataFrame:
        return states.select(*pieces, F.lit(0).alias("_kind"), F.explode(state).alias("_t"), F.lit(0).cast("long").alias("_id"), F.lit(0).alias("_limit"))

    empty = F.array().cast("array<long>")
    of_key = Window.partitionBy(*names)
    table = write_and_reread(run(events), "states")
    for round_number in count(1):
        wanted = table.withColumn("_want", F.coalesce(F.lag("_end").over(of_key.orderBy("_piece")), empty))
        due, chained = F.col("_want") != F.col("_in"), round_number > 2
        if chained:
            numbered = wanted.withColumn("_at", F.row_number().over(of_key.orderBy("_piece")))
            first = F.col("_at") - F.min(F.when(due, F.col("_at"))).over(of_key)
            # Only the first piece of a run is given a state.
            wanted = numbered.withColumn("_from", first).withColumn("_want", F.when(F.col("_from") == 0, F.col("_want")))
            due = (F.col("_from") >= 0) & (F.col("_from") < min(most, 4 ** (round_number - 2)))
        due = write_and_reread(wanted.filter(due).select(*pieces, "_want"), "due")
        if due.isEmpty():
            return as_rows(table, "_in")
        seams = [f"_due{i}" for i in range(len(pieces))]
        named = due.select(*[c(p).alias(n) for p, n in zip(pieces, seams)])
        again = events.join(named, same_keys(events, named, pieces, seams), "left_semi")
        redone = run(again.unionByName(as_rows(due, "_want")), chained)
        kept = table.join(named, same_keys(table, named, pieces, seams), "left_anti")
        table = write_and_reread(kept.unionByName(redone), "states")


def quota(admissions: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Per key, the headers after its last request: limit (its own, or ``limit`` for all), remaining requests and reset time."""
    last = F.max_by(F.struct("remaining", "reset_at", "_limit"), F.struct("_ts", "_id"))
    named = admissions.withColumnsRenamed({admissions.columns[len(keys)]: "_id", admissions.columns[len(keys) + 1]: "_ts", "limit": "_limit"})
    return named.groupBy(*[c(k) for k in keys]).agg(last.alias("q")).select(
        *[c(k) for k in keys], (F.col("q._limit") if limit is None else F.lit(limit)).alias("limit"), "q.remaining", "q.reset_at"
    )


def trailing_counts(requests: DataFrame, keys: list[str], ts: str, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """``(keys..., ts, at_once, requests)``: per key and moment, the requests of that moment and those of the
    trailing window up to it.

    Equal moments are summed before the shuffle. Time is cut into blocks of one window length; a moment
    looks back into its own block and the one before, so it is copied once forward, and a busy key is
    spread over its blocks, none of which holds more moments than the window has microseconds.
    """
    span = window_seconds * 1_000_000
    names = [c(k) for k in keys]
    moments = requests.groupBy(*names, c(ts)).agg(F.count(F.lit(1)).alias("at_once"))
    timed = moments.withColumn("_t", micros(ts)).withColumn("_shift", F.explode(F.array(F.lit(0), F.lit(1))))
    blocked = timed.withColumn("_block", F.floor(F.col("_t") / F.lit(span)).cast("long") + F.col("_shift"))
    trailing = Window.partitionBy(*names, "_block").orderBy("_t").rangeBetween(-(span - 1), 0)
    counted = blocked.withColumn("requests", F.sum("at_once").over(trailing))
    return counted.filter(F.col("_shift") == 0).select(*names, c(ts), "at_once", "requests")
