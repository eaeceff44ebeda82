"""Run log: history, status, notes and annotations as change logs, forks and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.plans.lookups import lookup_join
from tabguard.plans.ordered import PIECE_ROWS, previous_in_groups
from tabguard.schema import c
from tabguard.session import write_and_reread

FORKED_FIELDS = ("method", "num_rows", "sensitive_column", "epsilon", "epochs")


def history(configs: DataFrame) -> DataFrame:
    """Newest first; a missing timestamp sorts as the empty text, so last."""
    return configs.orderBy(F.coalesce("timestamp", F.lit("")).desc(), F.col("experiment_id").asc())


def resolve(requested: DataFrame, configs: DataFrame, reports: DataFrame, notes: DataFrame) -> DataFrame:
    """For every requested id: its report document, else its configuration, else not found; and its notes.

    The three right sides have one row per experiment; an id may be requested any number of times.
    """
    config = configs.select("experiment_id", F.to_json(F.struct(*[c(n) for n in configs.columns])).alias("_config"))
    report = reports.select("experiment_id", F.col("document").alias("_report"))
    note = notes.select("experiment_id", F.col("text").alias("_notes"))
    known = report.join(config, "experiment_id", "full").join(note, "experiment_id", "full")
    found = lookup_join(requested, known, ["experiment_id"], None, ["_report", "_config", "_notes"])
    source = F.when(F.col("_report").isNotNull(), "report").when(F.col("_config").isNotNull(), "config").otherwise("not_found")
    return found.select(
        "experiment_id", source.alias("source"), F.coalesce("_report", "_config").alias("document"),
        F.coalesce("_notes", F.lit("")).alias("notes"),
    )


def latest_status(events: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Last status per id of ``(experiment_id, status, ts, seq)``; ``not_found`` for requested ids without one.

    ``max_by`` merges on the map side, so an id with very many events is no hot spot.
    """
    latest = events.groupBy("experiment_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"))
    if requested is None:
        return latest
    return lookup_join(requested, latest, ["experiment_id"], None, ["status"]).select(
        "experiment_id", F.coalesce("status", F.lit("not_found")).alias("status")
    )


def current_rows(changes: DataFrame, payload: list[str], key: str = "id") -> DataFrame:
    """Live rows of a change log ``(op, id, ts, seq, payload...)`` with ops add, update and delete.

    An id is live if its last add or delete is an add; its content is its last add or update, and
    ``ts`` the time of that change. An update of an id that is not live has no effect: it either
    precedes the last add or belongs to a dead id. One aggregation, no window.
    """
    order = F.struct("ts", "seq")
    decides, writes = F.col("op").isin("add", "delete"), F.col("op").isin("add", "update")
    state = changes.groupBy(key).agg(
        F.max_by("op", F.when(decides, order)).alias("_op"),
        F.max_by(F.struct("ts", *[c(p) for p in payload]), F.when(writes, order)).alias("_row"),
    )
    return state.filter(F.col("_op") == "add").select(key, "_row.*")


def rejected_changes(changes: DataFrame, key: str = "id", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Updates and deletes of ids that were not live at that moment (unknown or deleted)."""
    decides = F.when(F.col("op").isin("add", "delete"), F.col("op"))
    found = previous_in_groups(changes, [key], ["ts", "seq"], decides, "_state", piece_rows)
    dead = F.coalesce(F.col("_state") != "add", F.lit(True))
    return found.filter(F.col("op").isin("update", "delete") & dead).drop("_state")


def upsert_text(changes: DataFrame) -> DataFrame:
    """Notes: the last text per experiment of ``(experiment_id, text, ts, seq)``."""
    return changes.groupBy("experiment_id").agg(F.max_by("text", F.struct("ts", "seq")).alias("text"))


def annotations_per_graph(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("graphId").agg(
        F.count(F.lit(1)).alias("annotations"), F.count_if(~F.col("resolved")).alias("open_annotations")
    )


def saved_sessions(sessions: DataFrame) -> DataFrame:
    """Saved sessions, newest first, with a readable title."""
    title = F.initcap(F.replace("name", F.lit("_"), F.lit(" ")))
    return sessions.withColumn("title", title).orderBy(F.desc("saved_at"), "name")


def fork(configs: DataFrame, requests: DataFrame) -> DataFrame:
    """New configurations from ``(new_id, source_id, timestamp)``: the copied fields, status pending, and the parent."""
    source = configs.select(F.col("experiment_id").alias("source_id"), F.lit(True).alias("_known"), *FORKED_FIELDS)
    found = lookup_join(requests, source, ["source_id"], None, ["_known", *FORKED_FIELDS])
    return found.filter("_known").select(
        F.col("new_id").alias("experiment_id"), F.col("source_id").alias("parent_id"), "timestamp", *FORKED_FIELDS,
        F.lit("pending").alias("status"),
    )


def lineage(forks: DataFrame) -> DataFrame:
    """``(experiment_id, root_id, depth)`` from ``(experiment_id, parent_id)``, parent null for originals.

    Each round doubles the distance every row looks up, so a chain of length n takes log2(n) joins.
    Only rows that have not reached a root are joined, and a much-forked ancestor is served from a
    broadcast (see :func:`lookup_join`). A row whose chain runs into a circle has no root: root and
    depth are null. No chain is longer than the table, so that what is open after log2(rows) rounds is that.
    """
    known = F.col("parent_id").isNotNull()
    state = forks.select(
        "experiment_id", F.coalesce("parent_id", "experiment_id").alias("root_id"), known.cast("int").alias("depth"),
        (~known).alias("done"),
    )
    state = write_and_reread(state, "lineage")
    for _ in range(state.count().bit_length() + 1):
        if state.filter(~F.col("done")).isEmpty():
            break
        table = state.select(
            F.col("experiment_id").alias("root_id"), F.col("root_id").alias("next_id"), F.col("depth").alias("further"), F.col("done").alias("ends")
        )
        stepped = lookup_join(state.filter(~F.col("done")), table, ["root_id"], None, ["next_id", "further", "ends"]).select(
            "experiment_id", F.coalesce("next_id", "root_id").alias("root_id"),
            (F.col("depth") + F.coalesce("further", F.lit(0))).alias("depth"), F.coalesce("ends", F.lit(True)).alias("done"),
        )
        state = write_and_reread(state.filter("done").unionByName(stepped), "lineage")
    return state.select("experiment_id", F.when(F.col("done"), F.col("root_id")).alias("root_id"), F.when(F.col("done"), F.col("depth")).alias("depth"))
