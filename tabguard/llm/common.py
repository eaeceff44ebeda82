"""Shared parts: the query registry, Arrow loops over texts, state that lives as long as a worker."""

from __future__ import annotations

import sys
import types

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES = {}
SQL = {}
#: Rows of one Arrow batch. Texts may be long, and a batch is held in a worker's memory.
BATCH_ROWS = 256
_HOLDER = "_tabguard_worker_state"


def query(sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under its own name."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of whole texts small; Spark's default of 10,000 rows is meant for short ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def worker_state(key, build):
    """``build()`` once for each Python worker; Spark reuses workers between tasks."""
    holder = sys.modules.setdefault(_HOLDER, types.ModuleType(_HOLDER))
    states = holder.__dict__.setdefault("states", {})
    if key not in states:
        states[key] = build()
    return states[key]


def map_texts(docs: DataFrame, fn, fields: str, id_column: str = "doc_id", text_column: str = "text", as_bytes: bool = False) -> DataFrame:
    """One row for each row of ``docs``: its id and what ``fn(texts)`` returns, a list for each of ``fields``.

    A null text is passed as an empty one; ids pass unchanged. ``docs`` may hold any other columns.
    """
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("t"))
    kind = chosen.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            columns = fn((texts.cast(pa.binary()) if as_bytes else texts).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(x if isinstance(x, pa.Array) else pa.array(x) for x in columns)],
                                             names=["id", *(f.split()[0] for f in fields.split(", "))])

    return chosen.mapInArrow(run, f"id {kind}, {fields}").withColumnRenamed("id", id_column)


def filter_texts(docs: DataFrame, keep, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text ``keep(texts)`` marks true; a null text is passed as empty."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_column)).cast(pa.string()).to_pylist()
            yield batch.filter(pa.array([bool(x) for x in keep([t or "" for t in texts])], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


#: Bytes to bytes: A-Z to lower case; whatever is no ASCII letter, digit or part of a longer character to a blank.
WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()
