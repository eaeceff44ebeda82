"""Change logs kept as written states in key ranges: batches are merged without reading the whole log.

A table lies below a path: ``states/v=<n>/part=<range>`` holds what commit ``n`` wrote, one row a key
with its last deciding and its last writing change; ``manifest/version=<n>`` names, for each key range,
the commits that hold its rows, the oldest first. A manifest is written last, so a broken commit is never read, and a
commit fails where another one took its number. States merge in any order: late changes are no special case.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard.schema import c

#: Key ranges of a new table, at most; a range is what compaction and lookups read as a whole.
RANGES = 64
#: Keys that the bounds of the ranges are taken from. They decide how even the ranges are, nothing else.
SAMPLE_KEYS = 50_000
_MANIFEST = "ranges array<struct<part:int,commits:array<int>>>, bounds array<string>"


@dataclass(frozen=True)
class Manifest:
    version: int
    commits: dict[int, list[int]]  # key range -> commits that hold rows of it
    bounds: list  # first keys of the ranges 1, 2, ...


@dataclass(frozen=True)
class ChangeTable:
    """Live rows of changes ``(op, key, ts, seq, payload...)``; see :func:`tabguard.operators.experiments.current_rows` for their meaning.

    Rows with a null key are one key of the first range. An empty batch is a commit without rows.
    """

    spark: SparkSession
    path: str
    payload: tuple[str, ...]
    key: str = "id"

    # --- states

    def _states(self, changes: DataFrame) -> DataFrame:
        order = F.struct("ts", "seq")
        decides, writes = F.when(F.col("op").isin("add", "delete"), order), F.when(F.col("op").isin("add", "update"), order)
        return changes.groupBy(c(self.key)).agg(
            F.max(decides).alias("decided"), F.max_by("op", decides).alias("op"),
            F.max(writes).alias("written"), F.max_by(F.struct(*[c(p) for p in self.payload]), writes).alias("row"),
        )

    def _merged(self, states: DataFrame) -> DataFrame:
        return states.groupBy(c(self.key)).agg(
            F.max("decided").alias("decided"), F.max_by("op", "decided").alias("op"),
            F.max("written").alias("written"), F.max_by("row", "written").alias("row"),
        )

    def _live(self, states: DataFrame) -> DataFrame:
        return states.filter(F.col("op") == "add").select(c(self.key), F.col("written.ts").alias("ts"), "row.*")

    # --- manifests

    def _publish(self, manifest: Manifest) -> None:
        row = ([(p, list(v)) for p, v in sorted(manifest.commits.items())], [str(b) for b in manifest.bounds])
        self.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("error").json(f"{self.path}/manifest/version={manifest.version}")

    def manifest(self) -> Manifest:
        found = self.spark.read.schema(_MANIFEST + ", version int").json(f"{self.path}/manifest")
        last = found.orderBy(F.desc("version")).first()
        kind = self._key_type(last["ranges"])
        bounds = [int(b) if isinstance(kind, T.IntegralType) else b for b in last["bounds"]]
        return Manifest(last["version"], {r["part"]: list(r["commits"]) for r in last["ranges"]}, bounds)

    def _key_type(self, ranges) -> T.DataType:
        if not ranges:
            return T.StringType()
        first = ranges[0]
        return self.spark.read.parquet(f"{self.path}/states/v={first['commits'][0]}/part={first['part']}").schema[self.key].dataType

    def _part(self, bounds: list, key_type: T.DataType) -> Column:
        held = F.array(*[F.lit(b) for b in bounds]).cast(T.ArrayType(key_type)) if bounds else F.array().cast(T.ArrayType(key_type))
        return F.coalesce(F.size(F.filter(held, lambda b: b <= c(self.key))), F.lit(0))

    def _read(self, places: list[tuple[int, int]]) -> DataFrame:
        """The states of (commit, range) pairs; no other files are listed or read."""
        paths = [f"{self.path}/states/v={v}/part={p}" for v, p in places]
        return self.spark.read.option("basePath", f"{self.path}/states").parquet(*paths)

    def _write(self, states: DataFrame, version: int, bounds: list) -> list[int]:
        """The key ranges that a commit has rows in."""
        part = self._part(bounds, states.schema[self.key].dataType)
        # A range is written by as many tasks as its bytes ask for.
        placed = states.withColumn("part", part).hint("rebalance", "part")
        placed.write.mode("error").partitionBy("part").parquet(f"{self.path}/states/v={version}")
        written = self.spark.read.schema(states.withColumn("part", F.lit(0)).schema).parquet(f"{self.path}/states/v={version}")
        return [r[0] for r in written.select("part").distinct().collect()]

    # --- commits

    def create(self, changes: DataFrame, ranges: int = RANGES) -> Manifest:
        """A new table from a first batch; the bounds of its key ranges come from a bounded sample of the batch's keys."""
        kind = changes.schema[self.key].dataType
        if not isinstance(kind, (T.IntegralType, T.StringType)):
            raise TypeError(f"keys of {self.key} have to be whole numbers or texts")
        hashed = changes.select(c(self.key).alias("k")).filter(F.col("k").isNotNull()).distinct().orderBy(F.xxhash64("k")).limit(SAMPLE_KEYS)
        keys = sorted(r.k for r in hashed.collect())
        bounds = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
        touched = self._write(self._states(changes), 1, bounds)
        manifest = Manifest(1, {p: [1] for p in touched}, bounds)
        self._publish(manifest)
        return manifest

    def append(self, changes: DataFrame) -> Manifest:
        """One more batch: its own states are written, nothing else is read."""
        old = self.manifest()
        version = old.version + 1
        touched = self._write(self._states(changes), version, old.bounds)
        commits = {p: list(v) for p, v in old.commits.items()}
        for p in touched:
            commits.setdefault(p, []).append(version)
        manifest = Manifest(version, commits, old.bounds)
        self._publish(manifest)
        return manifest

    def compact(self, least: int = 2) -> Manifest:
        """Merge the ranges that ``least`` or more commits hold rows of; other ranges are neither read nor written."""
        old = self.manifest()
        due = sorted(p for p, v in old.commits.items() if len(v) >= max(least, 2))
        if not due:
            return old
        version = old.version + 1
        states = self._merged(self._read([(v, p) for p in due for v in old.commits[p]]).drop("v", "part"))
        self._write(states, version, old.bounds)
        manifest = Manifest(version, old.commits | {p: [version] for p in due}, old.bounds)
        self._publish(manifest)
        return manifest

    # --- reading

    def _current(self, places: dict[int, list[int]], empty: DataFrame | None = None) -> DataFrame | None:
        one = [(v[0], p) for p, v in places.items() if len(v) == 1]
        many = [(v, p) for p, commits in places.items() if len(commits) > 1 for v in commits]
        # Ranges of a single commit hold a row a key already: no shuffle.
        parts = [self._live(self._read(one).drop("v", "part"))] if one else []
        if many:
            parts.append(self._live(self._merged(self._read(many).drop("v", "part"))))
        return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None

    def current(self) -> DataFrame | None:
        """``(key, ts, payload...)`` of all live keys; None for a table that never held a row."""
        return self._current(self.manifest().commits)

    def rows_of(self, keys: list) -> DataFrame | None:
        """The live rows of some keys, from the key ranges that can hold them."""
        manifest = self.manifest()
        wanted = {bisect_right(manifest.bounds, k) for k in keys}
        found = self._current({p: v for p, v in manifest.commits.items() if p in wanted})
        return None if found is None else found.filter(c(self.key).isin(*keys))
