"""Differentially private noise on numeric columns, with a budget ledger."""

from __future__ import annotations

import math
import secrets
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabguard.functions import randoms
from tabguard.schema import as_double, c, melt_row, numeric_columns, require_columns
from tabguard.session import write_and_reread

MECHANISMS = ("laplace", "gaussian")
LEDGER_SCHEMA = (
    "seq long, timestamp timestamp, operation_type string, column string, epsilon_used double, sensitivity double, "
    "noise_scale double, mechanism string"
)
# Upper epsilon bound (exclusive) and its reading.
EPSILON_LABELS = (
    (0.5, "Very Strong Privacy - High noise, significant utility loss expected"),
    (1.5, "Strong Privacy - Balanced noise and utility (RECOMMENDED)"),
    (5.0, "Moderate Privacy - Lower noise, better utility"),
    (math.inf, "Weak Privacy - Minimal noise, privacy guarantees may be insufficient"),
)


@dataclass(frozen=True)
class Budget:
    epsilon: float
    delta: float = 1e-5
    mechanism: str = "laplace"

    def __post_init__(self):
        if self.epsilon <= 0:
            raise ValueError(f"a budget needs an epsilon above 0; {self.epsilon} is not")
        if not 0 <= self.delta < 1:
            raise ValueError(f"a budget's delta is a probability below 1; {self.delta} is not")
        if self.mechanism not in MECHANISMS:
            raise ValueError(f"mechanism must be one of {MECHANISMS}")
        if self.mechanism == "gaussian" and self.delta == 0:
            raise ValueError("the gaussian mechanism needs delta > 0")

    def scale(self, sensitivity: Column, epsilon: Column) -> Column:
        """Laplace b = sensitivity / epsilon; Gaussian sigma = sensitivity * sqrt(2 ln(1.25/delta)) / epsilon."""
        factor = 1.0 if self.mechanism == "laplace" else math.sqrt(2.0 * math.log(1.25 / self.delta))
        return sensitivity * F.lit(factor) / epsilon


def noise_ledger(
    df: DataFrame,
    budget: Budget,
    columns: list[str] | None = None,
    sensitivities: dict[str, float] | None = None,
    allocation: str = "uniform",
    epsilon_fraction: float = 1.0,
) -> DataFrame:
    """What noising ``columns`` (default: all numeric) costs: one ledger row per column.

    ``uniform`` gives each column epsilon / columns, ``full`` the whole epsilon each (an overrun is
    recorded, not refused), ``inverse_sensitivity`` more of it to the less sensitive columns.
    A missing sensitivity is the range of the column, all from one scan.
    """
    columns = numeric_columns(df) if columns is None else columns
    require_columns(df, columns)
    if allocation not in ("uniform", "full", "inverse_sensitivity"):
        raise ValueError(f"unknown allocation {allocation!r}")
    given = sensitivities or {}
    if not columns:
        return df.sparkSession.createDataFrame([], LEDGER_SCHEMA)
    wide = df.agg(
        F.current_timestamp().alias("at"),
        *[
            (F.lit(float(given[n])) if n in given else F.max(as_double(n)) - F.min(as_double(n))).alias(f"s{i}")
            for i, n in enumerate(columns)
        ],
    )
    sensitivity = [F.col(f"s{i}") for i in range(len(columns))]
    total = F.lit(budget.epsilon * epsilon_fraction)
    if allocation == "uniform":
        epsilons = [total / F.lit(len(columns))] * len(columns)
    elif allocation == "full":
        epsilons = [total] * len(columns)
    else:
        inverse = [F.try_divide(F.lit(1.0), s) for s in sensitivity]
        whole = sum(inverse[1:], inverse[0])
        epsilons = [total * i / whole for i in inverse]
    return melt_row(
        wide,
        [
            {
                "seq": F.lit(i).cast("long"), "timestamp": F.col("at"), "operation_type": F.lit("add_noise"), "column": F.lit(n),
                "epsilon_used": epsilons[i], "sensitivity": sensitivity[i], "noise_scale": budget.scale(sensitivity[i], epsilons[i]),
                "mechanism": F.lit(budget.mechanism),
            }
            for i, n in enumerate(columns)
        ],
    )


def add_noise(df: DataFrame, ledger: DataFrame, key: list[str] | None = None, seed: int | None = None) -> DataFrame:
    """Noise every column of ``ledger`` by its scale; nulls stay null, other columns stay as they are.

    The noise of a row is a keyed SHA-512 of its ``key``, so that a lost task repeats it. Rows that
    shared a key would share their noise, which then cancels in their difference: a key that does
    not identify the rows is refused. Without a ``key`` the rows are numbered, and the numbers fixed by writing the table.
    The secret is drawn anew for each call and kept nowhere: nobody who knows the rows' keys can
    subtract the noise. A ``seed`` makes it repeatable (with a key, or for the same partitions), and public: for tests only.
    The ledger has one row per column, so its scales come to the driver and the noise is one projection.
    """
    scales = ledger.select("column", "noise_scale", "mechanism").collect()
    if not scales:
        return df
    if key is None:
        numbered = write_and_reread(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        keys = [F.col("_row")]
    else:
        require_columns(df, key)
        numbered, keys = df, [c(n) for n in key]
        repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > 1)
        if not repeated.isEmpty():
            raise ValueError(f"rows share a key {key}, and would share their noise")
    secret = secrets.token_hex(32) if seed is None else f"seed {seed}"
    made, uniforms = randoms.secret_uniforms(numbered, secret, keys, len(scales) + len(scales) % 2)
    normals, noised = randoms.normals_of(uniforms), {}
    for i, row in enumerate(scales):
        drawn = randoms.laplace_of(uniforms[i]) if row["mechanism"] == "laplace" else normals[i]
        noised[row["column"]] = (as_double(row["column"]) + drawn * F.lit(row["noise_scale"])).alias(row["column"])
    return made.select(*[noised.get(n, c(n)) for n in df.columns])


def noisy_column(
    df: DataFrame, column: str, budget: Budget, key: list[str] | None = None, sensitivity: float | None = None, epsilon_fraction: float = 1.0, seed: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The table with one noised column, and its ledger row."""
    given = {} if sensitivity is None else {column: sensitivity}
    ledger = noise_ledger(df, budget, [column], given, "full", epsilon_fraction)
    return add_noise(df, ledger, key, seed), ledger


def epsilon_label(epsilon: Column) -> Column:
    label = F.lit(EPSILON_LABELS[-1][1])
    for bound, text in reversed(EPSILON_LABELS[:-1]):
        label = F.when(epsilon < bound, text).otherwise(label)
    return label


def budget_report(ledger: DataFrame, budget: Budget) -> DataFrame:
    """One row: budget, use, rest, utilisation and its reading. An empty ledger is a reset budget."""
    used = F.coalesce(F.sum("epsilon_used"), F.lit(0.0))
    return ledger.agg(used.alias("budget_used"), F.count(F.lit(1)).alias("operations")).select(
        F.lit(budget.epsilon).alias("epsilon"), F.lit(budget.delta).alias("delta"), F.lit(budget.mechanism).alias("mechanism"),
        epsilon_label(F.lit(budget.epsilon)).alias("interpretation"), "operations", "budget_used",
        F.greatest(F.lit(0.0), F.lit(budget.epsilon) - F.col("budget_used")).alias("budget_remaining"),
        (F.col("budget_used") / F.lit(budget.epsilon) * 100).alias("utilization_percent"),
    )


def running_budget(ledger: DataFrame, budget: Budget) -> DataFrame:
    """The ledger with the budget used up to and including each row (one row per noised column)."""
    order = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = ledger.withColumn("budget_used", F.sum("epsilon_used").over(order))
    return used.withColumn("budget_remaining", F.greatest(F.lit(0.0), F.lit(budget.epsilon) - F.col("budget_used")))


def report_document(ledger: DataFrame, budget: Budget) -> DataFrame:
    """The export: one JSON document with the guarantee, the totals and the operations."""
    operations = ledger.agg(F.array_sort(F.collect_list(F.struct("seq", "column", "epsilon_used", "sensitivity", "noise_scale", "mechanism"))).alias("operations"))
    report = budget_report(ledger, budget).withColumnRenamed("operations", "operation_count")
    # One row beside one row.
    return report.join(F.broadcast(operations)).select(F.to_json(F.struct("*")).alias("document"))
