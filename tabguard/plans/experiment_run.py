"""A whole experiment: clean, fit, sample, constrain, compare, and keep the results as tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabguard.operators import closest, fidelity, ks, leakage, sequences, synthesis
from tabguard.operators.cleaning import clean_table
from tabguard.operators.constraints import Profile, apply_profile, compliance_report
from tabguard.operators.detection import analyze_columns, column_roles, distinct_counts
from tabguard.operators.noise import Budget, add_noise, noise_ledger
from tabguard.schema import c, numeric_columns
from tabguard.session import write_and_reread

REPORT_SCHEMA = "experiment_id string, section string, column string, metric string, value string"


@dataclass
class ExperimentConfig:
    experiment_id: str
    method: str = "GaussianCopula"
    num_rows: int = 1000
    sensitive_column: str | None = None
    epsilon: float | None = None
    sequence_key: str | None = None
    sequence_index: str | None = None
    missing_strategy: str = "median"
    seed: int = 0
    timestamp: str | None = None


def long_report(df: DataFrame, experiment_id: str, section: str, name: str | None = None) -> DataFrame:
    """Any result table as long rows; ``name`` is the column that labels a row."""
    metrics = [n for n in df.columns if n != name]
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), c(n).cast("string").alias("value")) for n in metrics])
    label = c(name).cast("string") if name else F.lit(None).cast("string")
    return df.select(F.lit(experiment_id).alias("experiment_id"), F.lit(section).alias("section"), label.alias("column"), F.inline(cells))


def run_experiment(spark: SparkSession, real: DataFrame, config: ExperimentConfig, profile: Profile | None = None) -> dict[str, DataFrame]:
    """Result tables: ``synthetic``, ``reports`` (long), ``histogram``, ``correlation``, ``config``, ``status`` and,
    with an epsilon, ``ledger``. The cleaned input and the sample are written once and read by every check."""
    started = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    real = write_and_reread(clean_table(real, missing_strategy=config.missing_strategy), "cleaned")
    results: dict[str, DataFrame] = {}
    if config.method == "PAR":
        if config.epsilon is not None:
            kept = {config.sequence_key, config.sequence_index}
            noised = [n for n, role in column_roles(real).items() if role == "numerical" and n not in kept]
            results["ledger"] = write_and_reread(noise_ledger(real, Budget(config.epsilon), noised), "ledger")
            real_view = write_and_reread(add_noise(real, results["ledger"]), "noised")
        else:
            real_view = real
        model = sequences.fit_sequences(real_view, config.sequence_key, config.sequence_index)
        synth = sequences.sample_sequences(spark, model, config.num_rows, config.seed)
        if profile is not None:
            synth = apply_profile(synth, profile, seed=config.seed)
    else:
        model = synthesis.fit_copula(real, epsilon=config.epsilon, method=config.method)
        if config.epsilon is not None:
            noised = [n for n, role, _ in model.columns if role == "numerical"]
            results["ledger"] = noise_ledger(real, Budget(config.epsilon), noised)
        synth = synthesis.sample_rows(spark, model, config.num_rows, config.seed, profile)
    synth = write_and_reread(synth, "synthetic")
    run = config.experiment_id
    sections = [
        long_report(analyze_columns(real), run, "clinical", "column"),
        long_report(fidelity.numeric_summary(real, synth), run, "stats", "column"),
        long_report(leakage.exact_leakage(real, synth), run, "privacy"),
        long_report(ks.ks_test(real, synth), run, "ks", "column"),
    ]
    if numeric_columns(real):
        sections.append(long_report(closest.closest_record_report(real, synth), run, "dcr"))
    protected = config.sensitive_column
    if protected and protected in synth.columns and distinct_counts(synth, [protected])[protected] == 2:
        flipped = fidelity.flip_test(synth, protected)
        sections += [long_report(flipped, run, "flip", "column"), long_report(fidelity.fairness_score(flipped), run, "fairness")]
    if profile is not None:
        sections.append(long_report(compliance_report(synth, profile).drop("invalid_values"), run, "compliance", "column"))
    reports = write_and_reread(reduce(DataFrame.unionByName, sections), "reports")
    finished = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    settings = {**asdict(config), "timestamp": config.timestamp or started.isoformat()}
    kinds = {"num_rows": "long", "epsilon": "double", "seed": "long"}
    results |= {
        "synthetic": synth,
        "reports": reports,
        "categories": fidelity.categorical_summary(real, synth),
        "histogram": fidelity.histogram(real, synth),
        "correlation": fidelity.correlation(real, synth),
        "config": spark.createDataFrame([tuple(settings.values())], ", ".join(f"{n} {kinds.get(n, 'string')}" for n in settings)),
        "status": spark.createDataFrame(
            [(run, s, at, i) for i, (s, at) in enumerate([("pending", started), ("running", started), ("completed", finished)])],
            "experiment_id string, status string, ts timestamp_ntz, seq long",
        ),
    }
    return results


def save_experiment(results: dict[str, DataFrame], path: str) -> None:
    """Every result table as Parquet below ``path``, one folder per table and experiment."""
    run = results["config"].first()["experiment_id"]
    for name, df in results.items():
        df.write.parquet(f"{path}/{name}/experiment_id={run}" if "experiment_id" not in df.columns else f"{path}/{name}/run-{run}")
