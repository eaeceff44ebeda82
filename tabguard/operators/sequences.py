"""Synthesis of entity sequences: lengths, marginals and first-order transitions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabguard.functions.statistics import pearson
from tabguard.operators.detection import column_roles
from tabguard.operators.synthesis import (
    Marginal, as_number, fit_knots, fit_marginals, from_number, modelled_columns, positive_definite, prepared, score_columns,
    score_correlation, values_of_scores,
)
from tabguard.plans.ordered import PIECE_ROWS, lag_in_groups
from tabguard.schema import c, require_columns
from tabguard.session import write_and_reread

CHUNK = 4_096


@dataclass
class SequenceModel:
    key: str
    key_type: str
    index: str | None
    index_type: str | None
    columns: list[tuple[str, str]]  # output name and type
    marginals: list[Marginal]
    categories: DataFrame | None
    correlation: np.ndarray
    persistence: list[float]  # correlation of a score with the previous one of its entity
    lengths: list[float]
    length_scores: list[float]
    starts: tuple[list[float], list[float]]
    steps: tuple[list[float], list[float]]


def fit_sequences(df: DataFrame, sequence_key: str, sequence_index: str | None = None, piece_rows: int = PIECE_ROWS) -> SequenceModel:
    """Entities are grouped by ``sequence_key`` and ordered by ``sequence_index`` (else by their columns)."""
    if not sequence_key:
        raise ValueError("sequence synthesis needs a sequence key")
    require_columns(df, [sequence_key] + ([sequence_index] if sequence_index else []))
    kinds = {f.name: f.dataType for f in df.schema}
    df = df.filter(c(sequence_key).isNotNull())
    roles = column_roles(df, sequence_key)
    modelled = [(n, kind) for n, kind in modelled_columns(roles) if n not in (sequence_key, sequence_index)]
    marginals, categories, _ = fit_marginals(df, modelled)
    d = len(marginals)
    position = as_number(sequence_index, kinds[sequence_index]) if sequence_index else F.xxhash64(*[c(n) for n in df.columns]).cast("double")
    view = prepared(df, modelled).withColumn("_position", position)
    scored = score_columns(view, marginals, categories).select(c(sequence_key).alias("_key"), "_position", *[f"z{i}" for i in range(d)])
    scored = write_and_reread(scored, "scores")
    correlation = score_correlation(scored, d)
    lagged = lag_in_groups(
        scored, ["_key"], ["_position", *[f"z{i}" for i in range(d)]],
        {"_before": "_position", **{f"p{i}": f"z{i}" for i in range(d)}}, piece_rows,
    )
    persistence = [0.0] * d
    if d:
        row = lagged.agg(*[pearson(c(f"z{i}"), c(f"p{i}")).alias(f"a{i}") for i in range(d)]).first()
        persistence = [min(0.999, max(-0.999, row[f"a{i}"] or 0.0)) for i in range(d)]
    entities = scored.groupBy("_key").agg(F.count(F.lit(1)).cast("double").alias("length"), F.min("_position").alias("start"))
    entities = write_and_reread(entities, "entities")
    counts = entities.count()
    entity_knots = fit_knots(entities, ["length", "start"], {"length": counts, "start": counts})
    steps = ([], [])
    if sequence_index:
        gaps = lagged.select((F.col("_position") - F.col("_before")).alias("step")).filter(F.col("step").isNotNull())
        steps = fit_knots(gaps, ["step"], {"step": gaps.count()})["step"]
    return SequenceModel(
        sequence_key, kinds[sequence_key].simpleString(), sequence_index,
        kinds[sequence_index].simpleString() if sequence_index else None,
        [(f.name, f.dataType.simpleString()) for f in df.schema], marginals, categories, correlation, persistence,
        *entity_knots["length"], entity_knots["start"], steps,
    )


def sample_sequences(spark: SparkSession, model: SequenceModel, count: int, seed: int = 0) -> DataFrame:
    """``count`` entities, each with a sampled length. Every entity is generated on its own from its
    number and the seed, so there is no shuffle, and long entities leave a task in chunks."""
    d = len(model.marginals)
    factor = np.linalg.cholesky(positive_definite(model.correlation)) if d else np.zeros((0, 0))
    hold = np.array(model.persistence)
    fresh = np.sqrt(1.0 - hold * hold)
    lengths, length_scores = list(model.lengths), list(model.length_scores)
    starts, steps = model.starts, model.steps
    schema = "_entity long, _step long, _index double" + "".join(f", z{i} double" for i in range(d))

    def generate(batches):
        import pandas as pd

        for pdf in batches:
            frames, size = [], 0
            for entity in pdf["id"]:
                draw = np.random.default_rng([seed, int(entity)])
                length = max(1, int(round(float(np.interp(draw.standard_normal(), length_scores, lengths)))))
                at = float(np.interp(draw.standard_normal(), starts[1], starts[0])) if starts[0] else 0.0
                state = None
                for first in range(0, length, CHUNK):
                    n = min(CHUNK, length - first)
                    noise = draw.standard_normal((n, d)) @ factor.T
                    scores = fresh * noise
                    scores[0] = noise[0] if state is None else scores[0] + hold * state
                    # score[t] = hold * score[t-1] + fresh noise, solved by doubling the reach of each step.
                    reach, factors = 1, hold
                    while reach < n:
                        scores[reach:] = scores[reach:] + factors * scores[:-reach]
                        reach, factors = 2 * reach, factors * factors
                    state = scores[-1]
                    if steps[0]:
                        moves = np.interp(draw.standard_normal(n), steps[1], steps[0])
                        if first == 0:
                            moves[0] = 0.0
                        index = at + np.cumsum(moves)
                        at = float(index[-1])
                    else:
                        index = np.arange(first, first + n, dtype=float)
                    frame = pd.DataFrame(scores, columns=[f"z{i}" for i in range(d)])
                    frame.insert(0, "_index", index)
                    frame.insert(0, "_step", np.arange(first, first + n))
                    frame.insert(0, "_entity", int(entity))
                    frames.append(frame)
                    size += n
                    if size >= CHUNK:
                        yield pd.concat(frames, ignore_index=True)
                        frames, size = [], 0
            if frames:
                yield pd.concat(frames, ignore_index=True)

    rows = spark.range(count).mapInPandas(generate, schema)
    rows = values_of_scores(rows, model.marginals, model.categories, ["_entity", "_step"], seed)
    at = {m.column: i for i, m in enumerate(model.marginals)}

    def output(name, dtype):
        if name == model.key:
            label = F.concat(F.lit(f"{name}-"), F.col("_entity").cast("string")) if dtype == "string" else F.col("_entity").cast(dtype)
            return label.alias(name)
        if name == model.index:
            return from_number(F.col("_index"), dtype).alias(name)
        if name in at:
            return F.col(f"o{at[name]}").alias(name)
        return F.lit(None).cast(dtype).alias(name)

    return rows.select(*[output(*column) for column in model.columns])
