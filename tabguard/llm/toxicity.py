"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols through a lexicon: insults and threats with a weight, targets, negations and
signs of reported speech. Quotation marks are paired within their paragraph, and a transducer that
reads backwards finds attributions at the end of a clause ("..., he said"). Transducers for negation,
reported speech and target, composed into one, then turn the symbols into matches: an insult aimed at
somebody, a plain one, a negated one, a reported one, a threat against somebody. A document is scored
by the weights of its matched clauses, never by words alone.

Learnt from labelled rows outside the held-out fold: words and word stems that mark toxic documents,
and the weight of each kind of match. Fitting reads a bounded sample of the labelled rows
(``fit_rows``); scoring reads everything.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabguard.llm.common import filter_texts, map_texts, query, small_batches, table, worker_state

#: Labelled rows that a fit reads at most, in expectation, and entries of the learnt lexicon.
FIT_ROWS, LEXICON = 20_000, 5_000
#: Lengths of word stems, least number of places with different neighbours, least share of toxic ones.
STEMS, PLACES, SHARE = (4, 5, 6), 8, 0.9
CACHED = 300_000

INSULTS = ("idiot idiots moron morons stupid scum loser losers worthless pathetic disgusting trash clown imbecile "
           "dumbass bastard retard filth vermin scumbag degenerate").split()
THREATS = "kill hurt destroy beat stab shoot strangle burn punch hang".split()
TARGETS = ("you your youre youve youll youd yours u he hes she shes they theyre theyve him her them his their these those "
           "people").split()
NEGATIONS = ("not never no isnt arent wasnt werent dont doesnt didnt aint cant cannot couldnt wont wouldnt shouldnt nobody without "
             "nicht kein keine pas jamais ni nunca").split()
REPORTS = "said says say told wrote called calls claimed claims quoted reported alleged according sagte dit dijo".split()
QUOTES = '"“”„«»'
#: Quotations in the symbols of a text; a paragraph ends with a slash.
QUOTED = re.compile('"[^"/]*"|“[^“”/]*”|„[^„“”/]*[“”]|«[^«»/]*»|»[^«»/]*«')
MARK = re.compile(f"[{QUOTES}]")
#: Words with the ending of a contraction, if they have one; ends of clauses, commas, quotation marks.
TOKEN = re.compile(r"\w+(?:['’](?:t|re|s|ll|ve|d|m)\b)?|[.!?;:,\n" + QUOTES + "]")
APOSTROPHES = str.maketrans("", "", "'’")
#: Words that an attribution behind a clause may have, its verb among them.
ATTRIBUTION = 3
#: Kinds of matches, and what each is worth before any label was seen.
KINDS, PRIOR = "DPiqH", np.array([1.3, 1.0, 0.4, 0.4, 1.5])


class Transducer:
    """A deterministic transducer: ``step(state, symbol) -> (state, output or "")``."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: "Transducer") -> "Transducer":
        """Composition: the other one reads what this one writes."""

        def step(state, symbol):
            first, out = self.step(state[0], symbol)
            second, last = other.step(state[1], out) if out else (state[1], "")
            return (first, second), last

        return Transducer((self.start, other.start), step)

    def tabulate(self, symbols: str) -> tuple[dict, int]:
        """All reachable transitions as ``{(state, symbol): (state, output)}`` with numbered states."""
        number, arcs, todo = {self.start: 0}, {}, [self.start]
        while todo:
            state = todo.pop()
            for symbol in symbols:
                after, out = self.step(state, symbol)
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                arcs[number[state], symbol] = number[after], out
        return arcs, len(number)


def _attributed(state, x):
    """Read backwards: a verb of saying between the last comma and the end of a clause reports what stands before.

    The state is (words, verb seen) behind the comma, "before" it in a reported clause, or "none".
    """
    if x in "./":
        return (0, False), x
    if state == "before":
        return state, "q" if x in "IT" else x
    if state == "none" or x in "OC":
        return "none", x
    if x == ",":
        return "before" if state[1] else "none", x
    return ((state[0] + 1, state[1] or x == "R") if state[0] < ATTRIBUTION else "none"), x


def _negation(k, x):
    """An insult or threat up to three words behind a negation is a negated one."""
    if x in "N./":
        return (3, "w") if x == "N" else (0, x)
    if x in ",OC":
        return k, x
    return max(k - 1, 0), x.lower() if x in "IT" and k else x


def _reported(state, x):
    """From a verb of saying to the end of its clause or of the quotation in it, and in all of a quotation, insults are reported ones."""
    said, quoted = state
    if x in "./":
        return (False, quoted and x == "."), "."
    if x in "ROC":
        return (x == "R" or (said and x == "O"), x == "O" or (quoted and x == "R")), "w"
    return state, "q" if (said or quoted) and x in "ITit" else x


def _aimed(state, x):
    """Insults with a target in their clause are aimed; threats count only with a target.

    Writes the kind of a match for the symbol just read, with "-" for the one held back, which waits
    for a target, and "+" where the symbol just read is held back from now on.
    """
    if x in "iq":
        return state, x
    held = "P" if state == "I" else ""
    if x == ".":
        return "", held and held + "-"
    if x == "Y":
        return "Y", {"I": "D-", "T": "H-"}.get(state, "")
    if x in "IT":
        if state == "Y":
            return "Y", "D" if x == "I" else "H"
        return x, held + "+"
    return state, ""


SYMBOLS = "ITYNRqOC,./w"


def grammar() -> tuple[dict, dict]:
    """Transitions of the transducer that reads backwards and of the composed one that reads what it wrote."""
    forwards = Transducer(0, _negation).then(Transducer((False, False), _reported)).then(Transducer("", _aimed))
    return Transducer((0, False), _attributed).tabulate(SYMBOLS)[0], forwards.tabulate(SYMBOLS)[0]


def words_of(text: str) -> list[str]:
    """Lower-cased words, contractions without apostrophe, and marks."""
    found = TOKEN.findall(text.lower())
    return [w.translate(APOSTROPHES) for w in found] if "'" in text or "’" in text else found


def pair_quotes(symbols: str) -> str:
    """Quotation marks as ``O`` and ``C`` where a paragraph holds both; others, and those inside a quotation, as words."""
    paired = QUOTED.sub(lambda m: "O" + MARK.sub("w", m[0][1:-1]) + "C", symbols)
    return MARK.sub("w", paired)


class Lexicon(dict):
    """Symbol and weight of a word; unknown words are looked up by their stems once."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.fixed = {w: (s, 0.0) for s, words in (("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in words}
        self.fixed |= {w: ("T", 1.0) for w in THREATS} | {w: (w, 0.0) for w in QUOTES + ","} | {w: (".", 0.0) for w in ".!?;:"} | {"\n": ("/", 0.0)}
        self.fixed |= {w: ("I", x) for w, x in weights.items() if not w.endswith("*")}
        self.stems = {w[:-1]: x for w, x in weights.items() if w.endswith("*")}
        self.update(self.fixed)

    def __missing__(self, word):
        found = ("w", 0.0)
        for n in STEMS:
            if len(word) > n and word[:n] in self.stems:
                found = ("I", max(found[1], self.stems[word[:n]]))
        if len(word) <= 40:
            if len(self) > CACHED:
                self.clear()
                self.update(self.fixed)
            self[word] = found
        return found


def matches(words: list[str], lexicon: dict, arcs: tuple[dict, dict]) -> dict[str, float]:
    """Weight by kind of match; an insult or threat that waits for a target keeps its weight until it is written."""
    read = [lexicon[w] for w in words]
    totals: dict[str, float] = defaultdict(float)
    symbols = "".join(s for s, _ in read)
    if "I" not in symbols and "T" not in symbols:
        return totals
    backwards, forwards = arcs
    symbols = [*pair_quotes(symbols)]
    if "R" in symbols and "," in symbols:
        state = 0
        for i in range(len(symbols) - 1, -1, -1):
            state, symbols[i] = backwards[state, symbols[i]]
    state, held = 0, 0.0
    for symbol, weight in zip([*symbols, "/"], [*(w for _, w in read), 0.0]):
        state, out = forwards[state, symbol]
        if out:
            if out[-1] in "+-":
                if out[0] in KINDS:
                    totals[out[0]] += held
                held = weight if out[-1] == "+" else 0.0
            else:
                totals[out] += weight
    return totals


def features(text: str, lexicon: dict, arcs: tuple[dict, dict]) -> list[float]:
    found = matches(words_of(text), lexicon, arcs)
    return [math.log1p(found[k]) if k in found else 0.0 for k in KINDS]


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    coefficients: list[float]
    bias: float


def _stems(word: str) -> list[str]:
    return [word] + [word[:n] + "*" for n in STEMS if len(word) > n]


def _labelled(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, fit_rows: int) -> DataFrame:
    """Training texts: labelled rows outside the held-out fold, thinned by a hash of the id to the bound."""
    fold = F.crc32(F.col("i").cast("string")) % 3
    known = labels.select(F.col(id_column).alias("i"), F.col("toxic").cast("int").alias("y")).where("i is not null and y in (0, 1)")
    known = known.where(fold != 1).groupBy("i").agg(F.max("y").alias("y"))
    share = min(1.0, fit_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("i", F.lit("fit")), F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1.0))
    texts = docs.select(F.col(id_column).alias("i"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("t"))
    # About fit_rows rows of two numbers: small at any size of the labels.
    return texts.join(F.broadcast(chosen), "i").select("t", "y")


def _tallied(train: DataFrame, of) -> DataFrame:
    """``of(words) -> iterable of keys`` counted by label: once a document, first within the partition."""

    def run(batches):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if y else clean).update(of([w for w in words_of(text) if w != ","]))
            if len(toxic) + len(clean) > 400_000:
                yield _rows(toxic, clean)
                toxic, clean = Counter(), Counter()
        yield _rows(toxic, clean)

    return train.mapInArrow(run, "k string, y1 long, y0 long").groupBy("k").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))


def _rows(toxic, clean):
    keys = list(toxic.keys() | clean.keys())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())],
                                      names=["k", "y1", "y0"])


def _telling():
    """Share of toxic documents among those with the key, with a prior of one clean document."""
    return F.col("y1") / (F.col("y1") + F.col("y0") + 1.0)


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """Words and stems that stand in toxic documents at places with different neighbours.

    Copies of one document repeat the same neighbours, so they count once.
    """
    listed = _tallied(train, lambda words: {k for w in words if len(w) > 2 for k in _stems(w)})
    wanted = listed.where((F.col("y1") >= PLACES) & (_telling() >= SHARE - 0.05))
    # The rows with most toxic documents, as many as the lexicon may hold before places are compared.
    first = {r.k for r in wanted.orderBy(F.desc("y1"), "k").limit(4 * LEXICON).select("k").collect()}
    if not first:
        return {}
    sent = train.sparkSession.sparkContext.broadcast(first)

    def places(words):
        around = ["", *words, ""]
        return {f"{k}\t{around[i]}\t{around[i + 2]}" for i, w in enumerate(words) if len(w) > 2 for k in _stems(w) if k in sent.value}

    spread = _tallied(train, places).select(F.split("k", "\t")[0].alias("k"), (F.col("y1") > 0).cast("long").alias("y1"), (F.col("y0") > 0).cast("long").alias("y0"))
    spread = spread.groupBy("k").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))
    rows = spread.where((F.col("y1") >= PLACES) & (_telling() >= SHARE)).orderBy(F.desc("y1"), "k").limit(LEXICON).collect()
    return {r.k: min(2.0, math.log((r.y1 + 0.5) / (r.y0 + 0.5)) / 2.0) for r in rows}


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Learn lexicon and weights; without usable labels the given words and prior weights stand."""
    small_batches(docs.sparkSession)
    train = _labelled(docs, labels, id_column, text_column, fit_rows)
    weights = {w: 1.0 for w in INSULTS} | learn_lexicon(train)
    arcs = grammar()

    def run(batches):
        lexicon = Lexicon(weights)
        for batch in batches:
            found = [features(t, lexicon, arcs) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    # Equal rows are summed before they leave the executors; what arrives is bounded by fit_rows.
    seen = train.mapInArrow(run, "x array<double>, y int").groupBy("x", "y").count().collect()
    x = np.array([r.x for r in seen]).reshape(len(seen), len(KINDS))
    coefficients, bias = _logistic(x, np.array([r.y for r in seen], float), np.array([r["count"] for r in seen], float))
    return ToxicityModel(weights, coefficients.tolist(), bias)


def _logistic(x, y, n, rounds: int = 40):
    """Logistic regression by Newton's steps, drawn to the prior weights by a unit Gaussian."""
    mean = np.append(3.0 * PRIOR, -2.5)
    precision = np.full(len(mean), 0.5)
    beta = mean.copy()
    x = np.hstack([x, np.ones((len(x), 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (n * (p - y)) + precision * (beta - mean)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(precision), slope)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return np.maximum(beta[:-1], 0.0), float(beta[-1])


def _scorer(model: ToxicityModel):
    """``texts -> (features, scores)``, with the lexicon kept by the worker."""
    arcs, weights, coefficients, bias = grammar(), model.weights, np.array(model.coefficients), model.bias

    def score(texts):
        lexicon = worker_state(("toxicity", hash(frozenset(weights.items()))), lambda: Lexicon(weights))
        x = np.array([features(t, lexicon, arcs) for t in texts]).reshape(len(texts), len(KINDS))
        return x, 1 / (1 + np.exp(-np.clip(x @ coefficients + bias, -30, 30)))

    return score


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, columns as they are, whose score is below the threshold."""
    score = _scorer(model)
    return filter_texts(docs, lambda texts: score(texts)[1] < threshold, text_column)


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``held_out``, ``score``, ``predicted`` and ``matches`` (weight of matched clauses) of every whole text.

    A null text is an empty one and gets the score of a text without a match. A null id is never held
    out. Repeated rows are scored each; labels and other columns are not read.
    """
    scorer = _scorer(model)

    def run(texts):
        x, score = scorer(texts)
        return score, (score >= threshold).astype(np.int32), np.expm1(x).sum(axis=1)

    scored = map_texts(docs, run, "score double, predicted int, matches double", id_column, text_column)
    held = F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))
    return scored.select(id_column, held.alias("held_out"), "score", "predicted", "matches")


@query()
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
