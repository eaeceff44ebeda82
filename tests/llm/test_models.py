"""Toxicity, quality and neighbours: held-out accuracy, brute force, small cases. The pipeline against a plain version."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabguard.llm import neighbours, quality, toxicity

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# ---------------------------------------------------------------- toxicity


ENTRIES = {"idiot": 1.0, "moron": 0.5, "loser": 1.0, "badn*": 1.0}


def weights_of(text):
    return dict(toxicity.matches(toxicity.words_of(text), toxicity.Lexicon(ENTRIES), toxicity.grammar()))


@pytest.mark.parametrize("text, kinds", [
    ("you are an idiot", "D"), ("idiot that you are", "D"), ("an idiot walks. you go", "P"), ("you are not an idiot", "i"),
    ("not so far away from home the idiot", "P"), ("they said the idiot left", "q"), ('a "loser" here', "q"), ("i will kill you", "H"),
    ("kill the process", ""), ("nothing here", ""), ("", ""), ("badness badnova bad", "P"), ("he said no. you idiot", "D"),
    ('he said "you are an idiot. you are a moron" and left', "q"), ('he said "you are an idiot. you are a moron" and you idiot', "qD"),
    ('he said "fine. ok" you are an idiot', "D"), ("he said „you idiot. moron“ you loser", "qD"), ('5" idiot you', "D"), ('a " open\nyou idiot" here', "D"),
    ("you aren't an idiot", "i"), ("you aren’t an idiot", "i"), ("you're an idiot", "D"), ("they’re idiots' idiot", "D"),
    ("you are an idiot, he said", "q"), ("you are an idiot, said the man. you moron", "qD"), ("you are an idiot, he said to all of them", "D"),
    ("no, you idiot", "i"), ("i will kill you, she told him", "q"),
])
def test_grammar(text, kinds):
    assert set(weights_of(text)) == set(kinds)


def test_a_match_has_its_own_weight():
    assert weights_of("moron idiot you") == {"P": 0.5, "D": 1.0} and weights_of("idiot kill moron you") == {"P": 1.0, "D": 0.5}


def plain_matches(words):
    """The grammar said over whole clauses, by looking ahead and back."""
    lexicon = toxicity.Lexicon(ENTRIES)
    symbols, weights = [lexicon[w][0] for w in words], [lexicon[w][1] for w in words]
    closers, quoted, marks, i = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«"}, set(), {}, 0
    while i < len(symbols):
        j = i + 1
        if symbols[i] in closers:
            while j < len(symbols) and symbols[j] not in closers[symbols[i]] + symbols[i] + "/":
                j += 1
            if j < len(symbols) and symbols[j] in closers[symbols[i]]:
                marks[i], marks[j] = "O", "C"
                quoted |= set(range(i, j))
                i = j
        i += 1
    symbols = [marks.get(i, "w" if x in toxicity.QUOTES else x) for i, x in enumerate(symbols)]
    ends = [i for i, x in enumerate([*symbols, "."]) if x in "./"]
    totals = {}
    for low, high in zip([0, *(e + 1 for e in ends)], ends):
        commas = [i for i in range(low, high) if symbols[i] == ","]
        tail = symbols[commas[-1] + 1 : high] if commas else []
        reported = commas[-1] if "R" in tail and len(tail) <= 3 and not set(tail) & set("OC") else -1
        kinds = {}
        for i in range(low, high):
            if symbols[i] in "IT":
                before = [x for x in symbols[low:i] if x not in ",OC"]
                verbs = [x for x in symbols[low:i] if x in "RC"]
                if i < reported or i in quoted or verbs[-1:] == ["R"]:
                    kinds[i] = "q"
                elif "N" in before[-3:]:
                    kinds[i] = symbols[i].lower()
        events = [(i, symbols[i]) for i in range(low, high) if symbols[i] == "Y" or (symbols[i] in "IT" and i not in kinds)]
        for n, (i, x) in enumerate(events):
            aimed = any(y == "Y" for _, y in events[:n]) or [y for _, y in events[n + 1 : n + 2]] == ["Y"]
            if x != "Y":
                kinds[i] = ("D" if aimed else "P") if x == "I" else ("H" if aimed else "t")
        for i, kind in kinds.items():
            if kind != "t":
                totals[kind] = totals.get(kind, 0.0) + weights[i]
    return totals


def test_grammar_against_plain_clauses():
    rng = random.Random(4)
    words = ["idiot", "moron", "kill", "you", "not", "said", "tree", "tree", ",", ".", "\n", '"', "“", "”", "„", "«", "»"]
    seen = set()
    for n in range(20_000):
        some = rng.choices(words, k=rng.randint(0, 24), weights=[3, 3, 3, 3, 2, 2, 4, 4, 3, 2, 0.5, 1, 1, 1, 0.5, 0.5, 0.5])
        got = dict(toxicity.matches(some, toxicity.Lexicon(ENTRIES), GRAMMAR))
        assert got == pytest.approx(plain_matches(some)), some
        seen |= got.keys()
    assert seen == set(toxicity.KINDS)


GRAMMAR = toxicity.grammar()


def test_composition_reads_what_the_first_writes():
    first = toxicity.Transducer(0, lambda s, x: (s, x.upper()))
    second = toxicity.Transducer(0, lambda s, x: (s + (x == "A"), str(s)))
    arcs, _ = toxicity.Transducer(0, lambda s, x: (0, "ok" if x == "A" else "")), None
    both = first.then(toxicity.Transducer(0, arcs.step))
    assert both.step((0, 0), "a") == ((0, 0), "ok") and both.step((0, 0), "b") == ((0, 0), "")
    assert first.then(second).step((0, 1), "a") == ((0, 2), "1")


def test_held_out_accuracy(spark):
    """English rows: labels of the other languages of these tables are drawn at random."""
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{n}.parquet") for n in ("documents", "labels"))
    scored = toxicity.op9_toxicity(spark, MIDDLE).join(labels, "doc_id").join(docs.where("lang = 'en'").select("doc_id"), "doc_id").collect()
    held = [r for r in scored if r.held_out]
    assert len(held) > 50 and np.mean([r.predicted == r.toxic for r in held]) > 0.95
    assert all((r.score >= 0.7) == (r.predicted == 1) and 0 <= r.score <= 1 for r in scored)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit_toxicity(docs, labels) == toxicity.fit_toxicity(docs, flipped)


def test_odd_documents_and_labels(spark, odd_docs, no_docs):
    odd_labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (6, 0, 0), (6, 1, 1), (7, 5, 9)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(odd_docs, odd_labels)
    scored = toxicity.score_documents(odd_docs, model).collect()
    assert len(scored) == odd_docs.count() and len({r.score for r in scored}) == 1
    assert toxicity.score_documents(no_docs, model).count() == 0
    kept = toxicity.drop_toxic(odd_docs, toxicity.fit_toxicity(no_docs, odd_labels.where("false")))
    assert kept.columns == odd_docs.columns and kept.exceptAll(odd_docs).count() == 0 and kept.count() == odd_docs.count()


# ---------------------------------------------------------------- quality


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    rows = quality.op2_quality(spark, MIDDLE).join(labels, "doc_id").collect()
    assert np.mean([r.keep == (r.quality == 1) for r in rows]) > 0.9


def test_posteriors_equal_a_plain_computation(spark):
    rng = random.Random(6)
    rows = [(n, rng.choice(["a", "a", "b", "c", None]), rng.choice(["x", "y", None]), rng.random() ** (1 + n % 3)) for n in range(400)]
    rows += [(500 + n, f"site{n}", "x", rng.random()) for n in range(30)]
    found = quality.posteriors(spark.createDataFrame(rows, "id long, host string, path string, p double")).collect()
    clip = lambda r: min(max(r, quality.EDGE), 1 - quality.EDGE)

    def groups(key):
        out = {}
        for r in rows:
            out.setdefault(key(r), []).append(r[3])
        return out

    def strength(parts, rate):
        several = {k: p for k, p in parts.items() if len(p) > 1}
        n = sum(map(len, several.values()))
        between = sum(len(p) * (np.mean(p) - rate(k)) ** 2 for k, p in several.items())
        chance = sum(np.var(p) for p in several.values())
        spread = sum(len(p) * clip(rate(k)) * (1 - clip(rate(k))) for k, p in several.items())
        nature = (between - chance) / n
        return min(quality.STRONGEST, max(quality.WEAKEST, spread / n / nature - 1)) if nature > 0 else quality.STRONGEST

    base = (sum(r[3] for r in rows) + 0.5) / (len(rows) + 1)
    hosts, paths = groups(lambda r: r[1]), groups(lambda r: (r[1], r[2]))
    m = strength(hosts, lambda k: base)
    rate = {k: (sum(p) + m * base) / (len(p) + m) for k, p in hosts.items()}
    k_path = strength(paths, lambda k: rate[k[0]])
    logit = lambda r: np.log(clip(r) / (1 - clip(r)))
    want = {}
    for i, host, path, p in rows:
        own = paths[host, path]
        others = (sum(own) - p + k_path * rate[host]) / (len(own) - 1 + k_path)
        want[i] = (rate[host], 1 / (1 + np.exp(-(logit(p) + logit(others) - np.log(base / (1 - base))))))
    assert {r.id: (r.host_rate, r.posterior) for r in found} == {i: pytest.approx(x, abs=1e-9) for i, x in want.items()}


def test_sparse_sites_lean_on_the_rest(spark):
    rows = [(n, "big", "x", 0.9) for n in range(500)] + [(600 + n, f"bad{n % 3}", "x", 0.1) for n in range(300)] + [(1000, "new", "x", 0.1)]
    found = {r.id: r for r in quality.posteriors(spark.createDataFrame(rows, "id long, host string, path string, p double")).collect()}
    assert found[0].host_rate > 0.85 and found[600].host_rate < 0.15 and 0.1 < found[1000].host_rate < 0.6


def test_quality_of_odd_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (4, None, 1)], "doc_id long, quality int, toxic int")
    host, path = F.col("source"), F.col("lang")
    assert quality.classify_quality(odd_docs, labels, host, path).count() == odd_docs.count()
    assert quality.classify_quality(odd_docs, labels.where("false"), host, path).where("evidence = 0.5").count() == odd_docs.count()
    assert quality.classify_quality(no_docs, labels, host, path).count() == 0


def test_host_and_path(spark):
    rows = spark.createDataFrame([("http://A.example.net/fr/25930",), ("https://b.example.com",), ("no url at all",), (None,)], "url string")
    host, path = quality.host_and_path(F.col("url"))
    assert [tuple(r) for r in rows.select(host, path).collect()][0] == ("a.example.net", "/fr")
    assert rows.select(host.alias("h")).where("h is null").count() == 2


# ---------------------------------------------------------------- neighbours


def plain_search(rows, every=20, k=20):
    good = [(i, np.array(v, float)) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows)]
    out = {}
    for i, v in good:
        if i % every == 0:
            others = sorted(((-float(v @ w), j) for j, w in good if j != i))[:k]
            out[i] = [j for _, j in others]
    return out


def test_recall_and_scores(spark):
    found = neighbours.op7_neighbours(spark, SMALL).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    want, vectors = plain_search(rows), {i: np.array(v, float) for i, v in rows}
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == pytest.approx(float(vectors[r.query_id] @ vectors[r.vec_id]), abs=1e-12)
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_copies_ties_and_bad_vectors(spark):
    """All vectors are scanned here, so that ties and copies must come out exactly."""
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 0.0, 2.0]) for i in range(300)] + [(300 + i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(60)]
    rows = [r for r in rows if any(r[1])]
    bad = [(400, None), (420, [0.0, 0.0, 0.0]), (440, [1.0, None, 2.0]), (460, [float("nan"), 1.0, 1.0]), (480, [float("inf"), 1.0, 1.0]),
           (None, [1.0, 1.0, 1.0]), (500, [1.0, 2.0]), (520, [])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad + rows[:5]], "vec_id long, embedding array<double>, key string, rank int")
    got = {}
    for r in neighbours.search(frame, recall=2.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == plain_search(rows)


def test_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<float>")
    rows = neighbours.search(frame).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(rows, key=lambda r: r.rank)] == [(0, 1, 1), (0, 2, 2)]
    empty = neighbours.search(frame.where("false"))
    assert empty.count() == 0 and empty.columns == ["query_id", "rank", "vec_id", "score"]


def found_share(rows, want):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(len(got[q]) == 20 for q in want)
    return np.mean([len(got[q] & set(want[q])) / 20 for q in want])


def test_recall_with_many_lists_and_blocks_of_queries(spark, monkeypatch):
    """A sample of about a point for each list must not decide how many are scanned; small lists still give all neighbours."""
    rng = np.random.default_rng(12)
    rows = [(i, v) for i, v in enumerate(rng.standard_normal((1500, 12)).tolist())]
    frame, want = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), plain_search(rows)
    monkeypatch.setattr(neighbours, "LIST", 8)
    monkeypatch.setattr(neighbours, "SAMPLE", 200)
    whole = neighbours.search(frame).collect()
    assert found_share(whole, want) >= 0.93
    assert found_share(neighbours.search(frame, recall=0.0).collect(), want) > 0
    monkeypatch.setattr(neighbours, "QUERIES", 4)
    monkeypatch.setattr(neighbours, "BLOCK", 5)
    assert found_share(neighbours.search(frame).collect(), want) >= 0.93


def test_early_abandoning_keeps_the_near(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((600, 64))
    longest = np.sqrt((x**2).sum(axis=1)).max()
    points, queries = neighbours.lifted(x, longest), neighbours.asked(x[:40])
    exact = ((queries[:, None] * longest - points[None]) ** 2).sum(axis=2)
    bounds = np.sort(exact, axis=1)[:, 20]
    rows, cols, d = neighbours.scan(queries, bounds, points, longest)
    assert np.allclose(d, exact[rows, cols], rtol=1e-4)
    kept = {(int(a), int(b)) for a, b in zip(rows, cols)}
    near = [(a, int(b)) for a in range(40) for b in np.argsort(exact[a])[:20]]
    assert np.mean([p in kept for p in near]) > 0.97 and len(kept) < 0.2 * exact.size
