"""Phrase mining against plain counts, with samples so small that the border fails."""

import random
import re
from collections import Counter, defaultdict

from tabguard.llm.phrases import collocations, frequent_phrases


def grams(docs):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for n in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    return counts, total


def plain(docs, least, top):
    counts, total = grams(docs)
    rows = []
    for lang, found in counts.items():
        often = {g: a for g, a in found.items() if a >= least and len(g) > 1}
        scored = []
        for g, a in often.items():
            if any(100 * b >= 50 * a for h, b in often.items() if len(h) > len(g) and g in (h[:2], h[1:])):
                continue
            score, k = min((1_000_000 * a * a // (found[g[:k]] * found[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), found[g[:k]], found[g[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -s))
    return sorted(rows)


def corpus():
    draw = random.Random(4)
    common, rare = [f"w{i}" for i in range(12)], [f"Rare{i}" for i in range(400)]
    fixed = ["new york city", "machine learning", "one two three four", "Été à Paris"]
    docs = []
    for n in range(400):
        words = [draw.choice(fixed) if draw.random() < 0.1 else draw.choice(rare) if draw.random() < 0.2 else draw.choice(common) for _ in range(draw.randrange(60))]
        docs.append((draw.choice(["en", "de", None]), draw.choice([" ", "  ", "\t"]).join(words) + draw.choice([".", "", "\n!"]) + " the\x00odd, the end"))
    return docs + [("en", None), ("fr", ""), ("fr", " . ,, \t"), ("es", "a b c " * 30), ("es", "solo")]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_against_plain_counts(spark):
    docs = corpus()
    table = spark.createDataFrame([(n, *d, "x", 1) for n, d in enumerate(docs)], "doc_id long, lang string, text string, phrase string, words int").repartition(5)
    assert rows_of(collocations(table)) == plain(docs, 10, 2000)
    assert rows_of(collocations(table, least=3, top=7)) == plain(docs, 3, 7)


def test_border_failures_are_followed(spark):
    docs = corpus()
    table = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    counts, _ = grams(docs)
    expected = {(lang, " ".join(g)): a for lang, found in counts.items() for g, a in found.items() if a >= 10}
    passes = set()
    for sample_words in (1, 60, 10_000_000):
        found, n = frequent_phrases(table, 10, sample_words=sample_words)
        got = [((r.lang, r.phrase), r.f) for r in found.where("words > 0").collect()]
        assert dict(got) == expected and len(got) == len(expected)
        passes.add(n)
    assert 1 in passes and max(passes) >= 2


def test_odd_and_empty_tables(spark, odd_docs, no_docs, odd_texts):
    assert collocations(no_docs).count() == 0
    docs = [(r.lang, r.text) for r in odd_docs.collect()]
    assert rows_of(collocations(odd_docs, least=2, top=50)) == plain(docs, 2, 50)
