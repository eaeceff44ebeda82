"""License scans, substring deduplication, decontamination and sanitisation against plain versions."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabguard.llm import decontamination, licenses, privacy, substrings

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def invented(seed, words, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(words))


# ---------------------------------------------------------------- licenses


def plain_scan(text):
    words = re.findall(WORD, lowered(text))
    places = {label: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p, label in licenses.PHRASES.items()}
    starts = sorted(i for x in places.values() for i in x)
    met = {label for label, x in places.items() if x}
    best = 1.0 if met else 0.0
    known = {w for ts in licenses.TEMPLATES.values() for t in ts for w in t.split()}
    for label, templates in licenses.TEMPLATES.items():
        for template in templates:
            wanted, size = set(template.split()), math.ceil(len(template.split()) / licenses.SHARE)
            for low in range(len(words)) if wanted & known & set(words) else ():
                share = len(wanted.intersection(words[low : low + size])) / len(wanted)
                if share >= licenses.SHARE:
                    met.add(label)
                    best = max(best, share)
    return (len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None,
            ",".join(sorted(k for k, x in places.items() if x)), ",".join(sorted(met)), round(best, 9))


def test_scan_equals_all_comparisons(spark, odd_texts):
    notices = [t for x in licenses.TEMPLATES.values() for t in x]
    rng = random.Random(4)
    texts = list(odd_texts)
    for n in range(120):
        words = rng.choice(notices).upper().split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "other"
        notice = rng.choice(["\n", " ", "\r\n"]).join(words)
        texts.append((100 + n, invented(n, rng.randrange(900)) + rng.choice(["\n\n", " ", "\n"]) + notice + rng.choice(["\n \n", " "]) + invented(-n, rng.randrange(50))))
    texts[3] = texts[4] = (4, " ".join(f"word{i % 977}" for i in range(3000)))
    texts += [(300, "MIT License, mit license"), (301, "apache-license GENERAL public\nlicense"), (302, "mit licenses smit license")]
    rows = licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels, r.labels, round(r.score, 9)) for r in rows)
    want = sorted((str(i), *((str(x) if k in (2, 3) else x) for k, x in enumerate(plain_scan(t)))) for i, t in texts)
    assert got == want
    assert sum(r.labels != "" for r in rows) > 60


def test_words_far_apart_are_no_notice(spark):
    apart = f"held all {invented(1, 90)} civil rights {invented(2, 90)} tables reserved"
    twice = f"All rights reserved. {invented(3, 40)} all RIGHTS reserved {invented(4, 40)} reserved"
    body = licenses.TEMPLATES["mit"][-1].split()
    blank = " ".join(body[:60]) + "\n\n" + " ".join(body[60:])
    long = " ".join(["rights reserved"] * 20_000) + " all rights reserved"
    texts = [(1, apart), (2, twice), (3, blank), (4, long), (5, " ".join(sorted(body)))]
    rows = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert (rows[1].labels, rows[1].score, rows[1].blocks) == ("", 0.0, [])
    assert rows[2].labels == "reserved" and rows[2].blocks == [0, 43]
    assert rows[3].labels == "mit" and rows[3].score == 1.0 and 0 in rows[3].blocks
    assert rows[4].labels == "reserved" and rows[5].labels == "mit"


def test_scan_of_odd_and_empty_tables(odd_docs, no_docs):
    assert licenses.scan_licenses(odd_docs).count() == odd_docs.count()
    assert licenses.scan_licenses(no_docs).count() == 0


# ---------------------------------------------------------------- substrings


def plain_passages(texts, least_words):
    """{id: (passages, dropped)} by plain dictionaries of neighbouring chunks."""
    gear = substrings.gear_table()
    chunks, places = {}, defaultdict(set)
    for i, t in texts:
        raw = (t or "").encode()
        ends = substrings.cuts(np.frombuffer(raw, np.uint8), gear).tolist()
        bounds = list(zip([0, *ends], ends))
        place = lambda x: len(raw[:x].decode())
        blank = lambda k: raw[k:k + 1] in (b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b" ")
        words = [max(sum(blank(k) and not (k + 1 < len(raw) and blank(k + 1)) for k in range(x, y)), (y - x) // substrings.WORD_LENGTH) for x, y in bounds]
        chunks[i] = [(raw[x:y], place(x), place(y), w) for (x, y), w in zip(bounds, words)]
        for n, (part, start, _, _) in enumerate(chunks[i]):
            places[part, chunks[i][n + 1][0] if n + 1 < len(chunks[i]) else None].add((i, start))
    out = {}
    for i, parts in chunks.items():
        run, found, gone = [], [], []
        for n, (part, start, end, _) in enumerate([*parts, (None, 0, 0, 0)]):
            key = (part, parts[n + 1][0] if n + 1 < len(parts) else None) if part is not None else None
            if key is not None and len(places[key]) > 1:
                run.append((n, min(places[key]) != (i, start)))
                continue
            if run and sum(p[3] for p in parts[run[0][0]:run[-1][0] + 2]) >= least_words:
                found.append((parts[run[0][0]][1], parts[min(run[-1][0] + 1, len(parts) - 1)][2]))
                for m, (k, later) in enumerate(run):
                    if later and m and run[m - 1][1]:
                        gone[-1] = (gone[-1][0], parts[min(k + 1, len(parts) - 1)][2])
                    elif later:
                        gone.append((parts[k][1], parts[min(k + 1, len(parts) - 1)][2]))
            run = []
        if found:
            spell = lambda spans: ",".join(f"{x}:{y}" for x, y in sorted(spans))
            out[i] = spell(found), spell(gone)
    return out


def test_chunks_join_to_the_text_and_never_cut_characters():
    gear = substrings.gear_table()
    for text in ("", "a", "naïve 日本語 " * 300, "x" * 9000, "日" * 5000, invented(1, 3000)):
        data = np.frombuffer(text.encode(), np.uint8)
        ends = substrings.cuts(data, gear).tolist()
        parts = [text.encode()[a:b] for a, b in zip([0, *ends], ends)]
        assert b"".join(parts) == text.encode() and all(p for p in parts)
        assert [p.decode() for p in parts] is not None
        assert all(len(p) <= substrings.LONGEST for p in parts)


def test_chunks_fall_into_step_after_an_insertion():
    text = invented(2, 2000).encode()
    gear = substrings.gear_table()

    def parts(raw):
        ends = substrings.cuts(np.frombuffer(raw, np.uint8), gear).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    before, after = Counter(parts(text)), Counter(parts(text[:5000] + b"inserted words " + text[5000:]))
    assert sum((after - before).values()) <= 4


def test_passages_are_found_and_short_lines_left_alone(spark, odd_texts):
    passage = invented("passage", 55, 5000)
    line = "All rights reserved. Please read the terms."
    texts = [(i, t) for i, t in dict(odd_texts).items() if i is not None]
    texts += [(100 + n, invented(n, 40 + 7 * n, 9000) + (" " + passage + " " if n < 12 else "\n" + line + "\n") + invented(1000 + n, 60, 9000)) for n in range(24)]
    texts += [(200, invented(7, 300)), (201, invented(7, 300))]
    rows = substrings.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    plain = plain_passages(texts, substrings.LEAST_WORDS)
    assert {r.doc_id: (r.passages, r.dropped) for r in rows} == plain
    # Text 7 is one letter over and over: it repeats itself.
    assert set(plain) == {4, 5, 7, *range(100, 112), 200, 201}
    by_id = {r.doc_id: r for r in rows}
    assert by_id[100].dropped == "" and by_id[105].dropped and by_id[105].first_doc == 100 and by_id[201].first_doc == 200
    held = dict(texts)
    for n in range(12):
        start, end = map(int, by_id[100 + n].passages.split(",")[0].split(":"))
        assert passage.count(held[100 + n][start:end].strip()[20:-20]) == 1


def test_passages_within_one_document(spark):
    """A passage that a document holds three times is found there, kept once and dropped twice; an equal row is no second place."""
    passage = invented("inner", 120, 5000)
    text = " ".join([invented(1, 30), passage, invented(2, 40), passage, invented(3, 50), passage])
    texts = [(1, text), (1, text), (2, invented(4, 200)), (2, invented(4, 200))]
    rows = substrings.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.passages, r.dropped) for r in rows} == plain_passages(texts, substrings.LEAST_WORDS)
    (row,) = rows
    assert row.doc_id == row.first_doc == 1 and row.n_passages == 3
    gone = [tuple(map(int, x.split(":"))) for x in row.dropped.split(",")]
    assert len(gone) == 2 and all(text[a:b] in passage and b - a > len(passage) - 200 for a, b in gone)


def test_frequent_lines_in_different_orders_make_no_passage(spark):
    """Each line stands in many documents, but no two of them together: neighbours have to repeat as well."""
    lines = [invented(f"line{n}", 12, 5000) for n in range(14)]
    rng = random.Random(5)
    texts, used = [], set()
    for n in range(400):
        order = rng.sample(lines, 4)
        if not any(p in used for p in zip(order, order[1:])):
            used.update(zip(order, order[1:]))
            texts.append((n, " ".join(order)))
    found = substrings.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string"))
    assert len(texts) > 20 and found.count() == len(plain_passages(texts, substrings.LEAST_WORDS)) == 0


def test_passages_without_blanks(spark):
    rng = random.Random(9)
    chinese = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400)) for _ in range(4)]
    code = "".join(rng.choice("abcdefghij(){};=+") for _ in range(900))
    texts = [(1, chinese[0]), (2, chinese[0]), (3, chinese[1] + chinese[2]), (4, chinese[3] + chinese[2]), (5, chinese[1][:20]), (6, code), (7, "x\xa0" + code), (8, chinese[3][:9])]
    rows = substrings.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: r.first_doc for r in rows} == {1: 1, 2: 1, 3: 3, 4: 3, 6: 6, 7: 6}


def test_passages_of_odd_and_empty_tables(spark, odd_docs, no_docs):
    assert {r.doc_id for r in substrings.repeated_passages(odd_docs).collect()} == {4, 5, 7}
    assert substrings.repeated_passages(no_docs).count() == 0


# ---------------------------------------------------------------- decontamination


def edits(a, b):
    """Least edit distance of words a to any stretch of words b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return min(row)


def plain_hits(texts, items):
    out = set()
    for i, t in texts:
        words = re.findall(WORD, lowered(t))
        for item, text in items:
            wanted = re.findall(WORD, lowered(text))
            if len(wanted) >= decontamination.LEAST_WORDS and (d := edits(wanted, words)) <= int(decontamination.EDITS * len(wanted)):
                out.add((str(i), item, d))
    return out


@pytest.fixture(scope="module")
def leaked():
    rng = random.Random(8)
    items = [(n, invented(f"item{n}", rng.randrange(5, 60), 300)) for n in range(25)] + [(90, "too short"), (91, None), (92, "")]
    items.append((93, items[3][1].upper()))
    texts = []
    for n in range(80):
        item = items[n % 25][1].split()
        for _ in range(rng.randrange(0, int(0.3 * len(item)) + 1)):
            at, kind = rng.randrange(len(item)), rng.randrange(3)
            item[at : at + (kind != 0)] = [f"new{n}"] if kind < 2 else []
        texts.append((100 + n, invented(f"a{n}", rng.randrange(60)) + "\n" + ", ".join(item).title() + "! " + invented(f"b{n}", rng.randrange(60))))
    return texts, items


def test_passages_equal_all_comparisons(spark, odd_texts, leaked):
    texts = leaked[0] + [x for x in odd_texts if len(x[1] or "") < 1000]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(leaked[1], "item_id long, text string")
    got = {(str(r.doc_id), r.item_id, r.distance) for r in decontamination.find_passages(docs, bench).collect()}
    want = plain_hits(texts, leaked[1])
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 30
    exact = {x for x in want if x[2] == 0}
    assert exact <= got
    kept = decontamination.drop_contaminated(docs, bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in texts if str(i) not in {g[0] for g in got})


def test_blocks_of_items_change_nothing(spark, leaked, monkeypatch):
    docs = spark.createDataFrame(leaked[0], "doc_id long, text string")
    bench = spark.createDataFrame(leaked[1], "item_id long, text string")
    whole = {(r.doc_id, r.item_id, r.distance) for r in decontamination.find_passages(docs, bench).collect()}
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 2500)
    parts = {(r.doc_id, r.item_id, r.distance) for r in decontamination.find_passages(docs, bench).collect()}
    exact = {x for x in whole if x[2] == 0}
    assert exact <= parts and len(whole ^ parts) <= 1


def test_decontamination_of_odd_and_empty_tables(spark, odd_docs, no_docs, leaked):
    bench = spark.createDataFrame(leaked[1], "item_id long, text string")
    assert decontamination.find_passages(odd_docs, bench).count() == 0
    kept = decontamination.drop_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert decontamination.find_passages(no_docs, bench).count() == 0
    assert decontamination.find_passages(odd_docs, bench.where("false")).count() == 0


def edited(words, k, rng):
    out = list(words)
    for _ in range(k):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        out[at : at + (kind != 0)] = ["foreign"] if kind < 2 else []
    return out


def test_recall_of_long_items_behind_short_ones():
    """The repetitions of long items don't depend on the items before them, and too many aren't cut."""
    rng = random.Random(2)
    rows = [(n, " ".join(f"s{n}x{i}" for i in range(6))) for n in range(300)]
    rows += [(1000 + n, " ".join(f"l{n}x{i}" for i in range(59 + 41 * (n % 3)))) for n in range(60)]
    items = decontamination.build_items(rows)
    texts = []
    for n in range(60):
        words = rows[300 + n][1].split()
        texts += [(300 + n, " ".join(["before"] * 9 + edited(words, int(0.2 * len(words)), rng) + ["behind"] * 9).encode()) for _ in range(10)]
    found = {(o, i) for o, i, *_ in decontamination.find_in_batch([t for _, t in texts], items)}
    assert sum((o, i) in found for o, (i, _) in enumerate(texts)) >= decontamination.RECALL * len(texts)


def test_short_items_are_found_unchanged(spark):
    docs = spark.createDataFrame([(1, "he said: Forty-two, Sir!"), (2, "forty and two"), (3, "the answer")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "forty two sir"), (8, "answer"), (9, "...")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.distance, r.last_word) for r in decontamination.find_passages(docs, bench).collect()} == {(1, 7, 0, 4), (3, 8, 0, 1)}


# ---------------------------------------------------------------- personal data


def luhn(digits):
    return sum(d if n % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for n, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


PARTS = ["a@b.c", "@", ".", "..", "1", "12", "255", "0", "000", "256", "-", " ", "+", "+1", "(", ")", "x", "é", "😀", "_d@e.f", "4111111111111111",
         "4111 1111 1111 1111", "555-2485", "\n", "1.2.3.4", "\x85", "000000255.1.1.1"]


def test_base_spans_equal_plain_patterns(spark, odd_texts):
    rng = random.Random(3)
    texts = list(odd_texts) + [(100 + n, "".join(rng.choice(PARTS) for _ in range(rng.randrange(25)))) for n in range(1500)]
    rows = privacy.span_report(spark.createDataFrame(texts, "doc_id long, text string")).collect()

    def seen(i, spans):
        counts = Counter(k for k, *_ in spans)
        return (str(i), *(counts[k] for k in privacy.KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())

    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows)
    assert got == sorted(seen(i, plain_spans(t or "")) for i, t in texts)


def test_telling_terms(spark):
    """A word that stands near an address and nowhere else discloses it; common words and lone texts don't."""
    mail = "boss@corp.example.com"
    texts = [(n, f"common filler{n % 7} text {n} goes on") for n in range(300)]
    texts += [(1000 + n, f"common note about Zebulon, {mail} then more common words{n}") for n in range(4)]
    texts += [(2000, "Zebulon is named here without it"), (3000, f"lonely {mail.replace('boss', 'other')} word")]
    rows = {r.doc_id: r for r in privacy.span_report(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    marked = rows[1000].spans.split(",")
    start = dict(texts)[1000].index("Zebulon")
    assert f"term:{start}:{start + 7}" in marked
    words = {dict(texts)[1000][int(a):int(b)] for k, a, b in (x.split(":") for x in marked) if k == "term"}
    assert "Zebulon" in words and "common" not in words
    assert rows[2000].spans == "" and "term" not in rows[3000].spans and rows[1000].n_email == 1
    clean = {r.doc_id: r.text for r in privacy.sanitise(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert "Zebulon" not in clean[1000] and "<EMAIL>" in clean[1000] and "common" in clean[1000]
    assert clean[2000] == dict(texts)[2000] and clean[5] == dict(texts)[5]


def plain_terms(texts, shrink=privacy.SHRINK, generalise=privacy.GENERALISE):
    """{entity: {term}} by plain counts over all rows."""
    words = lambda x: set(re.findall(r"[^\W\d_]+", x.lower()))
    n_t, n_e, n_et, kinds = Counter(), Counter(), Counter(), defaultdict(set)
    for t in texts:
        n_t.update(words(t))
        pairs, entities = set(), set()
        for kind, a, b in plain_spans(t):
            entity = f"{kind}:{t[a:b].lower()}"
            entities.add(entity)
            before, after = t[max(0, a - 80):a], t[b:b + 80]
            if a > 80 and t[a - 81].isalpha():
                before = re.sub(r"^[^\W\d_]+", "", before)
            if len(t) > b + 80 and t[b + 80].isalpha():
                after = re.sub(r"[^\W\d_]+$", "", after)
            pairs |= {(entity, w) for w in words(before) | words(after)}
        n_e.update(entities)
        n_et.update(pairs)
        for pair in pairs:
            kinds[pair].add(t)
    out = defaultdict(set)
    for (e, w), n in n_et.items():
        trust = len(kinds[e, w]) / (len(kinds[e, w]) + shrink)
        carried = np.log2(len(texts) / n_e[e])
        if carried > 0 and trust * min(1.0, np.log2(n * len(texts) / (n_e[e] * n_t[w])) / carried) >= generalise:
            out[e].add(w)
    return dict(out)


def test_terms_equal_plain_counts(spark):
    """Names at the edge of a text, short ones and ones of other scripts; contexts cut inside words; copies of texts."""
    rng = random.Random(8)
    common = [invented(f"c{n}", 1, 300).split()[0] for n in range(60)]
    filler = lambda n: " ".join(rng.choice(common) for _ in range(n))
    texts = [filler(rng.randrange(1, 40)) for _ in range(250)]
    for n in range(5):
        texts += [f"Zebulon: boss@corp.example {'' if n == 0 else filler(n)}".strip(), f"{filler(n)} mail Lee at lee-{7}@corp.example then {filler(3)}",
                  f"{filler(25)} +1 988 555 2485 Wu", f"{filler(30)} é王小明 {filler(n)} 10.1.2.3 {filler(30)}"]
    texts += ["Zebulon: boss@corp.example"] * 3 + [f"once@only.example of {w}" for w in ("alpha", "beta")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = {r.doc_id: r.spans for r in privacy.span_report(docs).collect()}
    expected = plain_terms(texts)
    assert {"zebulon"} <= expected["email:boss@corp.example"] and "lee" in expected["email:lee-7@corp.example"] and "wu" in expected["phone:+1 988 555 2485"]
    # The word that both of its texts share; words of a single text say nothing.
    assert expected["email:once@only.example"] == {"of"}
    for i, t in enumerate(texts):
        terms = set().union(*(expected.get(f"{k}:{t[a:b].lower()}", set()) for k, a, b in plain_spans(t)))
        inside = lambda a, b: any(x < b and a < y for _, x, y in plain_spans(t))
        want = {(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t) if m[0].lower() in terms and not inside(m.start(), m.end())}
        got = {tuple(map(int, x.split(":")[1:])) for x in rows[i].split(",") if x.startswith("term:")}
        assert got == want, t


def test_a_long_text_with_very_many_matches(spark):
    """Work grows with the text, not with matches times text: a log of 60,000 addresses."""
    line = "10.{}.{}.7 get a{}@b.example ok\n"
    text = "".join(line.format(n % 200, n // 200 % 200, n) for n in range(30_000))
    docs = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    start = time.time()
    row = privacy.span_report(docs).where("doc_id = 1").first()
    spans = sorted(plain_spans(text), key=lambda s: list(privacy.KINDS).index(s[0]))
    assert (row.n_ip, row.n_email) == (30_000, 30_000)
    assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    clean = privacy.sanitise(docs).where("doc_id = 1").first().text
    assert clean.startswith("<IP> get <EMAIL>") and clean.count("<EMAIL>") == 30_000 and "10." not in clean
    assert time.time() - start < 120


def test_overlapping_spans_are_replaced_as_one(spark):
    texts = [(1, "call +10.20.30.40 5678 now"), (2, "4111 1111 1111 1111+1 988 555 2485 end"), (3, "a@b.c1.2.3.4 x"), (4, "".join(f"n{i} 1.2.3.{i % 9} " for i in range(500)))]
    clean = {r.doc_id: r.text for r in privacy.sanitise(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, text in texts:
        end, out = 0, []
        for kind, a, b in sorted(plain_spans(text), key=lambda s: (s[1], s[2], s[0])):
            if a >= end:
                out += [text[end:a], f"<{kind.upper()}>"]
            end = max(end, b)
        assert clean[i] == "".join([*out, text[end:]])


def test_sanitising_keeps_rows_and_columns(odd_docs, no_docs):
    clean = privacy.sanitise(odd_docs)
    assert clean.columns == odd_docs.columns and clean.exceptAll(odd_docs).count() == 0 and clean.count() == odd_docs.count()
    assert privacy.sanitise(no_docs).count() == 0 and privacy.span_report(no_docs).count() == 0


def test_native_plan(spark):
    """No Python runs in the operator's plans."""
    docs = spark.createDataFrame([(1, "write to a@b.example, or call +1 (988) 555-2485")], "doc_id long, text string")
    plan = privacy.span_report(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow|ArrowEval", plan)


def test_items_with_one_opening_ask_for_each_window_once():
    """Many items that begin alike cost no more places than a few; each is still told from the others."""
    rng, opening = random.Random(8), "which of the following statements is "
    body = [" ".join(f"w{rng.randrange(3000)}" for _ in range(14)) for _ in range(400)]
    rows = [(i, opening + b) for i, b in enumerate(body)]
    few, many = decontamination.build_items(rows[:20]), decontamination.build_items(rows)
    texts = [f"intro words {opening}{b} and more".encode() for b in body[:10]] + [opening.encode() * 3]
    words = b" . ".join(t.translate(decontamination.WORD_BYTES) for t in texts).split()
    placed = []
    for items in (few, many):
        flat = np.array([items.vocabulary.get(w, -2 if w == b"." else 0) for w in words], np.int64)
        starts, sizes, direct = decontamination._windows(flat, items)
        placed.append(len(starts))
        assert not direct and {(o, i) for o, i, *_ in decontamination.find_in_batch(texts, items)} == {(i, i) for i in range(10)}
    assert placed[1] <= 2 * placed[0]
