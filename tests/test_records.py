import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tabguard.operators import corpus, experiments, fhir, registry

DAY = dt.datetime(2026, 1, 31)


def test_updates_of_dead_ids_do_not_revive_them(spark):
    log = [("add", 1, "a"), ("update", 1, "b"), ("update", 2, "x"), ("add", 3, "c"), ("delete", 3, None), ("update", 3, "d"), ("delete", 4, None),
           ("add", 5, "e"), ("delete", 5, None), ("add", 5, "f")]
    changes = spark.createDataFrame([(op, i, DAY + dt.timedelta(seconds=n), n, text) for n, (op, i, text) in enumerate(log)],
                                    "op string, id int, ts timestamp, seq int, comment string")
    assert {(r.id, r.comment) for r in experiments.current_rows(changes, ["comment"]).collect()} == {(1, "b"), (5, "f")}
    assert {(r.op, r.id) for r in experiments.rejected_changes(changes).collect()} == {("update", 2), ("update", 3), ("delete", 4)}


def test_lineage_of_long_and_wide_families(spark):
    parent = {i: None if i == 0 else (i - 1 if i < 200 else 7) for i in range(600)}
    rows = {r.experiment_id: (r.root_id, r.depth) for r in experiments.lineage(
        spark.createDataFrame(list(parent.items()), "experiment_id int, parent_id int")).collect()}
    assert rows[199] == (0, 199) and rows[599] == (0, 8) and rows[0] == (0, 0) and len(rows) == 600


def test_lineage_reports_circles(spark):
    rows = [("a", None), ("b", "a"), ("x", "y"), ("y", "x"), ("z", "x"), ("o", "gone")]
    found = {r.experiment_id: (r.root_id, r.depth) for r in experiments.lineage(
        spark.createDataFrame(rows, "experiment_id string, parent_id string")).collect()}
    assert found == {"a": ("a", 0), "b": ("a", 1), "x": (None, None), "y": (None, None), "z": (None, None), "o": ("gone", 1)}


def test_retention_keeps_entries_never_used(spark):
    rows = [("a", DAY, 1.0, None), ("b", DAY, None, DAY), ("c", DAY, 1024.0 * 5, DAY)]
    df = spark.createDataFrame(rows, "cache_key string, cached_at timestamp, size_mb double, last_accessed timestamp")
    assert {r.cache_key: r.action for r in registry.retention_plan(df, DAY).collect()} == {"a": "evict", "b": "keep", "c": "keep"}


def test_retention_keeps_the_most_recent(spark):
    entries = [("old", DAY - dt.timedelta(days=31), 10.0, DAY), ("broken", None, 10.0, DAY)] + [
        (f"k{i}", DAY - dt.timedelta(days=1), 1024.0, DAY - dt.timedelta(minutes=i)) for i in range(8)]
    df = spark.createDataFrame(entries, "cache_key string, cached_at timestamp, size_mb double, last_accessed timestamp")
    plan = {r.cache_key: r.action for r in registry.retention_plan(df, DAY).collect()}
    assert plan == {"old": "expire", "broken": "expire", **{f"k{i}": "keep" if i < 5 else "evict" for i in range(8)}}
    stats = registry.registry_statistics(df).first()
    assert stats.entries == 10 and stats.total_gb == pytest.approx(8 + 20 / 1024)


def test_fingerprint(spark):
    df = spark.range(100).selectExpr("id as Age", "id * 0.5 as BMI")
    key = registry.fingerprint(df).first().fingerprint
    assert len(key) == 16 and key == registry.fingerprint(df.repartition(5).orderBy(F.desc("Age"))).first().fingerprint
    others = [df.union(df.limit(1)), df.withColumnRenamed("BMI", "b"), df.withColumn("BMI", F.col("BMI") + 1), df.withColumn("Age", F.col("Age").cast("int"))]
    assert len({key, *[registry.fingerprint(d).first().fingerprint for d in others]}) == 5
    assert registry.cache_key(df, "PAR").split("_")[1:] == ["default", "PAR"]
    assert registry.cache_key(df, "PAR", {"b": 1, "a": 2}) == registry.cache_key(df, "PAR", {"a": 2, "b": 1})


def segments(text, marks):
    out, last = [], 0
    for start, end in marks:
        if start > last:
            out.append(text[last:start])
        out.append(text[start:max(start, end)])
        last = end
    if last < len(text):
        out.append(text[max(0, last):])
    return out


@pytest.mark.parametrize("options", [{}, {"piece_rows": 20, "share": 7}])
def test_highlight_segments(spark, options):
    draw = random.Random(4)
    texts = {d: "".join(draw.choice("abcdefg ") for _ in range(80)) for d in range(6)}
    marks = [(d, i, s, s + draw.randrange(0, 20)) for d in (1, 2, 3, 5) for i in range(60 if d == 2 else 4) for s in [draw.randrange(0, 85)]]
    rows = corpus.highlight_segments(
        spark.createDataFrame(list(texts.items()), "doc_id int, text string"),
        spark.createDataFrame([(d, i, s, e, "yellow", None) for d, i, s, e in marks],
                              "doc_id int, highlight_id int, start int, end int, color string, comment string"), **options).collect()
    for d, text in texts.items():
        own = sorted((s, i, e) for dd, i, s, e in marks if dd == d)
        want = segments(text, [(s, e) for s, _, e in own]) if own else [text]
        assert sorted(r.text for r in rows if r.doc_id == d) == sorted(want)


def test_search_ranks_pages(spark):
    rows = [("a.pdf", "Privacy of patients. " * 4), ("b.pdf", "Cooking rice and beans at home, slowly and well, every day\fPrivacy, one word only in this page about gardens and trees"),
            ("c.pdf", "short")]
    pages = corpus.ingest_pages(spark.createDataFrame(rows, "filename string, text string"))
    assert [(r.filename, r.page_number) for r in pages.orderBy("filename", "page_number").collect()] == [("a.pdf", 1), ("b.pdf", 1), ("b.pdf", 2)]
    found = corpus.search_pages(pages, "PRIVACY patients?", 5).orderBy("rank").collect()
    assert [(r.filename, r.page_number) for r in found] == [("a.pdf", 1), ("b.pdf", 2)] and found[0].score == 1.0 and 0 < found[1].score < 1
    assert corpus.search_pages(pages, "...").count() == 0
    empty = pages.limit(0)
    assert corpus.search_message(empty) and corpus.search_message(pages) is None and corpus.search_pages(empty, "x").count() == 0
    assert tuple(corpus.corpus_statistics(empty).first()) == (0, 0)


def test_search_log(spark):
    log = spark.createDataFrame([("old", "2026-01-01", 5)], "query string, timestamp string, top_k long")
    rows = corpus.search_history(corpus.log_search(log, "new", "2026-01-02", 3)).collect()
    assert [(r.query, r.top_k) for r in rows] == [("new", 3), ("old", 5)]


def test_patients(spark):
    df = spark.createDataFrame([(1, "M", "41"), (2, "Female", None), (3, "??", "n/a")], "id int, SEX string, Age string")
    rows = fhir.patient_resources(df, ["id"], 2026).orderBy("id").collect()
    assert [(r.gender, r.birthDate) for r in rows] == [("male", "1985-01-01"), ("female", None), (None, None)]
    assert fhir.patient_resources(df, ["id"], 2026, strict=True).filter("id = 1").first().gender is None
    assert len({r.patient_id for r in rows}) == 3
    entry = fhir.bundle_entries(fhir.patient_resources(df, ["id"], 2026).filter("id = 3")).first()
    assert '"gender"' not in entry.document and '"request":{"method":"POST","url":"Patient"}' in entry.document


def test_status_and_history(spark):
    events = spark.createDataFrame([("a", "running", DAY, 1), ("a", "completed", DAY, 2), ("b", "failed", DAY, 3)],
                                   "experiment_id string, status string, ts timestamp, seq int")
    asked = spark.createDataFrame([("a",), ("z",)], "experiment_id string")
    assert {tuple(r) for r in experiments.latest_status(events, asked).collect()} == {("a", "completed"), ("z", "not_found")}
    configs = spark.createDataFrame([("a", None), ("b", "2026"), ("c", "2027")], "experiment_id string, timestamp string")
    assert [r.experiment_id for r in experiments.history(configs).collect()] == ["c", "b", "a"]
