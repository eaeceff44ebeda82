"""Change tables against the whole log, and what a commit touches."""

import os
import random

import pytest

from tabguard.operators.change_tables import ChangeTable
from tabguard.operators.experiments import current_rows

SCHEMA = "op string, id long, ts long, seq long, text string, flag boolean"


def log(n=900, ids=60, seed=5):
    draw = random.Random(seed)
    rows = [(draw.choice(["add", "add", "update", "delete"]), draw.randrange(ids), draw.randrange(n), i, f"t{i}" if i % 7 else None, i % 2 == 0) for i in range(n)]
    return rows + [("add", None, 5, n, "no id", True), ("update", 9999, 1, n + 1, "unknown", True)]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_batches_in_any_order_equal_the_whole_log(spark, tmp_path):
    changes = log()
    random.Random(1).shuffle(changes)
    kept = ChangeTable(spark, str(tmp_path / "t"), ("text", "flag"))
    kept.create(spark.createDataFrame(changes[:300], SCHEMA), ranges=5)
    kept.append(spark.createDataFrame(changes[300:500], SCHEMA))
    kept.append(spark.createDataFrame([], SCHEMA))
    kept.compact()
    kept.append(spark.createDataFrame(changes[500:], SCHEMA))
    whole = current_rows(spark.createDataFrame(changes, SCHEMA), ["text", "flag"])
    assert rows(kept.current()) == rows(whole)
    assert rows(kept.rows_of([3, 17, 9999, -1])) == rows(whole.filter("id in (3, 17)"))


def test_a_commit_leaves_other_ranges_alone(spark, tmp_path):
    kept = ChangeTable(spark, str(tmp_path / "t"), ("text", "flag"))
    kept.create(spark.createDataFrame([("add", i, i, i, "a", True) for i in range(100)], SCHEMA), ranges=4)
    before = files(tmp_path)
    kept.append(spark.createDataFrame([("update", 99, 500, 500, "b", False), ("delete", 98, 501, 501, None, None)], SCHEMA))
    manifest = kept.compact()
    after = files(tmp_path)
    assert before.items() <= after.items()
    untouched = [p for p, commits in manifest.commits.items() if commits == [1]]
    assert len(untouched) == 3 and manifest.commits[3] == [3]
    read = {f.split("/states/")[1].rsplit("/", 1)[0] for f in kept.rows_of([99]).inputFiles()}
    assert read == {"v=3/part=3"}
    assert kept.current().count() == 99 and kept.rows_of([99]).first().text == "b"
    assert kept.compact() == manifest


def test_a_broken_commit_is_not_read_and_numbers_are_taken_once(spark, tmp_path):
    kept = ChangeTable(spark, str(tmp_path / "t"), ("text", "flag"))
    first = spark.createDataFrame([("add", 1, 1, 1, "a", True)], SCHEMA)
    kept.create(first)
    kept._write(kept._states(spark.createDataFrame([("update", 1, 2, 2, "lost", True)], SCHEMA)), 2, [])
    assert kept.current().first().text == "a"
    with pytest.raises(Exception, match="(?i)exists"):
        kept.append(first)
    with pytest.raises(Exception, match="(?i)exists"):
        kept.create(first)


def test_texts_as_keys_and_an_empty_table(spark, tmp_path):
    schema = SCHEMA.replace("id long", "id string")
    kept = ChangeTable(spark, str(tmp_path / "t"), ("text", "flag"))
    kept.create(spark.createDataFrame([("add", f"k{i:03d}é", i, i, "a", True) for i in range(50)], schema), ranges=3)
    kept.append(spark.createDataFrame([("delete", "k010é", 99, 99, None, None)], schema))
    assert kept.current().count() == 49 and kept.rows_of(["k010é", "k011é"]).count() == 1
    none = ChangeTable(spark, str(tmp_path / "none"), ("text", "flag"))
    none.create(spark.createDataFrame([], schema))
    assert none.current() is None
    with pytest.raises(TypeError):
        none.create(spark.createDataFrame([], SCHEMA.replace("id long", "id double")))
