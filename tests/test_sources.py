import json
import os

import pyarrow as pa
import pytest

from tabguard.session import scratch_scope, write_and_reread
from tabguard.sources import loader, sinks


@pytest.mark.parametrize("source, kind", [
    ("data.csv", "csv"), ("data.csv.gz", "csv"), ("data.parquet", "parquet"), ("a/b.pq", "parquet"), ("x.json.gz", "json"), ("t.feather", "feather"),
    ("sqlite:///data.db", "sql"), ("postgresql://u:p@h/db", "sql"), ("mysql+pymysql://u@h/db", "sql"), ("s3://bucket/t.parquet", "parquet"), ("noext", "csv"),
])
def test_format_routing(source, kind):
    assert loader.detect_format(source) == kind


def test_jdbc_options():
    options = loader.jdbc_options("mysql+pymysql://ann:pw@host:3306/db", table="t")
    assert options == {"url": "jdbc:mysql://host:3306/db", "user": "ann", "password": "pw", "dbtable": "t"}
    assert loader.jdbc_options("sqlite:///data.db", query="select 1", table="t") == {"url": "jdbc:sqlite:data.db", "query": "select 1"}
    ranged = loader.jdbc_options("postgresql://h/db", table="t", partition_column="id", lower=0, upper=100, partitions=4)
    assert ranged["numPartitions"] == "4" and ranged["dbtable"] == "t"
    with pytest.raises(ValueError):
        loader.jdbc_options("postgresql://h/db")
    with pytest.raises(ValueError):
        loader.jdbc_options("postgresql://h/db", table="t", partition_column="id")


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b-c,d\n1,2.5,x\n2,NaN,\n", encoding="utf-8")
    df = loader.load_table(spark, str(tmp_path / "t.csv"))
    assert df.dtypes == [("a", "int"), ("b-c", "double"), ("d", "string")]
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, 2.5, "x"), (2, None, None)]
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        loader.load_table(spark, str(tmp_path / "empty.csv"))


@pytest.mark.parametrize("orient, document", [
    ("records", [{"a": 1, "b": "x"}, {"a": 2, "b": None}]),
    ("columns", {"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": None}}),
    ("columns", {"a": [1, 2], "b": ["x", None]}),
    ("index", {"0": {"a": 1, "b": "x"}, "1": {"a": 2, "b": None}}),
])
def test_json_orientations(spark, tmp_path, orient, document):
    (tmp_path / "t.json").write_text(json.dumps(document))
    df = loader.load_table(spark, str(tmp_path / "t.json"), orient=orient)
    assert sorted(map(tuple, df.select("a", "b").collect())) == [(1, "x"), (2, None)]
    assert dict(df.dtypes)["a"] == "bigint"


def test_json_of_unknown_orientation(spark):
    with pytest.raises(ValueError):
        loader.load_json(spark, "x.json", orient="split")


def test_feather_reads_every_batch(spark, tmp_path):
    for part in range(2):
        table = pa.table({"k": list(range(part * 100, part * 100 + 100)), "s": [str(i) for i in range(100)]})
        with pa.OSFile(str(tmp_path / f"{part}.feather"), "wb") as sink, pa.ipc.new_file(sink, table.schema) as writer:
            writer.write_table(table, max_chunksize=30)
    df = loader.load_feather(spark, str(tmp_path / "*.feather"))
    assert df.count() == 200 and df.select("k").distinct().count() == 200


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="unsupported"):
        loader.load_table(spark, "x.xlsx", format="excel")


def test_configs_of_all_ages(spark, tmp_path):
    old = {"experiment_id": "a", "method": "CTGAN", "timestamp": "t", "num_rows": 5, "sensitive_column": None, "epsilon": 1, "status": "failed", "error": "e"}
    for name, text in {"a": json.dumps(old), "b": json.dumps({**old, "experiment_id": "b", "epochs": 300}, indent=2), "c": "{"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "config.json").write_text(text)
    rows = {r.experiment_id: r.epochs for r in sinks.read_configs(spark, str(tmp_path) + "/*/config.json").collect()}
    assert rows == {"a": None, "b": 300}


def test_dataset_sinks(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "id % 3 as experiment_id")
    sinks.write_dataset(df, str(tmp_path / "p"), partition_by="experiment_id")
    assert spark.read.parquet(str(tmp_path / "p")).filter("experiment_id = 1").count() == 33
    with pytest.raises(ValueError):
        sinks.write_dataset(df, str(tmp_path / "x"), format="xml")


def test_scratch_scope_deletes_its_tables(spark, tmp_path):
    with scratch_scope(spark):
        kept = write_and_reread(spark.range(10), "scoped")
        place = kept.inputFiles()[0]
        kept.write.parquet(str(tmp_path / "result"))
        assert os.path.exists(place.removeprefix("file://"))
    assert not os.path.exists(os.path.dirname(place.removeprefix("file://")))
    assert spark.read.parquet(str(tmp_path / "result")).count() == 10
