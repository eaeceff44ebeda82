import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tabguard.operators import admission
from tabguard.streaming import admission as streaming

START = dt.datetime(2026, 1, 1)


def requests(spark, n=2500, spread=4000):
    draw = random.Random(n)
    rows = [("hot" if draw.random() < 0.4 else f"u{draw.randrange(30)}", "api", START + dt.timedelta(seconds=draw.randrange(spread)), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "user string, endpoint string, ts timestamp, id long")


def replay(rows, limit, window):
    recent, out = {}, {}
    for user, _, ts, i in sorted(rows, key=lambda r: (r[2], r[3])):
        alive = [t for t in recent.get(user, []) if t > ts - dt.timedelta(seconds=window)]
        allowed = len(alive) < limit
        recent[user] = alive + [ts] if allowed else alive
        out[i] = (allowed, len(recent[user]))
    return out


@pytest.mark.parametrize("limit, window", [(1, 60), (3, 60), (10, 60), (2, 7)])
@pytest.mark.parametrize("piece_rows", [10**6, 60])
def test_admission_equals_the_sequential_replay(spark, limit, window, piece_rows):
    rows, df = requests(spark)
    got = admission.admit_requests(df, ["user", "endpoint"], "ts", "id", limit, window, piece_rows).collect()
    assert {r.id: (r.admitted, r.in_window) for r in got} == replay(rows, limit, window)


def test_boundary_is_strict(spark):
    df = spark.createDataFrame([("u", START, 1), ("u", START + dt.timedelta(seconds=59.999999), 2), ("u", START + dt.timedelta(seconds=60), 3)], "user string, ts timestamp, id long")
    got = {r.id: r.admitted for r in admission.admit_requests(df, ["user"], "ts", "id", limit=1).collect()}
    assert got == {1: True, 2: False, 3: True}
    counts = [r.requests for r in admission.trailing_counts(df.union(df.limit(1)), ["user"], "ts").orderBy("ts").collect()]
    assert counts == [2, 3, 2]


@pytest.mark.parametrize("piece_rows", [10**6, 40])
def test_null_and_numeric_keys(spark, piece_rows):
    draw = random.Random(8)
    rows = [(draw.choice([None, 1, 2]), draw.choice([None, 0.5]), START + dt.timedelta(seconds=draw.randrange(3000)), i) for i in range(600)]
    df = spark.createDataFrame(rows, "a int, b double, ts timestamp, id long")
    want = replay([((a, b), None, ts, i) for a, b, ts, i in rows], 2, 60)
    got = admission.admit_requests(df, ["a", "b"], "ts", "id", 2, piece_rows=piece_rows).collect()
    assert {r.id: (r.admitted, r.in_window) for r in got} == want
    assert {(r.id, r.a, r.b) for r in got} == {(i, a, b) for a, b, _, i in rows}


def test_quota(spark):
    rows, df = requests(spark, 300)
    decided = admission.admit_requests(df, ["user"], "ts", "id", limit=3)
    want = replay(rows, 3, 60)
    last = {}
    for user, _, ts, i in sorted(rows, key=lambda r: (r[2], r[3])):
        last[user] = (max(0, 3 - want[i][1]), ts + dt.timedelta(seconds=60))
    got = {r.user: (r.remaining, r.reset_at) for r in admission.quota(decided, ["user"], 3).collect()}
    assert got == last


def write(spark, rows, path, n):
    part = spark.createDataFrame(rows, "user string, endpoint string, ts timestamp, id long").coalesce(1)
    part.write.mode("append").parquet(str(path))


def run(df, path, spark, mode="append"):
    query = df.writeStream.outputMode(mode).format("parquet").option("path", str(path / "out")).option(
        "checkpointLocation", str(path / "log")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(str(path / "out")), query.recentProgress


def test_stream_over_several_batches_equals_the_replay(spark, tmp_path):
    rows, _ = requests(spark, 400, 900)
    rows.sort(key=lambda r: r[2])
    for n in range(4):
        write(spark, rows[n * 100:(n + 1) * 100], tmp_path / "in", n)
    source = spark.readStream.schema("user string, endpoint string, ts timestamp, id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got, _ = run(streaming.admit_stream(source, ["user"], "ts", "id", limit=2), tmp_path, spark)
    assert {r.order_id: (r.admitted, r.in_window) for r in got.collect()} == replay(rows, 2, 60)


def test_late_requests_are_dropped_and_counted(spark, tmp_path):
    day = [("u", "api", START + dt.timedelta(hours=h), h) for h in (1, 5)]
    write(spark, day, tmp_path / "in", 0)
    source = spark.readStream.schema("user string, endpoint string, ts timestamp, id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    decided = streaming.admit_stream(source, ["user"], "ts", "id", limit=2)
    run(decided, tmp_path, spark)
    write(spark, [("u", "api", START, 99), ("u", "api", START + dt.timedelta(hours=6), 6)], tmp_path / "in", 1)
    got, progress = run(decided, tmp_path, spark)
    assert {r.order_id for r in got.collect()} == {1, 5, 6}
    assert sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"]) == 1


def test_own_limits_in_stream_and_batch(spark, tmp_path):
    rows, _ = requests(spark, 300, 600)
    rows.sort(key=lambda r: (r[2], r[3]))
    schema = "user string, endpoint string, ts timestamp, id long, own int"
    limits = {user: n % 4 for n, user in enumerate(sorted({r[0] for r in rows}))}
    frame = spark.createDataFrame([(*r, limits[r[0]]) for r in rows], schema)
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = {}
    for user, limit in limits.items():
        own = [r for r in rows if r[0] == user]
        want |= {i: ok for i, (ok, _) in replay(own, limit, 60).items()}
    batch = admission.admit_requests(frame, ["user"], "ts", "id", "own", piece_rows=25)
    assert {r.id: r.admitted for r in batch.collect()} == want
    assert {r.user: r.limit for r in admission.quota(batch, ["user"]).collect()} == limits
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got, _ = run(streaming.admit_stream(source, ["user"], "ts", "id", limit="own"), tmp_path, spark)
    assert {r.order_id: r.admitted for r in got.collect()} == want


def test_stream_counts(spark, tmp_path):
    rows, df = requests(spark, 300, 600)
    write(spark, rows, tmp_path / "in", 0)
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got, _ = run(streaming.request_counts(source, ["user"], "ts"), tmp_path, spark)
    want = df.groupBy(F.window("ts", "60 seconds", "10 seconds").alias("w"), "user").agg(F.count("*").alias("requests")).select(
        F.col("w.start").alias("window_start"), "user", "requests")
    seen = got.select("window_start", "user", "requests")
    closed = want.join(seen.agg(F.max("window_start").alias("last")), F.col("window_start") <= F.col("last")).drop("last")
    assert seen.count() > 0 and seen.exceptAll(want).count() == 0 and closed.exceptAll(seen).count() == 0


def test_a_key_that_is_always_full_takes_few_rounds(spark, monkeypatch):
    """3,000 requests in 100 pieces, none of which holds a quiet moment: a round for each piece before."""
    rows = [("u", "api", START + dt.timedelta(seconds=7 * i, milliseconds=i * i % 997), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "user string, endpoint string, ts timestamp, id long")
    rounds, written = [], admission.write_and_reread
    monkeypatch.setattr(admission, "write_and_reread", lambda part, tag: rounds.append(tag) or written(part, tag))
    got = admission.admit_requests(df, ["user"], "ts", "id", 3, 3600, piece_rows=60).collect()
    assert {r.id: (r.admitted, r.in_window) for r in got} == replay(rows, 3, 3600)
    assert rounds.count("due") <= 7
