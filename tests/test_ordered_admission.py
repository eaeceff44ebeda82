"""Event-time admission on a stream whose requests come late, against the batch form."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tabguard.operators import admission
from tabguard.streaming.ordered_admission import admit_stream_in_order, rocksdb_state

START = dt.datetime(2026, 3, 1, 12)
SCHEMA = "user string, ts timestamp, id long, own int"


def arrivals(n=400, seed=3, late=50.0):
    """Requests with the second they arrive in, at most ``late`` seconds behind."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        at = draw.uniform(0, 900)
        moment = START + dt.timedelta(seconds=round(at) if i % 5 else at)
        rows.append(((moment - START).total_seconds() + draw.uniform(0, late), (draw.choice(["a", "b", None]), moment, i, draw.choice([1, 2, 4]))))
    return [r for _, r in sorted(rows, key=lambda r: r[0])]


def run(spark, folder, parts, **options):
    (folder / "in").mkdir()
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    with rocksdb_state(spark):
        for i, part in enumerate(parts):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
            query = admit_stream_in_order(source, ["user"], "ts", "id", **options).writeStream.format("parquet").option("path", str(folder / "out")).option(
                "checkpointLocation", str(folder / "log")).trigger(availableNow=True).start()
            query.awaitTermination()
    progress = query.recentProgress
    return spark.read.parquet(str(folder / "out")), progress


def test_late_requests_are_judged_in_their_place(spark, tmp_path):
    rows = arrivals()
    got, _ = run(spark, tmp_path, [rows[:150], rows[150:300], rows[300:]], limit="own", lateness="60 seconds")
    batch = admission.admit_requests(spark.createDataFrame(rows, SCHEMA), ["user"], "ts", "id", "own")
    passed = max(r[1] for r in rows) - dt.timedelta(seconds=61)
    want = {r.id: (r.admitted, r.in_window, r.remaining) for r in batch.collect()}
    seen = {r.order_id: (r.admitted, r.in_window, r.remaining) for r in got.collect()}
    assert got.count() == len(seen) and all(want[i] == v for i, v in seen.items())
    assert {r[2] for r in rows if r[1] <= passed} <= set(seen)
    # They did not come in order, and some were turned down.
    assert any(a[1] > b[1] for a, b in zip(rows, rows[1:])) and len({v[0] for v in seen.values()}) == 2


def test_what_comes_behind_the_watermark_is_dropped(spark, tmp_path):
    day = [("a", START + dt.timedelta(hours=h), h, 2) for h in (1, 5, 9)]
    got, progress = run(spark, tmp_path, [day[:2], [("a", START, 99, 2), day[2]], [("a", START + dt.timedelta(hours=12), 12, 2)]], limit=2)
    assert {r.order_id for r in got.collect()} == {1, 5, 9}
    assert got.filter(~F.col("admitted")).count() == 0


def test_state_is_held_by_groups_of_keys(spark, tmp_path):
    rows = [(f"u{i % 3000}", START + dt.timedelta(minutes=(i * 7) % 41, microseconds=i % 3), i, 2) for i in range(9000)]
    got, progress = run(spark, tmp_path, [rows], limit="own", lateness="20 minutes", window_seconds=1200)
    batch = admission.admit_requests(spark.createDataFrame(rows, SCHEMA), ["user"], "ts", "id", "own", 1200)
    passed = max(r[1] for r in rows) - dt.timedelta(minutes=20, milliseconds=1)
    assert {tuple(r) for r in got.drop("key", "limit").select("order_id", "admitted", "in_window").collect()} == {
        tuple(r) for r in batch.filter(F.col("ts") <= F.lit(passed)).select("id", "admitted", "in_window").collect()}
    # Some columns and a timer of 256 groups, not of 3,000 keys.
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert 0 < max(held) <= 5 * 256
