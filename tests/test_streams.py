"""Streams with state: equal to batches, restarted, with late rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from inkweave.streaming import jobs, joins, runs

BEGIN = dt.datetime(2024, 1, 1)
EVENTS = "job long, status string, at timestamp, event_id long"


def at(minutes: float) -> dt.datetime:
    return BEGIN + dt.timedelta(minutes=minutes)


def told(df):
    return sorted((r.job, r.status, (r["at"] - BEGIN).total_seconds() / 60) for r in df.collect())


def put(spark, rows, folder, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def progress(spark, place):
    schema = spark.createDataFrame([], EVENTS).schema
    return runs.finish(jobs.changes(runs.files(spark, f"{place}/files", schema)), f"{place}/out")


def test_changes_ends_and_timeouts(spark, tmp_path):
    put(spark, [(1, "click", at(0), 1), (1, "click", at(1), 2), (1, "view", at(2), 3), (2, "click", at(0), 4)], f"{tmp_path}/files", EVENTS)
    put(spark, [(1, "ready", at(3), 5), (1, "view", at(4), 6), (3, "error", at(5), 7), (3, "error", at(6), 8)], f"{tmp_path}/files", EVENTS)
    put(spark, [(4, "click", at(500), 9), (1, "view", at(501), 10)], f"{tmp_path}/files", EVENTS)
    want = [(1, "click", 0), (1, "view", 2), (1, "ready", 3), (1, "view", 4), (1, "timeout", 124), (1, "view", 501), (2, "click", 0), (2, "timeout", 120), (3, "error", 5), (3, "error", 6), (4, "click", 500)]
    assert told(progress(spark, tmp_path)) == sorted(want)


def test_a_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    files = [
        [(1, "click", at(0), 1), (2, "view", at(1), 2)],
        [(1, "click", at(30), 3), (2, "ready", at(31), 4)],
        [(1, "view", at(60), 5), (2, "view", at(61), 6)],
        [(1, "ready", at(90), 7), (3, "click", at(700), 8)],
    ]
    once, twice = tmp_path / "once", tmp_path / "twice"
    for f in files:
        put(spark, f, f"{once}/files", EVENTS)
    whole = told(progress(spark, once))
    for f in files[:2]:
        put(spark, f, f"{twice}/files", EVENTS)
    first = told(progress(spark, twice))
    # the click at 30 isn't told again: the state of the first run is there
    assert first == [(1, "click", 0), (2, "ready", 31), (2, "view", 1)]
    for f in files[2:]:
        put(spark, f, f"{twice}/files", EVENTS)
    assert told(progress(spark, twice)) == whole
    assert told(progress(spark, twice)) == whole  # nothing new, nothing twice


def test_late_events_are_dropped(spark, tmp_path):
    put(spark, [(1, "click", at(0), 1)], f"{tmp_path}/files", EVENTS)
    put(spark, [(2, "click", at(600), 2)], f"{tmp_path}/files", EVENTS)
    put(spark, [(3, "click", at(100), 3), (4, "click", at(590), 4)], f"{tmp_path}/files", EVENTS)
    jobs_told = {j for j, *_ in told(progress(spark, tmp_path))}
    assert jobs_told == {1, 2, 4}


ROWS = "user long, id long, at timestamp"


@pytest.fixture
def both(spark, tmp_path):
    schema = spark.createDataFrame([], ROWS).schema
    stream = lambda side: runs.files(spark, f"{tmp_path}/{side}", schema)
    return lambda side, rows: put(spark, rows, f"{tmp_path}/{side}", ROWS), lambda: runs.finish(joins.within_interval(stream("a"), stream("b"), "user"), f"{tmp_path}/out")


def test_interval_join_equals_the_batch(spark, both):
    add, run = both
    a = [(k % 3, k, at(7 * k)) for k in range(40)]
    b = [(k % 3, 100 + k, at(7 * k + (k % 11) * 8 - 30)) for k in range(40)]
    b.sort(key=lambda r: r[2])
    for k in range(0, 40, 10):
        add("a", a[k : k + 10])
        add("b", b[k : k + 10])
    got = sorted((r.first_id, r.second_id) for r in run().collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[2] <= x[2] + dt.timedelta(hours=1)) and got
    batch = joins.within_interval(*[spark.createDataFrame(x, ROWS) for x in (a, b)], "user")
    assert sorted((r.first_id, r.second_id) for r in batch.collect()) == got


def test_interval_join_drops_late_rows(both):
    add, run = both
    add("a", [(1, 1, at(0))])
    add("b", [(1, 2, at(30))])
    add("a", [(1, 3, at(900))])
    add("b", [(1, 4, at(900))])
    run()
    add("b", [(1, 5, at(40))])  # 14 hours behind, the first click has left the state
    add("a", [(1, 6, at(20))])
    assert sorted((r.first_id, r.second_id) for r in run().collect()) == [(1, 2), (3, 4)]


def test_files_follow_each_other_in_time(spark, tmp_path):
    rows = spark.range(100).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    runs.in_order(rows, str(tmp_path / "x"), "ts")
    files = sorted((tmp_path / "x").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    spans = [sorted(r.id for r in spark.read.parquet(str(f)).collect()) for f in files]
    assert [s[0] for s in spans] == [0, 25, 50, 75] and sum(map(len, spans)) == 100
    runs.in_order(rows.limit(0), str(tmp_path / "none"), "ts")
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0
