"""Queries over streams with state: each equals a query over the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from inkweave.plans.catalog import query
from inkweave.plans.fixtures import read
from inkweave.sources.tables import shared_folder
from inkweave.streaming import jobs, joins, runs


def _in_files(spark, sf):
    """The events as a stream of four files in the order of time, and a folder for what comes of them."""
    events = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    runs.in_order(events, f"{folder}/files", "ts")
    return lambda: runs.files(spark, f"{folder}/files", events.schema), folder


_JOBS = """WITH e AS (SELECT user_id AS job, CASE event_type WHEN 'purchase' THEN 'ready' ELSE event_type END AS status, ts FROM events),
p AS (SELECT *, lag(status) OVER w AS was, lag(ts) OVER w AS was_ts, lead(ts) OVER w AS next_ts, max(ts) OVER () AS latest FROM e WINDOW w AS (PARTITION BY job ORDER BY ts)),
r AS (SELECT *, was IS NULL OR was IN ('ready', 'error') OR ts > was_ts + INTERVAL 2 HOUR AS begins FROM p)
SELECT job, status, ts AS told_at FROM r WHERE begins OR status <> was
UNION ALL SELECT job, 'timeout', ts + INTERVAL 2 HOUR FROM r WHERE status NOT IN ('ready', 'error') AND coalesce(next_ts > ts + INTERVAL 2 HOUR, ts + INTERVAL 2 HOUR < latest - INTERVAL 1 HOUR)"""


@query("job_progress", "A15", _JOBS)
def job_progress(spark, sf):
    """What observers of jobs are told: changes, ends and timeouts."""
    stream, folder = _in_files(spark, sf)
    told = runs.finish(jobs.changes(jobs.statuses(stream())), folder)
    return told.select("job", "status", F.col("at").cast("timestamp_ntz").alias("told_at"))


@query("click_purchases", "A15", """SELECT c.user_id, c.event_id AS first_id, p.event_id AS second_id, c.ts AS first_at, p.ts AS second_at FROM events c JOIN events p ON p.user_id = c.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR
WHERE c.event_type = 'click' AND p.event_type = 'purchase'""")
def click_purchases(spark, sf):
    """Clicks with the purchases of the same user inside an hour, from two streams."""
    stream, folder = _in_files(spark, sf)
    of = lambda kind: stream().filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("at"))
    met = runs.finish(joins.within_interval(of("click"), of("purchase"), "user_id"), folder)
    return met.select("user_id", "first_id", "second_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_at", "second_at")])
