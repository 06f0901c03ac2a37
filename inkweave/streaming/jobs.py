"""The progress of jobs as a stream with state: each job's changes until it is ready, fails or falls silent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What ends a run of a job; after it the job's next event begins a new run.
ENDS = ("ready", "error")
OUT = "job long, status string, at timestamp"


def changes(events: DataFrame, silence: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """(job, status, at): what an observer of each job (job, status, at, event_id) of a stream is told.

    A run of a job begins with its first event. A status is told when it differs from the one before; ``ready`` and
    ``error`` end the run. A run that is silent for longer than ``silence`` ends with ``timeout``, told as of the time at
    which the silence became too long: as soon as the watermark (the latest time so far less ``late``) has passed it, or
    when the job's next event shows it. Events before the watermark are dropped. State is one status and one time for each
    run that goes on; a run that ended leaves none.
    """
    gap = int(pd.Timedelta(silence).total_seconds() * 1_000_000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told: list[tuple[str, int]] = []
        status, last = state.get if state.exists else (None, None)
        if state.hasTimedOut:
            told.append(("timeout", last + gap))
            status = None
        else:
            # plain lists: a job has few events in a batch, and a frame's own operations cost more than they do
            rows = [x for f in frames for x in zip(f["at"].to_numpy("datetime64[us]").astype("int64").tolist(), f["event_id"].tolist(), f["status"].tolist(), strict=True)]
            begin = state.getCurrentWatermarkMs() * 1000
            for at, _, now in sorted(x for x in rows if x[0] >= begin):
                if status is not None and at > last + gap:
                    told.append(("timeout", last + gap))
                    status = None
                if now != status:
                    told.append((now, at))
                status, last = (None, None) if now in ENDS else (now, at)
        if status is not None:
            end = -(-(last + gap) // 1000)
            if end <= state.getCurrentWatermarkMs():
                told.append(("timeout", last + gap))
                status = None
            else:
                state.update((status, last))
                state.setTimeoutTimestamp(end)
        if status is None and state.exists:
            state.remove()
        if told:
            yield pd.DataFrame({"job": key[0], "status": [s for s, _ in told], "at": np.array([t for _, t in told], dtype="datetime64[us]")})

    seen = events.select("job", "status", "at", "event_id").withWatermark("at", late)
    return seen.groupBy("job").applyInPandasWithState(step, OUT, "status string, last long", "append", GroupStateTimeout.EventTimeTimeout)


def statuses(events: DataFrame) -> DataFrame:
    """The event table as events of jobs: a user is a job, purchases are its ready ends."""
    status = F.when(F.col("event_type") == "purchase", "ready").otherwise(F.col("event_type"))
    return events.select(F.col("user_id").alias("job"), status.alias("status"), F.col("ts").cast("timestamp").alias("at"), "event_id")
