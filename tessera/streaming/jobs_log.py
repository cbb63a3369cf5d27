"""R-5 on an arriving log: the status of each job as a stateful stream.

The state of a job is its number of events and the last of them by (ts,
event_id), so the result is the same however the log is split into batches and
in whatever order they come.  Batches are written to a folder each, named by
their number; a batch that is run again after a crash replaces its folder.  A job that is
not finished and has had no event for ``silent_after`` is reported as silent by
a timer (of processing time, since an event-time timer would drop late events);
timers are looked at when the next batch of events arrives.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import constants as C

LOG_SCHEMA = "job_id string, ts timestamp, event_id long, status string"
OUT_SCHEMA = "job_id string, n_events long, last_status string, silent boolean"
STATE_SCHEMA = "n_events long, ts long, event_id long, status string"
SILENT_AFTER_MS = 3_600_000


def _follow(silent_after: int, finished: frozenset[str]):
    def follow(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ts, event_id, status = state.get if state.exists else (0, None, None, None)
        silent = state.hasTimedOut
        if not silent:
            for rows in batches:
                n += len(rows)
                times, ids = rows["ts"].to_numpy().astype("datetime64[ns]").view(np.int64), rows["event_id"].to_numpy()
                missing = np.isnat(times.view("datetime64[ns]"))
                some = np.flatnonzero(missing if missing.any() else times == times.max())  # a missing time counts as the last
                last = some[len(some) - 1 - ids[some][::-1].argmax()]
                at = int(times[last]), int(ids[last])
                if ts is None or at > (ts, event_id):
                    (ts, event_id), status = at, rows["status"].iat[last]
        state.update((n, ts, event_id, status))
        if status not in finished and not silent:
            state.setTimeoutDuration(silent_after)
        yield pd.DataFrame({"job_id": [key[0]], "n_events": [n], "last_status": [status], "silent": [silent]})

    return follow


def follow_jobs(log: DataFrame, silent_after: int = SILENT_AFTER_MS) -> DataFrame:
    """A row for each job of each batch: its events so far and its last status."""
    finished = frozenset([C.STATUS_COMPLETED, *C.TERMINAL_FAILURES])
    return log.groupBy("job_id").applyInPandasWithState(
        _follow(silent_after, finished), OUT_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.ProcessingTimeTimeout)


def start_following(log: DataFrame, out_path: str, checkpoint: str, silent_after: int = SILENT_AFTER_MS):
    """Start the stream over ``log`` (columns of ``LOG_SCHEMA``) for what has arrived; a later call goes on from the checkpoint."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    conf, key = log.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, "false")  # with a processing-time timer each batch would ask for another, and the run would not end
    try:
        return _writer(follow_jobs(log, silent_after), write, checkpoint).start()
    finally:
        conf.set(key, before)


def _writer(states: DataFrame, write, checkpoint: str):
    return states.writeStream.foreachBatch(write).outputMode("update") \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True)


def job_states(spark: SparkSession, out_path: str) -> DataFrame:
    """``job_id, n_events, last_status, outcome, silent`` of every job, from the last batch that has it."""
    rows = spark.read.schema(f"{OUT_SCHEMA}, batch long").parquet(out_path)
    last = rows.groupBy("job_id").agg(F.max_by(F.struct("n_events", "last_status", "silent"), F.struct("batch", "n_events")).alias("s")).select("job_id", "s.*")
    s = F.col("last_status")
    outcome = F.when(s == C.STATUS_COMPLETED, F.lit("completed")).when(s.isin(C.TERMINAL_FAILURES), F.lit("failed")).otherwise(F.lit("remaining"))
    return last.select("job_id", "n_events", "last_status", outcome.alias("outcome"), "silent")
