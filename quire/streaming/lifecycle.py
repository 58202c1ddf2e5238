"""Job events as a stream: states, leases, replays and windows."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What an event does to a job.
MOVES = {
    ("", "submit"): "received",
    ("received", "claim"): "processing",
    ("processing", "finish"): "done",
    ("processing", "doubt"): "needs_review",
    ("processing", "refuse"): "rejected",
    ("processing", "crash"): "failed",
    ("needs_review", "accept"): "done",
    ("needs_review", "decline"): "failed",
}


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need timestamps with a zone; ones without are taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def step(status: str, attempts: int, event: str) -> tuple[str, int]:
    """The next state; an event that has no meaning in a state changes nothing."""
    after = MOVES.get((status, event), status)
    return after, attempts + (event == "claim" and after != status)


def track_jobs(events: DataFrame, *, lease: str = "30 minutes", max_attempts: int = 3) -> DataFrame:
    """``(job_id, status, attempts, ts)`` after each event and each lapse of a lease, from a stream
    ``(job_id, event, ts)``.  A job in work whose lease lapses in event time is received again, or
    failed after its last attempt."""
    lease_ms = int(pd.Timedelta(lease).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts, at = state.get if state.exists else ("", 0, 0)
        out = []
        if state.hasTimedOut:
            if status == "processing":
                status = "failed" if attempts >= max_attempts else "received"
                out.append((key[0], status, attempts, pd.Timestamp(at + lease_ms, unit="ms")))
        else:
            rows = pd.concat(batches).sort_values(["ts", "event"], kind="stable")
            for event, ts in zip(rows["event"], rows["ts"], strict=True):
                after, tries = step(status, attempts, event)
                if (after, tries) != (status, attempts):
                    status, attempts, at = after, tries, int(ts.timestamp() * 1000)
                    out.append((key[0], status, attempts, ts))
        state.update((status, attempts, at))
        if status == "processing":
            state.setTimeoutTimestamp(max(at + lease_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job_id", "status", "attempts", "ts"])

    return _timed(events).withWatermark("ts", "1 minute").groupBy("job_id").applyInPandasWithState(run, "job_id long, status string, attempts int, ts timestamp", "status string, attempts int, at long", "append", GroupStateTimeout.EventTimeTimeout)


def first_requests(events: DataFrame, *, within: str = "1 day") -> DataFrame:
    """One event for each request that repeats within a day of event time."""
    return _timed(events).withWatermark("ts", within).dropDuplicatesWithinWatermark(["request_id"])


def activity(events: DataFrame, window, *, late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and event type; ``window`` is ``F.window`` or ``F.session_window``."""
    source = _timed(events).withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def concurrency(starts: DataFrame, limit: int) -> DataFrame:
    """``(call_id, admitted)`` of calls ``(call_id, host, start, end)``: while ``limit`` calls that were admitted
    earlier still run, a call is not.  Calls are taken in order of start, by host, in a pass over sorted rows that
    holds the running ones only."""

    def admit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, running = None, []
        for batch in batches:
            out = []
            for name, start, end in zip(batch["host"], batch["start"], batch["end"], strict=True):
                if name != host:
                    host, running = name, []
                while running and running[0] <= start:
                    heapq.heappop(running)
                out.append(len(running) < limit)
                if out[-1]:
                    heapq.heappush(running, end)
            yield batch[["call_id"]].assign(admitted=out)

    return starts.select("host", "call_id", "start", "end").repartition("host").sortWithinPartitions("host", "start", "call_id").mapInPandas(admit, "call_id long, admitted boolean")
