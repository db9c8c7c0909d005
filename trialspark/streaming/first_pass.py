"""Attempts as a stream: each task's search stops at its first pass. An extension; the batch form is a window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "task_id long, policy_name string, calls long, tokens long, passed boolean"


def first_pass_stops(attempts: DataFrame, max_calls: int, late: str = "1 hour", idle_seconds: int = 86_400) -> DataFrame:
    """A row for each (task_id, policy_name) of a stream (with ts, total_tokens, verification_passed) once its search ends.

    A search ends at its first pass or at max_calls attempts; later attempts of it are ignored. Within a micro-batch a
    key's attempts are taken in order of ts. State is two counts a key and is dropped idle_seconds of event time after
    the key's last attempt, so it is bounded by the keys of such a span; the watermark is `late` behind.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        calls, tokens, done = state.get if state.exists else (0, 0, False)
        rows = pd.concat(list(frames)).sort_values("ts")
        ended = None
        for used, passed in zip(rows["total_tokens"], rows["verification_passed"], strict=True):
            if done:
                break
            calls, tokens = calls + 1, tokens + int(used)
            done = bool(passed) or calls >= max_calls
            ended = bool(passed) if done else None
        state.update((calls, tokens, done))
        last = int(rows["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1000 * idle_seconds)
        if ended is not None:
            yield pd.DataFrame([(key[0], key[1], calls, tokens, ended)], columns=["task_id", "policy_name", "calls", "tokens", "passed"])

    kept = "calls long, tokens long, done boolean"
    keyed = attempts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("task_id", "policy_name")
    return keyed.applyInPandasWithState(step, OUT, kept, "append", GroupStateTimeout.EventTimeTimeout)


def rate_by_window(attempts: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window, policy_name, attempts, pass_rate) by event time; rows later than the watermark are dropped."""
    timed = attempts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "policy_name")
    return timed.agg(F.count("*").alias("attempts"), F.avg(F.col("verification_passed").cast("double")).alias("pass_rate"))
