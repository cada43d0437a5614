"""Streams over articles and events: duplicates, activity, sessions, failing feeds.

Every one of them has a watermark that lets state go, but for keys with fewer failures than open a breaker: those count however old they are, two numbers a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..fixtures import table_stream


def read_events(spark: SparkSession, sf_dir: str, late: str = "1 day") -> DataFrame:
    """The events as a stream, with event times."""
    return table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def unique(events: DataFrame, *keys: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.dropDuplicatesWithinWatermark(list(keys))


def velocity(events: DataFrame, length: str = "4 hours", slide: str = "1 hour") -> DataFrame:
    """(start, event_type, n, users) of sliding windows."""
    w = F.window("ts", length, slide)
    return events.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("window.start").alias("start"), "event_type", "n", "users")


def tumbling(events: DataFrame, length: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "48 hours") -> DataFrame:
    """(user_id, start, n): runs of events without a pause of the gap."""
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def breaker(events: DataFrame, most: int = 3, minutes: int = 30) -> DataFrame:
    """(user_id, at_ms, failures, open): an update for each key with errors.

    Failures count up until there are `most`, which opens the breaker for so many minutes after the last. Failures within that time change nothing; the state
    goes when the watermark has passed it, and the next failure counts anew. at_ms is the last failure that counted.
    """
    pause = minutes * 60_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, last = state.get if state.exists else (0, 0)
        for at in sorted(t for b in batches for t in b["at_ms"]):
            if count < most or at - last >= pause:
                count, last = (count if count < most else 0) + 1, at
        state.update((count, last))
        if count >= most:
            state.setTimeoutTimestamp(max(last + pause, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "at_ms": [last], "failures": [count], "open": [count >= most]})

    errors = events.where("event_type = 'error'").select("user_id", "ts", F.unix_millis("ts").alias("at_ms"))
    return errors.groupBy("user_id").applyInPandasWithState(run, "user_id long, at_ms long, failures long, open boolean", "failures long, last_ms long", "update", GroupStateTimeout.EventTimeTimeout)

