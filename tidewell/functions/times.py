"""Ages, weights by age, and waiting times. Every function takes the time that counts as now."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis(ts: Column) -> Column:
    """Milliseconds since 1970; a time without zone counts as UTC, whatever the session's zone is."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")).cast("long")


def hours_between(a: Column, b: Column) -> Column:
    return F.abs(millis(a) - millis(b)) / 3.6e6


def age_hours(ts: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0.0), (millis(as_of) - millis(ts)) / 3.6e6)


def recency_weight(ts: Column, as_of: Column, tau: float = 24.0) -> Column:
    """exp(-hours / tau); times to come count as now, a tau of 0 or less as 24."""
    return F.exp(-age_hours(ts, as_of) / (tau if tau > 0 else 24.0))


def age_label(ts: Column, as_of: Column) -> Column:
    hours = (millis(as_of) - millis(ts)) / 3.6e6
    return F.when(hours < 1, F.concat(F.round(hours * 60).cast("long").cast("string"), F.lit("m"))).otherwise(F.concat(F.floor(hours).cast("string"), F.lit("h")))


def backoff_ms(attempt: Column, base: int, most: int) -> Column:
    return F.least(base * F.pow(F.lit(2.0), attempt - 1), F.lit(float(most))).cast("long")


def idle_minutes(age_minutes: Column, waiting: bool = False) -> Column:
    """How long to wait for the next look at data of an age: the nearer the refresh after six hours, the shorter."""
    steps = (15.0, 2.0, 1.0, 0.5) if waiting else (30.0, 5.0, 2.0, 1.0)
    return F.when(age_minutes < 300, steps[0]).when(age_minutes < 330, steps[1]).when(age_minutes < 360, steps[2]).otherwise(steps[3])
