"""Stored state in batch form: cache entries, circuit breakers, refresh states, feed health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import millis


def cache_read(log: DataFrame, prefixes: list[str], as_of: Column) -> DataFrame:
    """The live value of each key of a log (ns, key, value, written_at, expires_at): the latest write of the first namespace that has one.

    As in a store, a later write hides an earlier one also when it has expired.
    """
    place = F.array_position(F.array(*[F.lit(p) for p in prefixes]), F.col("ns"))
    latest = log.where(place > 0).groupBy("ns", "key").agg(F.max_by(F.struct("value", "expires_at"), F.struct("written_at", "seq")).alias("v"))
    live = latest.where(F.col("v.expires_at") > as_of)
    best = F.min(F.struct(place.alias("place"), F.col("v.value").alias("value"))).alias("b")
    return live.groupBy("key").agg(best).select("key", F.col("b.value").alias("value"))


def cache_put(rows: DataFrame, ns: str, ttl_seconds: int, as_of: Column) -> DataFrame:
    """Log rows for (key, value)."""
    return rows.select(F.lit(ns).alias("ns"), "key", "value", as_of.alias("written_at"), (as_of + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"))


def cache_clear(log: DataFrame, pattern: str, prefix_only: bool = False) -> DataFrame:
    hit = F.startswith(F.col("key"), F.lit(pattern)) if prefix_only else F.contains(F.col("key"), F.lit(pattern))
    return log.where(~hit)


def cleared(log: DataFrame, pattern: str) -> DataFrame:
    return log.agg(F.count_if(F.contains(F.col("key"), F.lit(pattern))).alias("deleted"), F.count("*").alias("entries"))


def breaker(attempts: DataFrame, key: str, ts: str, failed: Column, as_of: Column, most: int = 3, minutes: int = 30) -> DataFrame:
    """(key, failures, skip): the failures that count now, and whether the key is to be skipped.

    Failures count up, however far apart, until there are `most`. The key is then skipped for so many minutes after the last of them: attempts within that time
    would not have been made and change nothing, and the next failure after it counts anew. A success changes nothing. A key's failures are one
    array of times on the way, as each depends on those before; a feed is attempted once a refresh.
    """
    pause = minutes * 60_000
    fails = attempts.where(failed).groupBy(key).agg(F.array_sort(F.collect_list(millis(F.col(ts)))).alias("times"))
    start = F.struct(F.lit(0).cast("long").alias("failures"), F.lit(0).cast("long").alias("last"))

    def step(s: Column, at: Column) -> Column:
        full = s["failures"] >= most
        counted = F.struct(F.when(full, 1).otherwise(s["failures"] + 1).cast("long").alias("failures"), at.alias("last"))
        return F.when(full & (at - s["last"] < pause), s).otherwise(counted)

    out = fails.select(key, F.aggregate("times", start, step).alias("s")).select(key, "s.failures", "s.last")
    full, cool = F.col("failures") >= most, millis(as_of) - F.col("last") >= pause
    return out.select(key, F.when(full & cool, 0).otherwise(F.col("failures")).cast("long").alias("failures"), (full & ~cool).alias("skip"))


def health(fetches: DataFrame, key: str, items: Column, millis_taken: Column, error: Column) -> DataFrame:
    """One row: totals, share of successes, means over the successful, empty and slow ones."""
    ok = error.isNull()
    return fetches.agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("ok"),
        (F.count_if(ok) * 100.0 / F.count("*")).alias("ok_percent"),
        F.avg(F.when(ok, items)).alias("mean_items"),
        F.avg(F.when(ok, millis_taken)).alias("mean_ms"),
        F.count_if(ok & (items == 0)).alias("empty"),
        F.count_if(millis_taken > 5000).alias("slow"),
    )


def slow(fetches: DataFrame, millis_taken: Column, error: Column, most: int = 5000) -> DataFrame:
    """The successful fetches that took longer, with `place`: the slowest first."""
    return fetches.where(error.isNull() & (millis_taken > most)).withColumn("place", F.dense_rank().over(Window.orderBy(F.desc(millis_taken))).cast("long"))


def empty(fetches: DataFrame, items: Column, error: Column) -> DataFrame:
    """The successful fetches without items."""
    return fetches.where(error.isNull() & (items == 0))


def error_class(message: Column) -> Column:
    low = F.lower(message)
    out = F.when(message.isNull(), None)
    for part, name in (("timeout", "timeout"), ("404", "not found"), ("403", "forbidden"), ("enotfound", "dns"), ("parse", "parse")):
        out = out.when(F.contains(low, F.lit(part)), name)
    return out.otherwise("other")


def refresh_status(rows: DataFrame, status: Column, age_minutes: Column) -> DataFrame:
    """rows with state (idle, refreshing or error), progress and stale (older than six hours)."""
    state = F.when(status.isNull(), "idle").when(status == "error", "error").when(status == "complete", "idle").otherwise("refreshing")
    return rows.withColumns({"state": state, "stale": F.coalesce(age_minutes > 360, F.lit(True))})


def progress(done: Column, total: Column) -> Column:
    """The part of the work that summaries take: from 50 to 90."""
    return F.when(total > 0, 50 + F.floor(done / total * 40)).otherwise(50).cast("long")
