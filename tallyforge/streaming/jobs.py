"""Jobs as streams: repeated ids, stopping after a limit, and a limiter with windows from first use."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_of_each(jobs: DataFrame, job_id: str, time: str, late: str | None = None) -> DataFrame:
    """Jobs whose id was not met before. In a stream ids are remembered for good, or with ``late`` for that long;
    in a batch the earliest row of an id stays, of equals that with the smallest event_id."""
    if jobs.isStreaming:
        return jobs.withWatermark(time, late).dropDuplicatesWithinWatermark([job_id]) if late else jobs.dropDuplicates([job_id])
    rest = [c for c in jobs.columns if c != job_id]
    best = jobs.groupBy(job_id).agg(F.min_by(F.struct(*rest), F.struct(time, "event_id")).alias("first"))
    return best.select(job_id, "first.*").select(*jobs.columns)


def after_limit(steps: DataFrame, group: str, order: str, limited: str) -> DataFrame:
    """Adds ``skipped``: whether an earlier step of the group hit the limit.

    All that matters of a group is its first such step, so one aggregated row a group is joined back.
    """
    first = steps.where(F.col(limited)).groupBy(F.col(group).alias("hit_group")).agg(F.min(order).alias("first_hit"))
    joined = steps.join(first, F.col(group).eqNullSafe(F.col("hit_group")), "left")
    return joined.withColumn("skipped", F.coalesce(F.col(order) > F.col("first_hit"), F.lit(False))).drop("hit_group", "first_hit")


def per_minute(events: DataFrame, key: str, time: str, most: int) -> DataFrame:
    """(key, minute, n, over): requests in each minute of the clock, and how many were over ``most``."""
    counted = events.groupBy(key, F.date_trunc("minute", time).alias("minute")).agg(F.count("*").alias("n"))
    return counted.withColumn("over", F.greatest(F.lit(0).cast("long"), F.col("n") - most))


LIMITER_SCHEMA = "key string, event_id long, ts timestamp_ntz, allowed boolean, used int, window_start timestamp_ntz"


def _admit(key: str, rows: pd.DataFrame, start: pd.Timestamp | None, used: int, most: int, length: pd.Timedelta) -> tuple[pd.DataFrame, pd.Timestamp | None, int]:
    """Requests in order of time against the window that is open; a request past its end opens the next."""
    rows = rows.sort_values(["ts", "event_id"])
    out = []
    for event, ts in zip(rows["event_id"], rows["ts"]):
        if start is None or ts - start >= length:
            start, used = ts, 0
        allowed = used < most
        used += allowed
        out.append((key, event, ts, allowed, used, start))
    return pd.DataFrame(out, columns=["key", "event_id", "ts", "allowed", "used", "window_start"]), start, used


def limited_batch(events: DataFrame, key: str, most: int, length: str) -> DataFrame:
    """Each request with whether a limiter of ``most`` a window lets it pass; a window begins with the
    first request after the one before has ended. Each key is one sequence by nature."""
    span = pd.Timedelta(length)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return _admit(str(group["key"].iloc[0]), group, None, 0, most, span)[0]

    rows = events.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return rows.groupBy("key").applyInPandas(run, LIMITER_SCHEMA)


def limited_stream(events: DataFrame, key: str, most: int, length: str) -> DataFrame:
    """The same on a stream; the open window of each key is kept as state."""
    span = pd.Timedelta(length)

    def run(key_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used = (pd.Timestamp(state.get[0]), state.get[1]) if state.exists else (None, 0)
        out, start, used = _admit(key_[0], pd.concat(list(batches)), start, used, most, span)
        if start is not None:
            state.update((start.isoformat(), used))
        yield out

    rows = events.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return rows.groupBy("key").applyInPandasWithState(run, LIMITER_SCHEMA, "start string, used int", "append", GroupStateTimeout.NoTimeout)


def reset_times(errors: DataFrame, kind: str = "RATE_LIMITED") -> DataFrame:
    """(upload_id, reset_at, n): the latest time an error of this kind names, from its JSON."""
    read = errors.select(
        "upload_id", F.get_json_object("metadata", "$.errorType").alias("type"),
        F.expr("try_cast(get_json_object(metadata, '$.resetTime') AS timestamp)").alias("at"),
    )
    return read.where((F.col("type") == kind) & F.col("at").isNotNull()).groupBy("upload_id").agg(F.max("at").alias("reset_at"), F.count("*").alias("n"))


def limiter_status(admitted: DataFrame, most: int, length: str, now: Column) -> DataFrame:
    """(key, remaining, reset_at, available) of each key at ``now``, from what the limiter has let through.

    A window that has ended is open anew: all is left, and it would end ``length`` from ``now``.
    """
    seconds = int(pd.Timedelta(length).total_seconds())
    last = admitted.groupBy("key").agg(F.max_by(F.struct("window_start", "used"), F.struct("ts", "event_id")).alias("w"))
    after = lambda c: c + F.expr(f"INTERVAL {seconds} SECONDS")
    over = after(F.col("w.window_start")) <= now
    remaining = F.when(over, F.lit(most)).otherwise(F.greatest(F.lit(0), most - F.col("w.used")))
    return last.select("key", remaining.alias("remaining"), F.when(over, after(now)).otherwise(after(F.col("w.window_start"))).alias("reset_at"), (remaining > 0).alias("available"))


def cause_depth(error: Column, kind: str = "RATE_LIMITED", most: int = 5) -> Column:
    """How many causes down a JSON error names this kind, 0 for itself, within ``most`` levels; else null."""
    out = F.lit(None).cast("int")
    for depth in reversed(range(most)):
        out = F.when(F.get_json_object(error, "$" + ".cause" * depth + ".errorType") == kind, depth).otherwise(out)
    return out
