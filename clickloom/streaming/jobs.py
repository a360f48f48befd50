"""Structured Streaming twins of the flow operators, on event time."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clickloom.operators.flow import bucket_step


def click_counts(log: DataFrame, late: str = "1 hour", every: str = "1 day") -> DataFrame:
    """(window, key, media_id, n_trac, n_hop): click attribution by event-time windows. log: (key, kind, ts, media_id)."""
    of = lambda kind: F.col("kind") == kind
    rows = log.withWatermark("ts", late).groupBy(F.window("ts", every), "key")
    out = rows.agg(F.max_by(F.when(of("CLICK"), F.col("media_id")), F.when(of("CLICK"), F.col("ts"))).alias("media_id"), F.count_if(of("TRAC")).alias("n_trac"), F.count_if(of("HOP")).alias("n_hop"), F.count_if(of("CLICK")).alias("n_click"))
    return out.filter("n_click > 0").drop("n_click")


def metrics(points: DataFrame, late: str = "10 minutes", every: str = "1 minute") -> DataFrame:
    """(window, name, n, total, last_value, members): counters, timers and gauges of (ts, name, value); members estimates a set's size."""
    return points.withWatermark("ts", late).groupBy(F.window("ts", every), "name").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max_by("value", "ts").alias("last_value"), F.approx_count_distinct("value").alias("members"))


def token_bucket(events: DataFrame, key: str, ts: str, rate: float, per: float, late: str = "1 hour") -> DataFrame:
    """Events that pass a token bucket for each key; its level and last time are the state. Within a micro-batch a key's events are put in time order.

    State goes when the watermark is `per` seconds past the
    last event: the bucket is full by then, as that of a new key is.
    """
    schema = events.schema

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        level, last = state.get if state.exists else (rate, None)
        rows = pd.concat(list(frames)).sort_values(ts)
        passed = []
        for now in rows[ts].astype("datetime64[us]").astype("int64") / 1e6:
            level, ok = bucket_step(level, last, now, rate, per)
            last = now if last is None else max(now, last)
            passed.append(ok)
        state.update((float(level), float(last)))
        state.setTimeoutTimestamp(max(int((last + per) * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows.loc[passed, schema.names]

    # watermarks want a time with a zone; what passes is as it came
    rows = events.withColumn("_event_time", F.col(ts).cast("timestamp")).withWatermark("_event_time", late).groupBy(key)
    return rows.applyInPandasWithState(run, schema, "level double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def reloaded(load: Callable[[], DataFrame], use: Callable[[DataFrame, DataFrame], None], max_age: float = 10.0) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands use() each micro-batch and a side table, which is loaded anew when it is older than max_age seconds."""
    held: dict[str, object] = {"at": -math.inf, "table": None}

    def run(batch: DataFrame, _: int) -> None:
        if time.monotonic() - held["at"] > max_age:
            held["table"], held["at"] = load(), time.monotonic()
        use(batch, held["table"])

    return run


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(session, key, n): events of a key with no longer gap than this between them."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("session"), key).agg(F.count("*").alias("n"))
