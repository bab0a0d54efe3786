"""Streaming face of the pacing machine, and event-time windows. An extension: the batch folds are the rule."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.pacing import Pacing

STATE = "k int, streak int, delay double, until double, last_block double, switched double, blocks int"
OUT = "exit string, k int, streak int, delay double, until double, blocks int"


def pace_stream(events: DataFrame, p: Pacing = Pacing()) -> DataFrame:
    """events(exit, ts, seq, event, retry_after, started_at) -> the state of each exit after each batch."""
    base, low, high = max(0.0, p.base), p.base if p.base > 0 else 0.25, max(p.base, p.most_delay)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        k, streak, delay, until, last, switched, blocks = state.get if state.exists else (0, 0, base, 0.0, -1e18, -2e18, 0)
        for e in pd.concat(list(frames)).sort_values(["ts", "seq"]).itertuples():
            if e.event == "switch":
                until, switched = e.ts + (max(0.0, e.retry_after) if pd.notna(e.retry_after) else 0.0), e.ts
                continue
            if e.event != "block":
                k, streak = 0, streak + 1
                if delay > base and streak >= p.recover_after:
                    streak, delay = 0, max(base, delay * p.recover_factor)
                continue
            if pd.notna(e.started_at) and e.started_at <= last and (until > e.ts or switched >= last):
                continue  # seen before by another request
            k, streak, blocks = k + 1, 0, blocks + 1
            known = pd.notna(e.retry_after) and e.retry_after > 0
            wait = e.retry_after + p.margin if known else min(p.most_cooldown, p.initial * p.multiplier ** (k - 1)) * (1 + p.jitter)
            until, last, delay = max(until, e.ts + wait), e.ts, min(high, max(delay, low) * p.slower)
        state.update((k, streak, delay, until, last, switched, blocks))
        yield pd.DataFrame([(key[0], k, streak, delay, until, blocks)], columns=["exit", "k", "streak", "delay", "until", "blocks"])

    return events.groupBy("exit").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def window_counts(events: DataFrame, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling windows; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
