"""Exits on a stream: the machine of ``limiter.exit_states`` with a timer for the end of each block. An extension: the
batch operator is the rule, and its last states can be what the stream starts from.

State and timers lie in Spark's state store, so they survive a lost executor and a restart from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.pacing import DEAD_AFTER, QUARANTINE, STRIKE_AFTER

STATE = "fails int, strikes int, until double, dead boolean"
OUT = "exit string, kind string, at double, fails int, strikes int, until double, dead boolean"
#: The state store that timers need; a session sets it before its first stateful stream.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Exits(StatefulProcessor):
    """A row of kind state for each batch that has events of an exit, one of kind free when a block ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("exit", STATE)

    def _now(self) -> tuple[int, int, float, bool]:
        return self.state.get() if self.state.exists() else (0, 0, 0.0, False)

    def _keep(self, before: float, new: tuple[int, int, float, bool]) -> None:
        """Store the state; an exit has one timer, at the end of its block."""
        self.state.update(new)
        if new[2] != before and not new[3]:
            self.handle.registerTimer(int(new[2] * 1000))
        if before and (new[2] != before or new[3]):
            self.handle.deleteTimer(int(before * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fails, strikes, until, dead = self._now()
        before, at = until, 0.0
        for e in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples():
            at = e.ts
            if dead:
                continue
            if e.kind == "ok":
                fails = strikes = 0
            elif e.kind == "blocked":
                until = max(until, e.ts + (max(0.0, e.seconds) if pd.notna(e.seconds) else 0.0))
            elif fails + 1 < STRIKE_AFTER:
                fails += 1
            else:
                fails, strikes = 0, strikes + 1
                dead = strikes >= DEAD_AFTER
                until = until if dead else max(until, e.ts + QUARANTINE * 2 ** (strikes - 1))
        self._keep(before, (fails, strikes, until, dead))
        yield pd.DataFrame([(key[0], "state", at, fails, strikes, until, dead)], columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fails, strikes, until, dead = self._now()
        yield pd.DataFrame([(key[0], "free", expiredTimerInfo.getExpiryTimeInMs() / 1000, fails, strikes, until, dead)], columns=[c.split()[0] for c in OUT.split(", ")])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self._keep(0.0, (int(r["fails"]), int(r["strikes"]), float(r["until"]), bool(r["dead"])))

    def close(self) -> None:
        pass


def exit_stream(events: DataFrame, initial: DataFrame | None = None, late: str = "0 seconds") -> DataFrame:
    """events(exit, ts, seq, kind ok|failed|blocked, seconds) -> OUT; ts in seconds, whole milliseconds.

    Events of an exit have to come in order, but for those of one batch; rows later than the watermark are left out.
    A block ends once the watermark has passed its end; what extends it before moves its timer. initial: (exit, fails,
    strikes, until, dead), a row an exit, the state to start from; its blocks have timers too.
    """
    timed = events.withColumn("at", F.timestamp_millis((F.col("ts") * 1000).cast("long"))).withWatermark("at", late)
    start = None if initial is None else initial.groupBy("exit")
    return timed.groupBy("exit").transformWithStateInPandas(Exits(), OUT, "Update", "EventTime", initialState=start)


def last_states(states: DataFrame) -> DataFrame:
    """The last of ``limiter.exit_states`` (keyed by exit) of each exit, as ``exit_stream`` starts from it."""
    last = F.max_by(F.struct("fails", "strikes", F.col("blocked_until").alias("until"), "dead"), F.struct("ts", "seq"))
    return states.groupBy("exit").agg(last.alias("s")).select("exit", "s.*")
