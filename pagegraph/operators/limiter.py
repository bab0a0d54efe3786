"""The rate limit of a whole run over its exits: one cooldown for all, a rhythm for each exit; and the state of the
exits as of each request.

``limiter`` is a fold whose state holds shared fields (cooldown, last block, override, totals) beside a map from exits
that are not in use to their rhythm, so a log in which the exits take turns is one sequence, as it was.

``exit_states`` are running counts and maxima, so Spark's windows give every state, not just the last, as an
interval of validity. ``exits_as_of`` joins requests to those intervals in which an exit is blocked, by bins of time: a
request meets the blocked exits alone, and the one to use follows from them and the number of exits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pacing import DEAD_AFTER, QUARANTINE, STRIKE_AFTER, Pacing, fold

RHYTHM = "struct<delay:double,k:int,streak:int>"
BIN = 600.0


def _step(p: Pacing):
    base, low, high = max(0.0, p.base), p.base if p.base > 0 else 0.25, max(p.base, p.most_delay)

    def step(s: Column, e: Column) -> Column:
        kind = {k: e["event"] == k for k in ("ok", "block", "switch", "cooldown")}
        now, to = e["ts"].cast("double"), F.coalesce(e["exit"], F.lit(""))
        handled = (s["until"] > now) | (s["overridden"] >= s["last_block"])
        late = F.coalesce(kind["block"] & (e["started_at"] <= s["last_block"]) & handled, F.lit(False))
        fresh, moves = kind["block"] & ~late, kind["switch"] & (to != s["exit"])
        k = F.when(fresh, s["k"] + 1).when(kind["ok"], 0).otherwise(s["k"])
        guess = F.least(F.lit(p.most_cooldown), p.initial * F.pow(F.lit(p.multiplier), (k - 1).cast("double"))) * (1 + p.jitter)
        cool = F.when(F.coalesce(e["retry_after"] > 0, F.lit(False)), e["retry_after"] + p.margin).otherwise(guess)
        streak = F.when(fresh, 0).when(kind["ok"], s["streak"] + 1).otherwise(s["streak"])
        eased = kind["ok"] & (s["delay"] > base) & (streak >= p.recover_after)
        delay = F.when(fresh, F.least(F.lit(high), F.greatest(s["delay"], F.lit(low)) * p.slower)).when(eased, F.greatest(F.lit(base), s["delay"] * p.recover_factor)).otherwise(s["delay"])
        streak = F.when(eased, 0).otherwise(streak)
        saved = F.try_element_at(s["rhythm"], to)
        own = F.struct(delay.cast("double").alias("delay"), k.cast("int").alias("k"), streak.cast("int").alias("streak"))
        others = F.map_filter(s["rhythm"], lambda x, _: (x != s["exit"]) & (x != to))
        after = F.when(moves, F.coalesce(saved, F.struct(F.lit(base).cast("double").alias("delay"), F.lit(0).alias("k"), F.lit(0).alias("streak")))).otherwise(own)
        return F.struct(
            F.when(moves, to).otherwise(s["exit"]).alias("exit"),
            after["delay"].alias("delay"),
            after["k"].alias("k"),
            after["streak"].alias("streak"),
            F.when(moves, F.map_concat(others, F.create_map(s["exit"], own))).otherwise(s["rhythm"]).alias("rhythm"),
            F.when(fresh, F.greatest(s["until"], now + cool)).when(kind["cooldown"], now + F.greatest(F.lit(0.0), F.coalesce(e["retry_after"], F.lit(0.0)))).otherwise(s["until"]).cast("double").alias("until"),
            F.when(fresh, now).otherwise(s["last_block"]).cast("double").alias("last_block"),
            F.when(kind["cooldown"], now).otherwise(s["overridden"]).cast("double").alias("overridden"),
            (s["blocks"] + fresh.cast("int")).cast("int").alias("blocks"),
            F.greatest(s["longest"], F.when(fresh, cool).when(kind["cooldown"], F.coalesce(e["retry_after"], F.lit(0.0))).otherwise(0.0)).cast("double").alias("longest"),
        )

    return step


def limiter(events: DataFrame, key: str = "run", p: Pacing = Pacing(), slices: int = 1) -> DataFrame:
    """events(key, ts, seq, event, exit, retry_after, started_at) -> the last state of each run.

    ok and block count for the exit in use. A block whose request had started before the last block does not count again
    while the cooldown runs, nor once it was overridden after that block: that request still left by the old exit.
    switch puts the rhythm (delay, blocks and successes in a row) of the exit in use aside and takes up that of
    ``exit``, which begins anew if it has none; the direct exit is null. cooldown puts ``retry_after`` seconds, none if
    null, in place of what is left of the cooldown. ``rhythms`` has the exits put aside; ``too_long`` says that one
    wait went beyond the limit. Events of null time come first; a run without events gives no row.
    """
    d = lambda v: F.lit(v).cast("double").alias
    zero = F.struct(
        F.lit("").alias("exit"), d(max(0.0, p.base))("delay"), F.lit(0).alias("k"), F.lit(0).alias("streak"), F.create_map().cast(f"map<string,{RHYTHM}>").alias("rhythm"),
        d(0)("until"), d(-1e18)("last_block"), d(-2e18)("overridden"), F.lit(0).alias("blocks"), d(0)("longest"),
    )
    s = fold(events, key, ["ts", "seq"], ["event", "exit", "retry_after", "started_at"], zero, _step(p), slices)
    aside = F.array_sort(F.transform(F.map_entries("s.rhythm"), lambda x: F.struct(F.nullif(x["key"], F.lit("")).alias("exit"), x["value"].alias("rhythm"))))
    return s.select(key, F.nullif("s.exit", F.lit("")).alias("exit"), "s.k", "s.streak", "s.delay", "s.until", "s.blocks", (F.col("s.longest") > p.max_wait).alias("too_long"), aside.alias("rhythms"))


def exit_states(events: DataFrame, keys: list[str], direct: Column | None = None) -> DataFrame:
    """events(*keys, ts, seq, kind ok|failed|blocked, seconds) -> (*keys, ts, seq, next_ts, next_seq, fails, strikes,
    blocked_until, dead): the state after each event, which holds until the next one of the exit, if any.

    Three failures in a row make a strike, which blocks the exit for a quarantine that doubles each time; the third
    strike without a success in between drops it for good. blocked puts it off for ``seconds``. A success ends the row
    of failures and strikes, not a block that runs. direct: which exits are never struck. Nothing counts after an exit is
    dropped.
    """
    if direct is not None:
        events = events.where(~((F.col("kind") == "failed") & direct))
    order = Window.partitionBy(*keys).orderBy("ts", "seq")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = events.withColumn("pg_run", F.sum((F.col("kind") == "ok").cast("int")).over(upto))
    failed = (F.col("kind") == "failed").cast("int")
    e = e.withColumn("pg_n", F.sum(failed).over(Window.partitionBy(*keys, "pg_run").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    struck = (F.col("kind") == "failed") & (F.col("pg_n") % STRIKE_AFTER == 0)
    e = e.withColumn("pg_strikes", F.floor(F.col("pg_n") / STRIKE_AFTER)).withColumn("pg_over", F.max((F.col("pg_strikes") >= DEAD_AFTER).cast("int")).over(upto))
    e = e.withColumn("pg_was", F.coalesce(F.max("pg_over").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("pg_was = 0")
    quarantine = F.when(struck & (F.col("pg_strikes") < DEAD_AFTER), QUARANTINE * F.pow(F.lit(2.0), (F.col("pg_strikes") - 1).cast("double")))
    blocked = F.when(F.col("kind") == "blocked", F.greatest(F.lit(0.0), F.coalesce("seconds", F.lit(0.0))))
    until = F.max(F.col("ts") + F.coalesce(quarantine, blocked)).over(upto)
    return e.select(
        *keys, "ts", "seq", F.lead("ts").over(order).alias("next_ts"), F.lead("seq").over(order).alias("next_seq"), (F.col("pg_n") % STRIKE_AFTER).cast("int").alias("fails"),
        F.col("pg_strikes").cast("int").alias("strikes"), F.coalesce(until, F.lit(0.0)).alias("blocked_until"), (F.col("pg_over") == 1).alias("dead"),
    )


def exits_as_of(requests: DataFrame, states: DataFrame, run: str, exits: int, width: float = BIN) -> DataFrame:
    """requests(run, id, ts, seq, pos), states of exits (run, pos) -> (run, id, quarantined, exit, wait).

    quarantined: positions of the exits that are blocked or dropped when the request is made, in order; exit: the one
    that is free first, the next in circular order after the request's own ``pos`` on ties, null if all are dropped;
    wait: the seconds until it is free. There are ``exits`` positions, from 0. A state holds from its event on, so not
    for requests before it, nor for the one that caused it. width: seconds of a bin of time, which changes no result.
    """
    bin_ = lambda t: F.floor(F.col(t) / width)
    last = requests.groupBy(F.col(run).alias("of")).agg(F.max("ts").alias("end"))
    spans = states.where("dead or blocked_until > ts").join(last, F.col(run) == F.col("of"))
    end = F.least(F.coalesce("next_ts", "end"), F.when(F.col("dead"), F.col("end")).otherwise(F.col("blocked_until")))
    spans = spans.withColumn("stop", end).where(F.col("stop") >= F.col("ts"))
    spans = spans.select(F.col(run).alias("of"), F.col("pos").alias("at"), F.struct("ts", "seq").alias("low"), F.struct("next_ts", "next_seq").alias("high"), "blocked_until", "dead", F.explode(F.sequence(bin_("ts"), bin_("stop"))).alias("b"))
    asked = requests.withColumn("b2", bin_("ts"))
    now = F.struct("ts", "seq")
    holds = (F.col("low") < now) & (F.col("high.next_ts").isNull() | (now <= F.col("high"))) & (F.col("dead") | (F.col("blocked_until") > F.col("ts")))
    met = asked.join(spans, (F.col(run) == F.col("of")) & (F.col("b2") == F.col("b")) & holds)
    wait = F.when(~F.col("dead"), F.col("blocked_until") - F.col("ts"))
    met = met.groupBy(F.col(run).alias("of"), F.col("id").alias("id2")).agg(F.array_sort(F.collect_list(F.struct(F.col("at"), wait.alias("wait"), F.col("dead")))).alias("busy"))
    out = requests.join(met, (F.col(run) == F.col("of")) & (F.col("id") == F.col("id2")), "left")
    busy = F.coalesce("busy", F.array().cast("array<struct<at:int,wait:double,dead:boolean>>"))
    every = F.transform(F.sequence(F.lit(1), F.lit(exits)), lambda k: F.struct(F.pmod(F.col("pos") + k, F.lit(exits)).cast("int").alias("at"), k.alias("k")))
    taken = F.transform(busy, lambda x: x["at"])
    free = F.transform(F.filter(every, lambda x: ~F.array_contains(taken, x["at"])), lambda x: F.struct(F.lit(0.0).alias("wait"), x["k"].alias("k"), x["at"].alias("at")))
    later = F.transform(F.filter(busy, lambda x: ~x["dead"]), lambda x: F.struct(x["wait"].alias("wait"), F.when(x["at"] == F.col("pos"), exits).otherwise(F.pmod(x["at"] - F.col("pos"), F.lit(exits))).cast("int").alias("k"), x["at"].alias("at")))
    best = F.array_min(F.concat(free, later))
    return out.select(run, "id", taken.alias("quarantined"), best["at"].alias("exit"), best["wait"].alias("wait"))
