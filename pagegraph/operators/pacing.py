"""Pacing, exit and retry machines as folds over the ordered events of one key.

A fold needs its key's events in order, so it is parallel over keys, and goes through a long log in slices of time.
Streak counts are running sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .ordinal import global_ordinal


@dataclass(frozen=True)
class Pacing:
    """The defaults of the rate limit."""

    base: float = 2.0
    initial: float = 30.0
    most_cooldown: float = 900.0
    multiplier: float = 2.0
    slower: float = 2.0
    most_delay: float = 20.0
    recover_after: int = 12
    recover_factor: float = 0.8
    margin: float = 2.0
    max_wait: float = 7200.0
    jitter: float = 0.0


def ordered_events(events: DataFrame, key: str, order: list[str], *cols: str) -> DataFrame:
    """(key, events: array of struct(order..., cols...)) in order."""
    return events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *cols))).alias("events"))


def fold(events: DataFrame, key: str, order: list[str], cols: list[str], zero: Column, step, slices: int = 1) -> DataFrame:
    """(key, s): the state of each key after its events in order.

    A task holds the events of a key. For keys with more than that, ``slices`` cuts the log at quantiles of the first
    order column: the states of one slice, a staged table, are where the next one goes on, so that a task holds a key's
    events of one slice, however long the log is.
    """
    if slices == 1:
        return ordered_events(events, key, order, *cols).select(key, F.aggregate("events", zero, step).alias("s"))
    at = events.agg(F.percentile_approx(order[0], [k / slices for k in range(1, slices)])).first()[0]
    bounds, state = sorted(set(at or [])), None
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = events if low is None else events.where(F.col(order[0]) > low)
        part = part if high is None else part.where(F.col(order[0]) <= high)
        e = ordered_events(part, key, order, *cols)
        if state is None:
            new = e.select(key, F.aggregate("events", zero, step).alias("s"))
        else:
            old = state.select(F.col(key).alias("__key"), "s", F.lit(True).alias("__old"))
            both = e.join(old, F.col(key).eqNullSafe(F.col("__key")), "full")
            after = F.when(F.col("events").isNull(), F.col("s")).otherwise(F.aggregate("events", F.coalesce("s", zero), step))
            new = both.select(F.when(F.col("events").isNull(), F.col("__key")).otherwise(F.col(key)).alias(key), after.alias("s"))
        state = stage(new, "fold")
    return state


def _pace_step(p: Pacing):
    base, low, high = max(0.0, p.base), p.base if p.base > 0 else 0.25, max(p.base, p.most_delay)

    def step(s: Column, e: Column) -> Column:
        block = e["event"] == "block"
        switch = e["event"] == "switch"
        late = block & e["started_at"].isNotNull() & (e["started_at"] <= s["last_block"]) & ((s["until"] > e["ts"]) | (s["switched"] >= s["last_block"]))
        fresh = block & ~F.coalesce(late, F.lit(False))
        k = F.when(fresh, s["k"] + 1).when(block | switch, s["k"]).otherwise(0)
        guess = F.least(F.lit(p.most_cooldown), p.initial * F.pow(F.lit(p.multiplier), (k - 1).cast("double"))) * (1 + p.jitter)
        cool = F.when(F.coalesce(e["retry_after"] > 0, F.lit(False)), e["retry_after"] + p.margin).otherwise(guess)
        streak = F.when(fresh, 0).when(block | switch, s["streak"]).otherwise(s["streak"] + 1)
        eased = ~block & ~switch & (s["delay"] > base) & (streak >= p.recover_after)
        delay = F.when(fresh, F.least(F.lit(high), F.greatest(s["delay"], F.lit(low)) * p.slower)).when(eased, F.greatest(F.lit(base), s["delay"] * p.recover_factor)).otherwise(s["delay"])
        return F.struct(
            k.cast("int").alias("k"),
            F.when(eased, 0).otherwise(streak).cast("int").alias("streak"),
            delay.cast("double").alias("delay"),
            F.when(fresh, F.greatest(s["until"], e["ts"] + cool)).when(switch, e["ts"] + F.greatest(F.lit(0.0), F.coalesce(e["retry_after"], F.lit(0.0)))).otherwise(s["until"]).cast("double").alias("until"),
            F.when(switch, e["ts"]).otherwise(s["switched"]).cast("double").alias("switched"),
            F.when(fresh, e["ts"]).otherwise(s["last_block"]).cast("double").alias("last_block"),
            (s["blocks"] + F.when(fresh, 1).otherwise(0)).cast("int").alias("blocks"),
            F.greatest(s["longest"], F.when(fresh, cool).otherwise(0.0)).cast("double").alias("longest"),
        )

    return step


def pacing(events: DataFrame, key: str = "exit", p: Pacing = Pacing(), slices: int = 1) -> DataFrame:
    """events(key, ts, seq, event ok|block|switch, retry_after, started_at) -> the final pacing state of each key.

    A block whose request had started before the last block does not count again while its cooldown runs, nor once the
    exit was switched after that block, which puts the new exit's wait (retry_after, or none) in place of the cooldown.
    ``too_long`` says that one wait went beyond the limit.
    """
    d = lambda v: F.lit(v).cast("double")
    zero = F.struct(F.lit(0).alias("k"), F.lit(0).alias("streak"), d(max(0.0, p.base)).alias("delay"), d(0).alias("until"), d(-2e18).alias("switched"), d(-1e18).alias("last_block"), F.lit(0).alias("blocks"), d(0).alias("longest"))
    s = fold(events, key, ["ts", "seq"], ["event", "retry_after", "started_at"], zero, _pace_step(p), slices)
    return s.select(key, "s.k", "s.streak", "s.delay", "s.until", "s.blocks", "s.longest", (F.col("s.longest") > p.max_wait).alias("too_long"))


def slots(requests: DataFrame, delay: float, key: str = "exit") -> DataFrame:
    """requests(key, seq, now, cooldown_until) -> the slot each request reserves:
    max(now, cooldown, last slot + delay)."""
    w = Window.partitionBy(key).orderBy("seq")
    nth = F.row_number().over(w)
    # the recurrence in closed form: the greatest of floor_j + (i - j) * delay over all j up to i
    floor = F.greatest("now", "cooldown_until").cast("double")
    slot = F.max(F.col("__floor") - F.col("__nth") * delay).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("__nth") * delay
    return requests.withColumns({"__nth": nth, "__floor": floor}).select(key, F.col("seq").cast("long").alias("seq"), slot.alias("slot"))


# Failures to a strike, first quarantine in seconds, strikes to being dropped.
STRIKE_AFTER, QUARANTINE, DEAD_AFTER = 3, 600.0, 3


def exit_quarantine(events: DataFrame, key: str = "exit", slices: int = 1) -> DataFrame:
    """events(key, ts, seq, failed): three failures in a row make a strike, whose quarantine doubles each
    time; the third strike drops the exit; a success clears failures and strikes. ``penalty`` is the last
    quarantine. The direct exit, of key null, is never quarantined."""
    counted = events.withColumn("failed", F.col("failed") & F.col(key).isNotNull())
    zero = F.struct(F.lit(0).alias("fails"), F.lit(0).alias("strikes"), F.lit(0.0).alias("penalty"), F.lit(False).alias("dead"))

    def step(s: Column, x: Column) -> Column:
        strike = x["failed"] & (s["fails"] + 1 >= STRIKE_AFTER)
        strikes = F.when(strike, s["strikes"] + 1).when(x["failed"], s["strikes"]).otherwise(0)
        dead = strikes >= DEAD_AFTER
        new = F.struct(
            F.when(strike | ~x["failed"], 0).otherwise(s["fails"] + 1).cast("int").alias("fails"),
            strikes.cast("int").alias("strikes"),
            F.when(strike & ~dead, QUARANTINE * F.pow(F.lit(2.0), (strikes - 1).cast("double"))).otherwise(s["penalty"]).alias("penalty"),
            dead.alias("dead"),
        )
        return F.when(s["dead"], s).otherwise(new)

    return fold(counted, key, ["ts", "seq"], ["failed"], zero, step, slices).select(key, "s.*")


def longest_streak(events: DataFrame, key: str, order: list[str], failed: Column, limit: int) -> DataFrame:
    """Longest run of failures of a key, and whether it reaches the limit: runs lie between successes."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = events.withColumn("__run", F.sum(F.when(failed, 0).otherwise(1)).over(w)).groupBy(key, "__run").agg(F.count_if(failed).alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("streak")).withColumn("tripped", F.col("streak") >= limit)


# Attempts of a page in a round, attempts after which a failure ends it, pause step and cap.
MAX_TRIES, FAILED_STOP, PAUSE_STEP, PAUSE_CAP = 4, 2, 4.0, 20.0


def retry_outcome(attempts: DataFrame, key: str = "url", most: int = MAX_TRIES, slices: int = 1) -> DataFrame:
    """attempts(key, ts, seq, outcome ok|blocked|transient|failed|timeout|permanent) -> how the page ended.

    Every attempt counts. A block, a transient error or the first failure is followed by another attempt, the
    latter two after a pause that grows with the attempt; the last attempt, and a failure from the second on,
    ends the page; a timeout puts it off to a later round. What comes after the end is not used.
    """
    zero = F.struct(F.lit("pending").alias("state"), F.lit(0).alias("tries"), F.lit(0.0).alias("paused"))

    def step(s: Column, x: Column) -> Column:
        o, n = x["outcome"], s["tries"] + 1
        over = (n >= most) | ((o == "failed") & (n >= FAILED_STOP))
        state = F.when(o == "ok", "done").when(o == "permanent", "failed").when(o == "timeout", "later").when(over, "failed").otherwise("pending")
        pause = s["paused"] + F.when(o.isin("transient", "failed") & ~over, F.least(F.lit(PAUSE_CAP), PAUSE_STEP * n)).otherwise(0.0)
        return F.when(s["state"] != "pending", s).otherwise(F.struct(state.alias("state"), n.cast("int").alias("tries"), pause.cast("double").alias("paused")))

    return fold(attempts, key, ["ts", "seq"], ["outcome"], zero, step, slices).select(key, "s.*")


# Attempts in the first round and in the later ones, the attempt from which resources are forgiven.
ROUNDS, LENIENT_FROM = (MAX_TRIES, 2, 2), 3


def retry_rounds(attempts: DataFrame, key: str = "url", rounds: tuple[int, ...] = ROUNDS, slices: int = 1) -> DataFrame:
    """attempts(key, ts, seq, outcome, at_exit) -> how the page ended after all rounds.

    A round ends as ``retry_outcome`` says, but that a timeout at an exit, which counts against the exit, is followed by
    another attempt; what failed in a round, other than for good, comes again in the next. ``state`` is open (more
    attempts are due), done, permanent or failed; ``lenient`` says whether the last attempt forgave resources.
    """
    zero = F.struct(F.lit("open").alias("state"), F.lit(1).alias("round"), F.lit(0).alias("tries"), F.lit(0).alias("attempts"), F.lit(0.0).alias("paused"), F.lit(False).alias("lenient"))
    most = lambda s: F.element_at(F.array(*map(F.lit, rounds)), s["round"])

    def step(s: Column, x: Column) -> Column:
        o, n = x["outcome"], s["tries"] + 1
        last = n >= most(s)
        again = ~last & ((o == "blocked") | (o == "transient") | ((o == "failed") & (n < FAILED_STOP)) | ((o == "timeout") & F.coalesce(x["at_exit"], F.lit(False))))
        ends, final = ~again & ~o.isin("ok", "permanent"), s["round"] >= len(rounds)
        state = F.when(o == "ok", "done").when(o == "permanent", "permanent").when(ends & final, "failed").otherwise("open")
        pause = s["paused"] + F.when(o.isin("transient", "failed") & again, F.least(F.lit(PAUSE_CAP), PAUSE_STEP * n)).otherwise(0.0)
        next_ = ends & ~final
        new = F.struct(
            state.alias("state"), (s["round"] + F.when(next_, 1).otherwise(0)).cast("int").alias("round"), F.when(next_, 0).otherwise(n).cast("int").alias("tries"),
            (s["attempts"] + 1).cast("int").alias("attempts"), pause.cast("double").alias("paused"), ((n >= LENIENT_FROM) | last).alias("lenient"),
        )
        return F.when(s["state"] != "open", s).otherwise(new)

    return fold(attempts, key, ["ts", "seq"], ["outcome", "at_exit"], zero, step, slices).select(key, "s.*")


def request_bans(requests: DataFrame, key: str, seconds: float, limit: int, ban: float, grace: float, slices: int = 1) -> DataFrame:
    """requests(key, t, seq, counted) -> (key, bans, pokes, late_pokes): more than ``limit`` counted requests within
    ``seconds`` ban the key for ``ban`` seconds and start its window anew; requests during a ban are pokes, late ones
    if it has lasted more than ``grace``."""
    d = lambda v: F.lit(v).cast("double")
    zero = F.struct(d(-1e18).alias("until"), d(-1e18).alias("since"), F.array().cast("array<double>").alias("recent"), F.lit(0).alias("bans"), F.lit(0).alias("pokes"), F.lit(0).alias("late"))

    def step(s: Column, x: Column) -> Column:
        t = x["t"].cast("double")
        banned = s["until"] > t
        # at most limit + 1 requests are kept, and those of the last window alone
        recent = F.array_append(F.filter(s["recent"], lambda r: r >= t - seconds), t)
        over = ~banned & x["counted"] & (F.size(recent) > limit)
        return F.struct(
            F.when(over, t + ban).otherwise(s["until"]).alias("until"), F.when(over, t).otherwise(s["since"]).alias("since"),
            F.when(over, F.array().cast("array<double>")).when(banned | ~x["counted"], s["recent"]).otherwise(recent).alias("recent"),
            (s["bans"] + F.when(over, 1).otherwise(0)).cast("int").alias("bans"), (s["pokes"] + F.when(banned, 1).otherwise(0)).cast("int").alias("pokes"),
            (s["late"] + F.when(banned & (t - s["since"] > grace), 1).otherwise(0)).cast("int").alias("late"),
        )

    return fold(requests, key, ["t", "seq"], ["counted"], zero, step, slices).select(key, "s.bans", "s.pokes", F.col("s.late").alias("late_pokes"))


def attempts_since_success(attempts: DataFrame, key: str, order: list[str], ok: Column) -> DataFrame:
    """Failed runs since the last success; keys whose last run succeeded are gone."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return attempts.withColumn("__ok", F.sum(F.when(ok, 1).otherwise(0)).over(w)).where("__ok = 0").groupBy(key).agg(F.count("*").alias("attempts"))


def rank_probes(probes: DataFrame, unique_ip: bool = True) -> DataFrame:
    """Working exits, tested ones first, then by seconds; one per known ip."""
    order = [F.col("tested").cast("int").desc(), F.col("seconds"), F.col("ord")]
    ok = probes.where("ok")
    if unique_ip:
        nth = F.row_number().over(Window.partitionBy("ip").orderBy(*order))
        named = ok.where("ip <> ''").withColumn("__n", nth).where("__n = 1").drop("__n")
        ok = named.unionByName(ok.where("ip = ''"))
    return ok.orderBy(*order)


def earliest_exit(exits: DataFrame, current: int, n: int) -> DataFrame:
    """exits(pos, wait [, dead]): the live one with the least wait, the next in circular order after ``current``
    on ties; no row if none is left."""
    if "dead" in exits.columns:
        exits = exits.where("not dead")
    offset = F.pmod(F.col("pos") - current - 1, F.lit(n))
    return exits.agg(F.min_by(F.struct("pos", "wait"), F.struct("wait", offset)).alias("e")).where("e is not null").select("e.*")


def round_robin(exits: DataFrame, current: int, n: int, groups: int) -> DataFrame:
    """Live exits(pos, dead) dealt to groups in turn, from ``current`` on."""
    offset = F.pmod(F.col("pos") - current, F.lit(n))
    turn = global_ordinal(exits.where("not dead").select("pos", offset.alias("__at")), [F.col("__at")], "__k")
    return turn.select("pos", ((F.col("__k") - 1) % groups).cast("int").alias("group"))


def workers_by_cooldown(workers: DataFrame, items: int) -> DataFrame:
    return workers.orderBy("cooldown", "worker").limit(items)


def request_window(requests: DataFrame, key: str, seconds: int, limit: int) -> DataFrame:
    """Requests with the count of the key's requests in the window up to each, and whether it is over."""
    w = Window.partitionBy(key).orderBy("t").rangeBetween(-seconds, 0)
    return requests.withColumn("in_window", F.count("*").over(w)).withColumn("over_limit", F.col("in_window") > limit)


def node_retries(events: DataFrame, key: str = "node", slices: int = 1) -> DataFrame:
    """events(key, ts, seq, kind ok|block|error|timeout): 8 blocks stop, 4 errors leave the node pending,
    2 timeouts give it up; a success ends it."""
    zero = F.struct(F.lit("open").alias("state"), F.lit(0).alias("blocks"), F.lit(0).alias("errors"), F.lit(0).alias("timeouts"))

    def step(s: Column, x: Column) -> Column:
        n = {k: s[k + "s"] + F.when(x["kind"] == k, 1).otherwise(0) for k in ("block", "error", "timeout")}
        state = F.when(x["kind"] == "ok", "done").when(n["block"] >= 8, "stop").when(n["error"] >= 4, "pending").when(n["timeout"] >= 2, "gave up").otherwise("open")
        return F.when(s["state"] != "open", s).otherwise(F.struct(state.alias("state"), *(v.cast("int").alias(k + "s") for k, v in n.items())))

    return fold(events, key, ["ts", "seq"], ["kind"], zero, step, slices).select(key, "s.*")
