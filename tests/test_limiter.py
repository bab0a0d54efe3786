from random import Random

from pagegraph.operators import limiter, pacing

EVENTS = "run string, ts double, seq long, event string, exit string, retry_after double, started_at double"


class Plain:
    """The rules event by event."""

    def __init__(self):
        self.exit, self.delay, self.k, self.streak, self.until, self.last, self.over, self.blocks, self.aside, self.longest = None, 2.0, 0, 0, 0.0, -1e18, -2e18, 0, {}, 0.0

    def take(self, ts, event, exit_, retry_after, started):
        if event == "ok":
            self.k, self.streak = 0, self.streak + 1
            if self.delay > 2.0 and self.streak >= 12:
                self.streak, self.delay = 0, max(2.0, self.delay * 0.8)
        elif event == "block":
            if started is not None and started <= self.last and (self.until > ts or self.over >= self.last):
                return
            self.k, self.streak, self.blocks = self.k + 1, 0, self.blocks + 1
            wait = retry_after + 2.0 if retry_after and retry_after > 0 else min(900.0, 30.0 * 2.0 ** (self.k - 1))
            self.until, self.last, self.delay, self.longest = max(self.until, ts + wait), ts, min(20.0, max(self.delay, 2.0) * 2.0), max(self.longest, wait)
        elif event == "switch":
            if exit_ != self.exit:
                self.aside[self.exit] = (self.delay, self.k, self.streak)
                self.delay, self.k, self.streak = self.aside.pop(exit_, (2.0, 0, 0))
                self.exit = exit_
        else:
            self.until, self.over = ts + max(0.0, retry_after or 0.0), ts
            self.longest = max(self.longest, retry_after or 0.0)


def log(seed, runs=6, n=250):
    r, out = Random(seed), []
    for run in range(runs):
        ts = 0.0
        for seq in range(n):
            ts += r.choice((0.0, 0.5, 3.0, 40.0))
            kind = r.choices(("ok", "block", "switch", "cooldown"), (12, 3, 2, 1))[0]
            started = r.choice((None, ts - r.choice((0.1, 5.0, 60.0))))
            out.append((f"r{run}", ts, seq, kind, r.choice((None, "a", "b", "c")), r.choice((None, None, 0.0, 7.0, 8000.0 if run == 0 else 20.0)), started))
    return out


def test_limiter_of_interleaved_exits(spark):
    rows = log(4)
    want = {}
    for run, ts, _, *rest in rows:
        want.setdefault(run, Plain()).take(ts, *rest)
    df = spark.createDataFrame(rows, EVENTS).repartition(5)
    for slices in (1, 4):
        got = {r["run"]: r for r in limiter.limiter(df, slices=slices).collect()}
        assert got.keys() == want.keys()
        for run, w in want.items():
            g = got[run]
            assert (g["exit"], g["k"], g["streak"], round(g["delay"], 9), round(g["until"], 6), g["blocks"], g["too_long"]) == (w.exit, w.k, w.streak, round(w.delay, 9), round(w.until, 6), w.blocks, w.longest > 7200)
            assert {x["exit"]: (round(x["rhythm"]["delay"], 9), x["rhythm"]["k"], x["rhythm"]["streak"]) for x in g["rhythms"]} == {k: (round(v[0], 9), *v[1:]) for k, v in w.aside.items()}


def test_a_late_report_after_an_override_does_not_count(spark):
    rows = [("r", 0.0, 0, "block", None, 100.0, None), ("r", 1.0, 1, "switch", "b", None, None), ("r", 1.0, 2, "cooldown", None, None, None), ("r", 2.0, 3, "block", None, None, -1.0), ("r", 3.0, 4, "block", None, None, 1.5)]
    df = spark.createDataFrame(rows, EVENTS)
    some = lambda n: limiter.limiter(df.where(f"seq < {n}")).first()
    assert (some(4)["until"], some(4)["blocks"], some(4)["k"], some(4)["exit"]) == (1.0, 1, 0, "b")
    assert (some(5)["until"], some(5)["blocks"], some(5)["k"]) == (33.0, 2, 1)


def plain_exits(events, requests, n):
    """For each request the states of all exits, event by event."""
    state = {}
    out = []
    for (ts, _), kind, what in sorted([((t, s), 0, (pos, k, sec)) for pos, t, s, k, sec in events] + [((t, s), 1, (i, pos)) for i, t, s, pos in requests], key=lambda x: (x[0], -x[1])):
        if kind == 0:
            pos, k, sec = what
            x = state.setdefault(pos, dict(fails=0, strikes=0, until=0.0, dead=False))
            if x["dead"]:
                continue
            if k == "ok":
                x["fails"] = x["strikes"] = 0
            elif k == "blocked":
                x["until"] = max(x["until"], ts + max(0.0, sec))
            else:
                x["fails"] += 1
                if x["fails"] == pacing.STRIKE_AFTER:
                    x["fails"], x["strikes"] = 0, x["strikes"] + 1
                    x["dead"] = x["strikes"] >= pacing.DEAD_AFTER
                    if not x["dead"]:
                        x["until"] = max(x["until"], ts + pacing.QUARANTINE * 2 ** (x["strikes"] - 1))
            continue
        i, pos = what
        busy = [p for p, x in sorted(state.items()) if x["dead"] or x["until"] > ts]
        waits = [(max(0.0, state[p]["until"] - ts) if p in state else 0.0, k, p) for k in range(1, n + 1) for p in [(pos + k) % n] if not (p in state and state[p]["dead"])]
        best = min(waits, default=(None, None, None))
        out.append((i, busy, best[2], best[0]))
    return sorted(out)


def test_exits_as_of_each_request(spark):
    r = Random(2)
    n, events, requests = 5, [], []
    for s in range(500):
        t = r.randrange(4000) * 1.0
        if r.random() < 0.6:
            events.append((r.randrange(n), t, s, r.choices(("failed", "ok", "blocked"), (9, 2, 2))[0], r.choice((0.0, 30.0, 900.0, 2500.0))))
        else:
            requests.append((s, t, s, r.randrange(n)))
    e = spark.createDataFrame([("r", *x) for x in events], "run string, pos int, ts double, seq long, kind string, seconds double")
    q = spark.createDataFrame([("r", *x) for x in requests] + [("other", 9999, 5.0, 1, 3)], "run string, id long, ts double, seq long, pos int")
    want = plain_exits(events, requests, n)
    assert any(x[2] is None for x in want) or any(x[3] for x in want)
    for width in (100.0, 600.0, 1e5):
        got = limiter.exits_as_of(q, limiter.exit_states(e, ["run", "pos"]), "run", n, width).collect()
        assert sorted((x["id"], x["quarantined"], x["exit"], x["wait"]) for x in got if x["run"] == "r") == want
        assert [(x["quarantined"], x["exit"], x["wait"]) for x in got if x["run"] == "other"] == [([], 4, 0.0)]


def test_the_direct_exit_is_never_struck(spark):
    e = spark.createDataFrame([("r", 0, float(i), i, "failed", None) for i in range(12)] + [("r", 1, float(i), i, "failed", None) for i in range(12)], "run string, pos int, ts double, seq long, kind string, seconds double")
    from pyspark.sql import functions as F

    got = limiter.exit_states(e, ["run", "pos"], direct=F.col("pos") == 0).collect()
    assert {r["pos"] for r in got} == {1} and sum(r["dead"] for r in got) == 1 and len(got) == 9
