"""Queries of the run-wide rate limit and of exits as of each request; added to the catalogue. 30 days of events are
read as seven hours, so that waits overlap with what follows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import limiter
from ..session import table
from .catalogue import query


def _timed(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    return table(spark, d, "events").withColumn("ts", us / 1e6 / 100.0).withColumn("seq", F.col("event_id"))


_AT = lambda i, new, old: f"list_transform([1, 2, 3], lambda i: CASE WHEN i = {i} THEN {new} ELSE {old}[i] END)"


@query(
    f"""WITH RECURSIVE e AS (
  SELECT user_id % 30 AS run, row_number() OVER (PARTITION BY user_id % 30 ORDER BY ts, event_id) AS n, epoch(ts) / 100.0::DOUBLE AS t, CAST(event_id % 3 + 1 AS INTEGER) AS x,
    CASE WHEN event_type = 'error' THEN 'block' WHEN event_type = 'signup' THEN 'switch' WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'cooldown' ELSE 'ok' END AS kind,
    CASE WHEN event_id % 97 = 0 THEN 9000.0::DOUBLE WHEN event_id % 4 = 0 THEN (event_id % 100)::DOUBLE END AS ra,
    CASE WHEN event_id % 2 = 0 THEN epoch(ts) / 100.0::DOUBLE - (event_id % 50 * 10)::DOUBLE END AS started
  FROM events),
s AS (
  SELECT run, CAST(0 AS BIGINT) AS n, 1 AS ex, [2.0, 2.0, 2.0]::DOUBLE[] AS d, [0, 0, 0]::INTEGER[] AS k, [0, 0, 0]::INTEGER[] AS st, [true, false, false] AS seen,
    0.0::DOUBLE AS til, -1e18::DOUBLE AS last, -2e18::DOUBLE AS over_, 0 AS blocks, 0.0::DOUBLE AS longest
  FROM (SELECT DISTINCT run FROM e)
  UNION ALL
  SELECT run, n, CASE WHEN kind = 'switch' THEN x ELSE ex END, {_AT("ex", "d1", "d")}, {_AT("ex", "k1", "k")}, {_AT("ex", "CASE WHEN eased THEN 0 ELSE st1 END", "st")},
    list_transform([1, 2, 3], lambda i: seen[i] OR (kind = 'switch' AND i = x)),
    CASE WHEN fresh THEN greatest(til, t + cool) WHEN kind = 'cooldown' THEN t + coalesce(ra, 0.0::DOUBLE) ELSE til END, CASE WHEN fresh THEN t ELSE last END, CASE WHEN kind = 'cooldown' THEN t ELSE over_ END,
    blocks + CASE WHEN fresh THEN 1 ELSE 0 END, greatest(longest, CASE WHEN fresh THEN cool WHEN kind = 'cooldown' THEN coalesce(ra, 0.0::DOUBLE) ELSE 0.0::DOUBLE END)
  FROM (
    SELECT *, CASE WHEN fresh THEN least(20.0::DOUBLE, greatest(d[ex], 2.0::DOUBLE) * 2.0::DOUBLE) WHEN eased THEN greatest(2.0::DOUBLE, d[ex] * 0.8::DOUBLE) ELSE d[ex] END AS d1,
      CASE WHEN ra > 0 THEN ra + 2.0::DOUBLE ELSE least(900.0::DOUBLE, 30.0::DOUBLE * pow(2.0::DOUBLE, k1 - 1)) END AS cool
    FROM (
      SELECT *, kind = 'ok' AND d[ex] > 2.0::DOUBLE AND st1 >= 12 AS eased
      FROM (
        SELECT *, CAST(CASE WHEN fresh THEN k[ex] + 1 WHEN kind = 'ok' THEN 0 ELSE k[ex] END AS INTEGER) AS k1, CAST(CASE WHEN fresh THEN 0 WHEN kind = 'ok' THEN st[ex] + 1 ELSE st[ex] END AS INTEGER) AS st1
        FROM (
          SELECT s.run, e.n, ex, d, k, st, seen, til, last, over_, blocks, longest, t, x, kind, ra,
            kind = 'block' AND NOT coalesce(started <= last AND (til > t OR over_ >= last), false) AS fresh
          FROM s JOIN e ON e.run = s.run AND e.n = s.n + 1))))
)
SELECT run, ['direct', 'a', 'b'][ex] AS exit, k[ex] AS k, st[ex] AS streak, round(d[ex], 6) AS delay, round(til, 3) AS til, blocks, longest > 7200 AS too_long,
  array_to_string(list_transform(list_filter([1, 2, 3], lambda i: seen[i] AND i <> ex), lambda i: ['direct', 'a', 'b'][i] || ':' || k[i] || ':' || st[i] || ':' || CAST(round(d[i] * 1000) AS BIGINT)), ' ') AS aside
FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY n DESC) AS z FROM s) WHERE z = 1"""
)
def limiter_rhythms(spark, d):
    """Runs whose exits take turns: one cooldown for all, a rhythm for each, some blocks reported late."""
    i, kind = F.col("event_id"), F.col("event_type")
    event = F.when(kind == "error", "block").when(kind == "signup", "switch").when((kind == "view") & (i % 5 == 0), "cooldown").otherwise("ok")
    wait = F.when(i % 97 == 0, 9000.0).when(i % 4 == 0, (i % 100).cast("double"))
    started = F.when(i % 2 == 0, F.col("ts") - (i % 50 * 10).cast("double"))
    e = _timed(spark, d).select((F.col("user_id") % 30).alias("run"), "ts", "seq", event.alias("event"), F.when(i % 3 == 1, "a").when(i % 3 == 2, "b").alias("exit"), wait.alias("retry_after"), started.alias("started_at"))
    s = limiter.limiter(e, "run", slices=4)
    named = lambda c: F.coalesce(c, F.lit("direct"))
    aside = F.transform("rhythms", lambda x: F.concat_ws(":", named(x["exit"]), x["rhythm"]["k"].cast("string"), x["rhythm"]["streak"].cast("string"), F.round(x["rhythm"]["delay"] * 1000).cast("long").cast("string")))
    return s.select("run", named(F.col("exit")).alias("exit"), "k", "streak", F.round("delay", 6).alias("delay"), F.round("until", 3).alias("til"), "blocks", "too_long", F.array_join(aside, " ").alias("aside"))


EXITS = 6


@query(
    """WITH e AS (SELECT user_id % 4 AS run, CAST(user_id // 4 % 6 AS INTEGER) AS pos, epoch(ts) / 100.0::DOUBLE AS t, event_id AS seq, event_type, value FROM events),
ev AS (SELECT *, event_type IN ('error', 'click') AS bad, event_type = 'purchase' AS ok FROM e WHERE event_type <> 'view'),
a AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY run, pos ORDER BY t, seq) AS g FROM ev),
b AS (SELECT *, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY run, pos, g ORDER BY t, seq) AS n FROM a),
c AS (SELECT *, min(CASE WHEN n >= 9 THEN (t, seq) END) OVER (PARTITION BY run, pos) AS died FROM b),
st AS (SELECT *, died IS NOT NULL AND (t, seq) = died AS dead, max(t + CASE WHEN bad AND n % 3 = 0 AND n < 9 THEN 600.0::DOUBLE * pow(2.0::DOUBLE, n // 3 - 1) WHEN NOT bad AND NOT ok THEN value * 20 END) OVER (PARTITION BY run, pos ORDER BY t, seq) AS til
  FROM c WHERE died IS NULL OR (t, seq) <= died),
ask AS (SELECT r.run, r.seq AS event_id, r.t, r.pos AS own, CAST(x AS INTEGER) AS pos FROM e AS r, range(6) AS every(x) WHERE event_type = 'view'),
now_ AS (SELECT ask.event_id, ask.t, ask.pos, CASE WHEN (ask.pos - own + 6) % 6 = 0 THEN 6 ELSE (ask.pos - own + 6) % 6 END AS k, max_by({'til': til, 'dead': dead}, (st.t, st.seq)) AS s
  FROM ask LEFT JOIN st ON st.run = ask.run AND st.pos = ask.pos AND (st.t, st.seq) < (ask.t, ask.event_id) GROUP BY ALL),
w AS (SELECT *, CASE WHEN coalesce(s.dead, false) THEN NULL ELSE greatest(0.0::DOUBLE, coalesce(s.til, 0.0::DOUBLE) - t) END AS wait FROM now_)
SELECT event_id, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (wait IS NULL OR wait > 0), '') AS quarantined, min_by(pos, (wait, k)) FILTER (wait IS NOT NULL) AS "exit", round(min(wait), 6) AS wait FROM w GROUP BY event_id"""
)
def exits_at_requests(spark, d):
    """For each request the exits that were blocked or dropped then, and the one that was free first."""
    t, kind = _timed(spark, d), F.col("event_type")
    t = t.select((F.col("user_id") % 4).alias("run"), (F.floor(F.col("user_id") / 4) % EXITS).cast("int").alias("pos"), "ts", "seq", "event_type", "value", "event_id")
    e = t.where(kind != "view").select("run", "pos", "ts", "seq", F.when(kind.isin("error", "click"), "failed").when(kind == "purchase", "ok").otherwise("blocked").alias("kind"), (F.col("value") * 20).alias("seconds"))
    asked = t.where(kind == "view").select("run", F.col("event_id").alias("id"), "ts", "seq", "pos")
    got = limiter.exits_as_of(asked, limiter.exit_states(e, ["run", "pos"]), "run", EXITS)
    return got.select(F.col("id").alias("event_id"), F.array_join("quarantined", ",").alias("quarantined"), "exit", F.round("wait", 6).alias("wait"))
