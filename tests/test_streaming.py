from random import Random

import pytest
from pyspark.sql import functions as F

from pagegraph.operators import pacing
from pagegraph.session import ship
from pagegraph.streaming.pacing_stream import pace_stream, window_counts

SCHEMA = "exit string, seq long, ts double, event string, retry_after double, started_at double"


def test_stream_ends_in_the_state_of_the_batch_fold(spark, tmp_path):
    ship(spark)
    rows = [(f"e{i % 3}", i, float(i * 7), "block" if i % 5 == 0 else "ok", 40.0 if i % 10 == 0 else None, None) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    for k in range(3):  # three files in order of time, one batch each
        df.where((F.col("seq") >= 40 * k) & (F.col("seq") < 40 * k + 40)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = pace_stream(stream).writeStream.outputMode("update").format("memory").queryName("paced").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    last = {r["exit"]: r for r in spark.table("paced").orderBy("until", "blocks").collect()}
    for r in pacing.pacing(df).collect():
        assert (last[r["exit"]]["blocks"], last[r["exit"]]["until"]) == (r["blocks"], r["until"])


def test_windows(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = window_counts(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == e.count()


def exit_log(n=400, exits=4):
    r, out = Random(3), []
    for i in range(n):
        out.append((f"e{r.randrange(exits)}", i, float(i * 20), r.choices(("failed", "ok", "blocked"), (8, 2, 1))[0], r.choice((0.0, 90.0, 1500.0))))
    return out


@pytest.mark.parametrize("cuts", [(), (7, 31, 32, 120, 333)])
def test_exits_with_timers_equal_the_batch_states(spark, tmp_path, cuts):
    from pagegraph.operators import limiter
    from pagegraph.streaming import exit_stream as xs

    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", xs.STORE)
    schema = "exit string, seq long, ts double, kind string, seconds double"
    log, first = exit_log(), 50
    df = spark.createDataFrame(log, schema)
    whole = limiter.exit_states(df, ["exit"])
    initial = xs.last_states(limiter.exit_states(df.where(F.col("seq") < first), ["exit"]))
    bounds = [first, *(c + first for c in cuts if c + first < len(log)), len(log)]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        df.where((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = spark.createDataFrame([("clock", 10**6, 1e6, "ok", None)], schema)  # moves the watermark past every block
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"exits{len(cuts)}"
    q = xs.exit_stream(stream, initial).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = [r for r in spark.table(name).collect() if r["exit"] != "clock"]
    want = {r["exit"]: (r["fails"], r["strikes"], r["until"], r["dead"]) for r in xs.last_states(whole).collect()}
    got = {}
    for r in rows:
        if r["kind"] == "state" and r["at"] >= got.get(r["exit"], (-1.0,))[0]:
            got[r["exit"]] = (r["at"], (r["fails"], r["strikes"], r["until"], r["dead"]))
    assert {k: v for k, (_, v) in got.items()} == want
    free = [(r["exit"], r["at"]) for r in rows if r["kind"] == "free"]
    assert len(free) == len(set(free)) and {(k, v[2]) for k, v in want.items() if v[2] and not v[3]} <= set(free)
    assert not {k for k, v in want.items() if v[3]} & {k for k, at in free if at > want[k][2]}
