from random import Random

from pyspark.sql import functions as F

from pagegraph.operators import recording
from pagegraph.sources import manifest

EVENT = "dir string, seq long, url string, event string, filename string, title string, size_bytes long, elapsed_seconds double, sha256 string, error string, at string"
LISTS = f"dir string, exported array<struct<k:string,v:{manifest.OUTPUT}>>, failures array<struct<k:string,v:{manifest.FAILURE}>>, recorded long, other string"


def other_form(u):
    return u.replace("/display/public/", "/display/") if "/public/" in u else u.replace("/display/", "/display/public/") if "/display/" in u else None


def plain(docs, events):
    for d, seq, url, event, *entry, error, at in sorted(set(events), key=lambda e: e[1]):
        if d not in docs:
            continue
        done, failed = docs[d]
        if event == "done":
            done.pop(other_form(url), None)
            failed.pop(other_form(url), None)
            done[url] = tuple(entry)
            failed.pop(url, None)
        else:
            failed[url] = (error, failed.get(url, (None, 0, None))[1] + 1, at)


def documents(seed):
    r = Random(seed)
    page = lambda: r.choice(("https://h/display/S/", "https://h/display/public/S/", "https://h/x/")) + str(r.randrange(9))
    docs = {f"j{j}": ({}, {}) for j in range(6)}
    for j, (done, failed) in docs.items():
        for _ in range(r.randrange(6)):
            u = page()
            if other_form(u) not in done:
                done[u] = (f"old{j}", None, 1, 2.0, None)
        for _ in range(r.randrange(5)):
            failed[page()] = ("old", r.randrange(4), "t")
    events = [(f"j{r.randrange(7)}", s, page(), r.choice(("done", "failed", "failed")), f"f{s}", "t", s, 0.5, None, f"e{s}", f"at{s}") for s in range(160)]
    return docs, [e for e in events if e[0] != "j5"]  # j5 has no events, j6 no document


def read(df):
    """Maps in their order: a dict would lose it on the way."""
    rows = df.select("dir", *(F.map_entries(c).alias(c) for c in ("exported", "failures"))).collect()
    return {r["dir"]: tuple([(k, tuple(v)) for k, v in r[c]] for c in ("exported", "failures")) for r in rows}


def test_batches_give_what_single_events_give(spark):
    docs, events = documents(1)
    start = spark.createDataFrame([(d, list(a.items()), list(b.items()), None, "kept") for d, (a, b) in docs.items()], LISTS)
    start = start.withColumns({c: F.map_from_entries(c) for c in ("exported", "failures")})
    e = spark.createDataFrame(events, EVENT).repartition(4).cache()
    plain(docs, events)
    want = {d: (list(a.items()), list(b.items())) for d, (a, b) in docs.items()}
    whole = recording.record(start, e).cache()
    assert read(whole) == want and whole.columns == start.columns and whole.where("other <> 'kept'").count() == 0
    assert {r["dir"]: r["recorded"] for r in whole.collect()}["j5"] is None
    assert read(recording.record(whole, e)) == want  # the same batch again
    part = recording.record(start, e.where("seq < 50"))
    part = recording.record(part.cache(), e.where("seq < 90").union(e.where("seq between 60 and 70")))  # overlaps and repeats
    assert read(recording.record(part.cache(), e)) == want


def test_documents_without_marks_or_maps(spark):
    docs = spark.createDataFrame([("a", None, None), ("b", None, {"u": ("x", 2, "t")})], f"dir string, exported map<string,{manifest.OUTPUT}>, failures map<string,{manifest.FAILURE}>")
    none = [None] * 5
    e = spark.createDataFrame([("a", 1, "u", "failed", *none, " boom\nCall log: x", "now"), ("b", 1, "u", "failed", *none, "y" * 600, "now"), ("b", 2, None, "failed", *none, "z", None), ("b", None, "u", "failed", *none, "z", None)], EVENT)
    got = recording.record(docs, e)
    assert {r["dir"]: (r["exported"], r["failures"]["u"]["attempts"], len(r["failures"]["u"]["error"]), r["recorded"]) for r in got.collect()} == {"a": ({}, 1, 4, 1), "b": ({}, 3, 500, 1)}
    assert recording.record(docs, e.where("false")).where("failures is null").count() == 1
