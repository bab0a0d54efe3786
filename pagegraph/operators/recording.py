"""What a run reports about its pages, merged into the job documents: a keyed merge of event batches, done once each.

A page is one key in both display forms. An export replaces the page's entry, whichever form that had, and ends its
failures; a failure adds an attempt to its own address. So the last export of a page decides its entry, and only the
failures after it count: no event needs the state that the one before it left. Documents remember the last event that
they took, in ``recorded``, so a batch that comes again, whole or in part, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, urls
from ..session import stage
from ..sources.manifest import FAILURE, OUTPUT

ENTRY = ("filename", "title", "size_bytes", "elapsed_seconds", "sha256")


def _regrouped(rows: DataFrame, name: str, kind: str) -> DataFrame:
    """rows(dir, ord, url, entry) -> (dir, map in that order)"""
    listed = F.array_sort(F.collect_list(F.struct("ord", "url", "entry")))
    return rows.groupBy("dir").agg(F.map_from_entries(F.transform(listed, lambda x: F.struct(x["url"], x["entry"]))).cast(f"map<string,{kind}>").alias(name)).withColumnRenamed("dir", f"dir_{name}")


def _place(k: int, at: Column) -> Column:
    """What was in the document keeps its place; what is new follows in the order of events."""
    return F.struct(F.lit(k).alias("k"), at.cast("long").alias("at")).alias("ord")


def record(m: DataFrame, events: DataFrame, kind: str = "exported") -> DataFrame:
    """m(dir, ``kind``, failures, ... [, recorded]), one row a job, with the events that it has not taken yet.

    events(dir, seq, url, event done|failed, filename, title, size_bytes, elapsed_seconds, sha256, error, at): seq is the
    order of a job's events, one that repeats counts once; batches have to come in that order, each as often as it
    may. Events of null seq or url and those of unknown jobs are left out, a document without new events stays as it is.
    """
    m = m if "recorded" in m.columns else m.withColumn("recorded", F.lit(None).cast("long"))
    marks = m.select(F.col("dir").alias("job"), "recorded")
    fresh = events.where("seq is not null and url is not null").dropDuplicates(["dir", "seq"]).join(marks, F.col("dir") == F.col("job"))
    fresh = stage(fresh.where("recorded is null or seq > recorded").withColumn("key", urls.page_key(F.col("url"))).drop("job", "recorded"), "record-events")
    done, failed = fresh.where("event = 'done'"), fresh.where("event = 'failed'")
    last = done.groupBy("dir", "key").agg(F.max("seq").alias("end"), F.max_by("url", "seq").alias("url"), F.max_by(F.struct(*ENTRY), "seq").alias("entry"))
    # of the exports under the last address those after any under the other one: the first of them put it there
    forms = done.select("dir", "key", "seq", F.col("url").alias("form")).join(last.select("dir", "key", "url"), ["dir", "key"])
    forms = forms.groupBy("dir", "key").agg(F.max(F.when(F.col("form") != F.col("url"), F.col("seq"))).alias("swapped"))
    last = last.join(forms, ["dir", "key"])
    begin = done.join(last.select("dir", "key", F.col("url").alias("form"), "swapped"), ["dir", "key"]).where((F.col("url") == F.col("form")) & (F.col("swapped").isNull() | (F.col("seq") > F.col("swapped"))))
    last = stage(last.join(begin.groupBy("dir", "key").agg(F.min("seq").alias("begin")), ["dir", "key"]), "record-exports")
    touched = stage(fresh.groupBy(F.col("dir").alias("job")).agg(F.max("seq").alias("upto")), "record-jobs")
    mine = m.join(touched.select("job"), F.col("dir") == F.col("job"), "left_semi")

    one = lambda c, k: F.coalesce(F.col(c), F.create_map().cast(f"map<string,{k}>"))
    old = mine.select("dir", F.posexplode(one(kind, OUTPUT)).alias("pos", "url", "entry")).withColumn("key", urls.page_key(F.col("url")))
    ends = last.select("dir", "key", F.col("url").alias("to"), F.col("entry").alias("new"), "swapped")
    kept = old.join(ends, ["dir", "key"], "left").where("to is null or (to = url and swapped is null)")
    kept = kept.select("dir", _place(0, F.col("pos")), "url", F.coalesce("new", "entry").alias("entry"))
    added = last.join(kept.select("dir", "url"), ["dir", "url"], "left_anti").select("dir", _place(1, F.col("begin")), "url", "entry")
    outputs = _regrouped(kept.union(added), kind, OUTPUT)

    n = failed.join(last.select("dir", "key", "end"), ["dir", "key"], "left").where("end is null or seq > end")
    n = n.groupBy("dir", "url").agg(F.count("*").cast("int").alias("n"), F.min("seq").alias("begin"), F.max_by("error", "seq").alias("error"), F.max_by("at", "seq").alias("at"))
    n = stage(n, "record-failures")
    tried = mine.select("dir", F.posexplode(one("failures", FAILURE)).alias("pos", "url", "entry")).withColumn("key", urls.page_key(F.col("url")))
    tried = tried.join(last.select("dir", "key"), ["dir", "key"], "left_anti").select("dir", "pos", "url", F.col("entry").alias("was"))
    both = tried.join(n, ["dir", "url"], "full")
    again = F.struct(classify.short_error(F.col("error"), 500).alias("error"), (F.coalesce("was.attempts", F.lit(0)) + F.col("n")).cast("int").alias("attempts"), F.col("at").alias("last_attempt"))
    place = F.when(F.col("pos").isNotNull(), _place(0, F.col("pos"))).otherwise(_place(1, F.col("begin"))).alias("ord")
    failures = _regrouped(both.select("dir", place, "url", F.when(F.col("n").isNull(), F.col("was")).otherwise(again).alias("entry")), "failures", FAILURE)

    out = m.join(touched, F.col("dir") == F.col("job"), "left")
    for name, table in ((kind, outputs), ("failures", failures)):
        out = out.withColumnRenamed(name, f"old_{name}").join(table, F.col("dir") == F.col(f"dir_{name}"), "left")
    empty = {kind: OUTPUT, "failures": FAILURE}
    value = lambda c: F.when(F.col("job").isNull(), F.col(f"old_{c}")).otherwise(F.coalesce(c, F.create_map().cast(f"map<string,{empty[c]}>"))).alias(c)
    return out.select(*(value(c) if c in empty else F.greatest("recorded", "upto").alias(c) if c == "recorded" else c for c in m.columns))
