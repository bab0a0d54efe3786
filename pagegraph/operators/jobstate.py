"""Job state: reports, missing, stale and orphan sets, map diffs, integrity, retries, summaries.

Lookups are joins on equal keys; sets are semi and anti joins; order is an explicit ``idx``. Planned joins
are left to Catalyst and adaptive execution, which know the sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import one_decimal
from ..session import stage
from .ordinal import exact_percentiles, global_ordinal

POINTS = {"p50": 0.50, "p95": 0.95, "p99": 0.99, "min": 0.0, "max": 1.0}
MAX_ATTEMPTS = 5


def keep_first(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """Of the rows of a key the first in the order; pre-aggregated, so a hot key costs a row a task."""
    keys = [key] if isinstance(key, str) else key
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("__r")).select("__r.*")


def report_rows(mapped: DataFrame, exported: DataFrame, failures: DataFrame) -> DataFrame:
    """mapped ⟕ exported ⟕ failures on the exact URL; exported before failed before pending."""
    e = exported.select("url", "filename", "title", "size_bytes", "elapsed_seconds", F.lit(True).alias("is_e"))
    f = failures.select("url", "error", "attempts", F.lit(True).alias("is_f"))
    j = mapped.select("idx", "url").join(e, "url", "left").join(f, "url", "left")
    done, failed = F.col("is_e").isNotNull(), F.col("is_e").isNull() & F.col("is_f").isNotNull()
    text = lambda on, c: F.when(on, F.coalesce(c, F.lit(""))).otherwise("")
    return j.select(
        "idx",
        "url",
        F.when(done, "exported").when(failed, "failed").otherwise("pending").alias("status"),
        text(done, "filename").alias("filename"),
        text(done, "title").alias("title"),
        F.when(done, F.coalesce("size_bytes", F.lit(0))).otherwise(0).cast("long").alias("size_bytes"),
        F.when(done, F.bround(F.coalesce("elapsed_seconds", F.lit(0.0)), 2)).otherwise(0.0).alias("elapsed_seconds"),
        F.when(failed, F.coalesce("attempts", F.lit(0))).otherwise(0).cast("int").alias("attempts"),
        text(failed, "error").alias("error"),
    )


def report_summary(rows: DataFrame) -> DataFrame:
    s = rows.agg(
        F.count("*").alias("total"),
        *(F.count_if(F.col("status") == k).alias(k) for k in ("exported", "failed", "pending")),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"),
    ).withColumn("conversion_rate", F.when(F.col("total") > 0, F.col("exported") / F.col("total")).otherwise(0.0))
    p = exact_percentiles(rows.where("status = 'exported'"), "elapsed_seconds", POINTS)
    return s.crossJoin(F.broadcast(p))  # a row with a row


def status_snapshot(mapped: DataFrame, exported: DataFrame, failures: DataFrame) -> DataFrame:
    """Counts by length, as the status command shows them: pending is a difference of counts, not of sets."""
    one = lambda df, name, *more: df.agg(F.count("*").alias(name), *more)
    j = one(mapped, "mapped").crossJoin(one(exported, "exported", F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))).crossJoin(one(failures, "failed"))
    pct = F.when(F.col("mapped") > 0, F.bround(100.0 * F.col("exported") / F.col("mapped"), 1)).otherwise(0.0)
    return j.withColumn("pending", F.greatest(F.lit(0), F.col("mapped") - F.col("exported") - F.col("failed"))).withColumn("pct", pct)


def consolidation_set(mapped: DataFrame, exported: DataFrame, valid_files: DataFrame | None = None) -> DataFrame:
    """Pages to merge, in map order: either display form of the URL finds the output; the exact one first."""
    e = exported.select(F.col("url").alias("e_url"), "filename", urls.page_key(F.col("url")).alias("k"))
    if valid_files is not None:
        e = e.join(valid_files.select("filename"), "filename", "left_semi")
    j = mapped.select("idx", "url", urls.page_key(F.col("url")).alias("k")).join(e, "k")
    return keep_first(j.select("idx", "url", "filename", (F.col("url") != F.col("e_url")).alias("other"), "e_url"), "idx", [F.col("other"), F.col("e_url")]).select("idx", "url", "filename")


def missing_pages(mapped: DataFrame, merged: DataFrame) -> DataFrame:
    return mapped.select("idx", "url").join(merged.select("idx"), "idx", "left_anti")


def stale_pages(merged: DataFrame, produced: DataFrame) -> DataFrame:
    """Merged pages whose file this run did not produce."""
    return merged.join(produced.select("filename"), "filename", "left_anti").select("idx", "url", "filename")


def map_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, url) of added and removed pages, and unchanged ones; display forms count as one page."""
    o, n = (d.select("url", urls.page_key(F.col("url")).alias("k")).groupBy("k").agg(F.min("url").alias("url")) for d in (old, new))
    mark = lambda d, s: d.select(F.lit(s).alias("change"), "url")
    return mark(n.join(o, "k", "left_anti"), "added").union(mark(o.join(n, "k", "left_anti"), "removed")).union(mark(n.join(o, "k", "left_semi"), "unchanged"))


def gated_map_diff(old: DataFrame, new: DataFrame, forced: bool, old_complete: bool, new_complete: bool) -> DataFrame:
    """The same if it can say anything: a map that was complete and not empty was mapped again, on demand and to its
    end. Else no row."""
    whole = old.limit(1).select(F.lit(True).alias("__any"))  # one row at most
    return map_diff(old, new).where(F.lit(forced and old_complete and new_complete)).crossJoin(F.broadcast(whole)).drop("__any")


def remap_outcome(n_new: Column, n_pending: Column, n_old: Column, limited: Column) -> Column:
    """What becomes of a map that was made again (n_old null: for the first time): ``replace`` it, ``keep`` the old one
    because the new one has the start page alone or isn't finished, or save the new one as ``partial``. A stop at
    the greatest number of pages counts as finished for a caller, but isn't a whole map."""
    lost = n_old.isNotNull() & (n_new == 1) & (n_old > 1)
    whole = (n_new > 0) & (n_pending == 0)
    return F.when(whole & lost, "keep").when(whole, "replace").when(n_old.isNotNull() & ~limited, "keep").otherwise("partial")


def crawl_summary(mapped: DataFrame, leaves: DataFrame, slow: DataFrame, pending: DataFrame, requests: DataFrame) -> DataFrame:
    """One row: mapped pages, navigations and listing requests, mapped leaves that needed none, slow and pending pages.
    requests(kind navigation|listing); the others have url."""
    one = lambda df, n: df.agg(F.count("*").alias(n))
    asked = requests.agg(F.count_if(F.col("kind") == "navigation").alias("navigations"), F.count_if(F.col("kind") == "listing").alias("requests"))
    known = mapped.select("url").distinct().join(leaves.select("url"), "url", "left_semi")
    out = one(mapped, "mapped").crossJoin(asked)  # rows of counts
    for df, n in ((known, "leaves"), (slow, "slow"), (pending, "pending")):
        out = out.crossJoin(one(df, n))
    return out


def merged_metrics(workers: DataFrame, by: list[str]) -> DataFrame:
    """workers(by..., blocks, waited) -> their sums."""
    return workers.groupBy(*by).agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"), F.coalesce(F.sum("waited"), F.lit(0.0)).alias("waited"))


def map_diff_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    return map_diff(old, new).groupBy("change").count().withColumnRenamed("count", "n")


def orphan_files(files: DataFrame, exported: DataFrame, protected: tuple[str, ...] = ("manifest.json",), tmp: str = r"\.tmp$") -> DataFrame:
    f = files.where(~F.col("filename").isin(*protected) & ~F.col("filename").rlike(tmp))
    return f.join(exported.select("filename"), "filename", "left_anti")


def reconcile(exported: DataFrame, files: DataFrame) -> DataFrame:
    """exported with ``kept``: whether a valid file is there."""
    return exported.join(files.select("filename", F.lit(True).alias("there")).distinct(), "filename", "left").withColumn("kept", F.col("there").isNotNull()).drop("there")


def verify(exported: DataFrame, disk: DataFrame) -> DataFrame:
    """exported(filename, sha256) ⟕ disk(filename, actual, io_error) -> (filename, result)."""
    j = exported.select("filename", "sha256").join(disk.select("filename", "actual", "io_error", F.lit(True).alias("there")), "filename", "left")
    r = F.when(F.col("there").isNull(), "missing").when(F.coalesce("sha256", F.lit("")) == "", "skipped").when(F.coalesce("io_error", F.lit(False)), "io_error").when(F.col("sha256") == F.col("actual"), "ok").otherwise("mismatch")
    return j.select("filename", r.alias("result"))


def verify_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("result").count().withColumnRenamed("count", "n")


def retry_expand(run: DataFrame, failures: DataFrame, exported: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """run(idx, url) followed by failed pages with attempts left that are neither in it nor exported."""
    more = failures.where(F.col("attempts") < most).select("url").join(run.select("url"), "url", "left_anti").join(exported.select("url"), "url", "left_anti")
    last = run.agg(F.coalesce(F.max("idx"), F.lit(0)).alias("last"))
    more = global_ordinal(more, [F.col("url")], "n")
    return run.select("idx", "url").union(more.crossJoin(F.broadcast(last)).select((F.col("last") + F.col("n")).alias("idx"), "url"))


def pending_failures(failures: DataFrame, exported: DataFrame) -> DataFrame:
    """Failures without an output under either display form."""
    f = failures.withColumn("k", urls.page_key(F.col("url")))
    return f.join(exported.select(urls.page_key(F.col("url")).alias("k")), "k", "left_anti").drop("k")


def reexport_matches(exported: DataFrame, numbers: DataFrame) -> DataFrame:
    """Outputs whose file name starts with one of the numbers(n), as four digits and a dash."""
    e = exported.withColumn("n", F.regexp_extract("filename", r"^(\d{4,})-", 1).try_cast("int"))
    return e.join(numbers.select(F.col("n").cast("int")).distinct(), "n", "left_semi").drop("n")


def same_job(jobs: DataFrame) -> DataFrame:
    """(dir, other): each job with every other directory that has the same start page."""
    k = jobs.select("dir", urls.start_url_key(F.col("start_url")).alias("k"))
    k = stage(k, "job-keys")  # both sides of the pairs are made of it
    n = 2 * jobs.sparkSession.sparkContext.defaultParallelism
    return k.repartition(n).join(k.withColumnRenamed("dir", "other"), "k").where("dir <> other").select("dir", "other")


def retry_round(failures: DataFrame, permanent: DataFrame) -> DataFrame:
    return failures.join(permanent.select("url"), "url", "left_anti")


def invariants(mapped: DataFrame, exported: DataFrame, failures: DataFrame, complete: bool, limit: int | None) -> DataFrame:
    """(issue, n) of each rule that is broken."""
    spark = mapped.sparkSession
    both = exported.select("url").join(failures.select("url"), "url", "left_semi").agg(F.count("*").alias("n")).select(F.lit("exported and failed").alias("issue"), "n")
    twice = mapped.groupBy("url").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(F.lit("duplicate url").alias("issue"), "n")
    blank = mapped.agg(F.count_if(F.trim("url") == "").alias("n")).select(F.lit("blank url").alias("issue"), "n")
    empty = mapped.agg((F.count("*") == 0).cast("long").alias("n")).select(F.lit("complete but empty").alias("issue"), (F.col("n") * int(complete)).alias("n"))
    below = spark.range(1).select(F.lit("negative limit").alias("issue"), F.lit(int(limit is not None and limit < 0)).cast("long").alias("n"))
    return reduce(DataFrame.union, [both, twice, blank, empty, below]).where("n > 0")


def job_summaries(jobs: DataFrame, mapped: DataFrame, exported: DataFrame, failures: DataFrame) -> DataFrame:
    """jobs(dir, start_url, last_updated, crawl_complete); the other tables carry dir. Newest first."""
    e = exported.select("dir", urls.page_key(F.col("url")).alias("k"))
    missing = mapped.withColumn("k", urls.page_key(F.col("url"))).join(e, ["dir", "k"], "left_anti").groupBy("dir").agg(F.count("*").alias("missing"))
    failed = failures.withColumn("k", urls.page_key(F.col("url"))).join(e, ["dir", "k"], "left_anti").groupBy("dir").agg(F.count("*").alias("pending_failures"))
    size = mapped.groupBy("dir").agg(F.count("*").alias("mapped"))
    done = exported.groupBy("dir").agg(F.count("*").alias("exported"))
    j = reduce(lambda a, b: a.join(b, "dir", "left"), [size, done, missing, failed], jobs).fillna(0, ["mapped", "exported", "missing", "pending_failures"])
    return j.withColumn("is_pending", ~F.col("crawl_complete") | (F.col("missing") > 0) | (F.col("pending_failures") > 0)).orderBy(F.desc("last_updated"))


def failures_sorted(failures: DataFrame) -> DataFrame:
    return failures.orderBy(F.desc("attempts"), "url")


def failure_reasons(failures: DataFrame, k: int = 6) -> DataFrame:
    return failures.groupBy("reason").count().withColumnRenamed("count", "n").orderBy(F.desc("n"), "reason").limit(k)


def slow_pages(rows: DataFrame, threshold: float, k: int | None = None) -> DataFrame:
    """Slow pages with their log line, slowest first."""
    took = one_decimal(F.col("elapsed_seconds"))
    line = F.format_string("%7ss | %-14s | %s", took, "phase", "url")
    out = rows.where(F.col("elapsed_seconds") >= threshold).withColumn("line", line).orderBy(F.desc("elapsed_seconds"), "url")
    return out.limit(k) if k else out


def run_totals(exported: DataFrame) -> DataFrame:
    return exported.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.avg("elapsed_seconds"), F.lit(0.0)).alias("mean_seconds"), F.count("*").alias("pages"))


def run_outcome(n_urls: Column, n_merged: Column, n_missing: Column, n_stale: Column, complete: Column) -> Column:
    """Exit code of a run: 1 without pages or outputs, 3 with missing or stale ones or an unfinished map, else 0."""
    return F.when((n_urls == 0) | (n_merged == 0), 1).when((n_missing > 0) | (n_stale > 0) | ~complete, 3).otherwise(0)


def net_stats(events: DataFrame, navigations: DataFrame) -> DataFrame:
    """Per navigation: same-host requests, blocked and failed resources, the longest Retry-After."""
    from ..functions import classify as c

    e = events.join(navigations.select("nav_id", F.lower("nav_host").alias("h")), "nav_id")
    e = e.where(urls.host(F.col("url")) == F.col("h"))
    content = F.col("resource_type").isin(*c.CONTENT_TYPES)
    blocked = (F.col("event") == "response") & ~F.col("is_navigation") & ((F.col("status") == 429) | ((F.col("status") >= 500) & content))
    failed = (F.col("event") == "failed") & content & ~c.any_of(F.lower(F.coalesce("failure", F.lit(""))), c.IGNORED_FAILURES)
    after = c.retry_after(F.col("retry_after"), F.lit(0.0))
    return e.groupBy("nav_id").agg(
        F.count_if(F.col("event") == "request").alias("requests"),
        F.count_if(blocked).alias("blocked"),
        F.array_join(F.array_sort(F.collect_set(F.when(blocked, F.col("status").cast("string")))), "/").alias("statuses"),
        F.count_if(failed).alias("failed"),
        F.max(F.when(blocked & (after > 0), after)).alias("retry_after"),
    )
