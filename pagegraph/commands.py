"""One function per command, over job documents (``sources.manifest.read_manifests``) and file tables.

Read-only commands return DataFrames; the two that change a job return the documents of a new snapshot.
``m`` has a row per job directory ``dir``; ``files`` has (dir, filename, size, sha256).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import consolidate, jobstate, pacing
from .sources import manifest, stored

TMP = r"\.pdf\.tmp$|\.tmp$"


def jobs(m: DataFrame, pending_only: bool = False) -> DataFrame:
    """Summaries of all jobs, newest first by the stored time text."""
    j = jobstate.job_summaries(m.select("dir", "start_url", "last_updated", "crawl_complete"), manifest.mapped(m).select("dir", "url"), manifest.exported(m).select("dir", "url"), manifest.failures(m).select("dir", "url"))
    return j.where("is_pending") if pending_only else j


def _size(c: str) -> Column:
    return F.greatest(F.lit(0), F.coalesce(F.size(c), F.lit(0)))


def status(m: DataFrame, files: DataFrame) -> DataFrame:
    """Counts by length of each job, with what is on disk."""
    pdf = files.where(F.col("filename").endswith(".pdf")).groupBy("dir").agg(F.count("*").alias("pdfs_on_disk"), F.sum("size").alias("total_bytes_on_disk"))
    n, e, f = _size("mapped_urls"), _size("exported"), _size("failures")
    s = m.select(
        "dir", F.coalesce("start_url", F.lit("")).alias("start_url"), "crawl_complete", n.alias("mapped_count"), _size("crawl_queue").alias("queue_remaining"), e.alias("exported_count"), f.alias("failures_count"),
        F.greatest(F.lit(0), n - e - f).alias("pending_count"), F.when(n > 0, F.bround(e / n * 100, 1)).otherwise(0.0).alias("progress_pct"), F.coalesce("last_updated", F.lit("")).alias("last_updated"),
    )
    return s.join(pdf, "dir", "left").fillna(0, ["pdfs_on_disk", "total_bytes_on_disk"])


def failures(m: DataFrame) -> DataFrame:
    return jobstate.failures_sorted(manifest.failures(m))


def report(m: DataFrame) -> DataFrame:
    """Report rows of one job: filter ``m`` to its directory."""
    return jobstate.report_rows(manifest.mapped(m).select("idx", "url"), manifest.exported(m), manifest.failures(m))


def report_summary(m: DataFrame) -> DataFrame:
    return jobstate.report_summary(report(m))


def verify(m: DataFrame, files: DataFrame, limit: int | None = None) -> DataFrame:
    """(dir, filename, result) of every output, or of each job's first ``limit`` in the order of its document."""
    e = manifest.exported(m, ord="ord")
    if limit is not None:
        e = e.where(F.col("ord") < limit)
    e = e.select(F.concat_ws("/", "dir", "filename").alias("filename"), "sha256")
    d = files.select(F.concat_ws("/", "dir", "filename").alias("filename"), F.col("sha256").alias("actual"), F.col("sha256").isNull().alias("io_error"))
    r = jobstate.verify(e, d)
    return r.select(F.regexp_extract("filename", "^(.*)/([^/]*)$", 1).alias("dir"), F.regexp_extract("filename", "([^/]*)$", 1).alias("filename"), "result")


def clean_tmp(files: DataFrame) -> DataFrame:
    return files.where(F.col("filename").rlike(TMP)).dropDuplicates(["dir", "filename"])


def clean_orphans(m: DataFrame, files: DataFrame) -> DataFrame:
    """Outputs on disk that no job document names."""
    pdf = files.where(F.col("filename").endswith(".pdf"))
    return pdf.join(manifest.exported(m).select("dir", "filename"), ["dir", "filename"], "left_anti")


def reexport(m: DataFrame, numbers: list[int]) -> tuple[DataFrame, DataFrame]:
    """(documents without the outputs of these numbers, the (dir, number) that were found).

    Numbers are those of file names, 1 to 9999.
    """
    if bad := [n for n in numbers if not 1 <= n <= 9999]:
        raise ValueError(f"numbers out of range: {bad}")
    starts = [F.lit(f"{n:04d}-") for n in dict.fromkeys(numbers)]
    hit = lambda e: F.exists(F.array(*starts), lambda s: F.startswith(F.coalesce(e["filename"], F.lit("")), s))
    new = m.withColumn("exported", F.map_filter("exported", lambda _, e: ~hit(e)))
    gone = manifest.exported(m).withColumn("number", F.regexp_extract("filename", r"^(\d{4})-", 1).try_cast("int"))
    return new, gone.where(F.col("number").isin(*numbers)).select("dir", "number").distinct()


def reset(m: DataFrame, dirs: list[str]) -> DataFrame:
    """Documents without those of the given directories."""
    return m.where(~F.col("dir").isin(*dirs))


def resume_plan(m: DataFrame, mode: str = "auto") -> DataFrame:
    """(dir, idx, url) of the pages that a run over these jobs would export.

    Mode auto: pages without output that haven't failed, retry: failed pages with attempts left, all: every page.
    """
    pages, done, bad = manifest.mapped(m), manifest.exported(m).select("dir", "url"), manifest.failures(m)
    if mode == "all":
        out = pages
    elif mode == "retry":
        out = pages.join(bad.where(F.col("attempts") < jobstate.MAX_ATTEMPTS).select("dir", "url"), ["dir", "url"], "left_semi").join(done, ["dir", "url"], "left_anti")
    elif mode == "auto":
        out = pages.join(done, ["dir", "url"], "left_anti").join(bad.select("dir", "url"), ["dir", "url"], "left_anti")
    else:
        raise ValueError(f"no such mode: {mode}")
    return out.select("dir", "idx", "url")


def markdown_pages(m: DataFrame) -> DataFrame:
    """(dir, idx, url) of the pages without a Markdown output."""
    return manifest.mapped(m).join(manifest.exported(m, "exported_md").select("dir", "url"), ["dir", "url"], "left_anti").select("dir", "idx", "url")


def add_exits(known: DataFrame, lines: DataFrame) -> DataFrame:
    """Known exits(n, exit) followed by the new ones of a list, each once."""
    new = stored.exit_list(lines).where("not bad").join(known.select("exit"), "exit", "left_anti")
    last = known.agg(F.coalesce(F.max("n"), F.lit(0)).alias("last"))
    return known.select("n", "exit").union(new.crossJoin(F.broadcast(last)).select(F.col("last") + F.col("n"), "exit"))


def clear_exits(known: DataFrame) -> DataFrame:
    return known.where("false")


def exits(lines: DataFrame) -> DataFrame:
    return stored.exit_list(lines)


def ranked_exits(probes: DataFrame, unique_ip: bool = True) -> DataFrame:
    return pacing.rank_probes(probes, unique_ip)


def as_json(rows: DataFrame) -> DataFrame:
    return consolidate.json_rows(rows)


def exit_code(mapped: DataFrame, merged: DataFrame, stale: DataFrame, complete: bool) -> DataFrame:
    """One row with the code of a run over these pages."""
    one = lambda df, n: df.agg(F.count("*").alias(n))
    j = one(mapped, "urls").crossJoin(one(merged, "merged")).crossJoin(one(stale, "stale"))  # rows of one count each
    return j.select(jobstate.run_outcome(F.col("urls"), F.col("merged"), F.col("urls") - F.col("merged"), F.col("stale"), F.lit(complete)).alias("code"))
