"""Exact duplicates: of rows with equal texts one stays. DataFrame functions only.

Rows meet by a digest of their text and are compared by the whole of it at every stage:

1. locally: the partial aggregation of each task leaves one row for each text that the task has read;
2. in shares: rows of a digest that more than ``HOT`` rows have are dealt to ``SHARES`` shares by the task that read
   them, so a text that a third of all rows hold meets in many tasks; any other digest is one share and final here;
3. globally: the winners of the shares, at most one a share and text, are combined.

Texts go through one shuffle, and only the shares' winners go on with theirs. Which digests are shared out changes how
rows are dealt, never the result, so telling the ``MOST_HOT`` most frequent ones to all tasks bounds what is broadcast.
The verdicts come back to the rows by digest; texts that differ under one digest, which shorter digests give, come back
by digest and text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import unused

SHARES, HOT, MOST_HOT = 32, 1_000, 100_000


def _shared_out(marks: DataFrame, hot: int) -> DataFrame:
    """(digest): the most frequent digests of more than ``hot`` rows."""
    n = marks.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    return stage(n.orderBy(F.desc("n"), "digest").limit(MOST_HOT).select("digest"), "exact-hot", MOST_HOT)


def _combined(rows: DataFrame, marks: DataFrame, hot: int, shares: int) -> DataFrame:
    """rows(doc_id, body, digest) -> (digest, keep_id, n), a row for each distinct text."""
    often = _shared_out(marks, hot).select(F.col("digest").alias("often"))
    dealt = rows.join(F.broadcast(often), F.col("digest") == F.col("often"), "left")
    dealt = dealt.withColumn("share", F.when(F.col("often").isNotNull(), F.spark_partition_id() % shares))
    merged = dealt.groupBy("digest", "share", "body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    merged = merged.select("digest", "share", F.when(F.col("share").isNotNull(), F.col("body")).alias("body"), "keep_id", "n")
    merged = stage(merged, "exact-shares", of=marks)
    final = merged.where("share is null").select("digest", "keep_id", "n")
    winners = merged.where("share is not null").groupBy("digest", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    return stage(final.union(winners.select("digest", "keep_id", "n")), "exact-groups", of=marks)


def _verdicts(marks: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    """marks(doc_id, tag, sha, *key), groups(*key, keep_id, n) -> the verdict on each row.

    Single rows need no partner, so only groups of several are joined. Of rows that share the text and the doc_id that
    stays, the one with the largest tag stays.
    """
    several = groups.where("n > 1")
    ends = marks.groupBy(*key, F.col("doc_id").alias("end_id")).agg(F.max("tag").alias("top"))
    several = several.join(ends, key).where(F.col("end_id").eqNullSafe(F.col("keep_id"))).select(*(F.col(k).alias(f"of_{k}") for k in key), "keep_id", "n", "top")
    on = [F.col(k) == F.col(f"of_{k}") for k in key]
    alone = F.col("n").isNull()
    return marks.join(several, on, "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("tag") == F.col("top"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    normalise: Callable[[Column], Column] = lambda c: c,
    digest_bytes: int = 32,
    hot: int = HOT,
    shares: int = SHARES,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs.

    Texts are equal when equal after ``normalise``; a null one counts as empty. Of equal texts the row with the largest
    doc_id stays, null ids being the smallest; of rows that repeat it just one has ``kept``. An empty table gives no
    rows, further columns are not read. digest_bytes: how much of the SHA-256 rows meet by; less moves fewer bytes and
    gives the same result.
    """
    body = normalise(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body")).withColumn("sha", F.unhex(F.sha2("body", 256)))
    rows = rows.withColumn("digest", F.substring("sha", 1, digest_bytes))
    marks = stage(rows.select("doc_id", "sha", "digest", F.monotonically_increasing_id().alias("tag")), "exact-marks", of=docs)
    rows = rows.select("doc_id", "body", "digest")
    found = _combined(rows, marks, hot, shares)
    clash = stage(found.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "exact-clashes")
    if not clash.limit(1).count():
        return _verdicts(marks, found, ["digest"])
    plain = _verdicts(marks.join(clash, "digest", "left_anti"), found.join(clash, "digest", "left_anti"), ["digest"])
    mixed = rows.join(clash, "digest", "left_semi").select("*", F.unhex(F.sha2("body", 256)).alias("sha"), F.monotonically_increasing_id().alias("tag"))
    mixed = stage(mixed, "exact-mixed", of=docs)
    apart = mixed.groupBy("digest", "body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    return plain.union(_verdicts(mixed, apart, ["digest", "body"]))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] = lambda c: c, **how) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat doc_id and text, one.

    Rows are joined by digest and doc_id together, so copies of a text fall on as many keys as they have ids.
    """
    stay = groups(docs, doc_id, text, normalise, **how).where("kept").select(F.col("keep_id").alias("pg_id"), F.col("text_sha256").alias("pg_sha"))
    sha = unused(docs, "sha")
    named = docs.withColumn(sha, F.sha2(normalise(F.coalesce(F.col(text), F.lit(""))), 256))
    on = (named[sha] == stay["pg_sha"]) & named[doc_id].eqNullSafe(stay["pg_id"])
    return named.join(stay, on, "left_semi").dropDuplicates([sha, doc_id]).select(*docs.columns)
