"""Consolidated documents: outline, table of contents, Markdown, and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import strip
from ..session import stage


def outline(entries: DataFrame, by: str | None = None) -> DataFrame:
    """entries(idx, title, page_count): start page of each entry, a running sum; corrupt ones (-1) are skipped."""
    w = Window.partitionBy(*([by] if by else [])).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    good = entries.where("page_count >= 0")
    return good.withColumn("start_page", F.coalesce(F.sum("page_count").over(w), F.lit(0)) + 1)


def page_markdown(title, url, body):
    """One page: heading, source line, trimmed body."""
    return F.concat(F.lit("# "), title, F.lit("\n\nFonte: "), url, F.lit("\n\n"), strip(body), F.lit("\n"))


def toc(entries: DataFrame) -> DataFrame:
    """entries(idx, title, stem): a contents line each; a blank title falls back on the file stem."""
    t = strip(F.coalesce("title", F.lit("")))
    t = F.when(t == "", F.col("stem")).otherwise(t)
    return entries.select("idx", F.format_string("%d. [%s](#page-%d)", "idx", t, "idx").alias("line"))


def _part(title_col, body_col):
    """(contents line, anchored body) of an entry."""
    t = strip(F.coalesce(title_col, F.lit("")))
    t = F.when(t == "", F.col("stem")).otherwise(t)
    line = F.format_string("%d. [%s](#page-%d)", "idx", t, "idx")
    return line, F.concat(F.format_string('<a id="page-%d"></a>\n\n', "idx"), strip(body_col), F.lit("\n\n---\n"))


def pieces(entries: DataFrame, title: str) -> DataFrame:
    """The consolidated document as rows (part, idx, text), to be joined in that order: for jobs of any length.

    Entries(idx, title, stem, body) without a body leave a gap in the numbers; without entries there are no rows. Bodies are
    staged, as four parts are made of them and rendering is what costs.
    """
    good = entries.where("body is not null").select(F.col("idx").cast("long").alias("idx"), "title", "stem", "body")
    good = stage(good, "consolidated")
    line, body = _part(F.col("title"), F.col("body"))
    ends = good.agg(F.min("idx").alias("first"), F.count("*").alias("n")).where("n > 0")
    head = ends.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("idx"), F.lit(f"# {title}\n\n## Indice\n\n").alias("text"))
    rule = ends.select(F.lit(2), F.lit(0).cast("long"), F.lit("\n---\n\n"))
    lines = good.select(F.lit(1), "idx", F.concat(line, F.lit("\n")))
    bodies = good.crossJoin(F.broadcast(ends)).select(F.lit(3), "idx", F.concat(F.when(F.col("idx") == F.col("first"), "").otherwise("\n"), body))
    return head.union(lines).union(rule).union(bodies)


def document(entries: DataFrame, title: str, by: str | None = None) -> DataFrame:
    """One text per job; an empty job has no row. For long jobs use ``pieces``."""
    keys = [by] if by else []
    line, body = _part(F.col("title"), F.col("body"))
    good = entries.where("body is not null")
    a = good.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", line.alias("l"), body.alias("b")))).alias("x"), F.count("*").alias("n")).where("n > 0")
    part = lambda k: F.array_join(F.transform("x", lambda e: e[k]), "\n")
    return a.select(*keys, F.concat(F.lit(f"# {title}\n\n## Indice\n\n"), part("l"), F.lit("\n\n---\n\n"), part("b")).alias("document"))


def consolidated_name(flag, saved, guess, suffix: str = ".pdf"):
    """Flag, else saved, else guessed name with its suffix; null if it holds a forbidden character."""
    n = F.coalesce(F.nullif(F.trim(flag), F.lit("")), F.nullif(F.trim(saved), F.lit("")), guess)
    named = F.when(F.lower(n).endswith(suffix), n).otherwise(F.concat(n, F.lit(suffix)))
    return F.when(~n.rlike(r'[<>:"/\\|?*]'), named)


def csv_ready(rows: DataFrame) -> DataFrame:
    """Text columns in one line each: every line end is a space, white space at the ends goes."""
    one = lambda c: strip(F.translate(c, "\r\n", "  "))
    return rows.select(*[one(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])


def write_csv(rows: DataFrame, at: str) -> None:
    csv_ready(rows).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(at)


def json_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def json_report(summary: DataFrame, rows: DataFrame) -> DataFrame:
    """(part, idx, json): the summary, then the report rows in order; rows(idx, ...)."""
    head = json_rows(summary).select(F.lit("summary").alias("part"), F.lit(0).cast("long").alias("idx"), "json")
    return head.union(rows.select(F.lit("row"), F.col("idx").cast("long"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})))


def write_json(rows: DataFrame, at: str) -> None:
    json_rows(rows).write.mode("overwrite").text(at)


def write_exits(exits: DataFrame, at: str, header: str = "# exits, one a line") -> None:
    spark = exits.sparkSession
    spark.createDataFrame([(0, header)], "k int, value string").union(exits.select(F.lit(1), "exit")).coalesce(1).orderBy("k").select("value").write.mode("overwrite").text(at)
