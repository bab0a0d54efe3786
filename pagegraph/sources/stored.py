"""Other stored inputs: REST child listings, output files, exit lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls

PAGE_SIZE, MAX_API_PAGES = 200, 20
RESULTS = "array<struct<id:string,_links:struct<webui:string>,children:struct<page:struct<size:int,results:array<struct<id:string>>>>>>"
API_PAGE = f"struct<size:int,limit:int,_links:struct<next:string>,results:{RESULTS}>"

MIN_PDF = 3 * 1024


def api_pages(raw: DataFrame, most: int | None = MAX_API_PAGES) -> DataFrame:
    """raw(parent_id, start, json), the pages of listings -> the decoded ones that count, with ``more``, whether another
    one follows, and ``truncated``, whether the parent has children beyond the last one that counts.

    The first ``most`` of a parent count, whatever their size; all of them if it is None.
    """
    p = raw.select("parent_id", "start", F.from_json("json", API_PAGE).alias("p")).select("parent_id", "start", "p.*")
    n = F.coalesce(F.size("results"), F.lit(0))
    p = p.withColumn("more", more_pages(F.col("_links.next").isNotNull(), F.coalesce("size", n), F.col("limit")))
    if most is None:
        return p.withColumn("truncated", F.lit(False))
    listing = Window.partitionBy("parent_id")
    p = p.withColumn("nth", F.row_number().over(listing.orderBy("start"))).where(F.col("nth") <= most)
    last = (F.col("nth") == most) & F.col("more") & (n > 0)
    return p.withColumn("truncated", F.max(last).over(listing)).drop("nth")


def more_pages(has_next: Column, size: Column, limit: Column) -> Column:
    return F.when(has_next, True).when(limit.isNotNull() & (limit > 0), size >= limit).otherwise(size >= PAGE_SIZE)


def next_start(start: Column, results: Column) -> Column:
    return start + F.size(results)


def child_refs(pages: DataFrame, base: str, start_is_public: bool) -> DataFrame:
    """(parent_id, ord, url, page_id, is_leaf): is_leaf is null where the listing does not say."""
    r = pages.select("parent_id", "start", F.posexplode("results").alias("pos", "r"))
    kids = F.col("r.children.page")
    leaf = F.when(kids["size"].isNotNull(), kids["size"] == 0).when(kids["results"].isNotNull(), F.size(kids["results"]) == 0)
    link = F.coalesce("r._links.webui", F.lit(""))
    url = urls.match_form(F.concat(F.lit(base), link), F.lit(start_is_public))
    return r.where(link != "").select("parent_id", (F.col("start") + F.col("pos")).alias("ord"), url.alias("url"), F.nullif("r.id", F.lit("")).alias("page_id"), leaf.alias("is_leaf"))


def binary_files(spark: SparkSession, root: str, glob: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)


def checked_files(files: DataFrame) -> DataFrame:
    """files(path, length, content) -> filename, valid, sha256: size, the first 16 bytes, end mark near the end."""
    head = F.decode(F.substring("content", 1, 16), "ISO-8859-1")
    page = F.contains(F.lower(head), F.lit("<html")) | F.contains(F.lower(head), F.lit("<!doctype"))
    tail = F.decode(F.expr("substring(content, greatest(1, length(content) - 1023), 1024)"), "ISO-8859-1")
    valid = (F.col("length") >= MIN_PDF) & F.startswith(head, F.lit("%PDF-")) & ~page & F.contains(tail, F.lit("%%EOF"))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "length", valid.alias("valid"), F.sha2("content", 256).alias("sha256"))


def exit_list(lines: DataFrame) -> DataFrame:
    """lines(n, line) -> (n, exit, bad): comments and blanks go, the first of equal exits stays, refused lines
    are marked with their number."""
    t = lines.select("n", urls.strip(F.col("line")).alias("line")).where("line <> '' and not startswith(line, '#')")
    e = t.withColumn("exit", urls.exit_url(F.col("line")))
    good = e.where("exit is not null").groupBy("exit").agg(F.min("n").alias("n")).select("n", "exit", F.lit(False).alias("bad"))
    direct = F.lower("line").isin(*urls.DIRECT_WORDS)
    return good.union(e.where(F.col("exit").isNull() & ~direct).select("n", "line", F.lit(True)))


def exit_source(flag: Column, file: Column, env: Column) -> Column:
    return F.coalesce(F.nullif(flag, F.lit("")), F.nullif(file, F.lit("")), F.nullif(env, F.lit("")), F.lit("direct"))
