"""Job documents: one JSON text per job, read with a fixed schema, migrated, and laid out as tables.

Snapshots are folders that appear by one rename, so the file system has to rename folders atomically, as HDFS and local
ones do; older versions are the rotating backups.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.urls import page_key

OUTPUT = "struct<filename:string,title:string,size_bytes:bigint,elapsed_seconds:double,sha256:string>"
FAILURE = "struct<error:string,attempts:int,last_attempt:string>"
SCHEMA = f"""
  version int, start_url string, started_at string, last_updated string, crawl_complete boolean, crawl_max_pages int,
  mapped_urls array<string>, crawl_queue array<string>, crawl_seen array<string>, crawl_leaves array<string>,
  exported map<string,{OUTPUT}>, exported_md map<string,{OUTPUT}>, failures map<string,string>,
  page_ids map<string,string>, consolidated_name string
"""
VERSIONS = (1, 2)
BACKUPS = 5


def _failure(v: Column) -> Column:
    """A failure entry: a struct as it is, else a v1 text, whose attempt count is in the text or 1."""
    n = F.regexp_extract(v, r"(?i)(\d+)\s*(?:tentativa|attempt)", 1)
    tries = F.greatest(F.lit(1), F.coalesce(F.when(n != "", n).try_cast("int"), F.lit(1)))
    old = F.struct(v.alias("error"), tries.alias("attempts"), F.lit(None).cast("string").alias("last_attempt"))
    return F.when(F.startswith(F.trim(v), F.lit("{")), F.from_json(v, FAILURE)).otherwise(old)


def parse_manifests(raw: DataFrame) -> DataFrame:
    """raw(dir, json) -> a row per valid job document; unknown versions and unusable ones give no row."""
    m = raw.select("dir", F.from_json("json", SCHEMA).alias("m")).select("dir", "m.*")
    m = m.where(F.coalesce("version", F.lit(1)).isin(*VERSIONS) & F.col("mapped_urls").isNotNull())
    lists = ("mapped_urls", "crawl_queue", "crawl_seen", "crawl_leaves")
    m = m.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists})
    m = m.withColumn("crawl_complete", F.coalesce("crawl_complete", F.lit(False)) & (F.size("mapped_urls") > 0))
    return m.withColumn("failures", F.transform_values(F.coalesce("failures", F.from_json(F.lit("{}"), "map<string,string>")), lambda k, v: _failure(v)))


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Jobs under ``root``, at depths 0 to 3; infrastructure directories are skipped."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").text(root)
    at = F.regexp_replace(F.col("_metadata.file_path"), "/manifest.json$", "")
    base = F.lit(root.rstrip("/"))
    deep = F.size(F.split(F.regexp_replace(at, F.concat(F.lit("^.*?"), F.regexp_replace(base, r"^\w+://", "")), F.lit("")), "/")) - 1
    raw = raw.select(at.alias("dir"), F.col("value").alias("json"), deep.alias("deep")).where("deep <= 3")
    return parse_manifests(raw.where(~F.col("dir").rlike(r"/(\.[^/]+|node_modules|__pycache__)(/|$)")))


def mapped(m: DataFrame) -> DataFrame:
    return m.select("dir", F.posexplode("mapped_urls").alias("pos", "url")).select("dir", (F.col("pos") + 1).alias("idx"), "url", page_key(F.col("url")).alias("page_key"))


def exported(m: DataFrame, kind: str = "exported", ord: str | None = None) -> DataFrame:
    """Outputs of each job; ``ord`` names a column for their place in the document."""
    every = F.coalesce(kind, F.from_json(F.lit("{}"), f"map<string,{OUTPUT}>"))
    if ord:
        return m.select("dir", F.posexplode(every).alias(ord, "url", "e")).select("dir", ord, "url", "e.*")
    return m.select("dir", F.explode(every).alias("url", "e")).select("dir", "url", "e.*")


def failures(m: DataFrame) -> DataFrame:
    return m.select("dir", F.explode("failures").alias("url", "f")).select("dir", "url", "f.*")


def crawl_state(m: DataFrame) -> DataFrame:
    """(dir, state, ord, url) of the queue, the seen pages and the leaves."""
    one = lambda c, s: m.select("dir", F.lit(s).alias("state"), F.posexplode(c).alias("ord", "url"))
    return one("crawl_queue", "queue").union(one("crawl_seen", "seen")).union(one("crawl_leaves", "leaf"))


def times(c: Column) -> Column:
    """The parsed form of a stored time; the stored text stays the order of jobs."""
    return F.try_to_timestamp(c)


class SnapshotTaken(Exception):
    """Another writer made this version."""


def _file_system(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put_if_absent(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder, or fail if there is one of the name already."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(b.getFileSystem(conf).getUri(), conf)
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.NONE
    try:
        files.rename(a, b, how)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
            raise SnapshotTaken(target) from None
        raise


def write_snapshot(m: DataFrame, root: str, version: int) -> str:
    """A new version of the job documents. It is written aside and becomes visible as a whole by one rename, which fails
    with ``SnapshotTaken`` if the version exists: of two writers one wins, and a run that breaks off before the rename
    leaves nothing but a folder under ``_tmp``, which is in nobody's way."""
    spark, root = m.sparkSession, root.rstrip("/")
    aside, at = f"{root}/_tmp/{uuid.uuid4().hex}", f"{root}/v={version:08d}"
    m.select(F.to_json(F.struct(*m.columns)).alias("value")).write.text(aside)
    try:
        _put_if_absent(spark, aside, at)
    except SnapshotTaken:
        path, files = _file_system(spark, aside)
        files.delete(path, True)
        raise
    return at


def versions(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(version, path) of the snapshots, the newest first; as many as ``expire_snapshots`` leaves."""
    path, files = _file_system(spark, f"{root.rstrip('/')}/v=*")
    found = [x.getPath().toString() for x in files.globStatus(path) or []]
    return sorted(((int(x.rpartition("v=")[2]), x) for x in found), reverse=True)


def expire_snapshots(spark: SparkSession, root: str, keep: int = BACKUPS) -> list[str]:
    """Delete the versions before the newest and the ``keep`` before it; returns their paths. A run that was cut short
    can be run again."""
    gone = []
    for _, at in versions(spark, root)[keep + 1 :]:
        path, files = _file_system(spark, at)
        if files.delete(path, True):
            gone.append(at)
    return gone


def recover_snapshots(spark: SparkSession, root: str, older_than: float = 86_400.0) -> list[str]:
    """Delete what writers that broke off left, as far as it is older than so many seconds; returns the paths."""
    path, files = _file_system(spark, f"{root.rstrip('/')}/_tmp/*")
    limit, gone = (time.time() - older_than) * 1000, []
    for x in files.globStatus(path) or []:
        if x.getModificationTime() <= limit and files.delete(x.getPath(), True):
            gone.append(x.getPath().toString())
    return gone


def latest_snapshot(spark: SparkSession, root: str) -> str | None:
    """Path of the newest version; the versions before it that ``expire_snapshots`` leaves are its backups."""
    found = versions(spark, root)
    return found[0][1] if found else None


def read_snapshot(spark: SparkSession, at: str, schema: StructType | str) -> DataFrame:
    """The job documents of a version; schema: that of the documents as they were written."""
    return spark.read.text(at).select(F.from_json("value", schema).alias("m")).select("m.*")


def update_snapshot(spark: SparkSession, root: str, schema: StructType | str, change: Callable[[DataFrame], DataFrame], tries: int = 5) -> str:
    """Write the change of the newest version as the next one. If another writer was faster, the change is made anew of
    what that one wrote, so no update is lost; without a version the change gets an empty table."""
    for left in reversed(range(tries)):
        newest = next(iter(versions(spark, root)), None)
        old = read_snapshot(spark, newest[1], schema) if newest else spark.createDataFrame([], schema)
        try:
            return write_snapshot(change(old), root, newest[0] + 1 if newest else 1)
        except SnapshotTaken:
            if not left:
                raise
    raise ValueError("tries must be 1 at least")
