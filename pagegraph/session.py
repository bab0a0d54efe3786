"""Session helpers: reading tables, shipping this package to the executors, staged tables.

Staged tables cut lineage: they are Parquet files in the shared folder that the session names in
``spark.checkpoint.dir``, so a lost executor never loses them.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that go to a Python worker at a time: texts differ in length, so a number of rows bounds nothing.
BATCH_BYTES = 8 << 20
FILE_ROWS, FILE_BYTES, BUCKET_BYTES = 250_000, 32 << 20, 1 << 20
#: How staged tables are written. On file systems without a store behind them Spark's writer starts a process to set the
#: mode of each file, of the folder of each task that writes one, and of a file of checksums beside it; Parquet has
#: checksums of its own, so these are left out. Until such a process runs its program it counts as large as the executor.
STAGED_AS = {"compression": "zstd", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_LOCK = threading.Lock()
_SHIPPED: set[str] = set()
_STAGED: dict[str, SparkSession] = {}
_NAMED: dict[str, str] = {}


def local_session(app: str = "pagegraph", cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application, and bound their batches by bytes."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{64 << 20}b":  # Spark's default; another value was asked for
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    with _LOCK:
        if sc.applicationId in _SHIPPED:
            return
        root = Path(__file__).resolve().parent
        at = os.path.join(tempfile.mkdtemp(prefix="pagegraph-"), "pagegraph_code.zip")
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        sc.addPyFile(at)
        _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a folder of this machine only where none is set and all runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def _delete(spark: SparkSession, at: str) -> None:
    try:
        if at in _NAMED:
            spark.sql(f"DROP TABLE IF EXISTS {_NAMED.pop(at)}")
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may already be gone at exit
        pass


@atexit.register
def sweep() -> None:
    """Delete every table staged by this process."""
    for at, spark in list(_STAGED.items()):
        _delete(spark, at)
    _STAGED.clear()


@contextmanager
def staging():
    """Tables staged inside are deleted on leaving; what is made of them has to be written before."""
    before = set(_STAGED)
    try:
        yield
    finally:
        for at in [x for x in _STAGED if x not in before]:
            _delete(_STAGED.pop(at), at)


def stage_path(spark: SparkSession, name: str) -> str:
    at = f"{shared_dir(spark)}/pagegraph/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _STAGED[at] = spark
    return at


def whole(spark: SparkSession, at: str) -> bool:
    """Whether a table was written there to its end: the writer puts its mark last."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


class Growing:
    """A staged table that grows by a set of files at a time; it is read whole, in one scan whatever their number."""

    def __init__(self, spark: SparkSession, name: str, schema: str):
        self.spark, self.at, self.schema, self.paths = spark, stage_path(spark, name), schema, []

    def add(self, df: DataFrame) -> DataFrame:
        """Write these rows too and give them back as stored."""
        self.paths.append(f"{self.at}/{len(self.paths)}")
        df.write.options(**STAGED_AS).parquet(self.paths[-1])
        return self.spark.read.schema(self.schema).parquet(self.paths[-1])

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths) if self.paths else self.spark.createDataFrame([], self.schema)


def stage_bucketed(df: DataFrame, name: str, key: str, of: DataFrame) -> DataFrame:
    """Write ``df``, dealt out by ``key`` already (by a join or an aggregation), to the shared folder in as many
    buckets as the session's shuffles have and read it back: joins by the key that follow need no shuffle of this
    side. The table's name lives as long as its files.

    of: the stored table that ``df`` is made of. Where it has less than ``BUCKET_BYTES`` a bucket, so many files cost
    more than the shuffles they spare: ``df`` is then staged without buckets.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if parts > file_parts(of) and stored_bytes(of) < parts * BUCKET_BYTES:
        return stage(df, name, of=of)
    at = stage_path(spark, name)
    _NAMED[at] = "pagegraph_" + at.rsplit("-", 1)[-1]
    df.write.options(**STAGED_AS).format("parquet").option("path", at).bucketBy(parts, key).saveAsTable(_NAMED[at])
    return spark.table(_NAMED[at])


def stored_bytes(table: DataFrame) -> int:
    """Spark's size statistics of a stored table."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def file_parts(table: DataFrame) -> int:
    """Partitions for what is made of a stored table: one for each ``FILE_BYTES`` of its files, two a core at least."""
    return min(1 << 20, max(2 * table.sparkSession.sparkContext.defaultParallelism, -(-stored_bytes(table) // FILE_BYTES)))


def few(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df``, made of a stored table, in no more partitions, so files, than its size asks for; without a shuffle."""
    return df.coalesce(file_parts(table))


def stage(df: DataFrame, name: str, rows: int | None = None, of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    rows: what the table has at most, where that is known; it then gets a file for each ``FILE_ROWS`` of them, in place
    of one for each partition of a shuffle. of: a stored table that it is made of and that sets the number of files.
    """
    spark = df.sparkSession
    at = stage_path(spark, name)
    out = df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))
    out = out if of is None else few(out, of)
    out.write.options(**STAGED_AS).parquet(at)
    return spark.read.schema(df.schema).parquet(at)
