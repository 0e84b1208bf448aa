"""The folder that driver and executors share, and tables and files in it.

Executors can be lost at any time, so nothing here relies on an executor's
memory or disk: intermediate tables are Parquet in the shared folder, written
by Spark's committer; files written by tasks carry the attempt in their name
and only those count that a committed table lists.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; where it is unset and the master is local, as in tests, a temporary folder of this machine."""
    conf = spark.sparkContext.getConf()
    if at := conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir isn't set: on a cluster intermediate tables need a folder that all executors share")
    made = tempfile.mkdtemp(prefix="shared-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def place(spark: SparkSession, name: str) -> str:
    """A new folder for one run's files of this name. Its files stay until the owner of the shared folder removes them: a lazy result may still read them."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables of hashes, of which a row group has too many for a dictionary: Parquet would build one, at half of the writing's CPU time, and drop it.
HASHES = ("line-words", "lines", "line-classes")


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again: cuts lineage, survives lost executors.

    The shuffle files behind it aren't needed any more, but Spark only deletes
    those of plans that the driver's collector has found to be unreachable, and
    of those that Python's has let go.
    """
    spark, schema, at = df.sparkSession, df.schema, place(df.sparkSession, name)
    df.write.options(**{"parquet.enable.dictionary": "false"} if name in HASHES else {}).parquet(at)
    del df
    give_back()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(at)
    out.written_at = at
    return out


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: int | str):
    """The session has this setting meanwhile, for what is planned and run there."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Rows of a batch on the way to Python, of texts or of documents' sets.
BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows that a task hands to Python at once: Spark's 10000 texts are tens of MB, which the JVM holds outside its heap while it copies them into larger buffers, and the worker again. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, BATCH)


def release(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of queries that have ended, before the next one writes its own; its listeners hold a plan until they have heard of the end."""
    with contextlib.suppress(Exception):  # an internal call; without it the files may stay until a later collection
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    give_back()
    spark.sparkContext._jvm.System.gc()


def remove(table: DataFrame) -> None:
    """Deletes a table that `written` made, by Spark's own file system, once all that was read from it is itself written."""
    context = table.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(table.written_at)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores before it as long as a column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def opened(uri: str):
    """(file system, path) of a URI, for tasks: local, HDFS and object stores alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


_turn: list = [None, None]


def give_back() -> None:
    """Returns the memory that this process has freed to the system; allocators keep it otherwise, beside what comes next."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc alone
        trim(0)


def take_turn(name: str, clear) -> None:
    """Tells that a worker now serves this operator: what another one kept in the worker's memory is given up."""
    if _turn[0] != name:
        if _turn[1] is not None:
            _turn[1]()
            give_back()
        _turn[:] = [name, clear]
