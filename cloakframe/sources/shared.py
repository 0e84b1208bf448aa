"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; where it is unset and the master is local, as in tests, a temporary folder of this machine."""
    if at := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir isn't set: on a cluster intermediate tables need a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tables-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written there and read again: computed once, and safe from lost executors."""
    at = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt to enough tasks, for work that is heavy for each row, where a scan has fewer: small files of few row groups.

    Only plans without a shuffle are looked at; what was shuffled is left as it is, as counting its partitions would run it.
    """
    if df.isStreaming:
        return df
    plan, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() >= 4 * cores:
        return df
    return df.repartition(3 * cores)


def one_worker(df: DataFrame) -> DataFrame:
    """The rows, written first if their plan already hands texts to Python: each such step of a stage has a worker of its own in every task, with its own matcher."""
    if df.isStreaming or "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString():
        return df
    return written(df, "documents")


def opened(uri: str):
    """(file system, path) of a URI, for tasks: local, HDFS and object stores alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
