"""Where intermediate tables live: the shared folder the cluster names."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
# the folders that running jobs of a thread have asked for, a list for each job
_JOBS = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; only a local session without one gets a folder of its own."""
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder all executors share")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="commitloom-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/commitloom-{uuid.uuid4().hex}"
    for folders in getattr(_JOBS, "stack", [])[-1:]:
        folders.append(path)
    return path


def cleared(job: Callable) -> Callable:
    """A job whose first argument is the session and whose result is written elsewhere: the folders that it
    asked for are removed when it ends, or fails."""

    @functools.wraps(job)
    def run(spark: SparkSession, *args, **kw):
        stack = _JOBS.__dict__.setdefault("stack", [])
        stack.append([])
        try:
            return job(spark, *args, **kw)
        finally:
            for path in stack.pop():
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return run


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read back; runs a job."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
