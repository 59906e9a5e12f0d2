"""Checkpoints that survive lost executors, and imports in Python workers."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """A checkpoint folder (the session's own, or a local one in tests), and this package for workers."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, ROOT])
    if spark.sparkContext.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark


#: Shuffle files go when the statement that wrote them ends; otherwise they wait for the driver's garbage collection.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
#: Bytes of a table's files up to which it is broadcast unasked: it passes through the driver, and rows are many times their files.
MOST_BROADCAST = 512 * 1024
_lock = threading.Lock()
_writing: dict = {}  # of a session: how many tables it writes now, and what it was set to before


@contextmanager
def writing(spark: SparkSession):
    """Settings of a table's statement. Threads may write at once: the first one sets, the last one sets back."""
    with _lock:  # a stream's batches have a session of their own, with its own settings
        of = _writing.setdefault((spark.sparkContext.applicationId, spark._jsparkSession.hashCode()), [0, {}])
        if not of[0]:
            of[1] = {name: spark.conf.get(name, None) for name in (SWEEP, BROADCAST)}
            spark.conf.set(SWEEP, "true")
            usual = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
            spark.conf.set(BROADCAST, str(min(usual, MOST_BROADCAST)))
        of[0] += 1
    try:
        yield
    finally:
        with _lock:
            of[0] -= 1
            if not of[0]:
                for name, value in of[1].items():
                    spark.conf.unset(name) if value is None else spark.conf.set(name, value)


_scopes = threading.local()  # of a thread: lists of the tables that it writes, the innermost last


@contextmanager
def scratch(spark: SparkSession):
    """Tables that this thread writes by cut() inside are deleted at the end, but those that the given list's tables read.

    Add to the list what is to be read on. In a scope inside another, the outer one does not know what was written.
    """
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append(written := [])
    kept: list[DataFrame] = []
    try:
        yield kept
        needed = {f.rpartition("/")[0].rpartition("/")[2] for df in kept for f in df.inputFiles()} if written else ()
        for folder in written:
            if folder.rpartition("/")[2] not in needed:
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    finally:
        stack.pop()


def cut(df: DataFrame) -> DataFrame:
    """Write a DataFrame to a table in the checkpoint folder and read it back.

    Like checkpoint(), this ends the lineage in storage that all executors share, but the rows are computed
    once, and later reads prune columns. Tables of a session lie in one folder, cut-<application id>. What was
    shuffled for a table is deleted once it is written: nothing else reads it. Only small tables are broadcast.
    """
    spark = prepare(df.sparkSession)
    sc = spark.sparkContext
    path = f"{sc.getCheckpointDir()}/cut-{sc.applicationId}/{uuid.uuid4().hex}"
    with writing(spark):
        df.write.parquet(path)
    if stack := _scopes.__dict__.get("stack"):
        stack[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing reads any more; folders of others stay."""
    for df in tables:
        spark = df.sparkSession
        own = f"{spark.sparkContext.getCheckpointDir()}/cut-{spark.sparkContext.applicationId}/"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            at = path(folder)
            if at.toUri().getPath().startswith(path(own).toUri().getPath()):
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
