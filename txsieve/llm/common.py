"""Session helpers, bounded label samples and connected components shared by the operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txsieve.functions.session import SWEEP

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TEXTS_A_BATCH = 2000


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and make sure that checkpoint() has a folder.

    The folder of ``spark.checkpoint.dir`` is used as it is; a folder of our own is set only
    where none is configured and all tasks run in this process (a local test session). On a cluster
    a missing folder is an error, as executors could not read the driver's disk.

    Arrow batches are of ``TEXTS_A_BATCH`` rows where the session has Spark's own default, as texts are large.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_A_BATCH))
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, ROOT])
    if spark.sparkContext.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark


@contextmanager
def swept(spark: SparkSession):
    """Statements whose shuffle files go when they end; otherwise these wait for the driver's garbage collection."""
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SWEEP) if before is None else spark.conf.set(SWEEP, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Eager, reliable checkpoint in the shared folder: survives lost executors."""
    prepare(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again: their size is known to the optimiser.

    What was shuffled for them is deleted once they are written: nothing else reads it.
    """
    spark = prepare(df.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"
    with swept(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def labelled_sample(labels: DataFrame, label: str, per_class: int | tuple[int, int], keep) -> DataFrame:
    """At most ``per_class`` labelled ids of each class (or so many of 0 and of 1): (doc_id, label), in hash order.

    ``keep`` is the condition that admits a row to training. One label per id is used, the
    smallest; rows with a null id or a label other than 0 and 1 are left out. The result has
    at most 2 * per_class rows (or their sum), which is the bound for broadcasting it.
    """
    one = (
        labels.where(keep & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    most = per_class if isinstance(per_class, tuple) else (per_class, per_class)
    parts = [one.where(F.col("label") == c).orderBy(*order).limit(n) for c, n in enumerate(most)]
    return parts[0].unionByName(parts[1])


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n)), F.lit(0)).cast("int")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) edges: (node, component), component = smallest node.

    Each round every root hooks to its smallest neighbour, parents are shortened by pointer
    jumping, and the edges are contracted to the new roots. Stars vanish in one round, chains
    in a logarithmic number. Nothing but row counts reaches the driver; a hub's rows are
    reduced by map-side minimums, and the joins are ones that Spark can split when skewed.
    """
    e = checkpoint(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    )
    labels = e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        parent = checkpoint(e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")))
        for _ in range(max_rounds):
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            jumped = checkpoint(
                parent.join(up, "parent", "left").select("node", "parent", F.coalesce("grand", "parent").alias("top"))
            )
            parent = jumped.select("node", F.col("top").alias("parent"))
            if jumped.where("top <> parent").isEmpty():
                break
        step = parent.select(F.col("node").alias("component"), F.col("parent").alias("root"))
        labels = checkpoint(
            labels.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        )
        pa = parent.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        pb = parent.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        x, y = F.coalesce("ra", "a"), F.coalesce("rb", "b")
        e = checkpoint(
            e.join(pa, "a", "left")
            .join(pb, "b", "left")
            .select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
            .where("a < b")
            .distinct()
        )
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return labels
