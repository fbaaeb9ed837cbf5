"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def make_importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, whatever the working directory is.

    On a cluster without a shared installation submit the package with ``--py-files`` instead.
    """
    bound_batches(spark)
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *have])


#: Bytes of an Arrow batch on its way to a Python worker, unless the session was given another limit.
BATCH_BYTES, BATCH_DEFAULT = "8m", "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """Batches of long texts otherwise hold tens of megabytes for each running task, beside the heap and the worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) == BATCH_DEFAULT:
        spark.conf.set(key, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what the context's checkpoint folder was set to.

    A local session that names none gets a temporary one; on a cluster that would lie on one machine, so it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not own.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quarry-ckpt-"))
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and goes on from there: short lineage, nothing recomputed when executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes on disk above which a kept table is never broadcast: in memory it is many times as large.
SMALL_BYTES = 1 << 20


def keep(df: DataFrame) -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it back: a cut whose size the planner knows.

    A checkpoint keeps the estimate of the plan it cut off. Estimates of joins are products, so in a loop their digits double
    with each round, until the driver has no time or memory for anything else.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    out = spark.read.schema(df.schema).parquet(path)
    return out.hint("merge") if size > SMALL_BYTES else out


def spread(files: DataFrame) -> DataFrame:
    """files dealt by path over all cores, for work in Python: rows made from a small table come in very few partitions."""
    spark = files.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return files.repartition(n, "path")
