"""Keeps a table of source files up to date from a stream and lifts the whole project again after each batch.

References resolve against all symbols, so a changed file can change the edges of others: the file table is merged by path
(the newest version wins) and the space is rebuilt from it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrygraph.operators.findings import last_write
from quarrygraph.plans.lift import lift
from quarrygraph.plans.space import Space
from quarrygraph.session import keep
from quarrygraph.sources import store
from quarrygraph.sources.files import decoded


def stream_files(spark: SparkSession, root: str, pattern: str = "*.java") -> DataFrame:
    """(path, modified, text, encoding, lossy) of files as they appear or change below root, decoded as read_sources does."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return decoded(raw.select("path", F.col("modificationTime").alias("modified"), "content"))


def merge_files(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """The newest text of each path; a batch may hold several versions."""
    both = new if old is None else old.withColumn("modified", F.lit(None).cast("timestamp")).select(*new.columns).unionByName(new)
    ordered = both.withColumn("version", F.coalesce(F.unix_micros("modified"), F.lit(-1)))
    return last_write(ordered, "path").drop("version", "modified")


def relift(files: DataFrame, store_root: str, space_id: str, checkpoint: str, done: Callable[[Space], None] | None = None) -> StreamingQuery:
    """Starts a query that saves a new snapshot of the space after each batch of files (path, text, modified, encoding, lossy)."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        try:
            old = store.load(spark, store_root, space_id).source_files
        except FileNotFoundError:
            old = None
        files = keep(merge_files(old, df.select("path", "text", "encoding", "lossy", "modified")))
        space = lift(files, space_id)
        store.save(space, store_root)
        if done is not None:
            done(space)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
