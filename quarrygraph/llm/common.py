"""Shared pieces: the shared folder, lineage cuts, training split, ids for rows."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.session import bound_batches, cut, shared_dir

__all__ = ["let_go", "sliced", "worker_cache", "HELD_OUT_PARTS", "WORD", "cut", "fresh_path", "held_out", "planned_bytes", "read_table", "release", "shared_dir", "text_bytes", "written"]

WORD = r"[^\x20\x09-\x0D]+"
HELD_OUT_PARTS = 5


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a table of the shared folder and read again: a cut whose size Spark knows when it plans a join, so that
    it is broadcast below ``spark.sql.autoBroadcastJoinThreshold`` and else both sides are exchanged."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def planned_bytes(df: DataFrame) -> int | None:
    """The size that Spark's planner expects of df, None where it knows none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_PARTS == 0, F.lit(False))


def text_bytes(values) -> list[bytes]:
    """UTF-8 of an Arrow string array; null is empty."""
    return [(v or "").encode("utf-8", "replace") for v in values.to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], column: int, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about size bytes of the text column (one row at least): what a kernel makes of a slice is
    many times as large as its texts, and a batch may hold ten thousand long ones."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size, "right")))
            yield batch.slice(first, last - first)
            first = last


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CACHED: dict = {}
_TASK: list = [None]


def release() -> None:
    """Gives freed memory back to the system: the allocators keep what earlier tasks of this worker used, and a later
    operator's needs would come on top of it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def worker_cache(name: str, make):
    """The one large object that this Python worker keeps between tasks; what another operator kept is let go first."""
    if name not in _CACHED:
        _CACHED.clear()
        release()
        _CACHED[name] = make()
    return _CACHED[name]


def let_go() -> None:
    """For kernels that keep nothing: workers are shared by all operators, so an earlier one's cache must not stay."""
    from pyspark import TaskContext

    _CACHED.clear()
    task = TaskContext.get()
    if (now := task.taskAttemptId() if task else None) != _TASK[0]:  # once a task, not once a group
        _TASK[0] = now
        release()
