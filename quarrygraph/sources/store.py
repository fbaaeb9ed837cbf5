"""The store: below ``spaces/<id>`` one folder a version with a Parquet folder a table, and a pointer to the current one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph import schema
from quarrygraph.plans.space import Space

from . import index

TABLES = ("cells", "incidences", "entities", "unresolved", "annotations", "source_files", "source_lines", "obstructions")
POINTER = "current"


def save(space: Space, root: str, indexed: bool = False) -> str:
    """Writes all tables as a new version, with lookup tables if indexed, then switches the pointer to it; the folder's path.

    A crash before the switch leaves the version before as it was. That one stays on disk, since a loaded space may still
    be read from it; older ones go.
    """
    path = f"{root.rstrip('/')}/spaces/{space.space_id}"
    fs, at = _fs(space.spark, path)
    before, version = _current(space.spark, path), f"v-{uuid.uuid4().hex}"
    for name in TABLES:
        space.table(name).write.parquet(f"{path}/{version}/{name}")
    if indexed:
        read = lambda name: space.spark.read.schema(getattr(schema, name.upper())).parquet(f"{path}/{version}/{name}")
        index.build(space.spark, f"{path}/{version}/index", read("entities"), read("incidences"), read("cells"))
    beside = at(f"{path}/{version}/{POINTER}")
    out = fs.create(beside, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm = space.spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.getFileSystem(_conf(space.spark)).getUri(), _conf(space.spark))
    options = space.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(beside), fs.makeQualified(at(f"{path}/{POINTER}")), options)
    for s in fs.listStatus(at(path)):
        if s.isDirectory() and s.getPath().getName() not in (version, before):
            fs.delete(s.getPath(), True)
    return path


def _conf(spark: SparkSession):
    return spark.sparkContext._jsc.hadoopConfiguration()


def _current(spark: SparkSession, path: str) -> str | None:
    """The version that the pointer names."""
    fs, at = _fs(spark, path)
    pointer = at(f"{path}/{POINTER}")
    if not fs.exists(pointer):
        return None
    held = fs.open(pointer)
    try:
        return bytes(held.readAllBytes()).decode()
    finally:
        held.close()


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def load(spark: SparkSession, root: str, space_id: str) -> Space:
    path = f"{root.rstrip('/')}/spaces/{space_id}"
    version = _current(spark, path)
    if version is None:
        raise FileNotFoundError(path)
    at, folder = _fs(spark, path)[1], f"{path}/{version}/index"
    lookup = index.open_index(spark, folder) if _fs(spark, path)[0].exists(at(f"{folder}/about/_SUCCESS")) else None
    return Space(space_id=space_id, index=lookup, stored=True, **{n: spark.read.schema(getattr(schema, n.upper())).parquet(f"{path}/{version}/{n}") for n in TABLES})


def list_spaces(spark: SparkSession, root: str) -> DataFrame:
    """(space_id, cells, incidences, entities)."""
    top = f"{root.rstrip('/')}/spaces"
    fs, at = _fs(spark, top)
    names = sorted(s.getPath().getName() for s in fs.listStatus(at(top)) if _current(spark, f"{top}/{s.getPath().getName()}")) if fs.exists(at(top)) else []
    rows = [(n, *(getattr(load(spark, root, n), t).count() for t in ("cells", "incidences", "entities"))) for n in names]
    return spark.createDataFrame(rows, "space_id string, cells long, incidences long, entities long").orderBy("space_id")


def write_markdown(text: str, spark: SparkSession, path: str) -> None:
    """One text file in the folder path."""
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def snapshot_rows(space: Space) -> DataFrame:
    """(table, json) rows of the whole space, for other programs."""
    out = None
    for name in TABLES:
        df = space.table(name)
        one = df.select(F.lit(name).alias("table"), F.to_json(F.struct(*df.columns)).alias("json"))
        out = one if out is None else out.unionByName(one)
    return out
