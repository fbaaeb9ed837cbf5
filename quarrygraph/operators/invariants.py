"""Structural invariants of a space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.plans import graph
from quarrygraph.plans.space import Space

_COLUMNS = ["invariant_name", "cell_id", "message", "severity"]


def grounding(space: Space) -> DataFrame:
    """Cells without provenance are errors, without a source place warnings."""
    bare = F.col("provenance").isNull()
    lost = space.cells.where(bare | F.col("provenance.uri").isNull() | (F.col("provenance.uri") == ""))
    return lost.select(F.lit("grounding").alias("invariant_name"), "cell_id", F.when(bare, "no provenance").otherwise("no source place").alias("message"), F.when(bare, "error").otherwise("warning").alias("severity"))


def reachability(space: Space, first: str | None = None) -> DataFrame:
    """Cells that no path of any relations, direction ignored, links with the first cell."""
    if space.index:
        comp = space.index.labels().select(F.col("cell_id").alias("node"), F.col("by_all").alias("component"))
    else:
        comp = graph.components(space.cells.select(F.col("cell_id").alias("node")), space.calls(), space.stored)
    start = first or space.cells.agg(F.min("cell_id")).first()[0]
    home = comp.where(F.col("node") == start).select("component")
    apart = comp.join(home, "component", "left_anti")
    return apart.select(F.lit("reachability").alias("invariant_name"), F.col("node").alias("cell_id"), F.lit("not reachable from the first cell").alias("message"), F.lit("warning").alias("severity"))


def acyclicity(space: Space, relation: str = "java.extends", most: int | None = 10, longest: int = 20) -> DataFrame:
    """Inheritance cycles, each once, labels joined by arrows."""
    found = graph.cycles(space.calls(relation), most, longest).withColumn("cycle", F.monotonically_increasing_id())
    steps = found.select("cycle", F.posexplode(F.concat("path", F.array(F.col("path")[0]))).alias("pos", "cell_id"))
    labels = steps.join(space.cells.select("cell_id", "label"), "cell_id").groupBy("cycle").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda s: s["label"]), " → ").alias("message"))
    return found.join(labels, "cycle").select(F.lit("acyclicity").alias("invariant_name"), F.col("path")[0].alias("cell_id"), "message", F.lit("error").alias("severity"))


def consistency(space: Space) -> DataFrame:
    """Holds for every space that can be built."""
    return grounding(space).where("false")


def check(space: Space) -> DataFrame:
    """All violations."""
    out = grounding(space)
    for f in (reachability, acyclicity, consistency):
        out = out.unionByName(f(space))
    return out.select(_COLUMNS)
