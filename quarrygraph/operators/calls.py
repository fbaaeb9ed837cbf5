"""Explanations, call graph, bounded impact and property checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph import schema
from quarrygraph.plans import graph
from quarrygraph.plans.space import Space, require


def _relations(space: Space, symbol: str, incoming: bool) -> DataFrame:
    cell = require(space, symbol).cell_id
    here, there = ("to_cell_id", "from_cell_id") if incoming else ("from_cell_id", "to_cell_id")
    if space.index:
        there, links = "other", space.index.near([cell], incoming, schema.REFERENCES)
    else:
        links = space.incidences.where((F.col(here) == cell) & F.col("relation_type").isin(*schema.REFERENCES))
    every = space.index.table("cells") if space.index else space.entities
    ends = every.select(F.col("cell_id").alias(there), "fqn", "label", F.col("file").alias("entity_file"), F.col("start_line").alias("entity_line"))
    return links.join(ends, there).select(
        F.col("fqn").alias("target"), F.col("label").alias("target_label"), "relation_type", F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
        F.coalesce("file", "entity_file").alias("file"), F.coalesce("start_line", "entity_line").alias("line"),
    ).orderBy("target", "relation_type", "line")


def callers(space: Space, symbol: str) -> DataFrame:
    """One row for each incidence that calls, constructs or accesses the symbol."""
    return _relations(space, symbol, True)


def callees(space: Space, symbol: str) -> DataFrame:
    """One row for each incidence from the symbol."""
    return _relations(space, symbol, False)


def explain(space: Space, symbol: str) -> DataFrame:
    """One row: the entity, its annotation with confidences, witness, callers, callees and unresolved references."""
    e = require(space, symbol)
    spark = space.spark
    cell = space.cells.where(F.col("cell_id") == e.cell_id).select("provenance.confidence").first()
    note = space.table("annotations").where(F.col("cell_id") == e.cell_id).first()
    rel = {True: callers(space, e.fqn), False: callees(space, e.fqn)}
    names = {k: v.where(F.col("relation_type").isin(*schema.CALLS)).agg(F.array_sort(F.collect_list("target"))).first()[0] for k, v in rel.items()}
    open_ = [r.target_text for r in space.table("unresolved").where(F.col("from_fqn") == e.fqn).select("target_text").distinct().orderBy("target_text").collect()]
    sure = float(cell.confidence) if cell is not None and cell.confidence is not None else 0.5
    told = lambda value, source: (value, sure, source) if value else None
    get = lambda k: note[k] if note is not None else None
    field = "struct<value:string,confidence:double,source:string>"
    row = (
        e.fqn, e.entity_type, e.label, told(get("intent"), "corroboration"), told(get("behavior"), "corroboration"), told(get("error_behavior"), "llm"),
        [told(x, "llm") for x in get("preconditions") or []], [told(x, "llm") for x in get("postconditions") or []], [told(x, "llm") for x in get("side_effects") or []],
        [(e.file, e.start_line, e.end_line)], names[True], names[False], open_,
    )
    return spark.createDataFrame([row], f"symbol string, entity_type string, signature string, intent {field}, behavior {field}, error_behavior {field}, preconditions array<{field}>, postconditions array<{field}>, side_effects array<{field}>, witnesses array<struct<file:string,start_line:int,end_line:int>>, callers array<string>, callees array<string>, obstructions array<string>")


def _search(space: Space, cell: str, max_depth: int, relations: tuple[str, ...] = (), reverse: bool = False) -> tuple[DataFrame, bool]:
    """Bounded search from one cell, by the lookup tables if the space has them."""
    if space.index:
        return space.index.search([cell], max_depth, relations, incoming=reverse)
    return graph.search(space.calls(*relations), space.spark.createDataFrame([(cell,)], "node string"), max_depth, reverse=reverse, stored=space.stored)


def _named(space: Space, found: DataFrame) -> DataFrame:
    return space.index.entities(found) if space.index else found.join(space.entities, "cell_id")


def impact(space: Space, symbol: str, max_depth: int = 3) -> DataFrame:
    """Everything that reaches the symbol along incoming calls, construction, inheritance or type references.

    (fqn, label, file, line, depth, scope): shortest depth; scope is direct at depth 1, else transitive.
    """
    cell = require(space, symbol).cell_id
    found, _ = _search(space, cell, max_depth, schema.IMPACT, reverse=True)
    hit = _named(space, found.where("depth > 0").withColumnRenamed("node", "cell_id"))
    return hit.select("fqn", "label", "file", F.col("start_line").alias("line"), "depth", F.when(F.col("depth") == 1, "direct").otherwise("transitive").alias("scope")).orderBy("depth", "fqn")


def affected_files(impacts: DataFrame) -> DataFrame:
    return impacts.where("file IS NOT NULL AND file <> ''").select("file").distinct().orderBy("file")


def enforces(space: Space, entry: str, relation: str, max_depth: int = 5) -> DataFrame:
    """One row: whether every bounded walk from the entry can meet an edge of the relation.

    satisfied: such an edge leaves a node at a depth below max_depth; violated: there is none and all was visited;
    unknown: the bound was met first. visited: the first 20 full names in the order of depth and name.
    """
    cell = require(space, entry).cell_id
    want = relation if relation.startswith("java.") else f"java.{relation}"
    found, exhausted = _search(space, cell, max_depth)
    inner = found.where(F.col("depth") < max_depth).select("node")
    hit = not (space.index.near(inner, False, (want,)) if space.index else inner.join(space.calls(want).select(F.col("src").alias("node")), "node", "left_semi")).isEmpty()
    status = "satisfied" if hit else "violated" if exhausted else "unknown"
    visited = [r.fqn for r in _named(space, found.withColumnRenamed("node", "cell_id")).orderBy("depth", "fqn").select("fqn").limit(20).collect()]
    return space.spark.createDataFrame([(entry, want, status, exhausted, visited)], "entry_symbol string, required_relation string, status string, exhaustive boolean, visited array<string>")
