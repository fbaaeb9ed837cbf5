"""Overview, ranked search, dependencies and feature slices of a space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph import schema
from quarrygraph.functions.names import class_prefix, package_of_types, package_prefix
from quarrygraph.plans.space import Space, SymbolNotFound, containing, members

CONTAINED = "java.contained_in"


def overview_counts(space: Space) -> DataFrame:
    """(kind, name, count): entities by type, relations by type, totals of entities, relations and files."""
    types = space.cells.groupBy(F.lit("entity").alias("kind"), F.col("cell_type").alias("name")).agg(F.count("*").alias("count"))
    relations = space.incidences.groupBy(F.lit("relation").alias("kind"), F.col("relation_type").alias("name")).agg(F.count("*").alias("count"))
    total = space.cells.agg(F.count("*").alias("count")).select(F.lit("total").alias("kind"), F.lit("entities").alias("name"), "count")
    links = space.incidences.agg(F.count("*").alias("count")).select(F.lit("total").alias("kind"), F.lit("relations").alias("name"), "count")
    files = space.entities.where("file <> ''").agg(F.countDistinct("file").alias("count")).select(F.lit("total").alias("kind"), F.lit("files").alias("name"), "count")
    return types.unionAll(relations).unionAll(total).unionAll(links).unionAll(files).orderBy("kind", F.col("count").desc(), "name")


def overview_packages(space: Space) -> DataFrame:
    """Per package: classes (with enums and records), interfaces, methods (with constructors), fields; largest first."""
    of = lambda *kinds: F.count_if(F.col("entity_type").isin(*kinds))
    out = space.entities.withColumn("package", package_of_types(F.col("fqn"))).where("package <> ''").groupBy("package").agg(
        of("java.class", "java.enum", "java.record").alias("classes"), of("java.interface").alias("interfaces"), of(*schema.CALLABLE).alias("methods"), of("java.field").alias("fields")
    )
    return out.where("classes + interfaces + methods + fields > 0").orderBy((F.col("classes") + F.col("interfaces") + F.col("methods")).desc(), "package")


def search(space: Space, query: str, entity_type: str | None = None, limit: int = 30) -> DataFrame:
    """Entities whose full name or label contains query, those that begin with it first; total_matches on each row."""
    low = query.lower()
    hit = containing(space, low)
    if entity_type:
        hit = hit.where(F.col("entity_type").contains(entity_type.lower()))
    first = F.lower("label").startswith(low) | F.lower("fqn").startswith(low)
    found = hit.select("fqn", "entity_type", "label", "file", F.col("start_line").alias("line"), first.alias("_first"))
    total = found.agg(F.count("*").alias("total_matches"))
    top = found.orderBy(F.col("_first").desc(), "fqn", "entity_type", "line").limit(limit)
    return top.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total_matches") > limit).drop("_first")


def package_nodes(space: Space) -> DataFrame:
    return space.entities.groupBy(package_prefix(F.col("fqn")).alias("name")).agg(F.count("*").alias("entity_count")).where("name <> ''")


def _ends(space: Space, name: Column) -> DataFrame:
    """Incidences but containment, with what ``name`` makes of both ends' full names."""
    named = space.entities.select("cell_id", name.alias("name"))
    return (
        space.incidences.where(F.col("relation_type") != CONTAINED).select("from_cell_id", "to_cell_id", "relation_type")
        .join(named.withColumnsRenamed({"cell_id": "from_cell_id", "name": "from"}), "from_cell_id")
        .join(named.withColumnsRenamed({"cell_id": "to_cell_id", "name": "to"}), "to_cell_id")
    )


def package_dependencies(space: Space) -> DataFrame:
    """(from, to, relation_count) between different packages, most first."""
    ends = _ends(space, package_prefix(F.col("fqn"))).where("`from` <> `to` AND `from` <> '' AND `to` <> ''")
    return ends.groupBy("from", "to").agg(F.count("*").alias("relation_count")).orderBy(F.col("relation_count").desc(), "from", "to")


def class_dependencies(space: Space, name: str, strict: bool = False) -> DataFrame:
    """(from, to, relation_count) of the class's members with other classes.

    Members are entities whose full name begins with the class's, letter case apart; strict asks for a dot after it, so
    that User does not take in UserService.
    """
    low = name.lower()
    mine = F.lower("fqn").startswith(low + ".") | (F.lower("fqn") == low) if strict else F.lower("fqn").startswith(low)
    held = space.entities.select("cell_id", F.col("fqn"), mine.alias("mine"), class_prefix(F.col("fqn")).alias("cls"))
    if held.where("mine").isEmpty():
        raise SymbolNotFound(name)
    ends = (
        space.incidences.where(F.col("relation_type") != CONTAINED).select("from_cell_id", "to_cell_id")
        .join(held.select(F.col("cell_id").alias("from_cell_id"), F.col("mine").alias("fm"), F.col("cls").alias("fc")), "from_cell_id")
        .join(held.select(F.col("cell_id").alias("to_cell_id"), F.col("mine").alias("tm"), F.col("cls").alias("tc")), "to_cell_id")
        .where("fm OR tm")
    )
    near = F.when(F.col("fm"), F.struct(F.lit(name).alias("from"), F.col("tc").alias("to"))).otherwise(F.struct(F.col("fc").alias("from"), F.lit(name).alias("to")))
    edges = ends.select(near.alias("e")).select("e.from", "e.to").where((F.lower("from") != low) | (F.lower("to") != low))
    return edges.groupBy("from", "to").agg(F.count("*").alias("relation_count")).orderBy(F.col("relation_count").desc(), "from", "to")


def feature(space: Space, keyword: str) -> dict[str, DataFrame]:
    """The slice of a space around a keyword: classes, entry points, internal calls, external dependencies, data entities."""
    classes = containing(space, keyword).where(F.col("entity_type").isin("java.class", "java.interface", "java.enum"))
    if classes.isEmpty():
        raise SymbolNotFound(keyword)
    owners = classes.select(F.col("fqn").alias("owner")).distinct()
    held = members(space.entities, owners)
    counts = held.groupBy("owner").agg(F.count_if(F.col("entity_type").isin(*schema.CALLABLE)).alias("method_count"), F.count_if(F.col("entity_type") == "java.field").alias("field_count"))
    matched = classes.join(counts, classes["fqn"] == counts["owner"], "left").select("fqn", "label", "entity_type", "file", F.col("start_line").alias("line"), F.coalesce("method_count", F.lit(0)).alias("method_count"), F.coalesce("field_count", F.lit(0)).alias("field_count"))
    inside = held.select("cell_id", "fqn", "label", "entity_type", "file", "start_line").distinct().unionByName(classes.select("cell_id", "fqn", "label", "entity_type", "file", "start_line")).distinct()
    links = space.incidences.where(F.col("relation_type") != CONTAINED).select("from_cell_id", "to_cell_id", "relation_type")
    marked = (
        links.join(inside.select(F.col("cell_id").alias("from_cell_id"), F.col("fqn").alias("ff")), "from_cell_id", "left")
        .join(inside.select(F.col("cell_id").alias("to_cell_id"), F.col("fqn").alias("tf")), "to_cell_id", "left")
    )
    calls = marked.where(F.col("relation_type").isin(*schema.CALLS))
    callers = calls.where("ff IS NULL AND tf IS NOT NULL").groupBy(F.col("to_cell_id").alias("cell_id")).agg(F.count("*").alias("caller_count"))
    callees = calls.where("ff IS NOT NULL").groupBy(F.col("from_cell_id").alias("cell_id")).agg(F.count("*").alias("callee_count"))
    entry = (
        inside.where(F.col("entity_type").isin(*schema.CALLABLE)).join(callers, "cell_id", "left").join(callees, "cell_id", "left").fillna(0, ["caller_count", "callee_count"])
        .where("caller_count > 0 OR callee_count > 0").select("fqn", "label", "file", F.col("start_line").alias("line"), "caller_count", "callee_count")
    )
    outside = marked.where("ff IS NOT NULL AND tf IS NULL").join(space.entities.select(F.col("cell_id").alias("to_cell_id"), "fqn"), "to_cell_id")
    return {
        "matched_classes": matched.orderBy(F.col("method_count").desc(), "fqn"),
        "entry_points": entry.orderBy(F.col("caller_count").desc(), "fqn"),
        "internal_calls": marked.where("ff IS NOT NULL AND tf IS NOT NULL").select(F.col("ff").alias("from"), F.col("tf").alias("to"), "relation_type"),
        "external_dependencies": outside.select(class_prefix(F.col("fqn")).alias("fqn")).distinct().orderBy("fqn"),
        "data_entities": matched.where("field_count > floor(method_count / 2) AND field_count >= 3").select("fqn"),
    }
