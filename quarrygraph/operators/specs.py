"""Specifications: loss of a projection, export, enrichment work lists, annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph import schema
from quarrygraph.functions.names import package_of_types, parent_name, simple_name
from quarrygraph.plans.space import Space, SymbolNotFound, members, require
from quarrygraph.session import keep

from .calls import callees, callers
from .evidence import has_content
from .findings import last_write

INSTRUCTIONS = "Read the source, its callers and callees; state intent, behavior, preconditions, postconditions, side effects and error behavior, each with the lines that show it."


def sections(space: Space) -> DataFrame:
    """(section, cell_id) of types with their methods and constructors; nested members count for outer types too."""
    types = space.entities.where(F.col("entity_type").isin(*schema.CLASS_LIKE)).select(F.col("fqn").alias("owner"), F.col("cell_id").alias("own"))
    called = space.entities.where(F.col("entity_type").isin(*schema.CALLABLE)).select("fqn", "cell_id")
    inner = members(called, types.select("owner").distinct()).select(F.col("owner").alias("section"), "cell_id")
    return types.select(F.col("owner").alias("section"), F.col("own").alias("cell_id")).unionByName(inner)


def spec_loss(space: Space) -> DataFrame:
    """One row of counts: what a specification of one section a type leaves out or folds together."""
    held = sections(space)
    sources = space.cells.select("cell_id").distinct()
    omitted = sources.join(held.select("cell_id").distinct(), "cell_id", "left_anti")
    folded = held.groupBy("section").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.expr("k * (k - 1) div 2")), F.lit(0)).alias("collapsed_pair_count"), F.count("*").alias("projected_sections"))
    noted = space.table("annotations").where(has_content()).select("cell_id")
    undeclared = held.join(noted, "cell_id", "left_anti").agg(F.countDistinct("cell_id").alias("unannotated_members"))
    left = omitted.agg(F.count("*").alias("omitted_count"))
    examples = omitted.join(space.entities, "cell_id", "left").orderBy(F.coalesce("fqn", "cell_id")).limit(5).agg(F.array_sort(F.collect_list(F.coalesce("fqn", "cell_id"))).alias("omitted_examples"))
    total = sources.agg(F.count("*").alias("total_sources"))
    out = total.crossJoin(folded).crossJoin(left).crossJoin(undeclared).crossJoin(examples)  # one row each
    risk = F.when(F.col("omitted_count") == 0, "low").when(F.col("omitted_count") * 2 < F.col("total_sources"), "medium").otherwise("high")
    return out.withColumn("risk_severity", risk)


def export_lines(space: Space) -> DataFrame:
    """(ord, line): the specification as Markdown lines in order, built as rows."""
    types = space.entities.where(F.col("entity_type").isin(*schema.CLASS_LIKE)).select(F.col("fqn").alias("cls"), "cell_id", "entity_type", F.col("label").alias("name"))
    called = space.entities.where(F.col("entity_type").isin(*schema.CALLABLE))
    inner = members(called.select("fqn", "cell_id", "label", "start_line"), types.select(F.col("cls").alias("owner")).distinct())
    notes = space.table("annotations").where(has_content())
    text = lambda c, title: F.when(F.coalesce(F.col(c) != "", F.lit(False)), F.concat(F.lit(f"- {title}: "), F.col(c)))
    many = lambda c, title: F.when(F.coalesce(F.size(c) > 0, F.lit(False)), F.concat(F.lit(f"- {title}: "), F.array_join(c, "; ")))
    bullets = F.array_compact(F.array(text("intent", "Intent"), text("behavior", "Behavior"), many("preconditions", "Preconditions"), many("postconditions", "Postconditions"), many("side_effects", "Side effects"), text("error_behavior", "Errors")))
    noted = notes.select("cell_id", bullets.alias("bullets"))
    lines = lambda head: F.concat(F.array(head), F.coalesce("bullets", F.array(F.lit("- not yet annotated"))))
    pkg = package_of_types(F.col("cls"))
    a = types.join(noted, "cell_id", "left").select(pkg.alias("pkg"), "cls", F.lit(-1).alias("at"), F.lit("").alias("m"), lines(F.concat(F.lit("### `"), simple_name(F.col("cls")), F.lit("`"))).alias("ls"))
    b = inner.join(noted, "cell_id", "left").select(package_of_types(F.col("owner")).alias("pkg"), F.col("owner").alias("cls"), F.col("start_line").alias("at"), F.col("fqn").alias("m"), lines(F.concat(F.lit("#### `"), F.col("label"), F.lit("`"))).alias("ls"))
    p = types.select(pkg.alias("pkg")).distinct().select("pkg", F.lit("").alias("cls"), F.lit(-2).alias("at"), F.lit("").alias("m"), F.array(F.concat(F.lit("## Package `"), "pkg", F.lit("`"))).alias("ls"))
    return a.unionByName(b).unionByName(p).select("pkg", "cls", "at", "m", F.posexplode("ls").alias("k", "line"))


def export_spec(space: Space) -> str:
    """The specification as one Markdown text (a project's classes; streamed to the driver row by row)."""
    n = space.entities.count(), space.incidences.count(), space.table("annotations").where(has_content()).count()
    head = ["# Specification", "", f"{n[0]} entities, {n[1]} relations, {n[2]} annotated.", ""]
    rows = export_lines(space).orderBy("pkg", "cls", "at", "m", "k").select("line").toLocalIterator()
    return "\n".join(head + [r.line for r in rows]) + "\n"


def enrich(space: Space, symbol: str) -> DataFrame:
    """One row with what an annotator needs: source slice, callers, callees, containing class, instructions."""
    e = require(space, symbol)
    lines = space.table("source_lines").where((F.col("path") == e.file) & F.col("line_no").between(e.start_line, e.end_line))
    source = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n")).first()[0]
    names = [sorted({r.target for r in f(space, e.fqn).select("target").collect()}) for f in (callers, callees)]
    owner = space.entities.where((F.col("fqn") == e.fqn.rpartition(".")[0]) & F.col("entity_type").isin(*schema.CLASS_LIKE)).first()
    row = (e.fqn, e.entity_type, e.label, source or "", e.file, e.start_line, e.end_line, owner.fqn if owner else None, INSTRUCTIONS, names[0], names[1])
    return space.spark.createDataFrame([row], "symbol string, entity_type string, signature string, source_code string, file string, start_line int, end_line int, containing_class string, instructions string, callers array<string>, callees array<string>")


def enrich_batch(space: Space, scope: str | None = None, limit: int = 10) -> DataFrame:
    """The next entities to annotate with their source, in the order of names; all in one plan."""
    noted = space.table("annotations").where(has_content()).select("cell_id")
    todo = space.entities.where(F.col("entity_type").isin("java.method", "java.constructor", "java.class", "java.interface")).join(noted, "cell_id", "left_anti")
    if scope and scope != "all":
        todo = todo.where(F.lower("fqn").contains(scope.lower()))
    todo = keep(todo.orderBy("fqn", "start_line").limit(limit))
    # a name may be declared in several files, and twice in one
    span = ["fqn", "file", "start_line", "end_line"]
    lines = todo.select(*span, F.explode(F.sequence("start_line", F.greatest("start_line", "end_line"))).alias("line_no")).distinct().join(space.table("source_lines").withColumnRenamed("path", "file"), ["file", "line_no"])
    source = lines.groupBy(*span).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("source_code"))
    names = space.entities.select("cell_id", F.col("fqn").alias("other"))
    # only what touches the few cells asked for is named
    ends = space.incidences.where(F.col("relation_type").isin(*schema.CALLS)).select("from_cell_id", "to_cell_id")
    mine = F.broadcast(todo.select("cell_id").distinct())
    calls, called = (ends.join(mine.withColumnRenamed("cell_id", c), c, "left_semi") for c in ("to_cell_id", "from_cell_id"))
    to = calls.join(names, calls["from_cell_id"] == names["cell_id"]).groupBy(F.col("to_cell_id").alias("cell_id")).agg(F.array_sort(F.collect_set("other")).alias("callers"))
    fro = called.join(names, called["to_cell_id"] == names["cell_id"]).groupBy(F.col("from_cell_id").alias("cell_id")).agg(F.array_sort(F.collect_set("other")).alias("callees"))
    return todo.join(source, span).join(to, "cell_id", "left").join(fro, "cell_id", "left").select(F.col("fqn").alias("symbol"), "entity_type", F.col("label").alias("signature"), "source_code", "file", "start_line", "end_line", parent_name(F.col("fqn")).alias("containing_class"), F.lit(INSTRUCTIONS).alias("instructions"), "callers", "callees").orderBy("symbol")


def annotate(space: Space, symbol: str, **fields) -> Space:
    """A space whose annotation of the exactly named symbol is replaced; invariants stay empty."""
    row = space.entities.where(F.col("fqn") == symbol).orderBy("cell_id").first()
    if row is None:
        raise SymbolNotFound(symbol)
    new = dict.fromkeys(schema.ANNOTATION_FIELDS) | {k: [] for k in ("preconditions", "postconditions", "invariants", "side_effects")} | fields | {"cell_id": row.cell_id, "invariants": []}
    added = space.spark.createDataFrame([tuple(new[f] for f in schema.ANNOTATION_FIELDS)], schema.ANNOTATIONS)
    log = space.table("annotations").withColumn("version", F.lit(0)).unionByName(added.withColumn("version", F.lit(1)))
    # written out: a service annotates again and again
    return space.with_tables(annotations=keep(last_write(log).drop("version")))
