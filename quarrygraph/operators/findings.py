"""Unknowns, dead code, hotspots and the CRUD matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrygraph import schema
from quarrygraph.functions import code, names
from quarrygraph.plans import condense
from quarrygraph.plans.space import Space, members
from quarrygraph.session import keep


def unknowns(space: Space, scope: str | None = None) -> DataFrame:
    """(kind, subject, detail, file, line): obstructions, entities of low or no confidence, unresolved references."""
    low = space.cells.where("provenance IS NULL OR provenance.confidence < 0.5").select("cell_id", F.when(F.col("provenance").isNull(), "no provenance").otherwise("confidence below 0.5").alias("detail"))
    weak = space.entities.join(low, "cell_id").select(F.lit("low_confidence").alias("kind"), F.col("fqn").alias("subject"), "detail", "file", F.col("start_line").alias("line"))
    open_ = space.table("unresolved").select(F.lit("unresolved").alias("kind"), F.col("from_fqn").alias("subject"), F.col("target_text").alias("detail"), "file", "line")
    told = space.table("obstructions").select(F.lit("obstruction").alias("kind"), F.col("message").alias("subject"), F.lit("").alias("detail"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"))
    out = told.unionByName(weak).unionByName(open_)
    if scope and scope != "all":
        text = F.when(F.col("kind") == "unresolved", F.concat_ws(" ", "subject", "detail")).otherwise(F.col("subject"))
        out = out.where(F.lower(text).contains(scope.lower()))
    return out.orderBy("kind", "subject", "detail", "line")


def dead_code(space: Space) -> DataFrame:
    """(fqn, entity_type, file, line, confidence, reason): methods nothing refers to by name, types nothing uses.

    Overriding methods, main methods and classes with a referenced member or a main method are left out.
    """
    links = space.incidences
    e = space.entities
    # a name may be declared in several files; whatever refers to one of its cells refers to the name
    name_of = e.select(F.col("cell_id").alias("to_cell_id"), "fqn")
    to = lambda kinds: links.where(F.col("relation_type").isin(*kinds)).select("to_cell_id").distinct().join(name_of, "to_cell_id").select("fqn").distinct()
    used, touched = to(schema.REFERENCES), to(schema.REFERENCES + schema.TYPE_REFERENCES)
    overriding = links.where(F.col("relation_type") == "java.overrides").select(F.col("from_cell_id").alias("cell_id")).distinct()
    noted = links.where(F.col("relation_type") == "java.annotated_with").select(F.col("from_cell_id").alias("cell_id")).distinct()
    main = e.where((F.col("entity_type") == "java.method") & F.col("label").rlike(r"^main(\(|$)"))
    methods = e.where(F.col("entity_type") == "java.method").join(main.select("cell_id"), "cell_id", "left_anti").join(used, "fqn", "left_anti").join(overriding, "cell_id", "left_anti")
    noted_classes = e.join(noted, "cell_id", "left_semi").select(F.col("fqn").alias("_class")).distinct()
    methods = methods.join(noted.withColumn("_own", F.lit(True)), "cell_id", "left").join(noted_classes.withColumn("_of", F.lit(True)), names.parent_name(F.col("fqn")) == F.col("_class"), "left")
    lines = space.table("source_lines").where(F.trim("line").startswith("private")).select(F.col("path").alias("_path"), F.col("line_no").alias("_no"))
    methods = methods.join(lines.withColumn("_private", F.lit(True)), (F.col("file") == F.col("_path")) & (F.col("start_line") == F.col("_no")), "left")
    verdict = F.when(F.col("_own") | F.col("_of"), F.struct(F.lit("low").alias("c"), F.lit("annotated").alias("r"))).when(
        names.is_accessor(F.col("label")), F.struct(F.lit("low").alias("c"), F.lit("accessor").alias("r"))
    ).when(F.col("_private"), F.struct(F.lit("high").alias("c"), F.lit("private and unreferenced").alias("r"))).otherwise(F.struct(F.lit("medium").alias("c"), F.lit("unreferenced").alias("r")))
    dead_methods = methods.select("fqn", "entity_type", "file", F.col("start_line").alias("line"), verdict.alias("v"))
    types = e.where(F.col("entity_type").isin("java.class", "java.interface", "java.enum")).join(touched, "fqn", "left_anti")
    owners = e.select("fqn").where("fqn IS NOT NULL").distinct().withColumnRenamed("fqn", "owner")
    alive = touched.unionAll(main.select("fqn")).distinct()
    alive_owners = members(alive, owners).select(F.col("owner").alias("fqn")).distinct()
    types = types.join(alive_owners, "fqn", "left_anti").join(noted.withColumn("_own", F.lit(True)), "cell_id", "left")
    verdict = F.when(F.col("_own"), F.struct(F.lit("low").alias("c"), F.lit("annotated").alias("r"))).otherwise(F.struct(F.lit("medium").alias("c"), F.lit("unreferenced").alias("r")))
    out = dead_methods.unionByName(types.select("fqn", "entity_type", "file", F.col("start_line").alias("line"), verdict.alias("v"))).select("fqn", "entity_type", "file", "line", F.col("v.c").alias("confidence"), F.col("v.r").alias("reason"))
    return out.orderBy(F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2), "fqn")


def body_lines(space: Space) -> DataFrame:
    """Lines of method and constructor bodies with their entity; spans are short, so lines join by equality."""
    spans = space.entities.where(F.col("entity_type").isin(*schema.CALLABLE)).select("fqn", "cell_id", "label", "file", "start_line", "end_line", F.explode(F.sequence("start_line", F.greatest("start_line", "end_line"))).alias("line_no"))
    return spans.join(space.table("source_lines").withColumnRenamed("path", "file"), ["file", "line_no"])


def hotspots(space: Space, limit: int = 20) -> DataFrame:
    """Methods by complexity (1 + branch words and short-circuit operators), then by lines of code."""
    out = body_lines(space).groupBy("fqn", "file", "start_line", "end_line").agg(
        F.count_if(code.is_code_line(F.col("line"))).alias("loc"), (F.sum(code.branch_count(F.col("line"))) + 1).alias("complexity")
    )
    return out.orderBy(F.col("complexity").desc(), F.col("loc").desc(), "fqn", "start_line").limit(limit)


def data_classes(space: Space) -> DataFrame:
    """(class fqn, table_name): classes with a field whose other members are constructors, accessors or no methods."""
    classes = space.entities.where(F.col("entity_type") == "java.class").select(F.col("fqn").alias("owner"), F.col("file").alias("class_file"))
    held = members(space.entities, classes)
    plain = (F.col("entity_type") != "java.method") | names.is_accessor(F.col("label"))
    out = held.groupBy("owner", "class_file").agg(F.count_if(F.col("entity_type") == "java.field").alias("fields"), F.count_if(~plain).alias("others")).where("fields > 0 AND others = 0")
    named = space.table("source_lines").select(F.col("path").alias("class_file"), F.regexp_extract("line", r'@Table\s*\([^)]*name\s*=\s*"([^"]+)"', 1).alias("t")).where("t <> ''").groupBy("class_file").agg(F.min("t").alias("t"))
    return out.join(named, "class_file", "left").select(F.col("owner").alias("table_class"), F.coalesce("t", names.snake_case(names.simple_name(F.col("owner")))).alias("table_name"))


def crud_matrix(space: Space, mapper: DataFrame | None = None) -> DataFrame:
    """(table_class, table_name, entry_point, operations, evidence): what each entry point does to each table.

    Entry points are methods that nothing calls, accessors apart. Evidence comes from SQL in the bodies of all reached
    methods, from calls on repository variables, and from mapper statements (mapper: fqn, sql) of reached methods. Operations
    in the order C, R, U, D; the first five pieces of evidence.
    """
    tables = data_classes(space)
    called = space.calls("java.calls").select(F.col("dst").alias("cell_id")).distinct()
    entries = space.entities.where((F.col("entity_type") == "java.method") & ~names.is_accessor(F.col("label"))).join(called, "cell_id", "left_anti")
    lines = body_lines(space)
    named = tables.withColumn("_name", F.lower("table_name"))
    # lines with an SQL keyword meet tables by the identifiers they hold
    sql = lines.where(F.lower("line").rlike(r"\b(insert\s+into|delete\s+from|update|from|join)\b")).withColumn("_name", F.explode(code.identifiers(F.col("line"))))
    said = sql.join(named, "_name").withColumn("operations", code.table_access(F.col("line"), F.col("table_name"))).where("operations IS NOT NULL")
    hits = [said.select("cell_id", "table_class", "table_name", "operations", F.concat("file", F.lit(":"), "line_no", F.lit(" "), F.trim("line")).alias("evidence"))]
    if mapper is not None:
        m = mapper.withColumn("_name", F.explode(code.identifiers(F.col("sql")))).join(named, "_name").withColumn("operations", code.table_access(F.col("sql"), F.col("table_name"))).where("operations IS NOT NULL").join(space.entities.select("fqn", "cell_id"), "fqn")
        hits.append(m.select("cell_id", "table_class", "table_name", "operations", F.concat(F.lit("mapper "), "fqn").alias("evidence")))
    bound = space.table("source_lines").select(F.col("path").alias("file"), F.explode(F.expr(r"regexp_extract_all(line, '([A-Z][A-Za-z0-9_]*(?:Repository|Dao|Mapper)\\s+[a-z][A-Za-z0-9_]*)', 1)")).alias("b"))
    bound = bound.select("file", names.repository_entity(F.split("b", r"\s+")[0]).alias("entity"), F.split("b", r"\s+")[1].alias("variable")).where("entity IS NOT NULL").distinct()
    used = lines.join(bound, "file").withColumn("method", code.calls_on(F.col("line"), F.col("variable"))).where("method IS NOT NULL").withColumn("operations", names.repository_operation(F.col("method"))).where("operations IS NOT NULL")
    by_name = tables.withColumn("entity", names.simple_name(F.col("table_class")))
    hits.append(used.join(by_name, "entity").select("cell_id", "table_class", "table_name", "operations", F.concat("file", F.lit(":"), "line_no", F.lit(" "), "variable", F.lit("."), "method").alias("evidence")))
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    every = keep(every)
    # carried back from the cells with evidence over strong components, not paired with every cell on the way
    table = F.struct("table_class", "table_name").alias("key")
    letters = every.select(F.col("cell_id").alias("node"), table, F.explode(F.split("operations", "")).alias("value")).where("value <> ''")
    graph = condense.Condensed(space.calls(*schema.CALLS))
    done = graph.carried_back(letters).groupBy("node", "key").agg(F.collect_set("value").alias("all"))
    shown = graph.carried_back(every.select(F.col("cell_id").alias("node"), table, F.col("evidence").alias("value")), 5)
    shown = shown.groupBy("node", "key").agg(F.array_sort(F.collect_list("value")).alias("evidence"))
    at = entries.select(F.col("cell_id").alias("node"), F.col("fqn").alias("entry_point"))
    out = at.join(done, "node").join(shown, ["node", "key"])
    ops = F.array_join(F.filter(F.array(*map(F.lit, "CRUD")), lambda x: F.array_contains("all", x)), "")
    out = out.select("key.table_class", "key.table_name", "entry_point", ops.alias("operations"), "evidence")
    return _by_name(out).orderBy("table_name", "entry_point")


def _by_name(rows: DataFrame) -> DataFrame:
    """One row for a table and an entry point's name, which several files may declare: their operations and first evidence."""
    letters = F.array_join(F.filter(F.array(*map(F.lit, "CRUD")), lambda x: F.contains(F.col("all"), x)), "")
    keys = ["table_class", "table_name", "entry_point"]
    # few rows a group: as many as files declare the name, each with five pieces of evidence at most
    out = rows.groupBy(*keys).agg(F.array_join(F.collect_list("operations"), "").alias("all"), F.flatten(F.collect_list("evidence")).alias("evidence"))
    return out.select(*keys, letters.alias("operations"), F.slice(F.array_sort(F.array_distinct("evidence")), 1, 5).alias("evidence"))


def crud_closure(space: Space, targets: DataFrame) -> DataFrame:
    """(entry_point, target): which targets (cell_id, target) each entry point reaches by calls and constructions.

    Targets are bits of a set that is carried back along links, so a link carries them all at once.
    """
    links = space.calls(*schema.CALLS)
    reach = condense.ReachedSets(links if space.stored else keep(links), targets.select(F.col("cell_id").alias("node"), F.col("target").alias("value")))
    entries = space.entities.where(F.col("entity_type") == "java.method").select(F.col("cell_id").alias("node"), F.col("fqn").alias("name"))
    called = space.calls("java.calls").select(F.col("dst").alias("node"))
    return reach.of(entries.join(called, "node", "left_anti")).select(F.col("name").alias("entry_point"), F.col("value").alias("target"))


def last_write(log: DataFrame, key: str = "cell_id", order: str = "version") -> DataFrame:
    """The row of the highest order for each key (upsert by append)."""
    return log.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")
