"""Queries over the driver tables and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrygraph import schema
from quarrygraph.functions import code, kernels, names
from quarrygraph.operators import calls, catalogue, decision_table, evidence, findings, invariants, jsp, resolvers, specs, symbolic, topology
from quarrygraph.plans import graph
from quarrygraph.plans.demo import demo_space
from quarrygraph.plans.lift import lift
from quarrygraph.plans.space import Space, resolve
from quarrygraph.registry import ORACLES, QUERIES, query

GRAPH = """
WITH RECURSIVE pkg AS (SELECT r_regionkey, 'geo.' || lower(replace(r_name, ' ', '_')) AS pkg FROM region),
cls AS (SELECT n_nationkey, n_regionkey, pkg || '.Nation' || n_nationkey AS cls FROM nation JOIN pkg ON n_regionkey = r_regionkey),
entities AS (
  SELECT pkg AS fqn, 'r' || r_regionkey AS cell_id, 'java.package' AS entity_type, split_part(pkg, '.', 2) AS label, pkg AS owner, 1 AS start_line FROM pkg
  UNION ALL SELECT cls, 'n' || n_nationkey, 'java.class', 'Nation' || n_nationkey, cls, 1 FROM cls
  UNION ALL SELECT 'catalog.' || lower(replace(p_brand, '#', '')) || '.Part' || p_partkey, 'p' || p_partkey, 'java.class', 'Part' || p_partkey, 'catalog.' || lower(replace(p_brand, '#', '')) || '.Part' || p_partkey, 1 FROM part
  UNION ALL SELECT cls || '.cust' || c_custkey, 'c' || c_custkey, 'java.method', 'cust' || c_custkey || '()', cls, c_custkey::INT FROM customer JOIN cls ON c_nationkey = n_nationkey
  UNION ALL SELECT cls || '.Supp' || s_suppkey, 's' || s_suppkey, 'java.constructor', 'Supp' || s_suppkey || '()', cls, s_suppkey::INT FROM supplier JOIN cls ON s_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT 'segment.' || c_mktsegment, 'a' || c_mktsegment, 'java.annotation', c_mktsegment, 'segment.' || c_mktsegment, 1 FROM customer
),
lines AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
chain AS (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS next FROM lines),
incidences AS (
  SELECT DISTINCT * FROM (
    SELECT 'c' || c_custkey AS from_cell_id, 'n' || c_nationkey AS to_cell_id, 'java.contained_in' AS relation_type FROM customer
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'java.contained_in' FROM supplier
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'java.contained_in' FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'a' || c_mktsegment, 'java.annotated_with' FROM customer
    UNION ALL SELECT 'p' || l_partkey, 'p' || next, 'java.calls' FROM chain WHERE next IS NOT NULL AND next <> l_partkey
    UNION ALL SELECT 'c' || o_custkey, 's' || l_suppkey, 'java.calls' FROM lines JOIN orders ON l_orderkey = o_orderkey
    UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey, 'java.constructs' FROM lines
  )
),
file_of AS (SELECT *, 'src/' || replace(owner, '.', '/') || '.java' AS file FROM entities),
hub AS (SELECT to_cell_id AS cell_id FROM incidences WHERE relation_type IN ('java.calls', 'java.constructs') AND to_cell_id LIKE 'p%' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
"""
PACKAGE = "rtrim(regexp_extract({0}, '^([a-z_0-9][^.]*(\\.|$))*'), '.')"
CLASS = "CASE WHEN regexp_extract({0}, '^([^A-Z.][^.]*\\.)*[A-Z][^.]*') = '' THEN {0} ELSE regexp_extract({0}, '^([^A-Z.][^.]*\\.)*[A-Z][^.]*') END"

def hub(space: Space) -> str:
    """The full name of the part that most calls and constructions go to."""
    top = space.incidences.where(F.col("relation_type").isin(*schema.CALLS) & F.col("to_cell_id").startswith("p")).groupBy("to_cell_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "to_cell_id").first()
    return space.entities.where(F.col("cell_id") == top.to_cell_id).first().fqn


def entry_point(space: Space) -> str:
    """The full name of the first customer by cell id that calls something."""
    cell = space.incidences.where((F.col("relation_type") == "java.calls") & F.col("from_cell_id").startswith("c")).agg(F.min("from_cell_id")).first()[0]
    return space.entities.where(F.col("cell_id") == cell).first().fqn


@query(GRAPH + """
SELECT 'entity' AS kind, entity_type AS name, count(*) AS count FROM entities GROUP BY 2
UNION ALL SELECT 'relation', relation_type, count(*) FROM incidences GROUP BY 2
UNION ALL SELECT 'total', 'entities', count(*) FROM entities
UNION ALL SELECT 'total', 'relations', count(*) FROM incidences
UNION ALL SELECT 'total', 'files', count(DISTINCT file) FROM file_of""")
def overview_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.overview_counts(demo_space(spark, sf_dir, again=True))


@query(GRAPH + f"""
SELECT {PACKAGE.format('fqn')} AS package, count(*) FILTER (entity_type = 'java.class') AS classes, count(*) FILTER (entity_type = 'java.interface') AS interfaces,
  count(*) FILTER (entity_type IN ('java.method', 'java.constructor')) AS methods, count(*) FILTER (entity_type = 'java.field') AS fields
FROM entities GROUP BY 1 HAVING package <> '' AND classes + interfaces + methods + fields > 0""")
def overview_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.overview_packages(demo_space(spark, sf_dir))


@query(GRAPH + """
, hit AS (SELECT fqn, entity_type, label, file, start_line AS line, (lower(label) LIKE 'nation1%' OR lower(fqn) LIKE 'nation1%') AS first FROM file_of WHERE lower(fqn) LIKE '%nation1%' OR lower(label) LIKE '%nation1%')
SELECT fqn, entity_type, label, file, line, (SELECT count(*) FROM hit) AS total_matches, (SELECT count(*) FROM hit) > 30 AS truncated FROM hit ORDER BY first DESC, fqn, entity_type, line LIMIT 30""")
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.search(demo_space(spark, sf_dir), "Nation1", limit=30)


@query(GRAPH + """
SELECT fqn, cell_id, entity_type FROM entities WHERE fqn = 'Nation7' OR fqn LIKE '%.Nation7' ORDER BY length(fqn), fqn, cell_id LIMIT 1""")
def resolve_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(demo_space(spark, sf_dir), "Nation7").select("fqn", "cell_id", "entity_type")


_ENDS = GRAPH + f"""
, named AS (SELECT cell_id, fqn, {PACKAGE.format('fqn')} AS pkg, {CLASS.format('fqn')} AS cls FROM entities),
ends AS (SELECT i.relation_type, a.fqn AS ff, b.fqn AS tf, a.pkg AS fp, b.pkg AS tp, a.cls AS fc, b.cls AS tc FROM incidences i JOIN named a ON from_cell_id = a.cell_id JOIN named b ON to_cell_id = b.cell_id WHERE relation_type <> 'java.contained_in')
"""


@query(_ENDS + """SELECT fp AS "from", tp AS "to", count(*) AS relation_count FROM ends WHERE fp <> tp AND fp <> '' AND tp <> '' GROUP BY 1, 2""")
def package_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.package_dependencies(demo_space(spark, sf_dir))


@query(GRAPH + f"""SELECT {PACKAGE.format('fqn')} AS name, count(*) AS entity_count FROM entities GROUP BY 1 HAVING name <> ''""")
def package_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.package_nodes(demo_space(spark, sf_dir))


@query(_ENDS + """
, e AS (
  SELECT CASE WHEN lower(ff) LIKE 'geo.asia.nation12%' THEN 'geo.asia.Nation12' ELSE fc END AS f, CASE WHEN lower(ff) LIKE 'geo.asia.nation12%' THEN tc ELSE 'geo.asia.Nation12' END AS t
  FROM ends WHERE lower(ff) LIKE 'geo.asia.nation12%' OR lower(tf) LIKE 'geo.asia.nation12%'
) SELECT f AS "from", t AS "to", count(*) AS relation_count FROM e WHERE f <> 'geo.asia.Nation12' OR t <> 'geo.asia.Nation12' GROUP BY 1, 2""")
def class_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = demo_space(spark, sf_dir)
    return catalogue.class_dependencies(space, "geo.asia.Nation12")


_FEATURE = GRAPH + """
, classes AS (SELECT fqn FROM entities WHERE entity_type IN ('java.class', 'java.interface', 'java.enum') AND (lower(fqn) LIKE '%asia%' OR lower(label) LIKE '%asia%')),
inside AS (SELECT DISTINCT e.cell_id, e.fqn, e.label, e.entity_type, f.file, e.start_line FROM entities e JOIN classes c ON e.fqn = c.fqn OR starts_with(e.fqn, c.fqn || '.') JOIN file_of f ON f.cell_id = e.cell_id),
calls AS (SELECT a.cell_id AS f, b.cell_id AS t, i.* FROM incidences i LEFT JOIN inside a ON from_cell_id = a.cell_id LEFT JOIN inside b ON to_cell_id = b.cell_id WHERE relation_type IN ('java.calls', 'java.constructs')),
ins AS (SELECT t AS cell_id, count(*) AS n FROM calls WHERE f IS NULL AND t IS NOT NULL GROUP BY 1), outs AS (SELECT f AS cell_id, count(*) AS n FROM calls WHERE f IS NOT NULL GROUP BY 1)
"""


@query(_FEATURE + """
SELECT fqn, label, file, start_line AS line, coalesce(ins.n, 0) AS caller_count, coalesce(outs.n, 0) AS callee_count FROM inside LEFT JOIN ins USING (cell_id) LEFT JOIN outs USING (cell_id)
WHERE entity_type IN ('java.method', 'java.constructor') AND coalesce(ins.n, 0) + coalesce(outs.n, 0) > 0""")
def feature_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.feature(demo_space(spark, sf_dir, again=True), "asia")["entry_points"]


@query(_FEATURE + f"""
SELECT DISTINCT {CLASS.format('e.fqn')} AS fqn FROM incidences i JOIN inside a ON from_cell_id = a.cell_id LEFT JOIN inside b ON to_cell_id = b.cell_id JOIN entities e ON to_cell_id = e.cell_id
WHERE relation_type <> 'java.contained_in' AND b.cell_id IS NULL""")
def feature_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.feature(demo_space(spark, sf_dir, again=True), "asia")["external_dependencies"]


@query(GRAPH + """
SELECT e.fqn AS target, e.label AS target_label, relation_type, 0.9 + CASE WHEN relation_type = 'java.calls' THEN 0 ELSE 0.05 END AS confidence, e.file, e.start_line AS line
FROM incidences JOIN file_of e ON e.cell_id = from_cell_id WHERE to_cell_id = (SELECT cell_id FROM hub) AND relation_type IN ('java.calls', 'java.constructs', 'java.field_access')""")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = demo_space(spark, sf_dir, again=True)
    return calls.callers(space, hub(space)).withColumn("confidence", F.round("confidence", 6))


@query(GRAPH + """
SELECT e.fqn AS target, e.label AS target_label, relation_type, e.file, e.start_line AS line
FROM incidences JOIN file_of e ON e.cell_id = to_cell_id WHERE from_cell_id = (SELECT cell_id FROM hub) AND relation_type IN ('java.calls', 'java.constructs', 'java.field_access')""")
def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = demo_space(spark, sf_dir, again=True)
    return calls.callees(space, hub(space)).drop("confidence")


@query(GRAPH + """
SELECT h.fqn AS symbol, h.entity_type, h.label AS signature, 'caller' AS side, e.fqn AS other FROM hub JOIN entities h USING (cell_id), incidences JOIN entities e ON e.cell_id = from_cell_id WHERE to_cell_id = (SELECT cell_id FROM hub) AND relation_type IN ('java.calls', 'java.constructs')
UNION ALL
SELECT h.fqn, h.entity_type, h.label, 'callee', e.fqn FROM hub JOIN entities h USING (cell_id), incidences JOIN entities e ON e.cell_id = to_cell_id WHERE from_cell_id = (SELECT cell_id FROM hub) AND relation_type IN ('java.calls', 'java.constructs')""")
def explain_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = demo_space(spark, sf_dir, again=True)
    one = calls.explain(space, hub(space))
    side = lambda c, s: one.select("symbol", "entity_type", "signature", F.lit(s).alias("side"), F.explode(c).alias("other"))
    return side("callers", "caller").unionAll(side("callees", "callee"))


_REACH = """
, walk AS (SELECT cell_id AS node, 0 AS depth FROM hub
  UNION SELECT i.from_cell_id, depth + 1 FROM walk JOIN incidences i ON to_cell_id = node WHERE depth < 3 AND relation_type IN ('java.calls', 'java.constructs', 'java.extends', 'java.implements', 'java.type_reference'))
"""


@query(GRAPH + _REACH + """
SELECT fqn, label, file, start_line AS line, d AS depth, CASE WHEN d = 1 THEN 'direct' ELSE 'transitive' END AS scope FROM (SELECT node, min(depth) AS d FROM walk GROUP BY 1) JOIN file_of ON cell_id = node WHERE d > 0""")
def impact_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = demo_space(spark, sf_dir, again=True)
    return calls.impact(space, hub(space), 3)


@query(GRAPH + _REACH + """
SELECT DISTINCT file FROM (SELECT node, min(depth) AS d FROM walk GROUP BY 1) JOIN file_of ON cell_id = node WHERE d > 0""")
def impact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = demo_space(spark, sf_dir, again=True)
    return calls.affected_files(calls.impact(space, hub(space), 3))


@query(GRAPH + """
, start AS (SELECT min(from_cell_id) AS cell_id FROM incidences WHERE relation_type = 'java.calls' AND from_cell_id LIKE 'c%'),
walk AS (SELECT cell_id AS node, 0 AS depth FROM start UNION SELECT to_cell_id, depth + 1 FROM walk JOIN incidences ON from_cell_id = node WHERE depth < 3),
seen AS (SELECT node, min(depth) AS depth FROM walk GROUP BY 1)
SELECT r AS required_relation, CASE WHEN EXISTS (SELECT 1 FROM seen JOIN incidences ON from_cell_id = node WHERE depth < 3 AND relation_type = r) THEN 'satisfied'
  WHEN (SELECT max(depth) FROM seen) < 3 THEN 'violated' ELSE 'unknown' END AS status FROM (VALUES ('java.constructs'), ('java.throws')) t(r)""")
def enforces_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = demo_space(spark, sf_dir, again=True)
    start = entry_point(space)
    return calls.enforces(space, start, "constructs", 3).unionAll(calls.enforces(space, start, "throws", 3)).select("required_relation", "status")


@query(GRAPH + """
SELECT 'low_confidence' AS kind, fqn AS subject, 'confidence below 0.5' AS detail, file, start_line AS line FROM file_of WHERE entity_type = 'java.constructor'""")
def unknowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.unknowns(demo_space(spark, sf_dir))


@query(GRAPH + """
, used AS (SELECT DISTINCT to_cell_id AS c FROM incidences WHERE relation_type IN ('java.calls', 'java.constructs', 'java.field_access')),
noted AS (SELECT DISTINCT from_cell_id AS c FROM incidences WHERE relation_type = 'java.annotated_with'),
alive AS (SELECT fqn FROM entities WHERE cell_id IN (FROM used))
SELECT fqn, entity_type, file, start_line AS line, CASE WHEN cell_id IN (FROM noted) THEN 'low' ELSE 'medium' END AS confidence, CASE WHEN cell_id IN (FROM noted) THEN 'annotated' ELSE 'unreferenced' END AS reason
FROM file_of WHERE entity_type = 'java.method' AND cell_id NOT IN (FROM used)
UNION ALL
SELECT fqn, entity_type, file, start_line, 'medium', 'unreferenced' FROM file_of f WHERE entity_type = 'java.class' AND cell_id NOT IN (FROM used) AND NOT EXISTS (SELECT 1 FROM alive a WHERE starts_with(a.fqn, f.fqn || '.'))""")
def dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.dead_code(demo_space(spark, sf_dir, again=True))


@query(GRAPH + """
, link AS (SELECT DISTINCT from_cell_id AS a, to_cell_id AS b FROM incidences WHERE relation_type IN ('java.calls', 'java.constructs')),
reach AS (SELECT 'p' || p_partkey AS node, p_brand AS target FROM part UNION SELECT a, target FROM reach JOIN link ON b = node)
SELECT DISTINCT fqn AS entry_point, target FROM reach JOIN entities ON cell_id = node WHERE entity_type = 'java.method' AND cell_id NOT IN (SELECT to_cell_id FROM incidences WHERE relation_type = 'java.calls')""")
def crud_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("p"), "p_partkey").alias("cell_id"), F.col("p_brand").alias("target"))
    return findings.crud_closure(demo_space(spark, sf_dir, again=True), parts)


@query(GRAPH + """
, e AS (SELECT from_cell_id AS a, to_cell_id AS b FROM incidences WHERE relation_type = 'java.calls' UNION SELECT to_cell_id, from_cell_id FROM incidences WHERE relation_type = 'java.calls'),
label(node, component) USING KEY (node) AS (
  SELECT cell_id, cell_id FROM entities
  UNION SELECT e.b, min(l.component) FROM label l JOIN e ON e.a = l.node JOIN recurring.label r ON r.node = e.b WHERE l.component < r.component GROUP BY 1
), comp AS (SELECT node, component FROM label)
SELECT component, count(*) AS members, count(DISTINCT regexp_replace(fqn, '\\.[^.]*$', '')) AS packages, count(DISTINCT regexp_replace(fqn, '\\.[^.]*$', '')) > 1 AS crosses_boundary FROM comp JOIN entities ON cell_id = node GROUP BY 1""")
def domain_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.cluster_sizes(demo_space(spark, sf_dir, again=True), 2)


@query("""
WITH pts AS (SELECT p_partkey AS k, round(p_retailprice, 2) AS x, floor(round(p_retailprice, 2))::BIGINT AS cell FROM part),
pairs AS (SELECT a.k AS i, b.k AS j, round(abs(a.x - b.x), 2) AS d FROM pts a, (VALUES (-1), (0), (1)) o(o), pts b WHERE b.cell = a.cell + o AND a.k < b.k AND abs(a.x - b.x) <= 1)
SELECT i, j, d, dense_rank() OVER (ORDER BY d) AS stage FROM pairs""")
def rips_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose prices are at most 1 apart."""
    points = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.round("p_retailprice", 2).alias("x"))
    return topology.near_stages(points, 1.0, 2).select("i", "j", "d", F.col("stage").cast("long").alias("stage"))


@query(GRAPH + """
, e AS (SELECT from_cell_id AS a, to_cell_id AS b FROM incidences UNION SELECT to_cell_id, from_cell_id FROM incidences),
seen AS (SELECT min(cell_id) AS node FROM entities UNION SELECT b FROM seen JOIN e ON a = node)
SELECT 'reachability' AS invariant_name, cell_id, 'not reachable from the first cell' AS message, 'warning' AS severity FROM entities WHERE cell_id NOT IN (SELECT node FROM seen)""")
def invariants_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invariants.reachability(demo_space(spark, sf_dir, again=True))


@query("""
WITH RECURSIVE ordered AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events),
step AS (SELECT DISTINCT a, b FROM ordered WHERE b IS NOT NULL),
path AS (SELECT [a] AS p, b AS nxt FROM step WHERE b >= a UNION ALL SELECT list_append(p, nxt), s.b FROM path JOIN step s ON s.a = nxt WHERE nxt <> p[1] AND NOT list_contains(p, nxt) AND s.b >= p[1])
SELECT array_to_string(p, '>') AS cycle, len(p) AS length FROM path WHERE nxt = p[1]""")
def invariants_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All simple cycles of event types that follow each other for some user."""
    following = F.lead("event_type").over(W.partitionBy("user_id").orderBy("event_id"))
    edges = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("src"), following.alias("dst")).where("dst IS NOT NULL")
    return graph.cycles(edges, None, 20).select(F.array_join("path", ">").alias("cycle"), F.size("path").cast("long").alias("length"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) FILTER (NOT regexp_matches(trim(line), '^(//|\*|/\*|$)')) AS loc,
  1 + sum(len(regexp_extract_all(line, '\b(if|for|while|case|catch)\b')) + (length(line) - length(replace(line, '&&', ''))) // 2 + (length(line) - length(replace(line, '||', ''))) // 2)::BIGINT AS complexity
FROM l GROUP BY 1 ORDER BY complexity DESC, loc DESC, doc_id LIMIT 20""")
def hotspots_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    out = lines.groupBy("doc_id").agg(F.count_if(code.is_code_line(F.col("line"))).alias("loc"), (F.sum(code.branch_count(F.col("line"))) + 1).alias("complexity"))
    return out.orderBy(F.col("complexity").desc(), F.col("loc").desc(), "doc_id").limit(20)


@query(GRAPH + """
, held AS (SELECT t.fqn AS section, t.cell_id FROM entities t WHERE entity_type = 'java.class' UNION ALL SELECT t.fqn, m.cell_id FROM entities t JOIN entities m ON starts_with(m.fqn, t.fqn || '.') WHERE t.entity_type = 'java.class' AND m.entity_type IN ('java.method', 'java.constructor')),
k AS (SELECT section, count(*) AS k FROM held GROUP BY 1)
SELECT (SELECT count(*) FROM entities) AS total_sources, (SELECT count(*) FROM k) AS projected_sections, (SELECT count(*) FROM entities WHERE cell_id NOT IN (SELECT cell_id FROM held)) AS omitted_count, (SELECT sum(k * (k - 1) // 2)::BIGINT FROM k) AS collapsed_pair_count""")
def spec_loss_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.spec_loss(demo_space(spark, sf_dir)).select("total_sources", "projected_sections", "omitted_count", "collapsed_pair_count")


_ROWS = "SELECT DISTINCT l_returnflag = 'R' AS a, l_linestatus = 'F' AS b, l_discount > 0.05 AS c, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity > 25 END AS d, CASE WHEN l_linestatus = 'F' AND l_quantity > 25 THEN 'a' WHEN l_tax > 0.04 THEN 'b' ELSE 'c' END AS o FROM lineitem"


def decision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    inputs = F.array(F.col("l_returnflag") == "R", F.col("l_linestatus") == "F", F.col("l_discount") > 0.05, F.when(F.col("l_returnflag") != "N", F.col("l_quantity") > 25))
    return li.select(F.lit("t").alias("table_id"), inputs.alias("inputs"), F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 25), "a").when(F.col("l_tax") > 0.04, "b").otherwise("c").alias("outcome")).distinct()


_MINTERMS = f"""
WITH r AS ({_ROWS}), m AS (SELECT DISTINCT a::INT + 2 * b::INT + 4 * c::INT + 8 * x AS minterm, o AS outcome FROM r JOIN (VALUES (0), (1)) v(x) ON d IS NULL OR d::INT = x)
"""


@query(_MINTERMS + "SELECT minterm::BIGINT AS minterm, outcome FROM m")
def decision_minterms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_table.expand_minterms(decision_rows(spark, sf_dir)).select("minterm", "outcome")


@query(_MINTERMS + "SELECT minterm::BIGINT AS minterm, count(*) AS outcomes FROM m GROUP BY 1 HAVING count(*) > 1")
def decision_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_table.minterm_conflicts(decision_rows(spark, sf_dir)).select("minterm", "outcomes")


@query(f"""
WITH r AS ({_ROWS}), c AS (SELECT DISTINCT a::INT + 2 * b::INT + 4 * c::INT + 8 * coalesce(d::INT, 0) AS p, (NOT a)::INT + 2 * (NOT b)::INT + 4 * (NOT c)::INT + 8 * coalesce((NOT d)::INT, 0) AS n, o FROM r)
SELECT x.p::BIGINT AS p1, x.n::BIGINT AS n1, x.o AS o1, y.p::BIGINT AS p2, y.n::BIGINT AS n2, y.o AS o2 FROM c x JOIN c y ON x.o < y.o AND (x.p & y.n) = 0 AND (x.n & y.p) = 0""")
def decision_cube_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_table.cube_conflicts(decision_rows(spark, sf_dir)).drop("table_id")


@query()
def decision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of one table a return flag; the choice of a cover is no SQL, tests check that it is faithful."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    inputs = F.array(F.col("l_linestatus") == "F", F.col("l_discount") > 0.05, F.col("l_quantity") > 25, F.col("l_tax") > 0.04)
    rows = li.select(F.col("l_returnflag").alias("table_id"), inputs.alias("inputs"), F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 25), "a").when(F.col("l_discount") > 0.05, "b").otherwise("c").alias("outcome"))
    return decision_table.minimise_tables(rows, 4)


@query("""
SELECT d.doc_id, round(o / (o + 1), 6) AS posterior FROM (
  SELECT d.doc_id, (CASE WHEN l.quality = 1 THEN 3.4 ELSE 1 END) * (CASE WHEN l.toxic = 1 THEN 1.75 ELSE 1 END) * (CASE WHEN d.n_chars > 1000 THEN 0.75 / 0.35 ELSE 1 END) AS o FROM documents d JOIN labels l USING (doc_id)) d""")
def bayes_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    seen = {"witnesses": F.col("quality") == 1, "intent": F.col("toxic") == 1, "preconditions": F.col("n_chars") > 1000}
    return d.select("doc_id", "n_chars").join(l, "doc_id").select("doc_id", F.round(evidence.posterior(seen), 6).alias("posterior"))


@query("""
SELECT count(*) AS total, count(*) FILTER (c >= 0.8) AS accepted, count(*) FILTER (c < 0.4) AS rejected, count(*) FILTER (c >= 0.4 AND c < 0.8) AS pending FROM (SELECT l_quantity / 50 AS c FROM lineitem)""")
def completion_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.completion_counts(evidence.completion(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity"), F.col("l_quantity") / 50))


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS s, o_orderstatus AS r, o_orderpriority AS o FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT o_custkey AS s, o_orderstatus AS r, o_orderpriority AS o FROM orders WHERE o_orderkey % 2 = 1),
t AS (SELECT coalesce(a.s, b.s) AS s, coalesce(a.r, b.r) AS r, a.s IS NOT NULL AS l, b.s IS NOT NULL AS q FROM a FULL JOIN b ON a.s = b.s AND a.r = b.r AND a.o = b.o),
p AS (SELECT s, r, count(*) FILTER (l AND q) AS common, count(*) FILTER (l) AS ls, count(*) FILTER (q) AS rs FROM t GROUP BY 1, 2),
g AS (SELECT s AS subject, sum(common)::BIGINT AS overlap, sum(ls + rs - 2 * common)::BIGINT AS differences, bool_or(common = 0 AND ls > 0 AND rs > 0) AS clash FROM p GROUP BY 1)
SELECT subject, overlap, differences, CASE WHEN clash THEN 'conflicting' WHEN overlap = 0 THEN 'none' WHEN differences = 0 THEN 'agreeing' ELSE 'partial' END AS agreement FROM g""")
def correspondence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("relation"), F.col("o_orderpriority").alias("object"))
    return evidence.correspondence(o.where("o_orderkey % 2 = 0").drop("o_orderkey"), o.where("o_orderkey % 2 = 1").drop("o_orderkey"))


@query(GRAPH + """SELECT a.fqn AS subject, relation_type AS relation, b.fqn AS object FROM incidences JOIN entities a ON from_cell_id = a.cell_id JOIN entities b ON to_cell_id = b.cell_id""")
def typed_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.triples(demo_space(spark, sf_dir))


@query("""
SELECT cell_id, max_by(value, event_id) AS value, max(event_id) AS version FROM (SELECT user_id AS cell_id, event_id, value FROM events) GROUP BY 1""")
def annotate_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("cell_id"), "value", F.col("event_id").alias("version"))
    return findings.last_write(log)


@query(r"""
SELECT page_id, CASE WHEN length(p) > 60 THEN left(p, 60) || '…' ELSE p END AS summary FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS p FROM pages)""")
def jsp_like_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", names.tags_stripped(F.col("html")).alias("summary"))


_NAMES = """
WITH n AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'getUser' WHEN 1 THEN 'is' || event_type WHEN 2 THEN 'saveOrder' WHEN 3 THEN 'findURLId' WHEN 4 THEN 'removeAll' ELSE 'settle' END || (event_id % 7) AS m FROM events)
"""


@query(_NAMES + r"""
SELECT event_id, m, lower(m[1] || regexp_replace(m[2:], '([A-Z])', '_\1', 'g')) AS snake, regexp_matches(m, '^(get|set|is)[A-Z]') AS accessor,
  CASE WHEN regexp_matches(m, '^(insert|create|persist|register)') THEN 'C' WHEN regexp_matches(m, '^(save|store|add)') THEN 'CU' WHEN regexp_matches(m, '^(find|get|select|load|read|count|exists|list|search|query|fetch)') THEN 'R'
    WHEN regexp_matches(m, '^(update|merge|modify)') THEN 'U' WHEN regexp_matches(m, '^(delete|remove|purge)') THEN 'D' END AS operation FROM n""")
def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    m = F.concat(F.when(k == 0, "getUser").when(k == 1, F.concat(F.lit("is"), "event_type")).when(k == 2, "saveOrder").when(k == 3, "findURLId").when(k == 4, "removeAll").otherwise("settle"), F.col("event_id") % 7)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", m.alias("m"))
    return e.select("event_id", "m", names.snake_case(F.col("m")).alias("snake"), names.is_accessor(F.col("m")).alias("accessor"), names.repository_operation(F.col("m")).alias("operation"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'R' WHEN 1 THEN 'U' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE NULL END AS access, CASE o_orderkey % 5 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'write' ELSE NULL END AS status_access FROM orders""")
def sql_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    k = F.col("o_orderkey") % 5
    line = F.when(k == 0, F.concat(F.lit("SELECT status FROM orders WHERE id = "), key)).when(k == 1, F.concat(F.lit("UPDATE orders SET status = 'x' WHERE id = "), key)).when(
        k == 2, F.concat(F.lit("INSERT INTO orders (id, status) VALUES ("), key, F.lit(", 'y')"))).when(k == 3, F.concat(F.lit("DELETE FROM orders WHERE id = "), key)).otherwise(F.concat(F.lit("SELECT 1 FROM reorders WHERE statuses = "), key))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", line.alias("line"))
    return o.select("o_orderkey", code.table_access(F.col("line"), "orders").alias("access"), code.column_access(F.col("line"), "status").alias("status_access"))


def generated_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): a Java file for each customer, so that lifting and rule extraction run over any number of files."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    lines = (
        F.concat(F.lit("package gen.n"), "c_nationkey", F.lit(";")), F.lit(""), F.concat(F.lit("public class Cust"), "c_custkey", F.lit(" {")), F.lit("    private double balance;"),
        F.concat(F.lit("    public Cust"), "c_custkey", F.lit("(double b) { this.balance = b; }")), F.lit("    public int rate(int a, String segment) {"), F.lit("        if (a > 1 && balance < 0) {"), F.lit("            return 1;"), F.lit("        }"),
        F.concat(F.lit('        if (segment.equals("'), "c_mktsegment", F.lit('")) {')), F.lit("            return call();"), F.lit("        }"), F.lit("        return other(a);"), F.lit("    }"), F.lit("    int call() { return 0; }"), F.lit("}"),
    )
    return c.select(F.concat(F.lit("gen/n"), "c_nationkey", F.lit("/Cust"), "c_custkey", F.lit(".java")).alias("path"), F.concat_ws("\n", *lines).alias("text"))


_GEN = """
WITH c AS (SELECT 'gen.n' || c_nationkey AS p, 'gen.n' || c_nationkey || '.Cust' || c_custkey AS k, 'gen/n' || c_nationkey || '/Cust' || c_custkey || '.java' AS file, c_custkey, c_mktsegment FROM customer)
"""


@query(_GEN + """
SELECT p AS fqn, 'java.package' AS entity_type, split_part(p, '.', 2) AS label, file, 1 AS start_line, 1 AS end_line FROM c
UNION ALL SELECT k, 'java.class', 'Cust' || c_custkey, file, 3, 16 FROM c
UNION ALL SELECT k || '.balance', 'java.field', 'balance', file, 4, 4 FROM c
UNION ALL SELECT k || '.<init>_1', 'java.constructor', 'Cust' || c_custkey || '(double)', file, 5, 5 FROM c
UNION ALL SELECT k || '.rate', 'java.method', 'rate(int, String)', file, 6, 14 FROM c
UNION ALL SELECT k || '.call', 'java.method', 'call()', file, 15, 15 FROM c""")
def lift_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift(generated_sources(spark, sf_dir), "gen").entities.select("fqn", "entity_type", "label", "file", "start_line", "end_line")


@query(_GEN + """
SELECT k AS from_fqn, p AS to_fqn, 'java.contained_in' AS relation_type, file FROM c
UNION ALL SELECT k || m, k, 'java.contained_in', file FROM c, (VALUES ('.<init>_1'), ('.rate'), ('.call')) t(m)
UNION ALL SELECT k || '.rate', k || '.call', 'java.calls', file FROM c""")
def lift_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = lift(generated_sources(spark, sf_dir), "gen")
    names = space.entities.select("cell_id", "fqn").distinct()
    a, b = names.withColumnsRenamed({"cell_id": "from_cell_id", "fqn": "from_fqn"}), names.withColumnsRenamed({"cell_id": "to_cell_id", "fqn": "to_fqn"})
    return space.incidences.join(a, "from_cell_id").join(b, "to_cell_id").select("from_fqn", "to_fqn", "relation_type", "file")


@query(_GEN + """
SELECT k || '.rate' AS from_fqn, t AS target_text, 'java.calls' AS relation_type, file, n AS line FROM c, (VALUES ('segment.equals', 10), ('other', 13)) v(t, n)""")
def lift_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift(generated_sources(spark, sf_dir), "gen").unresolved


@query(_GEN + """
SELECT k || '.rate' AS fqn, r AS outcome, 5 AS paths, CASE n WHEN 1 THEN 'a > 1;balance < 0' WHEN 2 THEN 'NOT a > 1;segment.equals("' || c_mktsegment || '")' WHEN 3 THEN 'NOT balance < 0;segment.equals("' || c_mktsegment || '")'
  WHEN 4 THEN 'NOT a > 1;NOT segment.equals("' || c_mktsegment || '")' ELSE 'NOT balance < 0;NOT segment.equals("' || c_mktsegment || '")' END AS "when" FROM c, (VALUES (1, 'return 1'), (2, 'return call()'), (3, 'return call()'), (4, 'return other(a)'), (5, 'return other(a)')) v(n, r)""")
def lift_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = symbolic.extract_rules(generated_sources(spark, sf_dir))
    return rules.select("fqn", "outcome", "paths", F.array_join("when_", ";").alias("when"))


@query(_GEN + """
SELECT k || '.rate' AS fqn, 9::BIGINT AS loc, 4::BIGINT AS complexity FROM c
UNION ALL SELECT k || m, 1, 1 FROM c, (VALUES ('.<init>_1'), ('.call')) t(m)""")
def lift_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.hotspots(lift(generated_sources(spark, sf_dir), "gen"), 2**31 - 1).select("fqn", "loc", F.col("complexity").cast("long").alias("complexity"))


@query(_GEN + "SELECT '' AS root, count(*) AS files FROM c")
def source_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolvers.source_roots(generated_sources(spark, sf_dir))


@query(GRAPH + """
, names AS (SELECT 'geo.asia' AS package, 'Nation' || n_nationkey AS target_text FROM nation)
SELECT DISTINCT target_text, fqn FROM names JOIN entities ON fqn = target_text OR fqn = package || '.' || target_text OR (fqn LIKE '%.' || target_text)""")
def heuristic_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("Nation"), "n_nationkey").alias("target_text"), F.lit("geo.asia").alias("package"), F.lit(None).cast("string").alias("class"))
    return resolvers.HeuristicResolver(demo_space(spark, sf_dir).entities).resolve_type(names)


@query(_GEN + """
SELECT c_custkey::VARCHAR AS key, CASE c_custkey % 4 WHEN 0 THEN 'paused: 3 branches' WHEN 1 THEN 'finished: return 1' WHEN 2 THEN 'finished: return call()' ELSE 'finished: return other(a)' END AS status FROM c""")
def trace_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sessions: none, the first branch, the last branch and then the first, the last and the second."""
    src = generated_sources(spark, sf_dir).withColumn("key", F.regexp_extract("path", r"Cust(\d+)", 1))
    k = F.col("key").cast("long") % 4
    none = F.array().cast("array<int>")
    choices = F.when(k == 0, none).when(k == 1, F.array(F.lit(0))).when(k == 2, F.array(F.lit(2), F.lit(0))).otherwise(F.array(F.lit(2), F.lit(1)))
    asked = src.select("key", "text", F.concat(F.lit("Cust"), "key", F.lit(".rate")).alias("symbol"), choices.alias("choices"))
    return symbolic.trace_rows(asked).select("key", "status")


@query(_GEN + """
SELECT k || '.rate' AS fqn, o AS outcome, n AS rules FROM c, (VALUES ('return 1', 1), ('return call()', 2), ('return other(a)', 2), ('return call()', 2), ('return other(a)', 2)) v(o, n)
UNION ALL SELECT k || '.call', 'return 0', 0 FROM c UNION ALL SELECT k || '.<init>_1', '(fall-through)', 0 FROM c""")
def world_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbolic.world_line_rows(generated_sources(spark, sf_dir)).select("fqn", "outcome", F.size("rules").alias("rules"))


@query("""
SELECT 'sql/r' || n_regionkey || '.sql' AS path, 't' || n_nationkey AS table_name, c AS column_name, t AS sql_type, CASE c WHEN 'id' THEN 'Key of ' || n_name END AS comment FROM nation, (VALUES ('id', 'BIGINT'), ('name', 'VARCHAR(25)')) v(c, t)""")
def ddl_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    ddl = F.concat(F.lit("CREATE TABLE IF NOT EXISTS `t"), "n_nationkey", F.lit("` (\n  id BIGINT NOT NULL COMMENT 'Key of "), "n_name", F.lit("',\n  name VARCHAR(25),\n  PRIMARY KEY (id)\n);"))
    files = n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(ddl)), "\n").alias("text")).select(F.concat(F.lit("sql/r"), "n_regionkey", F.lit(".sql")).alias("path"), "text")
    return kernels.create_table_columns(files)


@query("""
SELECT 'gen.S' || s_suppkey || '.' || m AS fqn, m AS kind, CASE m WHEN 'select' THEN 'SELECT * FROM supplier WHERE id = ' || s_suppkey ELSE 'UPDATE supplier SET n = ' || s_nationkey END AS sql, CASE m WHEN 'select' THEN 'R' ELSE 'U' END AS access
FROM supplier, (VALUES ('select'), ('update')) v(m)""")
def mapper_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    xml = F.concat(F.lit('<mapper namespace="gen.S'), "s_suppkey", F.lit('">\n  <select id="select" resultType="x">\n    SELECT *\n    FROM supplier WHERE id = '), "s_suppkey", F.lit('\n  </select>\n  <update id="update">UPDATE supplier SET n = '), "s_nationkey", F.lit("</update>\n</mapper>"))
    files = s.select(F.concat(F.lit("m/S"), "s_suppkey", F.lit(".xml")).alias("path"), xml.alias("text"))
    return kernels.mapper_statements(files).select("fqn", "kind", "sql", code.table_access(F.col("sql"), "supplier").alias("access"))


@query("""
SELECT 'p/P' || p_partkey || '.jsp' AS path, o AS outcome, w AS "when", 3 AS paths FROM (
  SELECT p_partkey, CASE n WHEN 1 THEN 'renders: Small' WHEN 2 THEN 'renders: Brand ' || p_brand ELSE 'renders: Other' END AS o, CASE n WHEN 1 THEN 'size < ' || p_size WHEN 2 THEN 'NOT size < ' || p_size || ';known' ELSE 'NOT size < ' || p_size || ';NOT known' END AS w
  FROM part, (VALUES (1), (2), (3)) v(n))""")
def jsp_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    page = F.concat(F.lit('<h1>x</h1><c:choose><c:when test="${size < '), "p_size", F.lit('}"><b>Small</b></c:when><c:when test="${known}">Brand '), "p_brand", F.lit("</c:when><c:otherwise>Other</c:otherwise></c:choose>"))
    files = p.select(F.concat(F.lit("p/P"), "p_partkey", F.lit(".jsp")).alias("path"), page.alias("text"))
    return jsp.extract_rules(files).select("path", "outcome", F.array_join("when_", ";").alias("when"), "paths")


@query("""
SELECT event_id AS cell_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS intent, round(o / (o + 1), 6) AS posterior, CASE WHEN event_id % 2 = 0 THEN 'no witness cited' END AS discrepancy
FROM (SELECT *, (CASE WHEN event_id % 3 <> 0 AND event_id % 2 <> 0 THEN 0.85 / 0.25 ELSE 1 END) * (CASE WHEN event_id % 3 <> 0 THEN 1.75 ELSE 1 END) AS o FROM events) WHERE event_id % 3 <> 0
UNION ALL SELECT event_id, NULL, 0.5, 'no witness cited' FROM events WHERE event_id % 3 = 0""")
def parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of an annotator: in a code fence, without witnesses, or no JSON at all."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    witness = F.when(F.col("event_id") % 2 == 0, '[]').otherwise('["line 1"]')
    reply = F.when(F.col("event_id") % 3 == 0, "I cannot say.").otherwise(F.concat(F.lit('```json\n{"intent": "'), "event_type", F.lit('", "witnesses": '), witness, F.lit("}\n```")))
    got = evidence.parse_replies(e.select(F.col("event_id").alias("cell_id"), reply.alias("json")))
    return got.select("cell_id", "intent", F.round("posterior", 6).alias("posterior"), "discrepancy")


@query("""
SELECT coalesce(a.event_id, b.event_id) AS cell_id, CASE WHEN b.event_type IN ('click', 'view') THEN b.event_type ELSE a.event_type END AS intent FROM (SELECT * FROM events WHERE event_id % 2 = 0) a FULL JOIN (SELECT * FROM events WHERE event_id % 3 = 0) b ON a.event_id = b.event_id""")
def merged_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second event has a base and every third an overlay, which says something for two event types only."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    none, text = F.array().cast("array<string>"), F.lit(None).cast("string")
    row = lambda df, intent: df.select(F.col("event_id").alias("cell_id"), intent.alias("intent"), text.alias("behavior"), text.alias("error_behavior"), *(none.alias(c) for c in evidence.LISTS))
    over = row(e.where("event_id % 3 = 0"), F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise(""))
    return evidence.merge_annotations(row(e.where("event_id % 2 = 0"), F.col("event_type")), over).select("cell_id", "intent")


@query("""
WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation),
w AS (SELECT DISTINCT a AS i, a AS j, 0 AS d FROM e UNION SELECT i, b, d + 1 FROM w JOIN e ON a = j WHERE d < 4)
SELECT i, j, min(d) AS d FROM w WHERE i <> j GROUP BY 1, 2""")
def hop_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = demo_space(spark, sf_dir)
    edges = space.calls("java.contained_in").where(F.col("src").startswith("n"))
    return graph.hop_distances(edges, edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")))


@query(GRAPH + """
SELECT 'grounding' AS invariant_name, cell_id, CASE WHEN entity_type = 'java.annotation' THEN 'no provenance' ELSE 'no source place' END AS message, CASE WHEN entity_type = 'java.annotation' THEN 'error' ELSE 'warning' END AS severity FROM entities WHERE entity_type IN ('java.annotation', 'java.package')""")
def invariants_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived graph with the provenance of annotations and the places of packages taken away."""
    space = demo_space(spark, sf_dir)
    lost = F.when(F.col("cell_type") == "java.package", F.col("provenance").withField("uri", F.lit(None).cast("string"))).when(F.col("cell_type") != "java.annotation", F.col("provenance"))
    return invariants.grounding(space.with_tables(cells=space.cells.withColumn("provenance", lost)))


@query(GRAPH + """
SELECT n AS name, v AS value FROM (SELECT 'class' AS n, count(*) AS v FROM entities WHERE entity_type = 'java.class'
UNION ALL SELECT 'member', count(*) FROM entities t JOIN entities m ON starts_with(m.fqn, t.fqn || '.') WHERE t.entity_type = 'java.class' AND m.entity_type IN ('java.method', 'java.constructor')
UNION ALL SELECT 'package', count(DISTINCT regexp_replace(fqn, '\\.[^.]*$', '')) FROM entities WHERE entity_type = 'java.class'
UNION ALL SELECT 'unannotated', (SELECT count(*) FROM entities WHERE entity_type = 'java.class') + (SELECT count(*) FROM entities t JOIN entities m ON starts_with(m.fqn, t.fqn || '.') WHERE t.entity_type = 'java.class' AND m.entity_type IN ('java.method', 'java.constructor')))""")
def export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of lines of the Markdown specification."""
    line = F.col("line")
    kind = F.when(line.startswith("### "), "class").when(line.startswith("#### "), "member").when(line.startswith("## "), "package").otherwise("unannotated")
    return specs.export_lines(demo_space(spark, sf_dir)).groupBy(kind.alias("name")).agg(F.count("*").alias("value"))


@query(GRAPH + """
SELECT fqn AS symbol, entity_type, label AS signature FROM entities WHERE entity_type IN ('java.method', 'java.constructor', 'java.class', 'java.interface') AND fqn LIKE '%nation7%' OR (entity_type IN ('java.method', 'java.constructor', 'java.class') AND fqn LIKE '%Nation7%') ORDER BY fqn LIMIT 10""")
def enrich_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next ten symbols to annotate in a scope (the limit is the operator's own)."""
    space = demo_space(spark, sf_dir)
    lines = space.entities.select("file", F.explode(F.sequence("start_line", F.col("start_line") + 3)).alias("line_no")).distinct().select(F.col("file").alias("path"), "line_no", F.concat(F.lit("line "), "line_no").alias("line"))
    return specs.enrich_batch(space.with_tables(source_lines=lines), "Nation7", 10).select("symbol", "entity_type", "signature")


@query("""
SELECT c_custkey, 'gen.n' || c_nationkey AS package, 'gen.n' || c_nationkey || '.Cust' || c_custkey AS cls, 'gen.n' || c_nationkey || '.Cust' || c_custkey AS owner, 'Cust' || c_custkey AS simple FROM customer""")
def dotted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    fqn = F.concat(F.lit("gen.n"), "c_nationkey", F.lit(".Cust"), "c_custkey", F.lit(".rate"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", fqn.alias("f"))
    f = F.col("f")
    return c.select("c_custkey", names.package_of_types(f).alias("package"), names.class_prefix(f).alias("cls"), names.parent_name(f).alias("owner"), names.simple_name(names.parent_name(f)).alias("simple"))


# further queries register themselves
from quarrygraph import queries_sources  # noqa: E402, F401

__all__ = ["ORACLES", "QUERIES"]
