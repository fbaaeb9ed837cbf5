"""Queries over generated sources and small derived tables, with the SQL they are checked against.

Every table row makes a file, a line or a request, so each operator runs over as much as the tables hold.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.functions import kernels, names
from quarrygraph.operators import calls, column_usage, decision_table, evidence, findings, invariants, resolvers, specs, symbolic, topology
from quarrygraph.plans.demo import demo_space
from quarrygraph.plans.lift import lift
from quarrygraph.plans.space import Space
from quarrygraph.registry import query
from quarrygraph.session import shared_dir
from quarrygraph.sources import store
from quarrygraph.sources.files import decoded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(template: str) -> Column:
    """The template with the values of the columns named between dollar signs."""
    parts = re.split(r"\$(\w+)\$", template)
    return F.concat(*(F.col(p).cast("string") if k % 2 else F.lit(p) for k, p in enumerate(parts)))


def java_files(rows: DataFrame, path: str, text: str) -> DataFrame:
    return rows.select(filled(path).alias("path"), filled(text.strip("\n")).alias("text"))


# --- declarations and relations of many kinds ---------------------------------------------------------------------

NATION_FILE = """
package sh.n$k$;

@interface Mark$k$ { }
interface Duty$k$ {
    void serve() throws Fail$k$;
}
class Fail$k$ extends Exception {
    Fail$k$(String why) { super(why); }
}
abstract class Base$k$ implements Duty$k$ {
    protected int level, depth = 2;
    void note(String... words) { }
}
"""
SUPPLIER_FILE = """
package sh.n$k$;

import sh.n$k$.Fail$k$;

@Mark$k$
public class Supp$s$ extends Base$k$ {
    enum Mood { CALM, TENSE }
    record Pair(int a, int b) { }
    static class Part { int weigh() { return 1; } }
    @Mark$k$
    public void serve() throws Fail$k$ {
        Part p = new Part();
        if (level > $k$) { throw new Fail$k$("x"); }
        words().forEach(x -> tell(x));
        Supp$s$.ready();
        new Missing().go();
    }
    private void tell(int x) { }
    private void tell(int x, int y) { tell(x); }
    static boolean ready() { return true; }
}
"""


def shape_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("s"))
    return java_files(n, "sh/n$k$/Base$k$.java", NATION_FILE).unionByName(java_files(s, "sh/n$k$/Supp$s$.java", SUPPLIER_FILE))


_SHAPES = """
WITH n AS (SELECT n_nationkey AS k, 'sh.n' || n_nationkey AS p, 'sh/n' || n_nationkey || '/Base' || n_nationkey || '.java' AS file FROM nation),
s AS (SELECT s_nationkey AS k, 'sh.n' || s_nationkey AS p, 'sh.n' || s_nationkey || '.Supp' || s_suppkey AS c, s_suppkey, 'sh/n' || s_nationkey || '/Supp' || s_suppkey || '.java' AS file FROM supplier)
"""


@query(_SHAPES + """
SELECT p AS fqn, 'java.package' AS entity_type, 'n' || k AS label, file, 1 AS start_line, 1 AS end_line FROM n
UNION ALL SELECT p || '.' || t || k || m, 'java.' || e, replace(l, '#', t || k), file, a, b FROM n, (VALUES
  ('Mark', '', 'annotation', '#', 3, 3), ('Duty', '', 'interface', '#', 4, 6), ('Duty', '.serve', 'method', 'serve()', 5, 5), ('Fail', '', 'class', '#', 7, 9), ('Fail', '.<init>_1', 'constructor', '#(String)', 8, 8),
  ('Base', '', 'class', '#', 10, 13), ('Base', '.level', 'field', 'level', 11, 11), ('Base', '.depth', 'field', 'depth', 11, 11), ('Base', '.note', 'method', 'note(String...)', 12, 12)) v(t, m, e, l, a, b)
UNION ALL SELECT p, 'java.package', 'n' || k, file, 1, 1 FROM s
UNION ALL SELECT c || m, 'java.' || e, replace(l, '#', 'Supp' || s_suppkey), file, a, b FROM s, (VALUES
  ('', 'class', '#', 5, 21), ('.Mood', 'enum', 'Mood', 7, 7), ('.Mood.CALM', 'enum_constant', 'CALM', 7, 7), ('.Mood.TENSE', 'enum_constant', 'TENSE', 7, 7), ('.Pair', 'record', 'Pair', 8, 8), ('.Part', 'class', 'Part', 9, 9),
  ('.Part.weigh', 'method', 'weigh()', 9, 9), ('.serve', 'method', 'serve()', 10, 17), ('.tell', 'method', 'tell(int, int)', 19, 19), ('.ready', 'method', 'ready()', 20, 20)) v(m, e, l, a, b)""")
def shape_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of all kinds; overloads share a name, whose entity is the last of them."""
    return lift(shape_files(spark, sf_dir), "shapes").entities.select("fqn", "entity_type", "label", "file", "start_line", "end_line")


@query(_SHAPES + """
SELECT p || '.' || a || k || m AS from_fqn, p || CASE WHEN b = '' THEN '' ELSE '.' || b || k END AS to_fqn, 'java.' || r AS relation_type, file, l AS line FROM n, (VALUES
  ('Duty', '', '', 'contained_in', 4), ('Fail', '', '', 'contained_in', 7), ('Base', '', '', 'contained_in', 10), ('Duty', '.serve', 'Duty', 'contained_in', 5), ('Fail', '.<init>_1', 'Fail', 'contained_in', 8),
  ('Base', '.note', 'Base', 'contained_in', 12), ('Base', '', 'Duty', 'implements', 10), ('Duty', '.serve', 'Fail', 'throws', 5)) v(a, m, b, r, l)
UNION ALL SELECT c || a, c || b, 'java.' || r, file, l FROM s, (VALUES
  ('.Mood', '', 'contained_in', 7), ('.Pair', '', 'contained_in', 8), ('.Part', '', 'contained_in', 9), ('.Part.weigh', '.Part', 'contained_in', 9), ('.serve', '', 'contained_in', 10), ('.tell', '', 'contained_in', 18), ('.tell', '', 'contained_in', 19),
  ('.ready', '', 'contained_in', 20), ('.serve', '.Part', 'constructs', 12), ('.serve', '.tell', 'calls', 14), ('.serve', '.ready', 'calls', 15), ('.tell', '.tell', 'calls', 19)) v(a, b, r, l)
UNION ALL SELECT c || a, p || CASE WHEN b = '' THEN '' ELSE '.' || b || k END, 'java.' || r, file, l FROM s, (VALUES
  ('', '', 'contained_in', 5), ('', 'Base', 'extends', 5), ('', 'Mark', 'annotated_with', 5), ('.serve', 'Mark', 'annotated_with', 10), ('.serve', 'Fail', 'throws', 10), ('.serve', 'Fail', 'constructs', 13), ('', 'Fail', 'imports', 3)) v(a, b, r, l)""")
def shape_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment, inheritance, throws, annotations, constructions, calls from lambdas and with a class as receiver, imports."""
    space = lift(shape_files(spark, sf_dir), "shapes", emit_imports=True)
    n = space.entities.select("cell_id", "fqn").distinct()
    a, b = n.withColumnsRenamed({"cell_id": "from_cell_id", "fqn": "from_fqn"}), n.withColumnsRenamed({"cell_id": "to_cell_id", "fqn": "to_fqn"})
    # a name of several files has a cell in each; the target's cell is one of them
    to = space.incidences.join(b, "to_cell_id").join(a, "from_cell_id")
    return to.select("from_fqn", "to_fqn", "relation_type", "file", F.col("start_line").alias("line"))


@query(_SHAPES + """
SELECT c || '.serve' AS from_fqn, t AS target_text, 'java.' || r AS relation_type, file, l AS line FROM s, (VALUES ('words', 'calls', 14), ('words().forEach', 'calls', 14), ('new Missing().go', 'calls', 16), ('new Missing', 'constructs', 16)) v(t, r, l)""")
def shape_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift(shape_files(spark, sf_dir), "shapes").unresolved


@query(_SHAPES + """
, used AS (SELECT p || '.Fail' || k AS fqn FROM s UNION SELECT c || m FROM s, (VALUES ('.Part'), ('.tell'), ('.ready')) v(m))
SELECT c || m AS fqn, 'medium' AS confidence, 'unreferenced' AS reason FROM s, (VALUES ('.Part.weigh'), ('.Mood')) v(m)
UNION ALL SELECT c || '.serve', 'low', 'annotated' FROM s
UNION ALL SELECT p || m || k || t, 'medium', 'unreferenced' FROM n, (VALUES ('.Duty', '.serve'), ('.Base', '.note')) v(m, t)
UNION ALL SELECT p || '.Fail' || k, 'medium', 'unreferenced' FROM n WHERE p NOT IN (SELECT p FROM s) AND false
UNION ALL SELECT p || '.Base' || k, 'medium', 'unreferenced' FROM n WHERE k NOT IN (SELECT k FROM s)""")
def shape_dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested, overriding and annotated members; a class whose member is used is used."""
    return findings.dead_code(lift(shape_files(spark, sf_dir), "shapes")).select("fqn", "confidence", "reason")


# --- tables, columns and who touches them ---------------------------------------------------------------------------

STOCK_FILE = """
package st;
@Table(name = "stocks")
public class Stock {
    /** How many are left */
    private int amount;
    @Column(name = "place_code")
    private String place;
    public int getAmount() { return amount; }
    public void setAmount(int a) { amount = a; }
}
"""
USER_FILE = """
package st;
class User$s$ {
    int a(Stock x) { return x.getAmount(); }
    void b(Stock x) { x.setAmount($s$); }
    void c(Stock x) { x.place = "p"; }
    String q = "SELECT amount FROM stocks WHERE place_code = $s$";
    void d() { run("DELETE FROM stocks WHERE amount = 0"); help(); }
    void help() { run("UPDATE stocks SET amount = 1"); }
}
"""


def stock_space(spark: SparkSession, sf_dir: str) -> Space:
    one = spark.range(1).select(F.lit("st").alias("p"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"))
    ddl = one.select(F.lit("st/load.sql").alias("path"), F.lit("INSERT INTO stocks (amount) VALUES (1);\nCREATE TABLE stocks (\n  place_code VARCHAR(9) COMMENT 'Where'\n);").alias("text"))
    return lift(java_files(one, "st/Stock.java", STOCK_FILE).unionByName(java_files(s, "st/User$s$.java", USER_FILE)).unionByName(ddl), "stock")


@query("""
SELECT f AS field_name, n AS logical_name, c AS column_name, 'st/User' || s_suppkey || '.java' AS file, l AS line, t AS access_type FROM supplier, (VALUES
  ('amount', 'How many are left', 'amount', 3, 'read'), ('amount', 'How many are left', 'amount', 4, 'write'), ('amount', 'How many are left', 'amount', 6, 'read'), ('amount', 'How many are left', 'amount', 7, 'read'),
  ('amount', 'How many are left', 'amount', 8, 'write'), ('place', 'Where', 'place_code', 5, 'write'), ('place', 'Where', 'place_code', 6, 'read')) v(f, n, c, l, t)
UNION ALL SELECT 'amount', 'How many are left', 'amount', 'st/load.sql', 1, 'write'""")
def column_usage_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who reads and writes the columns of a table class: accessors, direct writes, SQL in strings and files."""
    out = column_usage.column_usage(stock_space(spark, sf_dir), "Stock")
    place = out.select("field_name", "logical_name", "column_name", F.explode(F.concat("readers", "writers")).alias("p"))
    return place.select("field_name", "logical_name", "column_name", "p.file", "p.line", "p.access_type")


@query("""SELECT 'st.Stock' AS table_class, 'stocks' AS table_name, 'st.User' || s_suppkey || '.d' AS entry_point, 'UD' AS operations FROM supplier""")
def crud_matrix_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each entry point does to the table, by itself and in what it calls."""
    return findings.crud_matrix(stock_space(spark, sf_dir)).select("table_class", "table_name", "entry_point", "operations")


@query("""
SELECT 'f/F' || s_suppkey || '.java' AS path, f AS field_name, t AS java_type, c AS column_name, replace(d, '#', s_suppkey::VARCHAR) AS doc, o AS ord FROM supplier, (VALUES
  ('a', 'int', NULL, 'First of #', 0), ('b', 'List<String>', 'b_col', NULL, 1), ('c', 'long', NULL, 'after it', 2)) v(f, t, c, d, o)""")
def field_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field declarations with the comment or column name that belongs to each."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"))
    text = 'class F {\n    /** First of $s$ */\n    private int a = $s$;\n    @Column(name = "b_col")\n    protected final List<String> b;\n    long c; // after it\n    void m() { return; }\n}'
    return kernels.field_declarations(java_files(s, "f/F$s$.java", text)).select("path", "field_name", "java_type", "column_name", "doc", "ord")


# --- annotations, the store, encodings --------------------------------------------------------------------------------

CUSTOMER_FILE = """
package gen.n$k$;

public class Cust$c$ {
    private double balance;
    public Cust$c$(double b) { this.balance = b; }
    public int rate(int a) { return call(a); }
    int call(int a) { return other(a); }
}
"""


def customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("c"))
    return java_files(c, "gen/n$k$/Cust$c$.java", CUSTOMER_FILE)


@query("""
SELECT t AS name, n * (SELECT count(*) FROM customer) AS rows FROM (VALUES ('cells', 6), ('entities', 6), ('incidences', 5), ('unresolved', 1), ('source_files', 1), ('source_lines', 8), ('obstructions', 0)) v(t, n)
UNION ALL SELECT 'annotations', 1""")
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table of a space that was lifted, annotated, saved, saved again and loaded."""
    root = f"{shared_dir(spark)}/quarry/store-{uuid.uuid4().hex}"
    store.save(lift(customer_files(spark, sf_dir), "customers"), root)
    space = store.load(spark, root, "customers")
    first = space.entities.where("entity_type = 'java.method'").agg(F.min("fqn")).first()[0]
    store.save(specs.annotate(specs.annotate(space, first, intent="one"), first, intent="two"), root)
    back = store.load(spark, root, "customers")
    rows = [(t, getattr(back, t).count()) for t in store.TABLES]
    return spark.createDataFrame(rows, "name string, rows long")


@query("""
WITH f AS (SELECT min('gen.n' || c_nationkey || '.Cust' || c_custkey) AS c FROM customer)
SELECT c || '.call' AS symbol, 'java.method' AS entity_type, 'call(int)' AS signature, 'two' AS intent, c || '.rate' AS callers, 'other' AS obstructions, '    int call(int a) { return other(a); }' AS source_code, c AS containing_class FROM f""")
def explain_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The explanation and the work order of a symbol that was annotated twice."""
    space = lift(customer_files(spark, sf_dir), "customers")
    name = space.entities.where("label = 'call(int)'").agg(F.min("fqn")).first()[0]
    noted = specs.annotate(specs.annotate(space, name, intent="one", behavior="old"), name, intent="two")
    one = calls.explain(noted, name).select("symbol", "entity_type", "signature", F.col("intent.value").alias("intent"), F.array_join("callers", ",").alias("callers"), F.array_join("obstructions", ",").alias("obstructions"))
    return one.join(specs.enrich(noted, name).select("symbol", "source_code", "containing_class"), "symbol")


@query("""
SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 3 THEN chr(65533) || chr(65533) || s_suppkey ELSE '日本' || s_suppkey END AS text,
  CASE s_suppkey % 4 WHEN 1 THEN 'shift_jis' WHEN 2 THEN 'euc-jp' ELSE 'utf-8' END AS encoding, s_suppkey % 4 = 3 AS lossy FROM supplier""")
def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in UTF-8, Shift_JIS, EUC-JP and none of them."""
    k = F.col("s_suppkey") % 4
    head = F.unhex(F.when(k == 0, "E697A5E69CAC").when(k == 1, "93FA967B").when(k == 2, "C6FCCBDC").otherwise("FFFF"))
    content = F.concat(head, F.col("s_suppkey").cast("string").cast("binary"))
    return decoded(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), content.alias("content"))).select("k", "text", "encoding", "lossy")


@query("""
SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'Order' || s_suppkey END AS entity, 'Ab' || s_suppkey AS cap, s_suppkey % 2 = 0 AS getter, s_suppkey % 2 = 1 AS setter, s_suppkey % 5 < 2 AS direct, s_suppkey % 5 = 1 AS writes,
  'src.Ab' || s_suppkey AS cls, 'a b ' || s_suppkey AS plain, s_suppkey % 2 = 0 AS logs FROM supplier""")
def name_functions_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository entities, capitalised names, accessor and direct access, classes of files, white space, logging calls."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    k = F.col("k").cast("string")
    name = F.when(F.col("k") % 3 == 0, filled("Order$k$Dao")).when(F.col("k") % 3 == 1, filled("Order$k$")).otherwise(F.lit("Repository"))
    call = F.when(F.col("k") % 2 == 0, F.concat(F.lit("x = o.getAb"), k, F.lit("();"))).otherwise(F.concat(F.lit("o.setAb"), k, F.lit("(1);")))
    access = F.when(F.col("k") % 5 == 0, F.lit("return o.size;")).when(F.col("k") % 5 == 1, F.lit("o.size = 1;")).when(F.col("k") % 5 == 2, F.lit("o.sizes = 1;")).otherwise(F.lit("size = 1;"))
    acc, direct = names.getter_setter_access(call, F.concat(F.lit("ab"), k)), names.direct_access(access, F.lit("size"))
    line = F.when(F.col("k") % 2 == 0, F.lit("System.out.println(x)")).otherwise(F.lit("System.outer(x)"))
    return s.select(
        "k", names.repository_entity(name).alias("entity"), names.capitalised(F.concat(F.lit("ab"), k)).alias("cap"), acc["getter"].alias("getter"), acc["setter"].alias("setter"), direct["found"].alias("direct"), direct["write"].alias("writes"),
        names.class_of_file(filled("src/Ab$k$.java")).alias("cls"), names.normalised(filled(" a\t b \n$k$ ")).alias("plain"), names.is_logging_call(line).alias("logs"),
    )


# --- symbolic execution and decision tables ---------------------------------------------------------------------------

BRANCH_FILE = """
class W$c$ {
    int f(int a, boolean go, boolean more) {
        switch (a) {
            case 1: return 10;
            case $m$: if (go) { log.info(a); } return 20;
            default: audit();
        }
        while (more) { a++; }
        return 30;
    }
    int g(boolean go) { if (go) { log.info(1); } return 1; }
    int h(boolean go) { while (go) { if (a()) { return 7; } } if (go) { return 1; } return 2; }
}
"""


@query("""
SELECT 'W' || c_custkey || f AS fqn, o AS outcome, replace(w, '#', (2 + c_custkey % 3)::VARCHAR) AS "when", d AS dead, p AS paths, i AS incomplete FROM customer, (VALUES
  ('.f', 'return 10', 'a == 1', 'go', 3, false), ('.f', 'return 20', 'NOT a == 1;a == #', 'go', 3, false), ('.f', 'return 30 {audit()}', 'NOT a == 1;NOT a == #', 'go', 3, false),
  ('.g', 'return 1', '', 'go', 1, false), ('.h', 'return 1', 'go', '', 2, true), ('.h', 'return 2', 'NOT go', '', 2, true)) v(f, o, w, d, p, i)""")
def branch_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of switches, effects, loops that can and cannot end the method, and tests that change nothing."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), (F.col("c_custkey") % 3 + 2).alias("m"))
    got = symbolic.extract_rules(java_files(c, "w/W$c$.java", BRANCH_FILE))
    return got.select("fqn", "outcome", F.array_join("when_", ";").alias("when"), F.array_join("dead", ";").alias("dead"), "paths", "incomplete")


def outcomes_by_rules(rows: DataFrame, variables: int) -> DataFrame:
    """(table_id, inputs, outcome) of every distinct row, by the minimal rules that hold for it."""
    rules = decision_table.minimise_tables(rows, variables).select("table_id", "when_", "outcome")
    asked = rows.select("table_id", "inputs").distinct()
    fits = F.forall(F.zip_with("when_", "inputs", lambda w, i: w.isNull() | (w == i)), lambda x: x)
    return asked.join(rules, "table_id").where(fits).select("table_id", "inputs", "outcome").distinct()


@query("""
SELECT DISTINCT l_returnflag AS table_id, l_linestatus = 'F' AS a, l_discount > 0.05 AS b, l_quantity > 25 AS c, l_tax > 0.04 AS d,
  CASE WHEN l_linestatus = 'F' AND l_quantity > 25 THEN 'a' WHEN l_discount > 0.05 THEN 'b' ELSE 'c' END AS outcome FROM lineitem""")
def decision_rules_faithful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimal rules of one table a return flag, applied to every distinct row, give back its outcome and no other."""
    li = table(spark, sf_dir, "lineitem")
    inputs = F.array(F.col("l_linestatus") == "F", F.col("l_discount") > 0.05, F.col("l_quantity") > 25, F.col("l_tax") > 0.04)
    outcome = F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 25), "a").when(F.col("l_discount") > 0.05, "b").otherwise("c")
    out = outcomes_by_rules(li.select(F.col("l_returnflag").alias("table_id"), inputs.alias("inputs"), outcome.alias("outcome")), 4)
    return out.select("table_id", *(F.col("inputs")[k].alias(c) for k, c in enumerate("abcd")), "outcome")


@query("""
WITH r AS (SELECT l_returnflag AS table_id, list_transform(range(14), lambda k: CASE WHEN k = 13 THEN l_linestatus = 'F' ELSE l_quantity > 3 * k + 5 END) AS inputs, CASE WHEN l_quantity > 20 AND l_linestatus = 'F' THEN 'x' WHEN l_quantity > 35 THEN 'y' ELSE 'z' END AS outcome FROM lineitem)
SELECT DISTINCT table_id, array_to_string(list_transform(inputs, lambda x: CASE WHEN x THEN '1' ELSE '0' END), '') AS inputs, outcome FROM r""")
def decision_cubes_faithful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over fourteen variables, beyond what the exact minimiser takes."""
    li = table(spark, sf_dir, "lineitem")
    inputs = F.array(*(F.col("l_quantity") > 3 * k + 5 for k in range(13)), F.col("l_linestatus") == "F")
    outcome = F.when((F.col("l_quantity") > 20) & (F.col("l_linestatus") == "F"), "x").when(F.col("l_quantity") > 35, "y").otherwise("z")
    out = outcomes_by_rules(li.select(F.col("l_returnflag").alias("table_id"), inputs.alias("inputs"), outcome.alias("outcome")), 14)
    return out.select("table_id", F.array_join(F.transform("inputs", lambda x: F.when(x, "1").otherwise("0")), "").alias("inputs"), "outcome")


# --- topology, invariants, evidence, resolvers ------------------------------------------------------------------------


def nation_metric(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations of one region are 1 apart; the least nations of following regions 3 and their region's key."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("r"))
    a, b = n.withColumnsRenamed({"node": "i"}), n.withColumnsRenamed({"node": "j"})
    near = a.join(b, "r").where("i < j").select("i", "j", F.lit(1.0).alias("d"))
    least = n.groupBy("r").agg(F.min("node").alias("m"))
    x, y = least.select(F.col("r").alias("ra"), F.col("m").alias("ma")), least.select((F.col("r") - 1).alias("ra"), F.col("m").alias("mb"))
    far = x.join(y, "ra").select(F.least("ma", "mb").alias("i"), F.greatest("ma", "mb").alias("j"), (F.col("ra") + 3.0).alias("d"))
    return n.select("node", F.concat(F.lit("r"), "r", F.lit(".N"), F.lpad(F.col("node").cast("string"), 2, "0")).alias("fqn")), near.unionByName(far)


@query("""
SELECT string_agg('r' || n_regionkey || '.N' || lpad(n_nationkey::VARCHAR, 2, '0'), ',' ORDER BY n_nationkey) AS members FROM nation GROUP BY n_regionkey""")
def persistent_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that live two stages at least: regions, which merge one after another."""
    points, distances = nation_metric(spark, sf_dir)
    return topology.clusters(points, distances, 2).select(F.array_join("members", ",").alias("members"))


@query("""
SELECT a.n_nationkey AS i, b.n_nationkey AS j, least(abs(a.n_nationkey - b.n_nationkey)::DOUBLE, CASE WHEN a.n_regionkey = b.n_regionkey THEN 1.5 ELSE 1e9 END) AS d FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey""")
def combined_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lesser of two metrics, one of which lacks pairs."""
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("i"), F.col("n_regionkey").alias("r")), n.select(F.col("n_nationkey").alias("j"), F.col("n_regionkey").alias("q"))
    pairs = a.join(b, F.col("i") < F.col("j"))
    return topology.min_combine(pairs.select("i", "j", F.abs(F.col("i") - F.col("j")).cast("double").alias("d")), pairs.where("r = q").select("i", "j", F.lit(1.5).alias("d")))


@query(_SHAPES + """
SELECT 'acyclicity' AS name, count(*) AS violations FROM n WHERE false
UNION ALL SELECT 'consistency', 0
UNION ALL SELECT 'grounding', 0""")
def shape_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations by kind over sources without cycles, all grounded."""
    space = lift(shape_files(spark, sf_dir), "shapes")
    kinds = spark.createDataFrame([("acyclicity",), ("consistency",), ("grounding",)], "name string")
    found = invariants.check(space).groupBy(F.col("invariant_name").alias("name")).agg(F.count("*").alias("n"))
    return kinds.join(found, "name", "left").select("name", F.coalesce("n", F.lit(0)).cast("long").alias("violations"))


@query("""
SELECT 'E' || c_nationkey || '_' || c_custkey AS cycle, count(*) OVER (PARTITION BY c_nationkey) AS length FROM customer WHERE false
UNION ALL SELECT 'C' || s_suppkey || ' → D' || s_suppkey || ' → C' || s_suppkey, 2 FROM supplier""")
def inheritance_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that extend each other, each cycle once."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"))
    space = lift(java_files(s, "e/C$s$.java", "package e;\nclass C$s$ extends D$s$ { }\nclass D$s$ extends C$s$ { }\nclass Z$s$ extends C$s$ { }"), "cycles")
    found = invariants.acyclicity(space, "java.extends", None, 20)
    return found.select(F.col("message").alias("cycle"), (F.size(F.split("message", " → ")) - 1).cast("long").alias("length"))


@query("""
SELECT 'p' || p_partkey AS cell_id, p_partkey % 2 = 0 AS told FROM part""")
def corroborated_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations from replies that answer every second part with something, the rest with nothing."""
    space = demo_space(spark, sf_dir)
    reply = F.when(F.col("p_partkey") % 2 == 0, F.lit('{"behavior": "moves", "witnesses": ["l"]}')).otherwise(F.lit('{"intent": "", "side_effects": []}'))
    replies = table(spark, sf_dir, "part").select(filled("p$p_partkey$").alias("cell_id"), reply.alias("json"))
    return evidence.corroborate(space, replies).select("cell_id", evidence.has_content().alias("told"))


@query("""
SELECT 'file:///a%20b/C' || c_custkey || '%2B.java' AS uri, '/a b/C' || c_custkey || '+.java' AS path, 'a.C' || c_custkey AS fqn FROM customer""")
def uri_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(resolvers.path_to_uri(filled("/a b/C$c_custkey$+.java")).alias("uri"), resolvers.path_to_fqn(filled("src/main/a/C$c_custkey$.java"), F.lit("src/main")).alias("fqn"))
    return c.select("uri", resolvers.uri_to_path(F.col("uri")).alias("path"), "fqn")


@query("""
SELECT 'Supp' || s_suppkey AS target_text, CASE WHEN s_suppkey % 2 = 0 THEN 'cached.Supp' ELSE 'x.Supp' END || s_suppkey AS fqn FROM supplier""")
def resolver_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache made from answers at places, asked twice, and the textual rules for what it does not know."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"))
    answers = s.where("s % 2 = 0").select(filled("Supp$s$").alias("target_text"), F.lit("F.java").alias("file"), F.col("s").cast("int").alias("line"), F.lit(1).alias("col"), filled("cached.Supp$s$").alias("fqn"))
    cache = resolvers.resolution_cache(answers.unionByName(answers))
    asked = s.select(filled("Supp$s$").alias("target_text"), F.lit("x").alias("package"), F.lit("x.A").alias("class"))
    known = s.select(filled("x.Supp$s$").alias("fqn"))
    return resolvers.ChainResolver(resolvers.CachedResolver(cache), resolvers.HeuristicResolver(known)).resolve_type(asked)
