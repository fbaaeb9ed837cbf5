"""Kernels, column functions, decision tables, graph plans, evidence, service and streaming."""

from __future__ import annotations

import io
import json
import random

import pytest
from conftest import FIXTURES, SF
from pyspark.sql import functions as F

from quarrygraph.cli import main
from quarrygraph.functions import code, kernels, names
from quarrygraph.functions.javaparse import parse
from quarrygraph.operators import evidence, topology
from quarrygraph.operators.decision_table import Conflict, Table, TableError, compress, contains, cube, expand, intersects, minimise_cubes, minimise_tables, prime_implicants, select_cover
from quarrygraph.plans import graph
from quarrygraph.service import Service
from quarrygraph.sources.files import read_sources
from quarrygraph.streaming import relift


def faithful(t: Table) -> None:
    c = compress(t)
    for inputs, outcome in t.rows:
        pos, neg = cube(inputs)
        for when, o in c.rules:
            p, n = cube(when)
            if o == outcome:
                continue
            assert not intersects((p, n), (pos, neg)), (inputs, when)
        assert any(o == outcome and intersects(cube(w), (pos, neg)) for w, o in c.rules)


def make(n, f, rng, rows):
    t = Table([f"v{k}" for k in range(n)])
    for _ in range(rows):
        i = tuple(rng.random() < 0.5 for _ in range(n))
        t.add(i, f(i))
    return t


@pytest.mark.parametrize("n", [1, 3, 6, 12, 13, 20])
def test_minimiser_is_faithful_and_repeats(n):
    rng = random.Random(n)
    t = make(n, lambda i: "a" if i[0] else "b" if sum(i) % 2 else "c", rng, 60)
    faithful(t)
    assert compress(t).rules == compress(t).rules


def test_dead_variables_and_markdown():
    t = make(4, lambda i: "x" if i[1] else "y", random.Random(0), 60)
    c = compress(t)
    assert c.live == ["v1"] and c.dead == ["v0", "v2", "v3"] and "Dead variables: `v0`" in c.to_markdown()


def test_cover_of_a_multiplexer():
    # minterms of s ? a : b over bits s = 4, a = 2, b = 1; the consensus term a b is no part of the least cover
    on = {m for m in range(8) if (m >> 1 & 1 if m >> 2 & 1 else m & 1)}
    primes = prime_implicants(on, 3)
    assert len(primes) == 3 and len(select_cover(primes, on, 3)) == 2
    # with s always set as don't care only a is left to test
    assert len(select_cover(prime_implicants(on | {0, 1, 2, 3}, 3), on - {1, 3}, 3)) == 1


def test_table_errors():
    with pytest.raises(TableError):
        compress(Table(["a"]))
    with pytest.raises(TableError):
        Table(["a"]).add((True, False), "x")
    t = Table(["a", "b"])
    t.add((True, None), "x")
    t.add((None, True), "y")
    with pytest.raises(Conflict):
        compress(t)
    wide = Table([f"v{k}" for k in range(65)])
    wide.add((None,) * 65, "x")
    with pytest.raises(TableError):
        compress(wide)


def test_cubes():
    a, b = cube((True, None, False)), cube((True, True, False))
    assert contains(a, b) and not contains(b, a) and intersects(a, b) and not intersects(cube((False, None, None)), a)
    assert expand(b, [cube((False, True, False))], 3) == cube((True, None, None))
    assert minimise_cubes([b], [], 3) == [(0, 0)]


def test_minimise_tables(spark):
    rows = [("t", [True, None], "x"), ("t", [False, True], "y"), ("t", [True, None], "x"), ("u", [True, True], "x"), ("u", [None, True], "y")]
    got = minimise_tables(spark.createDataFrame(rows, "table_id string, inputs array<boolean>, outcome string"), 2).collect()
    assert {(r.table_id, tuple(r.when_), r.outcome) for r in got if r.rule_no >= 0} == {("t", (True, None), "x"), ("t", (False, None), "y")}
    assert [r.table_id for r in got if r.error] == ["u"]


def random_graph(seed, n=30, m=40):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)]


def test_graph_plans(spark):
    pairs = random_graph(3)
    edges = spark.createDataFrame(pairs, "src string, dst string")
    nodes = spark.createDataFrame([(f"n{k:02d}",) for k in range(30)], "node string")
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)

    def reach(start, both=False):
        seen, todo = {start: 0}, [start]
        while todo:
            x = todo.pop(0)
            for y in near.get(x, set()) | ({a for a, b in pairs if b == x} if both else set()):
                if y not in seen:
                    seen[y] = seen[x] + 1
                    todo.append(y)
        return seen

    start = pairs[0][0]
    found, done = graph.search(edges, spark.createDataFrame([(start,)], "node string"), 99)
    assert {r.node: r.depth for r in found.collect()} == reach(start) and done
    assert {r.node: r.component for r in graph.components(nodes, edges).collect()} == {f"n{k:02d}": min(reach(f"n{k:02d}", True)) for k in range(30)}
    got = {(r.start, r.node) for r in graph.closure(edges, nodes.where("node < 'n05'")).collect()}
    assert got == {(f"n{k:02d}", y) for k in range(5) for y in reach(f"n{k:02d}")}
    hops = {(r.i, r.j): r.d for r in graph.hop_distances(edges, nodes).collect()}
    assert hops == {(f"n{k:02d}", y): d for k in range(30) for y, d in reach(f"n{k:02d}", True).items() if d}


def test_components_around_hubs(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT_LEAST", 3)
    rng = random.Random(4)
    pairs = [(0, k) for k in range(1, 300)] + [(900, k) for k in range(600, 899)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(5, 700), (None, 3), (1200, None)]
    parent = {x: x for p in pairs for x in p}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.id: r.component for r in graph.connected(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    # the least id of a component has no row of its own
    assert all(got.get(x, x) == find(x) for x in parent if x is not None) and 1200 not in got


def test_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("d", "d"), ("c", "d")], "src string, dst string")
    assert [tuple(r.path) for r in graph.cycles(edges).collect()] == [("d",), ("a", "b"), ("a", "b", "c")]


def test_persistence(spark):
    pts = spark.createDataFrame([(k, f"p.C{k}.m") for k in range(4)], "node long, fqn string")
    d = spark.createDataFrame([(0, 1, 1.0), (2, 3, 1.0), (1, 2, 3.0)], "i long, j long, d double")
    tree = topology.MergeTree(pts, d)
    counts = [r.components for r in tree.counts().orderBy("stage").collect()]
    assert counts == [4, 2, 1] and tree.cut_stage(2) == 1
    got = topology.clusters(pts, d, 2).collect()
    assert [tuple(r.members) for r in got] == [("p.C0.m", "p.C1.m"), ("p.C2.m", "p.C3.m")]
    assert topology.min_combine(d, spark.createDataFrame([(0, 1, 0.5)], "i long, j long, d double")).where("i = 0").first().d == 0.5


def test_evidence(spark):
    yes = {n: F.lit(True) for n, _, _ in evidence.LIKELIHOODS}
    assert abs(spark.range(1).select(evidence.posterior(yes).alias("p")).first().p - 0.9647) < 1e-3
    replies = spark.createDataFrame([("a", 'Sure: ```{"intent": "x", "witnesses": ["l1"]}```'), ("b", "no json"), ("c", None)], "cell_id string, json string")
    got = {r.cell_id: r for r in evidence.parse_replies(replies).collect()}
    assert got["a"].intent == "x" and got["a"].discrepancy is None and got["b"].posterior == 0.5 and got["c"].discrepancy
    u = spark.createDataFrame([(0.9,), (0.5,), (0.1,)], "c double")
    assert tuple(evidence.completion_counts(evidence.completion(u, F.col("c"))).first()) == (3, 1, 1, 1)
    t = lambda *x: spark.createDataFrame(list(x), "subject string, relation string, object string")
    out = {r.subject: r.agreement for r in evidence.correspondence(t(("a", "r", "x"), ("b", "r", "x"), ("c", "r", "x"), ("d", "r", "x")), t(("a", "r", "x"), ("b", "r", "y"), ("c", "r", "x"), ("c", "q", "z"))).collect()}
    assert out == {"a": "agreeing", "b": "conflicting", "c": "partial", "d": "none"}
    cols = "cell_id string, intent string, behavior string, error_behavior string, preconditions array<string>, postconditions array<string>, invariants array<string>, side_effects array<string>"
    base = spark.createDataFrame([("a", "i", "b", None, ["p"], [], [], [])], cols)
    over = spark.createDataFrame([("a", "", "new", None, [], [], [], ["s"])], cols)
    m = evidence.merge_annotations(base, over).first()
    assert (m.intent, m.behavior, m.preconditions, m.side_effects) == ("i", "new", ["p"], ["s"])


def test_names(spark):
    one = spark.range(1)
    of = lambda f, x: one.select(f(F.lit(x)).alias("x")).first().x
    assert of(names.package_of_types, "com.example.model.User.getName") == "com.example.model" and of(names.package_of_types, "Foo") == ""
    assert of(names.class_prefix, "a.b.Foo.bar") == "a.b.Foo" and of(names.parent_name, "Foo") == "Foo"
    assert of(names.snake_case, "URLId") == "u_r_l_id" and of(names.snake_case, "userName") == "user_name"
    assert of(names.is_accessor, "getUser(Long)") and not of(names.is_accessor, "settle()")
    assert [of(names.repository_operation, m) for m in ("saveAll", "findById", "createX", "mergeY", "purge", "zap")] == ["CU", "R", "C", "U", "D", None]
    assert of(names.repository_entity, "UserDao") == "User" and of(names.repository_entity, "User") is None
    assert of(names.tags_stripped, "<b>" + "x" * 70 + "</b>") == "x" * 60 + "…" and of(names.capitalised, "aBc") == "ABc"
    assert of(code.branch_count, "if (a && b) iff for") == 3
    assert of(lambda c: code.table_access(c, "user"), "DELETE FROM user WHERE a = 1") == "D" and of(lambda c: code.table_access(c, "user"), "select 1 from users") is None
    assert of(lambda c: code.column_access(c, "mail"), "UPDATE t SET a = 1 WHERE mail = 2") == "read"


def test_line_kernels():
    ddl = kernels.ddl_rows((FIXTURES / "harbor/sql/layout.sql").read_text())
    assert ddl == [("quay", "code", "CHAR(4)", None), ("quay", "depth", "DECIMAL(5,2)", "Metres at low tide"), ("pallets", "pallet_no", "BIGINT", "Painted number"), ("pallets", "bound", "VARCHAR(20)", None), ("pallets", "mass", "DOUBLE", "Kilograms")]
    got = kernels.field_rows('/** The key */\n@Column(name = "k")\nprivate Long id;\nString a = "x"; // why\nreturn x;\nvoid f() {\nint n;\n')
    assert [(r[0], r[2], r[3]) for r in got] == [("id", "k", "The key"), ("a", None, "why"), ("n", None, None)]
    maps = kernels.mapper_rows((FIXTURES / "harbor/mapper/Yard.xml").read_text())
    assert [(m[0].rpartition(".")[2], m[1]) for m in maps] == [("stack", "insert"), ("heaviest", "select"), ("clear", "delete")]


def test_decode():
    text = "日本語"
    assert kernels.decode(text.encode("cp932"))[:2] == (text, "shift_jis") and kernels.decode(text.encode()) == (text, "utf-8", False)
    assert kernels.decode(b"\xff\xff\xff")[2] and kernels.decode(text.encode("euc_jp"), "euc-jp")[0] == text
    with pytest.raises(ValueError):
        kernels.decode(b"", "klingon")


def test_read_sources(spark, tmp_path):
    (tmp_path / "a" / "gen").mkdir(parents=True)
    (tmp_path / "a" / "X.java").write_bytes("class X { /* 日本 */ }".encode("cp932"))
    (tmp_path / "a" / "Y.java").write_text("class Y {}")
    (tmp_path / "a" / "gen" / "Z.java").write_text("class Z {}")
    got = {r.path: r.encoding for r in read_sources(spark, str(tmp_path), excludes=["**/gen/**"]).collect()}
    assert got == {"a/X.java": "shift_jis", "a/Y.java": "utf-8"}
    with pytest.raises(ValueError):
        read_sources(spark, str(tmp_path), encoding="klingon")


def test_parser_survives():
    unit, p = parse("class A { int x = ; void f() { foo( } void g() {} } class B {}")
    assert p.errors and unit.kids[-1]["name"] == "B"
    assert parse("")[0].kids == [] and parse("}{ ((")[1].errors


def test_service(harbor, tmp_path):
    s = Service(harbor, str(tmp_path))
    ask = lambda name, **a: json.loads(s.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})))
    assert len(json.loads(s.handle('{"id": 1, "method": "tools/list"}'))["result"]["tools"]) == 24
    assert json.loads(s.handle("{"))["error"]["code"] == -32700 and s.handle('{"method": "x"}') is None
    assert json.loads(s.handle('{"id": 1, "method": "zap"}'))["error"]["code"] == -32601
    assert ask("nope")["error"]["code"] == -32602 and ask("explain")["error"]["code"] == -32602 and ask("explain", symbol="zz")["error"]["code"] == -32000
    assert "removeAll" in ask("enrich", symbol="Yard.clear")["result"]["content"][0]["text"]
    assert "4 paths" in ask("extract_core_rules", symbol="Crane.raise")["result"]["content"][0]["text"]
    assert "paused: 3" in ask("debug_trace", symbol="Crane.raise", choices=[])["result"]["content"][0]["text"]
    assert "ok" in ask("annotate", symbol="port.cargo.Yard.clear", intent="x")["result"]["content"][0]["text"]
    assert "annotations" in ask("save")["result"]["content"][0]["text"]
    out = io.StringIO()
    s.serve(io.StringIO('\n{"id": 2, "method": "ping"}\n'), out)
    assert json.loads(out.getvalue()) == {"jsonrpc": "2.0", "id": 2, "result": {}}


def test_cli(spark, tmp_path, capsys):
    at = ["--store", str(tmp_path / "s")]
    assert main(["lift", str(FIXTURES / "harbor"), *at], spark) == 0
    assert json.loads(capsys.readouterr().out)["cells"] == 61
    assert main(["query", "callers", '{"symbol": "Crane.drop"}', *at], spark) == 0 and "inspect" in capsys.readouterr().out
    assert main(["query", "explain", '{"symbol": "zz"}', *at], spark) == 1
    assert main(["rules", str(FIXTURES), *at], spark) == 0 and "throw new port.dock.Overload" in capsys.readouterr().out


def test_stream(spark, tmp_path):
    src, root = tmp_path / "src", tmp_path / "store"
    src.mkdir()
    (src / "A.java").write_text("class A { void f() { g(); } void g() {} }")
    spaces = []
    run = lambda: relift.relift(relift.stream_files(spark, str(src)), str(root), "live", str(tmp_path / "cp"), spaces.append).awaitTermination()
    run()
    (src / "B.java").write_text("class B extends A {}")
    run()
    (src / "C.java").write_bytes("class C { /* 日本 */ void h() {} }".encode("cp932"))
    run()
    assert [s.entities.count() for s in spaces][-1] == 6 and {r.encoding for r in spaces[-1].source_files.collect()} == {"utf-8", "shift_jis"} and spaces[-1].incidences.where("relation_type = 'java.extends'").count() == 1


def test_driver_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    for name in ("overview_types", "package_deps", "decision_conflicts", "name_functions", "sql_access"):
        assert e.queries()[name](spark, SF).count() > 0


def test_resolvers(spark):
    from quarrygraph.operators import resolvers as r

    symbols = spark.createDataFrame([("a.B",), ("a.B.f",), ("c.B",)], "fqn string")
    names = spark.createDataFrame([("B", "a", "a.B"), ("Z", "a", "a.B"), ("f", "a", "a.B")], "target_text string, package string, class string")
    h = r.HeuristicResolver(symbols)
    assert {tuple(x) for x in h.resolve_type(names.where("target_text <> 'f'")).collect()} == {("B", "a.B"), ("B", "c.B")}
    assert {tuple(x) for x in h.resolve_method_call(names).collect()} == {("f", "a.B.f")}
    cache = r.resolution_cache(spark.createDataFrame([("B", "x", 1, 1, "c.B"), ("B", "x", 1, 1, "c.B"), ("Z", "x", 2, 1, None)], "target_text string, file string, line int, col int, fqn string"))
    assert {tuple(x) for x in r.ChainResolver(r.CachedResolver(cache), h).resolve_type(names).collect()} == {("B", "c.B"), ("f", "a.B.f")}


def test_resolver_references(harbor):
    from quarrygraph.operators import resolvers as r

    h = r.HeuristicResolver(harbor.entities.select("fqn"), harbor.incidences, harbor.entities)
    one = harbor.spark.createDataFrame([("port.dock.Crane.load",)], "fqn string")
    assert [(x.from_fqn, x.relation_type) for x in h.find_references(one).collect()] == [("port.dock.Crane.inspect", "java.calls")]
    assert [tuple(x) for x in r.source_roots(harbor.table("source_files")).collect()] == [("src", 8)]


def test_uris(spark):
    from quarrygraph.operators import resolvers as r

    one = spark.range(1).select(r.path_to_uri(F.lit("/a b/C+.java")).alias("u"))
    assert one.first().u == "file:///a%20b/C%2B.java" and one.select(r.uri_to_path(F.col("u")).alias("p")).first().p == "/a b/C+.java"
    assert spark.range(1).select(r.path_to_fqn(F.lit("src/a/B.java"), F.lit("src")).alias("f")).first().f == "a.B"
