"""Lookup tables, strong components, condensed closure and cycles against plain versions on random graphs."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarrygraph import schema
from quarrygraph.operators import calls, catalogue, findings, invariants, specs, topology
from quarrygraph.plans import condense, graph
from quarrygraph.plans.space import Space, containing, resolve
from quarrygraph.sources import index, store


def random_space(spark, seed=1, n=120, links=260):
    rng = random.Random(seed)
    parts = ["user", "User", "order", "Order", "get", "set", "Repo", "x1", "a", "Service"]
    fqns = [".".join(rng.choice(parts) + str(rng.randrange(4)) for _ in range(rng.randrange(1, 5))) for _ in range(n)]
    kinds = ["java.method", "java.class", "java.method", "java.field"]
    entities = [(f, f"c{k}", rng.choice(kinds), f.split(".")[-1] + "()", f"f{k % 9}.java", k, k + 2, 0, 1) for k, f in enumerate(fqns)]
    edges = {(f"c{rng.randrange(n)}", f"c{min(int(rng.expovariate(0.05)), n - 1)}", rng.choice(["java.calls", "java.constructs", "java.extends"])) for _ in range(links)}
    rows = [(f"i{k}", a, b, r, "f.java", k, k, 0.9, "x") for k, (a, b, r) in enumerate(sorted(edges))]
    cells = [(c, "t", 0, e, label, (f"{file}#L1", file, 0.9, "x")) for f, c, e, label, file, *_ in entities]
    make = spark.createDataFrame
    return Space(entities=make(entities, schema.ENTITIES), incidences=make(rows, schema.INCIDENCES), cells=make(cells, schema.CELLS), space_id="random")


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    """A space, and the same one loaded with its lookup tables; some cells are hot, some letters too common."""
    space, root = random_space(spark), str(tmp_path_factory.mktemp("store"))
    kept = index.HOT_EDGES, index.GRAM_LEAST, index.BLOCK, index.BUCKET_ROWS
    index.HOT_EDGES, index.GRAM_LEAST, index.BLOCK, index.BUCKET_ROWS = 12, 5, 7, 20
    try:
        store.save(space, root, indexed=True)
    finally:
        index.HOT_EDGES, index.GRAM_LEAST, index.BLOCK, index.BUCKET_ROWS = kept
    return space, store.load(spark, root, "random")


def rows(df):
    return sorted(map(str, df.collect()))


def test_neighbours(spark, pair):
    space, stored = pair
    assert stored.index.hot
    for nodes in (["c0", "c1", "c2"], ["c5"], ["none"], [f"c{k}" for k in range(120)]):
        for incoming, here, there in ((False, "from_cell_id", "to_cell_id"), (True, "to_cell_id", "from_cell_id")):
            want = rows(space.incidences.where(F.col(here).isin(nodes) & (F.col("relation_type") != "java.extends")).select(here, there, "relation_type", "start_line").toDF("n", "o", "r", "l"))
            frame = spark.createDataFrame([(n,) for n in nodes], "node string")
            for asked in (nodes, frame):
                assert rows(stored.index.near(asked, incoming, schema.CALLS).select("node", "other", "relation_type", "start_line").toDF("n", "o", "r", "l")) == want


def test_a_lookup_reads_its_buckets_and_exchanges_no_edges(spark, pair):
    stored = pair[1]
    explain = lambda df: df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    # the planner shows the buckets it selects only where it keeps the scan bucketed; it skips the others' files either way
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        plan = explain(stored.index.near(["c50"], True, ("java.calls",)))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert f"SelectedBucketsCount: 1 out of {stored.index.buckets['in']}" in plan and "Exchange" not in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frontier = spark.range(1000).select(F.concat(F.lit("c"), "id").alias("node"))
        plain = index.SpaceIndex(spark, stored.index.root, stored.index.buckets, ())
        plan = explain(plain.near(frontier, False))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1  # of the frontier alone


@pytest.mark.parametrize("few", [2000, 3])
def test_searches_by_lookup_equal_those_by_scan(spark, pair, monkeypatch, few):
    """With lists all the way, and with tables from the first steps on."""
    monkeypatch.setattr(index, "FEW", few)
    space, stored = pair
    for symbol in [r.fqn for r in space.entities.orderBy("cell_id").limit(2).collect()]:
        for f in (lambda s: calls.impact(s, symbol, 4), lambda s: calls.callers(s, symbol), lambda s: calls.callees(s, symbol), lambda s: calls.enforces(s, symbol, "extends", 3), lambda s: calls.enforces(s, symbol, "throws", 50)):  # noqa: B023
            assert rows(f(stored)) == rows(f(space))


def test_names_by_letters_and_endings(pair, monkeypatch):
    space, stored = pair
    rng = random.Random(2)
    names = [r.fqn for r in space.entities.collect()]
    asked = ["user", "USER1", "er2.or", "zzz", "a", "", "ice3()", "get1.set"] + [(f := rng.choice(names))[(k := rng.randrange(len(f))) : k + rng.randrange(1, 9)] for _ in range(4)]
    by_lookup = 0
    for part in asked:
        by_lookup += stored.index.containing(part.lower()) is not None
        assert rows(containing(stored, part)) == rows(containing(space, part)), part
    assert by_lookup > 3
    assert rows(catalogue.search(stored, "user", limit=5)) == rows(catalogue.search(space, "user", limit=5))
    monkeypatch.setattr(index, "FEW", 1)
    assert rows(containing(stored, "user1")) == rows(containing(space, "user1"))
    for symbol in (*names[:2], *(n.split(".")[-1] for n in names[:4]), "nothing", "er1"):
        assert rows(resolve(stored, symbol)) == rows(resolve(space, symbol))
    assert stored.with_tables(entities=space.entities).index is None and stored.with_tables(annotations=space.table("annotations")).index is not None


def plain_components(nodes, edges):
    label = {n: n for n in nodes}
    change = True
    while change:
        change = False
        for a, b in edges:
            low = min(label[a], label[b])
            change |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_stored_labels_and_their_merge(spark, pair):
    space, stored = pair
    cells = [r.cell_id for r in space.cells.collect()]
    links = [(r.from_cell_id, r.to_cell_id, r.relation_type) for r in space.incidences.collect()]
    every, by_calls = plain_components(cells, [(a, b) for a, b, _ in links]), plain_components(cells, [(a, b) for a, b, r in links if r == "java.calls"])
    assert {r.cell_id: (r.by_calls, r.by_all) for r in stored.index.labels().collect()} == {c: (by_calls[c], every[c]) for c in cells}
    assert rows(topology.domain_clusters(stored)) == rows(topology.domain_clusters(space)) and rows(invariants.reachability(stored)) == rows(invariants.reachability(space))
    sizes = {r.component: (r.members, r.packages) for r in topology.cluster_sizes(stored).collect()}
    assert sizes == {r.component: (len(r.members), len(r.packages)) for r in topology.domain_clusters(space).collect()}
    rng = random.Random(3)
    more = [(rng.choice(cells), rng.choice(cells)) for _ in range(25)]
    merged = index.merged_labels(stored.index.labels(), "by_calls", spark.createDataFrame(more, "src string, dst string"))
    want = plain_components(cells, [(a, b) for a, b, r in links if r == "java.calls"] + more)
    assert {r.cell_id: r.by_calls for r in merged.collect()} == want and merged.columns == ["cell_id", "by_calls", "by_all"]


def reach(nodes, edges):
    out = {n: {n} for n in nodes}
    change = True
    while change:
        change = False
        for a, b in edges:
            more = out[b] - out[a]
            out[a] |= more
            change |= bool(more)
    return out


@pytest.mark.parametrize("seed,n,links", [(1, 25, 35), (3, 14, 50), (4, 30, 0)])
def test_condensed_graphs(spark, seed, n, links):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(links)]
    frame = spark.createDataFrame(edges + edges[:3] + [(None, "n01")], "src string, dst string")
    nodes = {x for e in edges for x in e}
    to = reach(nodes, edges)
    got = {r.node: r.component for r in condense.strong_components(frame).collect()}
    assert got == {a: min(b for b in to[a] if a in to[b]) for a in nodes}
    seeds = [(rng.choice(sorted(nodes | {"lone"})), k % 2, f"v{rng.randrange(12):02}") for k in range(20)]
    held = condense.Condensed(frame)
    for most in (None, 2):
        want = set()
        for a in nodes | {s[0] for s in seeds}:
            for key in (0, 1):
                values = sorted({v for b, k, v in seeds if k == key and b in to.get(a, {a})})
                want |= {(a, key, v) for v in values[:most]}
        got = held.carried_back(spark.createDataFrame(seeds, "node string, key int, value string"), most).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def plain_cycles(edges, longest):
    out = set()

    def walk(path):
        for b in [b for a, b in set(edges) if a == path[-1]]:
            if b == path[0]:
                out.add(tuple(path))
            elif b > path[0] and b not in path and len(path) < longest:
                walk([*path, b])

    for a in {a for a, _ in edges}:
        walk([a])
    return sorted(out, key=lambda p: (len(p), p))


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_within_components(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(12):02}", f"n{rng.randrange(12):02}") for _ in range(26)]
    frame = spark.createDataFrame(edges, "src string, dst string")
    want = plain_cycles(edges, 20)
    assert [tuple(r.path) for r in graph.cycles(frame, None).collect()] == want
    assert [tuple(r.path) for r in graph.cycles(frame, 4).collect()] == want[:4]
    assert [tuple(r.path) for r in graph.cycles(frame, None, 3).collect()] == [p for p in want if len(p) <= 3]


def test_a_dense_component_answers_its_first_cycles(spark):
    """Ten thousand edges among a hundred nodes: the ten shortest cycles come without longer paths."""
    edges = [(f"n{a:03}", f"n{b:03}") for a, b in itertools.permutations(range(101), 2)]
    got = [tuple(r.path) for r in graph.cycles(spark.createDataFrame(edges, "src string, dst string"), 10).collect()]
    assert got == [("n000", f"n{k:03}") for k in range(1, 11)]


def test_crud_on_a_graph_with_cycles(spark):
    """Entry points reach SQL through cycles and shared calls; two tables."""
    e = [(f"p.S.m{k}", f"m{k}", "java.method", f"m{k}()", "p/S.java", 10 * k + 1, 10 * k + 5, 0, 1) for k in range(6)]
    for t in ("Person", "Order"):
        e += [(f"p.{t}", f"t{t}", "java.class", t, f"p/{t}.java", 1, 9, 0, 1), (f"p.{t}.id", f"f{t}", "java.field", "id", f"p/{t}.java", 2, 2, 0, 1)]
    links = [("m0", "m1"), ("m1", "m2"), ("m2", "m1"), ("m2", "m3"), ("m4", "m2"), ("m4", "m5")]
    lines = [("p/S.java", 32, 'run("INSERT INTO person VALUES (1)");'), ("p/S.java", 33, 'run("SELECT * FROM order");'), ("p/S.java", 52, 'run("DELETE FROM person");')]
    make = spark.createDataFrame
    space = Space(
        entities=make(e, schema.ENTITIES), incidences=make([(f"i{a}{b}", a, b, "java.calls", None, None, None, 0.9, "x") for a, b in links], schema.INCIDENCES),
        cells=make([], schema.CELLS), source_lines=make(lines, schema.SOURCE_LINES),
    )
    got = {(r.table_name, r.entry_point): (r.operations, len(r.evidence)) for r in findings.crud_matrix(space).collect()}
    assert got == {("person", "p.S.m0"): ("C", 1), ("order", "p.S.m0"): ("R", 1), ("person", "p.S.m4"): ("CD", 2), ("order", "p.S.m4"): ("R", 1)}


def test_sources_of_a_name_in_two_files(spark):
    e = [("p.A", f"c{k}", "java.class", "A", f"{k}/p/A.java", 1, 2, 0, 1) for k in ("one", "two")]
    lines = [(f"{k}/p/A.java", n, f"{k} {n}") for k in ("one", "two") for n in (1, 2)]
    make = spark.createDataFrame
    space = Space(entities=make(e, schema.ENTITIES), incidences=make([], schema.INCIDENCES), cells=make([], schema.CELLS), source_lines=make(lines, schema.SOURCE_LINES))
    assert {r.file: r.source_code for r in specs.enrich_batch(space).collect()} == {f"{k}/p/A.java": f"{k} 1\n{k} 2" for k in ("one", "two")}
