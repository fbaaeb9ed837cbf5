"""Steps whose cost once grew faster than their input."""

from __future__ import annotations

import math
import random

import pandas as pd
import pytest
from __spark_entry__ import queries
from pyspark.sql import functions as F

from quarrygraph import session
from quarrygraph.operators import calls, findings, invariants, symbolic, topology
from quarrygraph.plans import condense, demo, graph
from quarrygraph.plans.space import Space

BIG = "/root/testdata/sf0.001"


def planned_bits(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_rounds_do_not_multiply_the_size_estimate(spark):
    df = spark.range(50).select("id", F.lit(1).alias("k"))
    for _ in range(6):
        df = session.keep(df.join(df.select(F.col("id").alias("id2"), F.col("k").alias("k2")), F.col("id") == F.col("id2")).select("id", "k"))
    assert df.count() == 50 and planned_bits(df) < 40


def test_files_of_one_partition_are_dealt_over_all_cores(spark):
    files = spark.range(200).coalesce(1).select(F.concat(F.lit("A"), "id", F.lit(".java")).alias("path"), F.lit("class A { int f(boolean a) { if (a) { return 1; } return 2; } }").alias("text"))
    got = symbolic.extract_rules(files)
    assert got.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism and got.count() == 400


def test_world_lines_parse_a_file_once(spark, monkeypatch):
    parsed = []
    monkeypatch.setattr(symbolic, "parse", lambda text, own=symbolic.parse: parsed.append(text) or own(text))
    frame = {}
    fake = type("Files", (), {"mapInPandas": lambda self, run, schema: frame.setdefault("run", run)})()
    monkeypatch.setattr(symbolic, "spread", lambda files: fake)
    symbolic.world_line_rows(spark.createDataFrame([("A.java", "x")], "path string, text string"))
    out = pd.concat(frame["run"](iter([pd.DataFrame({"path": ["A.java"], "text": ["class A { int f() { return 1; } int g(boolean b) { if (b) { return 2; } return 3; } }"]})])))
    assert len(parsed) == 1 and sorted(out["outcome"]) == ["return 1", "return 2", "return 3"]


def test_entities_do_not_derive_links(spark):
    space = demo.demo_space(spark, BIG)
    plan = space.entities._jdf.queryExecution().toString()
    assert space.index is None and "lineitem" not in plan
    again = demo.demo_space(spark, BIG, again=True)
    assert sorted(map(tuple, again.incidences.collect())) == sorted(map(tuple, space.incidences.collect()))


def test_values_of_near_points_are_those_of_all_pairs(spark):
    points = spark.createDataFrame([(1, 900.0), (2, 900.0), (3, 900.4), (4, 901.3), (5, 950.0), (6, None)], "k long, x double")
    want = {r.d for r in topology.near_pairs(points, 1.0).select(F.round("d", 2).alias("d")).collect()}
    assert {r.d for r in topology.near_values(points, 1.0).select(F.round("d", 2).alias("d")).collect()} == want == {0.0, 0.4, 0.9}


def test_pairs_are_made_where_they_are_returned(spark):
    """Every pair was once looked up in a table of stages by a join, after three times as many had been made in vain."""
    plan = queries()["rips_stages"](spark, BIG)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("Generate")] and "Repartition" in plan[plan.index("Generate") : plan.index("Join")]


def test_near_stages_are_those_of_all_pairs(spark, monkeypatch):
    """Places of several chunks, one with most of the points, keys that occur twice; null, infinite and undefined places are near none."""
    monkeypatch.setattr(topology, "CHUNK", 7)
    monkeypatch.setattr(graph, "HOT_LEAST", 20)
    rng = random.Random(3)
    points = [(k, rng.choice([900.0, 900.0, 900.0, 900.1, 900.4, 901.0, 901.35, 902.0, -0.0, 0.0])) for k in range(160)] + [(3, 900.0), (4, 901.0), (200, 950.0)]
    points += [(201, None), (202, None), (203, math.nan), (204, math.nan), (205, math.inf), (206, math.inf)]
    near = [(a, b, round(abs(x - y), 2)) for a, x in points for b, y in points if a < b and x is not None and y is not None and abs(x - y) <= 1]
    stage = {d: k for k, d in enumerate(sorted({d for *_, d in near}), 1)}
    got = topology.near_stages(spark.createDataFrame(points, "k long, x double"), 1.0, 2)
    assert sorted(map(tuple, got.collect())) == sorted((a, b, d, stage[d]) for a, b, d in near)
    assert topology.near_stages(spark.createDataFrame([], "k long, x double"), 1.0, 2).count() == 0


def kept_rows(monkeypatch) -> list[int]:
    """Filled with the rows of each table that graph plans write out."""
    rows = []
    monkeypatch.setattr(graph, "keep", lambda df: (out := session.keep(df), rows.append(out.count()))[0])
    return rows


def test_a_search_makes_no_copy_of_stored_links(spark, monkeypatch):
    space = demo.demo_space(spark, BIG, again=True)
    top = space.incidences.where("relation_type = 'java.calls'").groupBy("to_cell_id").count().orderBy("count", "to_cell_id").first().to_cell_id
    name = space.entities.where(F.col("cell_id") == top).first().fqn
    links, rows = space.calls(*calls.schema.IMPACT).count(), kept_rows(monkeypatch)
    got = calls.impact(space, name, 2)
    assert rows and max(rows) < links
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, calls.impact(demo.demo_space(spark, BIG), name, 2).collect()))


def test_a_search_is_the_same_listed_broadcast_or_joined(spark, monkeypatch):
    edges = spark.createDataFrame([(k % 97, (k * k + 3) % 97) for k in range(300)] + [(1, None), (5, 5)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "node long")
    want = sorted(map(tuple, graph.search(edges.where("dst IS NOT NULL"), start, 5)[0].collect()))
    for few, listed in ((100, 0), (0, 0), (100, 3)):
        monkeypatch.setattr(graph, "FEW", few)
        monkeypatch.setattr(graph, "LISTED", listed)
        for stored in (True, False):
            assert sorted(map(tuple, graph.search(edges.where("dst IS NOT NULL"), start, 5, stored=stored)[0].collect())) == want


def test_components_make_no_copy_of_stored_links(spark, monkeypatch):
    space = demo.demo_space(spark, BIG, again=True)
    links, rows = space.incidences.count(), kept_rows(monkeypatch)
    assert invariants.reachability(space).count() == 0 and len(rows) > 2 and links not in rows


def test_stored_links_may_hold_a_pair_twice(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (2, 3), (7, 9), (9, 7), (4, 4), (None, 5), (5, None)], "src long, dst long")
    got = lambda stored: sorted(map(tuple, graph.connected(links, stored=stored).collect()))
    assert got(True) == got(False) == [(2, 1), (3, 1), (9, 7)]


def test_components_of_texts_sort_no_links(spark, monkeypatch):
    """The least of texts has no hash aggregation, so each round would sort all links."""
    plans = []
    monkeypatch.setattr(graph, "keep", lambda df: plans.append((df._jdf.queryExecution().executedPlan().toString(), df.columns)) or session.keep(df))
    links = spark.createDataFrame([(f"n{k}", f"n{(k * 7) % 50}") for k in range(50)] + [("x", "y"), ("z", "z")], "src string, dst string")
    got = {r.id: r.component for r in graph.connected(links).collect()}
    number = {r.id: r.component for r in graph.connected(links.select(*(F.when(F.col(c).startswith("n"), F.substring(c, 2, 9).cast("long")).otherwise(F.ascii(c) + 1000).alias(c) for c in ("src", "dst")))).collect()}
    groups = lambda of, nodes: {frozenset(n for n in nodes if of.get(n, n) == c) for c in {of.get(n, n) for n in nodes}}
    name = lambda k: f"n{k}" if k < 1000 else chr(k - 1000)
    assert groups(got, [f"n{k}" for k in range(50)] + ["x", "y"]) == {frozenset(map(name, g)) for g in groups(number, [*range(50), ord("x") + 1000, ord("y") + 1000])}
    assert all(c == min(k for k in [*got, *got.values()] if got.get(k, k) == c) for c in got.values())
    assert not [p for p, columns in plans if "SortAggregate" in p and "component" not in columns]


def test_texts_that_share_a_number_get_others(spark, monkeypatch):
    own = graph._number
    monkeypatch.setattr(graph, "_number", lambda column, seed: F.lit(7).cast("long") if seed < 2 else own(column, seed))
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("e", "d")], "src string, dst string")
    assert {r.id: r.component for r in graph.connected(links).collect()} == {"b": "a", "c": "a", "e": "d"}


def test_components_beyond_least_and_greatest_neighbours(spark, monkeypatch):
    """Many small groups, joined by links that are no node's least or greatest, in either way of joining them."""
    groups = [[f"g{g}n{k}" for k in range(6)] for g in range(8)]
    links = [(a, b) for g in groups for a in g for b in g if a < b] + [(groups[g][2], groups[g + 1][3]) for g in (0, 1, 4, 6)]
    label = {n: n for g in groups for n in g}
    for _ in range(20):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    for few in (100, 0):
        monkeypatch.setattr(graph, "FEW", few)
        got = {r.id: r.component for r in graph.connected(spark.createDataFrame(links, "src string, dst string"), stored=True).collect()}
        assert got == {n: c for n, c in label.items() if n != c}
    assert graph.connected(spark.createDataFrame([("a", "a")], "src string, dst string")).count() == 0


def called_space(spark, links, names):
    """A space of calls whose methods are names (cell, fqn)."""
    entities = spark.createDataFrame([(c, n, "java.method") for c, n in names], "cell_id string, fqn string, entity_type string")
    incidences = spark.createDataFrame([(a, b, "java.calls") for a, b in links], "from_cell_id string, to_cell_id string, relation_type string")
    return Space(entities=entities, incidences=incidences, cells=entities)


def reached(links, targets, names):
    out = {}
    for a, b in links:
        out.setdefault(a, set()).add(b)
    called, found = {b for _, b in links}, set()
    for cell, name in names:
        seen, todo = {cell}, [cell]
        while todo:
            new = out.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        if cell not in called:
            found |= {(name, t) for c, t in targets if c in seen}
    return sorted(found)


def test_targets_are_carried_as_sets(spark, monkeypatch):
    """Each target once went back along each link as a row of its own."""
    links = [(f"e{k}", f"m{k % 4}") for k in range(50)] + [("m0", "p0"), ("m1", "p0"), ("m2", "m3"), ("m3", "p1")]
    targets = [(f"p{k % 2}", f"T{k}") for k in range(100)]
    names, rows = [(f"e{k}", f"E{k // 2}") for k in range(50)], []
    for module in (graph, condense):
        monkeypatch.setattr(module, "keep", lambda df: (out := session.keep(df), rows.append(out.count()))[0])
    got = findings.crud_closure(called_space(spark, links, names), spark.createDataFrame(targets, "cell_id string, target string"))
    assert sorted(map(tuple, got.collect())) == reached(links, targets, names) and max(rows) <= 2 * (len(links) + len(targets))


@pytest.mark.parametrize("form", ["n{}", "p.N{}", "n0{}"])
@pytest.mark.parametrize("first", [1, 2, 1000])
def test_sets_over_a_share_of_the_links_are_those_over_all(spark, monkeypatch, form, first):
    """Cycles, chains, links that occur twice, ends and targets without entities, more than 64 targets, nodes that reach few of them."""
    monkeypatch.setattr(condense, "FIRST", first)
    rng, cell = random.Random(first), form.format
    links = [(cell(rng.randrange(20, 60)), cell(rng.randrange(20, 60))) for _ in range(240)]
    links += [(cell(k), cell(rng.randrange(20, 60))) for k in range(12) for _ in range(5)] + [(cell(k), cell(k + 1)) for k in range(60, 72)] + [(cell(12), cell(70)), (cell(13), cell(64))]
    links += links[:9] + [(cell(21), cell(21))]
    targets = [(cell(rng.randrange(20, 50)), f"T{k % 70}") for k in range(90)] + [(cell(72), "T3"), (cell(66), "end"), (cell(14), "own"), (cell(900), "T1")]
    names = [(cell(k), f"E{k // 2}") for k in range(16)] + [(cell(k), f"F{k}") for k in range(60, 73)]
    able = spark.createDataFrame([*targets, (None, "x"), (cell(20), None)], "cell_id string, target string")
    space = called_space(spark, [*links, (None, cell(20)), (cell(2), None)], names)
    assert sorted(map(tuple, findings.crud_closure(space, able).collect())) == reached(links, targets, names)


def test_numbers_tell_ids_apart(spark, monkeypatch):
    ids = ["a1", "b1", "a01", "a", "", "a-5", "a+1", "a 1", "1a", "a999999999999999", "a1000000000000000", "b0", "é5", "a1.0", "aa1"]
    plain = spark.createDataFrame([(x,) for x in ids], "id string")
    taken = [r.id for r in plain.where(condense._plain("id")[0]).collect()]
    assert taken == ["a1", "b1", "a999999999999999", "b0"]
    for some in (taken, ids):
        df = spark.createDataFrame([(x,) for x in some], "id string")
        assert df.select(condense.numbering(df)("id").alias("n")).distinct().count() == len(some)
