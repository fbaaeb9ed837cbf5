"""The fixture project: lift counts and every catalogue query on it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarrygraph.functions.kernels import mapper_statements
from quarrygraph.operators import calls, catalogue, column_usage, findings, invariants, specs, topology
from quarrygraph.plans.lift import diagnostics, lift
from quarrygraph.plans.space import SymbolNotFound, resolve
from quarrygraph.sources import store

YARD, CRANE = "port.cargo.Yard", "port.dock.Crane"


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def relations(space):
    """(from, relation, to) by short names."""
    n = space.entities.select("cell_id", F.regexp_replace("fqn", r"^port\.\w+\.", "").alias("n")).distinct()
    a, b = n.withColumnsRenamed({"cell_id": "from_cell_id", "n": "a"}), n.withColumnsRenamed({"cell_id": "to_cell_id", "n": "b"})
    return [tuple(r) for r in space.incidences.join(a, "from_cell_id").join(b, "to_cell_id").select("a", F.substring_index("relation_type", ".", -1), "b").collect()]


def test_counts(harbor):
    assert harbor.cells.count() == 61
    # the two stack methods share a name and its entity
    assert harbor.entities.count() == 60 and harbor.entities.select("fqn").distinct().count() == 54
    assert dict(rows(harbor.cells.groupBy("cell_type").count())) == {
        "java.method": 24, "java.field": 11, "java.package": 8, "java.class": 6, "java.constructor": 3, "java.interface": 3, "java.enum_constant": 3, "java.enum": 1, "java.record": 1, "java.annotation": 1,
    }
    open_ = harbor.table("unresolved").groupBy(F.regexp_extract("from_fqn", r"([^.]+\.[^.]+)$", 1).alias("m")).count()
    assert dict(rows(open_)) == {"Label.of": 1, "Yard.stack": 3, "Yard.clear": 1, "Yard.run": 1, "Yard.main": 2, "Crane.raise": 1, "Crane.inspect": 2, "Crane.drop": 2, "Crane.load": 3}


def test_relations(harbor):
    got = relations(harbor)
    assert {r for r in got if r[1] in ("extends", "implements")} == {("Gantry", "extends", "Crane"), ("Lift", "extends", "Inspected"), ("Crane", "implements", "Lift")}
    assert sorted(r for r in got if r[1] == "throws") == [("Crane.inspect", "throws", "Overload"), ("Inspected.inspect", "throws", "Overload"), ("Yard.stack", "throws", "Overload"), ("Yard.stack", "throws", "Overload")]
    assert sorted(r for r in got if r[1] == "annotated_with") == [("Crane", "annotated_with", "Audited"), ("Crane.inspect", "annotated_with", "Audited")]
    assert sorted(r for r in got if r[1] == "constructs") == [
        ("Crane.inspect", "constructs", "Crane.Cable"), ("Crane.inspect", "constructs", "Overload"), ("Label.of", "constructs", "Label"), ("Yard.main", "constructs", "Yard"), ("Yard.stack", "constructs", "Overload"),
    ]
    assert sorted(r for r in got if r[1] == "calls") == [
        ("Crane.inspect", "calls", "Crane.drop"), ("Crane.inspect", "calls", "Crane.load"), ("Crane.load", "calls", "Crane.weight"), ("Lift.idle", "calls", "Lift.load"),
        ("Yard.clear", "calls", "Yard.run"), ("Yard.stack", "calls", "Label.of"), ("Yard.stack", "calls", "Yard.stack"),
    ]
    held = {(a, b) for a, r, b in got if r == "contained_in"}
    assert {("Crane.State", "Crane"), ("Crane.Cable", "Crane"), ("Crane.Cable.holds", "Crane.Cable"), ("Yard.PalletDao", "Yard"), ("Label", "port.cargo"), ("Gantry.<init>_1", "Gantry"), ("Audited.by", "Audited")} <= held
    assert sum(r == "contained_in" for _, r, _ in got) == 38 and len(got) == 59 and not any(r == "imports" for _, r, _ in got)


def test_cell_ids_are_dense_and_repeat(harbor):
    assert sorted(int(r[0].split(":")[1]) for r in rows(harbor.cells, "cell_id")) == list(range(1, 62))


def test_resolve(harbor):
    assert resolve(harbor, "Yard").first().fqn == YARD and resolve(harbor, "State.BROKEN").first().entity_type == "java.enum_constant"
    assert resolve(harbor, CRANE).first().entity_type == "java.class"
    assert resolve(harbor, "Nothing").first() is None
    assert resolve(harbor, "weight").first().fqn == "port.dock.Crane.weight"  # shorter than Gantry's


def test_explain_and_calls(harbor):
    r = calls.explain(harbor, f"{CRANE}.inspect").first()
    assert (r.entity_type, r.signature, r.callees) == ("java.method", "inspect()", ["port.dock.Crane.Cable", "port.dock.Crane.drop", "port.dock.Crane.load", "port.dock.Overload"])
    assert r.witnesses[0].start_line == 38 and r.obstructions == ["hooks.isEmpty", "new Cable().holds"] and r.callers == []
    assert sorted(rows(calls.callers(harbor, "port.dock.Overload"), "target", "relation_type", "line")) == [("port.cargo.Yard.stack", "java.constructs", 26), ("port.dock.Crane.inspect", "java.constructs", 44)]
    assert rows(calls.callees(harbor, f"{CRANE}.load"), "target") == [(f"{CRANE}.weight",)]
    with pytest.raises(SymbolNotFound):
        calls.explain(harbor, "nope")


def test_impact(harbor):
    out = calls.impact(harbor, f"{CRANE}.weight", 3)
    assert rows(out, "fqn", "depth", "scope") == [(f"{CRANE}.load", 1, "direct"), (f"{CRANE}.inspect", 2, "transitive")]
    assert calls.affected_files(out).count() == 1 and calls.impact(harbor, f"{CRANE}.weight", 1).count() == 1
    # inheritance counts too
    assert rows(calls.impact(harbor, "port.dock.Inspected", 3), "fqn", "depth") == [("port.dock.Lift", 1), ("port.dock.Crane", 2), ("port.dock.Gantry", 3)]


def test_search(harbor):
    assert sorted(rows(catalogue.search(harbor, "lift", "interface"), "fqn", "entity_type")) == [("port.dock.Lift", "java.interface")]
    assert {r[0] for r in rows(catalogue.search(harbor, "LIFT"), "label")} == {"Lift", "raise(int)", "idle()", "load()", "LIFTING"}


def test_dead_code(harbor):
    out = {r.fqn.removeprefix("port."): (r.confidence, r.reason) for r in findings.dead_code(harbor).collect()}
    plain = ("medium", "unreferenced")
    assert out == {
        "cargo.Pallet": plain, "cargo.Yard.PalletDao": plain, "cargo.Yard.PalletDao.findByNumber": plain, "cargo.Yard.PalletDao.removeAll": plain, "cargo.Yard.PalletDao.store": plain, "cargo.Yard.clear": plain,
        "dock.Audited.by": plain, "dock.Crane.Cable.holds": plain, "dock.Crane.State": plain, "dock.Gantry": plain, "dock.Gantry.weight": plain, "dock.Inspected.inspect": plain, "dock.Lift.idle": plain, "dock.Lift.raise": plain,
        "cargo.Pallet.getNumber": ("low", "accessor"), "cargo.Pallet.isHeavy": ("low", "accessor"), "cargo.Pallet.setBound": ("low", "accessor"), "dock.Crane.inspect": ("low", "annotated"), "dock.Crane.raise": ("low", "annotated"),
    }


def test_a_name_in_two_source_roots_is_used_in_both(spark):
    text = "package p; class A { void run() {} void go() { run(); } private void left() {} }"
    space = lift(spark.createDataFrame([("one/p/A.java", text), ("two/p/A.java", text)], "path string, text string"))
    assert {(r.fqn, r.file[:3]) for r in findings.dead_code(space).collect()} == {(f"p.A.{m}", f) for m in ("go", "left") for f in ("one", "two")}


def test_hotspots(harbor):
    top = findings.hotspots(harbor, 3).collect()
    assert [(r.fqn, r.complexity, r.loc) for r in top] == [(f"{CRANE}.raise", 4, 15), (f"{CRANE}.inspect", 3, 11), (f"{YARD}.main", 3, 9)]
    # 24 methods and 3 constructors under 26 names
    assert findings.body_lines(harbor).select("fqn").distinct().count() == 26


def test_crud(harbor):
    out = {r.entry_point.rpartition(".")[2]: (r.operations, r.evidence) for r in findings.crud_matrix(harbor).collect()}
    assert set(out) == {"clear"} and out["clear"][0] == "UD"
    assert [e.split(" ")[1].split("(")[0] for e in out["clear"][1]] == ["pallets.removeAll", "run"]
    mapped = findings.crud_matrix(harbor, mapper_statements(harbor.table("source_files"))).where(F.col("entry_point").endswith("clear")).first()
    assert any(e == "mapper port.cargo.Yard.clear" for e in mapped.evidence)


def test_column_usage(harbor):
    out = {r.field_name: r for r in column_usage.column_usage(harbor, "Pallet").collect()}
    place = lambda ps: {(p.file.rpartition("/")[2], p.line, p.access_type) for p in ps}
    assert (out["number"].logical_name, out["number"].column_name, out["number"].data_type) == ("Number painted on the side", "pallet_no", "long")
    assert place(out["number"].readers) == {("Label.java", 5, "read")} and place(out["number"].writers) == {("Yard.xml", 4, "write")}
    assert (out["mass"].logical_name, out["mass"].data_type, out["bound"].logical_name) == ("Kilograms", "double", "")
    assert place(out["bound"].writers) >= {("Yard.xml", 4, "write")} and ("Yard.java", 38, "read") in place(out["bound"].readers)
    assert ("night.sql", 1, "read") in place(out["mass"].readers) and ("Yard.java", 38, "write") in place(out["mass"].writers)


def test_packages(harbor):
    assert sorted(rows(catalogue.package_nodes(harbor))) == [("port.cargo", 24), ("port.dock", 36)]
    assert rows(catalogue.package_dependencies(harbor)) == [("port.cargo", "port.dock", 3)]
    assert sorted(rows(catalogue.overview_packages(harbor))) == [("port.cargo", 3, 1, 12, 5), ("port.dock", 5, 2, 14, 6)]


def test_feature(harbor):
    out = catalogue.feature(harbor, "crane")
    assert {r.label for r in out["matched_classes"].collect()} == {"Crane", "Cable", "State"}
    assert {r.label.partition("(")[0]: (r.caller_count, r.callee_count) for r in out["entry_points"].collect()} == {"inspect": (0, 4), "load": (0, 1)}
    assert sorted(rows(out["external_dependencies"])) == [("port.dock.Audited",), ("port.dock.Lift",), ("port.dock.Overload",)]
    assert out["internal_calls"].count() == 4
    with pytest.raises(SymbolNotFound):
        catalogue.feature(harbor, "zebra")


def test_unknowns(harbor):
    assert findings.unknowns(harbor).count() == 16 and findings.unknowns(harbor, "crane").count() == 9


def test_spec(harbor):
    r = specs.spec_loss(harbor).first()
    assert r.total_sources == 61 and r.projected_sections == 11
    noted = specs.annotate(harbor, f"{YARD}.clear", intent="Empties the yard", preconditions=["a bound"])
    text = specs.export_spec(noted)
    assert "### `Yard`" in text and "Intent: Empties the yard" in text and "not yet annotated" in text
    assert calls.explain(noted, f"{YARD}.clear").first().intent.value == "Empties the yard"
    again = specs.annotate(noted, f"{YARD}.clear", intent="Second")
    assert calls.explain(again, f"{YARD}.clear").first().intent.value == "Second"
    with pytest.raises(SymbolNotFound):
        specs.annotate(harbor, "clear", intent="x")


def test_enrich(harbor):
    one = specs.enrich(harbor, f"{CRANE}.load").first()
    assert one.source_code.strip().startswith("public int load()") and one.containing_class == CRANE and one.callees == [f"{CRANE}.weight"] and one.callers == [f"{CRANE}.inspect"]
    assert [r.symbol for r in specs.enrich_batch(harbor, "gantry", 10).collect()] == ["port.dock.Gantry", "port.dock.Gantry.<init>_1", "port.dock.Gantry.weight"]


def test_invariants(harbor):
    # containment, calls and the rest reach nothing from the first package cell: a later file's cell stands for the name
    assert invariants.reachability(harbor).count() == 60
    assert invariants.grounding(harbor).count() == 0 and invariants.check(harbor).count() >= 60


def test_domain_clusters(harbor):
    out = topology.domain_clusters(harbor, 2).collect()
    assert {tuple(m.rpartition(".")[2] for m in r.members) for r in out if len(r.members) > 1} == {("drop", "inspect", "load", "weight"), ("of", "stack"), ("clear", "run"), ("idle", "load")}
    assert [len(r.members) for r in out if r.crosses_boundary] == [2] and {r.lifetime for r in out} == {2}
    assert topology.domain_clusters(harbor, 9).count() == 0


def test_enforces(harbor):
    of = lambda rel: calls.enforces(harbor, f"{CRANE}.inspect", rel).first().status
    assert of("constructs") == "satisfied" and of("throws") == "satisfied" and of("implements") == "satisfied" and of("catches") == "violated"


def test_store(harbor, spark, tmp_path):
    store.save(harbor, str(tmp_path))
    back = store.load(spark, str(tmp_path), "harbor")
    assert back.entities.count() == 60 and back.incidences.count() == 59
    store.save(back, str(tmp_path))
    assert rows(store.list_spaces(spark, str(tmp_path))) == [("harbor", 61, 59, 60)]
    # a space read before a save can still be read after it
    assert back.cells.count() == 61
    # a version that was not finished is not seen
    (tmp_path / "spaces" / "harbor" / "v-half" / "cells").mkdir(parents=True)
    assert store.load(spark, str(tmp_path), "harbor").entities.count() == 60
    with pytest.raises(FileNotFoundError):
        store.load(spark, str(tmp_path), "other")


def test_lift_cache_imports_and_errors(spark):
    files = spark.createDataFrame([("A.java", "package p; import q.B; class A extends B { void f() { b.g(); broken( ; } }"), ("B.java", "package q; class B { void g() {} }"), ("C.java", None)], "path string, text string")
    cache = spark.createDataFrame([("b.g", "q.B.g")], "target_text string, fqn string")
    space = lift(files, "x", cache, emit_imports=True)
    got = {(r.relation_type, r.derivation_source) for r in space.incidences.collect()}
    assert ("java.calls", "lsp") in got and ("java.imports", "source-parse") in got and ("java.extends", "source-parse") in got
    assert {r.severity for r in diagnostics(files, space).collect()} == {"error"}


def test_empty_project(spark):
    space = lift(spark.createDataFrame([], "path string, text string"))
    assert space.cells.count() == 0 and catalogue.overview_packages(space).count() == 0 and findings.dead_code(space).count() == 0
