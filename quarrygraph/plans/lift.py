"""Lifting Java files into a space: one parse a file for entities and raw references, then joins with the symbols."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrygraph.functions.javaparse import Node, parse, walk
from quarrygraph.session import keep, spread
from quarrygraph.sources.files import source_lines

from .space import Space

CONFIDENCE, DERIVATION = 0.95, "source-parse"
KINDS = {"class": "java.class", "interface": "java.interface", "enum": "java.enum", "record": "java.record", "annotation_type": "java.annotation"}
RAW = "what string, file string, fqn string, kind string, label string, start_line int, end_line int, start_col int, end_col int, ord int, package string, class string, receiver string, name string"


def file_rows(path: str, text: str) -> list[tuple]:
    """Rows of RAW: entities, references (what = relation) and diagnostics of one file."""
    out: list[tuple] = []
    try:
        unit, p = parse(text)
    except (RecursionError, IndexError) as e:
        return [("diagnostic", path, None, "error", f"not parsed: {type(e).__name__}", 0, 0, 0, 0, 0, None, None, None, None)]
    package = unit["package"] or ""

    def add(what: str, fqn: str | None, kind: str | None, label: str | None, n: Node, cls: str | None = None, receiver: str | None = None, name: str | None = None) -> None:
        a, b = p.place(n.start), p.place(max(n.end, n.start))
        out.append((what, path, fqn, kind, label, a[0], b[0], a[1], b[1], len(out), package, cls, receiver, name))

    def refer(relation: str, source: str, n: Node, target: str, cls: str | None) -> None:
        add(relation, source, None, None, n, cls, None, bare(target))

    def annotations(n: Node, source: str, cls: str | None) -> None:
        for a in (n["mods"].parts["annotations"] if n["mods"] is not None else []):
            refer("java.annotated_with", source, a, a["name"], cls)

    def type_(n: Node, outer: list[str]) -> None:
        names = [*outer, n["name"]]
        fqn = ".".join(filter(None, [package, *names]))
        add("entity", fqn, KINDS[n.kind], n["name"], n)
        owner = ".".join(filter(None, [package, *outer]))
        if owner and n.kind != "annotation_type":
            add("java.contained_in", fqn, None, None, n, None, None, owner)
        for t in n["extends"][: 1 if n.kind == "class" else None]:
            refer("java.extends", fqn, n, t, fqn)
        for t in n["implements"]:
            refer("java.implements", fqn, n, t, fqn)
        annotations(n, fqn, fqn)
        for k in n.kids:
            if k.kind in KINDS:
                type_(k, names)
            elif k.kind == "enum_constant":
                add("entity", f"{fqn}.{k['name']}", "java.enum_constant", k["name"], k)
            elif k.kind == "field":
                for name in k["names"]:
                    add("entity", f"{fqn}.{name}", "java.field", name, k)
            elif k.kind in ("method", "constructor"):
                args = k["params"] or []
                mine = f"{fqn}.{k['name']}" if k.kind == "method" else f"{fqn}.<init>_{len(args)}"
                add("entity", mine, f"java.{k.kind}", f"{k['name']}({', '.join(t for t, _ in args)})", k)
                add("java.contained_in", mine, None, None, k, None, None, fqn)
                for t in k["throws"]:
                    refer("java.throws", mine, k, t, fqn)
                annotations(k, mine, fqn)
                if k["body"] is not None:
                    references(k["body"], mine, fqn)

    def references(body: Node, source: str, cls: str) -> None:
        for n in walk(body):
            if n.kind == "call" and not (n["receiver"] is None and n["name"] in ("super", "this")):
                r = n["receiver"]
                add("java.calls", source, None, None, n, cls, p.source(r) if r is not None else None, n["name"])
            elif n.kind == "new":
                refer("java.constructs", source, n, n["type"], cls)

    for k in unit.kids:
        if k.kind == "package":
            add("entity", k["name"], "java.package", k["name"].rpartition(".")[2], k)
        elif k.kind == "import" and not k["star"]:
            refer("import", package, k, k["name"], None)
        elif k.kind in KINDS:
            type_(k, [])
    for e in p.errors:
        line = int(e.split()[1].rstrip(":")) if e.startswith("line ") else 0
        out.append(("diagnostic", path, None, "error", e, line, line, 0, 0, len(out), package, None, None, None))
    return out


def bare(type_text: str) -> str:
    """A type's name without arguments, arrays and white space."""
    depth, out = 0, []
    for c in type_text:
        depth += c == "<"
        if not depth and not c.isspace():
            out.append(c)
        depth -= c == ">"
    return "".join(out).replace("[]", "")


def raw_rows(files: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in RAW.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([r for p, t in zip(pdf["path"], pdf["text"], strict=True) for r in file_rows(p, t or "")], columns=names)

    return spread(files.where(F.lower("path").endswith(".java")).select("path", "text")).mapInPandas(run, RAW)


def resolved(refs: DataFrame, symbols: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """refs (with ref, what, package, class, receiver, name) with target (fqn) and its derivation, null where none is found.

    Candidates are tried in order: the cache on the target text, then for calls package.receiver.name and receiver.name, or
    CurrentClass.name without a receiver; for types the name if it is dotted, package.name, then any known name that ends
    with it, the shortest and first. All candidates are looked up by equality in one join and the best rank wins.
    """
    call = F.col("what") == "java.calls"
    text = F.when(call & F.col("receiver").isNotNull(), F.concat_ws(".", "receiver", "name")).otherwise(F.col("name"))
    c = lambda rank, name, when: F.when(when, F.struct(F.lit(rank).alias("rank"), name.alias("candidate")))
    has = F.col("receiver").isNotNull()
    dotted = F.contains(F.col("name"), F.lit("."))
    in_package = lambda n: F.when(F.col("package") == "", n).otherwise(F.concat_ws(".", F.col("package"), n))
    options = F.array_compact(F.array(
        c(1, in_package(text), call & has), c(2, text, call & has), c(1, F.concat_ws(".", "class", "name"), call & ~has),
        c(1, F.col("name"), ~call & dotted), c(2, in_package(F.col("name")), ~call), c(2, F.concat_ws(".", "class", "name"), ~call & F.col("class").isNotNull()),
    ))
    refs = refs.withColumn("target_text", F.when(F.col("what") == "java.constructs", F.concat(F.lit("new "), F.col("name"))).otherwise(text))
    exact = refs.select("ref", F.explode(options).alias("o")).select("ref", "o.rank", F.col("o.candidate").alias("fqn")).join(symbols.select("fqn"), "fqn")
    # a simple type name that nothing else settles: by the last segment of the known types
    tails = symbols.where(F.col("is_type")).select("fqn", F.substring_index("fqn", ".", -1).alias("name"))
    tails = tails.withColumn("_n", F.row_number().over(W.partitionBy("name").orderBy(F.length("fqn"), "fqn"))).where("_n = 1").drop("_n")
    loose = refs.where(~call & ~dotted).select("ref", "name").join(tails, "name").select("ref", F.lit(3).alias("rank"), "fqn")
    found = exact.select("ref", "rank", "fqn").unionByName(loose).withColumn("derivation", F.lit(DERIVATION))
    if cache is not None:
        hit = refs.select("ref", F.regexp_replace("target_text", "^new ", "").alias("target_text")).join(cache.select("target_text", F.col("fqn")), "target_text").join(symbols.select("fqn"), "fqn")
        found = found.unionByName(hit.select("ref", F.lit(0).alias("rank"), "fqn", F.lit("lsp").alias("derivation")))
    best = found.groupBy("ref").agg(F.min_by(F.struct("fqn", "derivation"), F.struct("rank", "fqn")).alias("b")).select("ref", F.col("b.fqn").alias("target"), F.col("b.derivation").alias("derivation"))
    return refs.join(best, "ref", "left")


def lift(files: DataFrame, space_id: str = "space", cache: DataFrame | None = None, emit_imports: bool = False) -> Space:
    """A space of Java files (path, text); other files stay as sources. cache(target_text, fqn) holds outside resolutions.

    Names are shared by overloads: the last file and declaration give a name its cell, earlier cells stay without an
    entity; packages repeat for each file. Imports give edges only on demand. References without a target become
    unresolved records if they are calls or constructions.
    """
    raw = keep(raw_rows(files))
    found = raw.where("what = 'entity'")
    # ids must be dense and repeatable: numbers within a file plus the entities of all files before it
    per_file = found.groupBy("file").agg(F.count("*").alias("n"))
    before = per_file.select("file", (F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("file").orderBy("start_line", "start_col", "ord"))
    placed = keep(found.withColumn("k", own).join(before, "file").withColumn("cell_id", F.concat(F.lit("cell:"), F.col("before") + F.col("k"))))
    last = F.row_number().over(W.partitionBy("fqn").orderBy(F.col("file").desc(), F.col("ord").desc()))
    here = F.row_number().over(W.partitionBy("file", "fqn").orderBy(F.col("ord").desc()))
    # a file's declarations of one name share its last cell; every file that declares a name keeps a row
    entities = placed.withColumn("_h", here).where("_h = 1").select("fqn", "cell_id", F.col("kind").alias("entity_type"), "label", "file", "start_line", "end_line", "start_col", "end_col")
    symbols = keep(placed.withColumn("_l", last).where("_l = 1").select("fqn", "cell_id", F.col("kind").isin(*KINDS.values()).alias("is_type")))
    uri = F.concat("file", F.lit("#L"), "start_line", F.lit("-L"), "end_line")
    provenance = F.struct(uri.alias("uri"), F.col("file").alias("title"), F.lit(CONFIDENCE).alias("confidence"), F.lit(DERIVATION).alias("extraction_method"))
    cells = placed.select("cell_id", F.lit(space_id).alias("space_id"), F.lit(0).alias("dimension"), F.col("kind").alias("cell_type"), "label", provenance.alias("provenance"))
    refs = raw.where("what LIKE 'java.%'").withColumn("ref", F.concat_ws("#", "file", "ord"))
    contained = refs.where("what = 'java.contained_in'").join(symbols.select(F.col("fqn").alias("target"), F.lit(1).alias("_ok")), F.col("name") == F.col("target")).select("ref", "what", "fqn", "file", "start_line", "end_line", "target", F.lit(DERIVATION).alias("derivation"))
    other = resolved(refs.where("what <> 'java.contained_in'"), symbols, cache)
    if emit_imports:
        held = raw.where("what = 'import'").select(F.concat_ws("#", "file", "ord").alias("ref"), "file", "start_line", "end_line", F.col("name").alias("target"))
        tops = entities.join(placed.groupBy("file").agg(F.min(F.struct("ord", "cell_id")).alias("_")).select("file"), "file").where(F.col("entity_type").isin(*KINDS.values())).groupBy("file").agg(F.min("fqn").alias("fqn"))
        imports = held.join(tops, "file").join(symbols.select(F.col("fqn").alias("target")), "target").select("ref", F.lit("java.imports").alias("what"), "fqn", "file", "start_line", "end_line", "target", F.lit(DERIVATION).alias("derivation"))
        contained = contained.unionByName(imports)
    edges = contained.unionByName(other.where("target IS NOT NULL").select("ref", "what", "fqn", "file", "start_line", "end_line", "target", "derivation"))
    # the source is the cell of its own file where several files share the name
    mine = placed.withColumn("_h", here).where("_h = 1").select(F.col("fqn"), F.col("file"), F.col("cell_id").alias("from_cell_id"))
    to = symbols.select(F.col("fqn").alias("target"), F.col("cell_id").alias("to_cell_id"))
    incidences = edges.join(mine, ["fqn", "file"]).join(to, "target").select(
        F.concat(F.lit("inc:"), "ref").alias("incidence_id"), "from_cell_id", "to_cell_id", F.col("what").alias("relation_type"), "file", "start_line", "end_line", F.lit(CONFIDENCE).alias("confidence"), F.col("derivation").alias("derivation_source"))
    unresolved = other.where("target IS NULL AND what IN ('java.calls', 'java.constructs')").select(F.col("fqn").alias("from_fqn"), "target_text", F.col("what").alias("relation_type"), "file", F.col("start_line").alias("line"))
    return Space(entities=keep(entities), incidences=keep(incidences), cells=keep(cells), unresolved=keep(unresolved), source_files=files, source_lines=source_lines(files), space_id=space_id, stored=True)


def diagnostics(files: DataFrame, space: Space) -> DataFrame:
    """(file, message, severity): parse errors, and a warning for each unresolved reference."""
    errors = raw_rows(files).where("what = 'diagnostic'").select("file", F.col("label").alias("message"), F.lit("error").alias("severity"))
    warnings = space.table("unresolved").select("file", F.concat(F.lit("unresolved "), "target_text", F.lit(" at line "), "line").alias("message"), F.lit("warning").alias("severity"))
    return errors.unionByName(warnings)
