"""Command line: lift, query, rules, export, serve."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from quarrygraph.operators import invariants, jsp, specs, symbolic
from quarrygraph.plans.lift import diagnostics, lift
from quarrygraph.service import Service
from quarrygraph.session import make_importable
from quarrygraph.sources import files, store


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarrygraph")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("lift")
    p.add_argument("root")
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--encoding")
    p = sub.add_parser("query")
    p.add_argument("tool")
    p.add_argument("arguments", nargs="?", default="{}", help="JSON object")
    p = sub.add_parser("rules")
    p.add_argument("root")
    p.add_argument("--terminal-call", action="append", default=[])
    p = sub.add_parser("export")
    p.add_argument("--to")
    sub.add_parser("serve")
    for q in sub.choices.values():
        q.add_argument("--store", default="quarry-store")
        q.add_argument("--space", default="space")
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("quarrygraph").getOrCreate()
    make_importable(spark)
    if a.command == "lift":
        src = files.read_project(spark, a.root, a.exclude, a.encoding).cache()
        space = lift(src, a.space)
        path = store.save(space, a.store)
        print(json.dumps({"cells": space.cells.count(), "incidences": space.incidences.count(), "unresolved": space.unresolved.count(), "errors": diagnostics(src, space).where("severity = 'error'").count(), "violations": invariants.check(space).count(), "path": path}))
    elif a.command == "rules":
        terminal = (*symbolic.TERMINAL, *a.terminal_call)
        src = files.read_rules_sources(spark, a.root).cache()
        for r in symbolic.extract_rules(src, terminal).orderBy("path", "line", "rule_no").toLocalIterator():
            print(f"{r.path}:{r.line} {r.fqn}: " + (r.note or f"{' AND '.join(r.when_) or 'always'} -> {r.outcome}"))
        for r in jsp.extract_rules(src).orderBy("path", "line", "rule_no").toLocalIterator():
            print(f"{r.path}:{r.line}: " + (r.note or f"{' AND '.join(r.when_) or 'always'} -> {r.outcome}"))
    else:
        service = Service(store.load(spark, a.store, a.space), a.store)
        if a.command == "serve":
            service.serve()
        elif a.command == "export":
            text = specs.export_spec(service.space)
            store.write_markdown(text, spark, a.to) if a.to else sys.stdout.write(text)
        else:
            reply = json.loads(service.handle(json.dumps({"id": 1, "method": "tools/call", "params": {"name": a.tool, "arguments": json.loads(a.arguments)}})))
            print(reply["result"]["content"][0]["text"] if "result" in reply else reply["error"]["message"])
            return int("error" in reply)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
