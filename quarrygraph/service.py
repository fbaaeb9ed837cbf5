"""A line-delimited JSON-RPC service over the query catalogue."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import IO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.operators import calls, catalogue, column_usage, findings, specs, symbolic, topology
from quarrygraph.functions.kernels import mapper_statements
from quarrygraph.plans.space import Space, SymbolNotFound, require
from quarrygraph.sources import store


class BadParams(ValueError):
    """Missing or unknown arguments."""


def rows(df: DataFrame) -> list[dict]:
    return [json.loads(r) for r in df.toJSON().toLocalIterator()]


def tables(d: dict[str, DataFrame]) -> dict[str, list[dict]]:
    return {k: rows(v) for k, v in d.items()}


class Service:
    """Answers tool calls on one space; annotate changes it, save writes it."""

    def __init__(self, space: Space, root: str | None = None) -> None:
        self.space, self.root = space, root
        s = lambda: self.space
        self.tools: dict[str, tuple[Callable[..., object], tuple[str, ...], str]] = {
            "overview": (lambda: tables({"counts": catalogue.overview_counts(s()), "packages": catalogue.overview_packages(s())}), (), "counts by type and package"),
            "search": (lambda query, entity_type=None, limit=30: rows(catalogue.search(s(), query, entity_type, limit)), ("query",), "ranked symbol search"),
            "package_dependencies": (lambda: tables({"nodes": catalogue.package_nodes(s()), "edges": catalogue.package_dependencies(s())}), (), "edges between packages"),
            "class_dependencies": (lambda class_name: rows(catalogue.class_dependencies(s(), class_name)), ("class_name",), "edges of a class"),
            "feature": (lambda keyword: tables(catalogue.feature(s(), keyword)), ("keyword",), "slice around a keyword"),
            "column_usage": (lambda table: rows(column_usage.column_usage(s(), table)), ("table",), "readers and writers of a table's columns"),
            "explain": (lambda symbol: rows(calls.explain(s(), symbol)), ("symbol",), "what is known of a symbol"),
            "callers": (lambda symbol: rows(calls.callers(s(), symbol)), ("symbol",), "incoming references"),
            "callees": (lambda symbol: rows(calls.callees(s(), symbol)), ("symbol",), "outgoing references"),
            "impact": (lambda symbol, max_depth=3: rows(calls.impact(s(), symbol, max_depth)), ("symbol",), "what a change reaches"),
            "unknowns": (lambda scope=None: rows(findings.unknowns(s(), scope)), (), "unresolved and uncertain facts"),
            "dead_code": (lambda: rows(findings.dead_code(s())), (), "unreferenced methods and types"),
            "hotspots": (lambda limit=20: rows(findings.hotspots(s(), limit)), (), "most complex methods"),
            "crud_matrix": (lambda: rows(findings.crud_matrix(s(), mapper_statements(s().table("source_files")))), (), "entry points by table"),
            "enforces": (lambda entry, relation, max_depth=5: rows(calls.enforces(s(), entry, relation, max_depth)), ("entry", "relation"), "bounded property check"),
            "spec_loss": (lambda: rows(specs.spec_loss(s())), (), "what a specification leaves out"),
            "domain_clusters": (lambda min_lifetime=2: rows(topology.domain_clusters(s(), min_lifetime)), (), "clusters of cells that call each other"),
            "export_spec": (lambda: specs.export_spec(s()), (), "Markdown specification"),
            "enrich": (lambda symbol: rows(specs.enrich(s(), symbol)), ("symbol",), "source and context for an annotator"),
            "enrich_batch": (lambda scope=None, limit=10: rows(specs.enrich_batch(s(), scope, limit)), (), "next symbols to annotate"),
            "annotate": (self.annotate, ("symbol",), "stores an annotation"),
            "save": (self.save, (), "writes the space"),
            "extract_core_rules": (self.core_rules, ("symbol",), "minimal decision table"),
            "debug_trace": (self.debug_trace, ("symbol",), "replays choices through a method"),
        }

    def annotate(self, symbol: str, **fields) -> dict:
        known = {"intent", "behavior", "preconditions", "postconditions", "side_effects", "error_behavior"}
        if set(fields) - known:
            raise BadParams(f"unknown fields {sorted(set(fields) - known)}")
        self.space = specs.annotate(self.space, symbol, **fields)
        return {"status": "ok", "symbol": symbol}

    def save(self) -> dict:
        if self.root is None:
            raise RuntimeError("no store")
        return {"status": "ok", "path": store.save(self.space, self.root), "annotations": self.space.table("annotations").count()}

    def source(self, symbol: str) -> tuple[str, str]:
        e = require(self.space, symbol)
        row = self.space.table("source_files").where(F.col("path") == e.file).select("text").first()
        if row is None:
            raise LookupError(f"no source for {e.fqn}")
        return e.fqn, row.text

    def core_rules(self, symbol: str, terminal_calls=symbolic.TERMINAL) -> str:
        fqn, text = self.source(symbol)
        return symbolic.core_rules(text, fqn, tuple(terminal_calls))

    def debug_trace(self, symbol: str, choices=(), terminal_calls=symbolic.TERMINAL) -> str:
        fqn, text = self.source(symbol)
        return symbolic.trace(text, fqn, list(choices), tuple(terminal_calls)).to_markdown()

    def handle(self, line: str) -> str | None:
        """The reply to one request; None for a notification (no id)."""
        try:
            req = json.loads(line)
        except ValueError:
            return self.reply(None, error=(-32700, "parse error"))
        if not isinstance(req, dict) or "id" not in req:
            return None
        key, method, params = req["id"], req.get("method"), req.get("params") or {}
        if method == "initialize":
            return self.reply(key, {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "quarrygraph", "version": "1"}})
        if method == "ping":
            return self.reply(key, {})
        if method == "tools/list":
            return self.reply(key, {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "required": list(r)}} for n, (_, r, d) in self.tools.items()]})
        if method != "tools/call":
            return self.reply(key, error=(-32601, f"unknown method {method}"))
        name, args = params.get("name"), params.get("arguments") or {}
        if name not in self.tools:
            return self.reply(key, error=(-32602, f"unknown tool {name}"))
        f, required, _ = self.tools[name]
        if missing := [r for r in required if r not in args]:
            return self.reply(key, error=(-32602, f"missing {missing}"))
        try:
            out = f(**args)
        except (BadParams, TypeError) as e:
            return self.reply(key, error=(-32602, str(e)))
        except SymbolNotFound as e:
            return self.reply(key, error=(-32000, f"not found: {e}"))
        except Exception as e:  # a failed tool must not end the service
            return self.reply(key, error=(-32000, str(e)[:500]))
        return self.reply(key, {"content": [{"type": "text", "text": out if isinstance(out, str) else json.dumps(out, indent=2, ensure_ascii=False)}]})

    @staticmethod
    def reply(key, result=None, error: tuple[int, str] | None = None) -> str:
        body = {"error": {"code": error[0], "message": error[1]}} if error else {"result": result}
        return json.dumps({"jsonrpc": "2.0", "id": key} | body, ensure_ascii=False)

    def serve(self, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
        for line in source:
            if line.strip() and (out := self.handle(line)) is not None:
                sink.write(out + "\n")
                sink.flush()
