"""Decision tables of JSP and tag files: which content each combination of JSTL conditions renders."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from .decision_table import MOST, Table, TableError, compress
from .symbolic import normal

MAX_PATHS, SUMMARY = 512, 60
TAG = re.compile(r"<(/?)c:(if|choose|when|otherwise)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.S)
TEST = re.compile(r"\btest\s*=\s*(\"([^\"]*)\"|'([^']*)')", re.S)


@dataclass
class Element:
    tag: str
    start: int
    test: str | None = None
    body: list = field(default_factory=list)


class Malformed(ValueError):
    pass


def summary(text: str) -> str:
    """Plain text of a fragment: tags removed, cut after SUMMARY characters."""
    plain = normal(re.sub(r"<[^>]*>", " ", re.sub(r"<%--.*?--%>|<!--.*?-->", " ", text, flags=re.S)))
    return plain[:SUMMARY] + "…" if len(plain) > SUMMARY else plain


def parse(text: str) -> list:
    """Text and Elements in order; a stray end tag is ignored, an open element ends with the file."""
    root = Element("root", 0)
    stack, at = [root], 0
    for m in TAG.finditer(text):
        if m.start() > at:
            stack[-1].body.append(text[at : m.start()])
        at = m.end()
        if m[1]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == m[2]), None)
            if k is not None:
                del stack[k:]
            continue
        t = TEST.search(m[3])
        e = Element(m[2], m.start(), normal((t[2] if t[2] is not None else t[3]).strip()) if t else None)
        stack[-1].body.append(e)
        if not m[4]:
            stack.append(e)
    stack[-1].body.append(text[at:])
    return root.body


def condition(test: str) -> str:
    m = re.fullmatch(r"\$\{(.*)\}", test, re.S)
    return normal(m[1]) if m else test


def paths(body: list, truth: dict[str, bool], atoms: list[str]) -> list[tuple[dict[str, bool], list[str]]]:
    """(conditions, rendered summaries) of each way through a body."""
    out: list[tuple[dict[str, bool], list[str]]] = [(truth, [])]
    for k in body:
        if isinstance(k, str):
            if s := summary(k):
                out = [(t, [*r, s]) for t, r in out]
            continue
        nxt = []
        for t, r in out:
            for t2, r2 in element(k, t, atoms):
                nxt.append((t2, r + r2))
        out = nxt
        if len(out) > MAX_PATHS:
            raise Malformed(f"more than {MAX_PATHS} paths")
    return out


def fork(test: str | None, truth: dict[str, bool], atoms: list[str]) -> list[tuple[dict[str, bool], bool]]:
    if test is None:
        raise Malformed("a condition without a test")
    a = condition(test)
    if a in ("true", "false"):
        return [(truth, a == "true")]
    negated = False
    if m := re.fullmatch(r"(?:!|not\s+)\s*(\w[\w.]*)", a):
        a, negated = m[1], True
    if a not in atoms:
        if len(atoms) >= MOST:
            raise Malformed(f"more than {MOST} conditions")
        atoms.append(a)
    if a in truth:
        return [(truth, truth[a] != negated)]
    return [(truth | {a: not negated}, True), (truth | {a: negated}, False)]


def element(e: Element, truth: dict[str, bool], atoms: list[str]) -> list[tuple[dict[str, bool], list[str]]]:
    if e.tag == "if":
        return [x for t, v in fork(e.test, truth, atoms) for x in (paths(e.body, t, atoms) if v else [(t, [])])]
    if e.tag == "choose":
        out, rest = [], [truth]
        for k in (k for k in e.body if isinstance(k, Element)):
            if k.tag == "when":
                nxt = []
                for t in rest:
                    for t2, v in fork(k.test, t, atoms):
                        if v:
                            out += paths(k.body, t2, atoms)
                        else:
                            nxt.append(t2)
                rest = nxt
            elif k.tag == "otherwise":
                out += [x for t in rest for x in paths(k.body, t, atoms)]
                rest = []
        return out + [(t, []) for t in rest]
    raise Malformed(f"c:{e.tag} outside c:choose")


@dataclass
class Cluster:
    line: int
    table: Table | None
    incomplete: bool
    note: str | None = None


def clusters(text: str) -> list[Cluster]:
    """A table for each top-level c:if or c:choose."""
    out = []
    end = 0
    body = parse(text)
    for k, e in enumerate(body):
        if not isinstance(e, Element):
            continue
        nxt = next((x.start for x in body[k + 1 :] if isinstance(x, Element)), len(text))
        inside = text[e.start : nxt]
        end = max((m.end() for m in TAG.finditer(inside)), default=len(inside))
        incomplete = re.search(r"<%(?![-=@!])[^%]*\bif\s*\(", inside[:end]) is not None
        line, atoms = text.count("\n", 0, e.start) + 1, []
        try:
            found = element(e, {}, atoms)
        except Malformed as x:
            out.append(Cluster(line, None, incomplete, str(x)))
            continue
        common = set(found[0][1]).intersection(*(r for _, r in found)) if found else set()
        table = Table(atoms)
        for t, r in found:
            told = [s for s in r if s not in common]
            table.add([t.get(a) for a in atoms], f"renders: {' ⊕ '.join(told)}" if told else "(no conditional content)")
        out.append(Cluster(line, table, incomplete))
    return out


def extract_rules(files: DataFrame) -> DataFrame:
    """(path, line, paths, rule_no, when_, outcome, incomplete, note) of all JSP and tag files (path, text)."""
    schema = "path string, line int, paths int, rule_no int, when_ array<string>, outcome string, incomplete boolean, note string"

    def rows(path: str, text: str) -> Iterator[tuple]:
        for c in clusters(text):
            try:
                if c.table is None:
                    raise TableError(c.note)
                done = compress(c.table)
                for k, (when, outcome) in enumerate(done.rules):
                    yield path, c.line, done.paths, k, [("" if v else "NOT ") + a for a, v in zip(done.variables, when, strict=True) if v is not None], outcome, c.incomplete, None
            except TableError as e:
                yield path, c.line, 0, -1, None, None, c.incomplete, str(e)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([r for p, t in zip(pdf["path"], pdf["text"], strict=True) for r in rows(p, t or "")], columns=[c.split()[0] for c in schema.split(", ")])

    return files.where(files["path"].rlike(r"(?i)\.(jsp|tag)$")).select("path", "text").mapInPandas(run, schema)
