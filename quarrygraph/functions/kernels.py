"""Kernels with state across the lines of one file: DDL, field declarations, mapper statements, source decoding."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDENT = r"[^\W\d]\w*"
# fixed values
CONSTRAINTS = ("primary", "foreign", "unique", "constraint", "key", "index", "check", "fulltext")
NOT_FIELDS = ("return", "import", "package", "throw", "else", "new", "case", "break", "continue", "assert", "goto", "yield")
ENCODINGS = {"utf-8": "utf-8", "utf8": "utf-8", "shift_jis": "cp932", "sjis": "cp932", "shift-jis": "cp932", "windows-31j": "cp932", "ms932": "cp932", "euc-jp": "euc_jp", "eucjp": "euc_jp", "iso-2022-jp": "iso2022_jp", "utf-16": "utf-16", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "latin1": "latin-1", "iso-8859-1": "latin-1", "windows-1252": "cp1252"}


def per_file(files: DataFrame, rows: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """rows(text) of each file, with its path first: one call a file, no shuffle."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [(p, *r) for p, t in zip(pdf["path"], pdf["text"], strict=True) if t for r in rows(t)]
            yield pd.DataFrame(out, columns=["path", *names])

    return files.select("path", "text").mapInPandas(run, "path string, " + schema)


def ddl_rows(text: str) -> list[tuple]:
    """(table_name, column_name, sql_type, comment) of CREATE TABLE statements, line by line; an unclosed table counts."""
    out, table = [], None
    for line in text.splitlines():
        if m := re.search(rf"create\s+table\s+(?:if\s+not\s+exists\s+)?[`\"\[]?((?:{IDENT}[.])?{IDENT})", line, re.I):
            table = m[1].rpartition(".")[2]
            continue
        if table is None:
            continue
        bare = line.strip()
        if bare.startswith(")"):
            table = None
            continue
        tokens = bare.rstrip(",").split()
        if len(tokens) < 2:
            continue
        name = tokens[0].strip("`\"[]")
        if name.lower() in CONSTRAINTS or not re.fullmatch(IDENT, name):
            continue
        m = re.search(r"comment\s+'((?:[^']|'')*)'", bare, re.I)
        out.append((table, name, tokens[1].rstrip(","), m[1].replace("''", "'") if m else None))
    return out


def create_table_columns(files: DataFrame) -> DataFrame:
    return per_file(files, ddl_rows, "table_name string, column_name string, sql_type string, comment string")


def field_rows(text: str) -> list[tuple]:
    """(field_name, java_type, column_name, doc, ord) of field declarations, with the comment or @Column before each."""
    out, doc, column, inside = [], None, None, False
    for raw in text.splitlines():
        line = raw.strip()
        if inside or line.startswith("/*"):
            said = re.sub(r"^/?\*+|\*+/$", "", line).strip().rstrip("*/").strip()
            inside = "*/" not in line
            if said and not said.startswith("@") and doc is None:
                doc = said
            continue
        if line.startswith("//"):
            doc = line[2:].strip() or doc
            continue
        if line.startswith("@"):
            if m := re.search(r'@Column\s*\([^)]*name\s*=\s*"([^"]+)"', line):
                column = m[1]
            continue
        body, _, note = line.partition("//")
        body = body.strip()
        m = re.fullmatch(rf"((?:(?:private|public|protected|static|final|transient|volatile)\s+)*)([\w.<>\[\],? ]+?)\s+({IDENT})\s*(?:=\s*[^;]*)?;", body)
        if m and m[2].split()[0] not in NOT_FIELDS and not re.search(r"[(){}]", body.partition("=")[0]):
            out.append((m[3], m[2].strip(), column, doc or note.strip() or None, len(out)))
            doc, column = None, None
        elif body:
            doc, column = None, None
    return out


def field_declarations(files: DataFrame) -> DataFrame:
    return per_file(files, field_rows, "field_name string, java_type string, column_name string, doc string, ord int")


def mapper_rows(text: str) -> list[tuple]:
    """(fqn, kind, sql) of the statements of a mapper file."""
    m = re.search(r"<mapper\b[^>]*\bnamespace\s*=\s*[\"']([^\"']+)", text)
    if not m:
        return []
    found = re.finditer(r"<(select|insert|update|delete)\b([^>]*)>(.*?)</\1\s*>", text, re.S | re.I)
    out = []
    for s in found:
        if i := re.search(r"\bid\s*=\s*[\"']([^\"']+)", s[2]):
            out.append((f"{m[1]}.{i[1]}", s[1].lower(), re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", s[3])).strip()))
    return out


def mapper_statements(files: DataFrame) -> DataFrame:
    return per_file(files.where(F.lower("path").endswith(".xml") & F.col("text").contains("<mapper")), mapper_rows, "fqn string, kind string, sql string")


def decode(data: bytes, forced: str | None = None) -> tuple[str, str, bool]:
    """(text, encoding, lossy): a forced encoding, else the first of UTF-8, Shift_JIS, EUC-JP that decodes cleanly, else lossy UTF-8."""
    if forced:
        codec = ENCODINGS.get(forced.lower())
        if codec is None:
            raise ValueError(f"unknown encoding {forced}")
        text = data.decode(codec, "replace")
        return text, forced.lower(), "�" in text
    for name, codec in (("utf-8", "utf-8-sig"), ("shift_jis", "cp932"), ("euc-jp", "euc_jp")):
        try:
            text = data.decode(codec)
        except UnicodeDecodeError:
            continue
        # single bytes that Shift_JIS does not define come out in the private use area
        if codec != "cp932" or not re.search("[\uf8f0-\uf8f3]", text):
            return text, name, False
    return data.decode("utf-8", "replace"), "utf-8", True
