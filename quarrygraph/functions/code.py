"""Column functions on lines of code and SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_LEFT, _RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
# fixed values
BRANCH_WORDS = ("if", "for", "while", "case", "catch")
SQL_WORDS = ("SELECT ", "INSERT ", "UPDATE ", "DELETE ", " FROM ", " WHERE ", " JOIN ")


def identifier(name: str) -> str:
    """A pattern for the identifier with nothing identifier-like on either side."""
    return _LEFT + re.escape(name) + _RIGHT


def branch_count(line: Column) -> Column:
    """Branch words and short-circuit operators in a line."""
    words = F.regexp_count(line, F.lit(_LEFT + "(" + "|".join(BRANCH_WORDS) + ")" + _RIGHT))
    return words + F.regexp_count(line, F.lit("&&")) + F.regexp_count(line, F.lit(r"\|\|"))


def is_code_line(line: Column) -> Column:
    """Neither blank nor begun as a comment."""
    return ~F.trim(line).rlike(r"^(//|\*|/\*|$)")


def looks_like_sql(line: Column) -> Column:
    upper = F.upper(line)
    out = F.lit(False)
    for w in SQL_WORDS:
        out = out | upper.contains(w)
    return out


def identifiers(line: Column) -> Column:
    """The different identifiers of a line, lower-cased: what equality joins with names use instead of scanning for each."""
    return F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(r"([\p{L}_][\p{L}\p{N}_]*)"), F.lit(1)))


def _mention(name: Column | str) -> Column:
    """A pattern for the identifier, lower-cased, as a column."""
    if isinstance(name, str):
        return F.lit(identifier(name.lower()))
    return F.concat(F.lit(_LEFT), F.lower(name), F.lit(_RIGHT))


def _before(low: Column, pattern: Column) -> Column:
    return F.call_function("regexp_extract", low, F.concat(F.lit("^(.*?)"), pattern), F.lit(1))


def table_access(line: Column, table: Column | str) -> Column:
    """C, R, U or D: the nearest keyword before the table's first mention; null without a mention or keyword."""
    low, pattern = F.lower(line), _mention(table)
    before = _before(low, pattern)

    def last(word: str) -> Column:
        return F.length(F.regexp_extract(before, "^(.*)" + word, 1)) + F.when(before.rlike(word), 1).otherwise(-10**6)

    insert, delete = last(r"\binsert\s+into\b"), last(r"\bdelete\s+from\b")
    update = last(r"\bupdate\b")
    read = F.greatest(last(r"(?<!delete )\bfrom\b"), last(r"\bjoin\b"))
    best = F.greatest(insert, delete, update, read)
    return F.when(F.rlike(low, pattern) & (best > 0), F.when(best == insert, "C").when(best == delete, "D").when(best == update, "U").otherwise("R"))


def column_access(line: Column, column: Column | str) -> Column:
    """Write after INSERT INTO or between SET and WHERE, else read if the line looks like SQL; null without a mention."""
    low, pattern = F.lower(line), _mention(column)
    before = _before(low, pattern)
    write = before.contains("insert into") | (before.rlike(r"\bset\b") & ~before.rlike(r"\bset\b.*\bwhere\b"))
    return F.when(F.rlike(low, pattern), F.when(write, "write").when(looks_like_sql(line), "read"))


def calls_on(line: Column, variable: Column) -> Column:
    """The method called on a variable: the first ``variable.name(``; null if there is none."""
    found = F.call_function("regexp_extract", line, F.concat(F.lit(_LEFT), variable, F.lit(r"\.([\p{L}_][\p{L}\p{N}_]*)\(")), F.lit(1))
    return F.when(found != "", found)
