"""Column functions on names: dotted names, accessors, repository methods, SQL names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def package_of_types(fqn: Column) -> Column:
    """Segments before the first that starts upper-case; empty for a name of one segment."""
    found = F.rtrim(F.regexp_extract(fqn, r"^(?:(?!\p{Lu})[^.]+(?:[.]|$))*", 0), F.lit("."))
    return F.when(F.instr(fqn, ".") == 0, F.lit("")).otherwise(found)


def package_prefix(fqn: Column) -> Column:
    """The same without the rule for one segment."""
    return F.rtrim(F.regexp_extract(fqn, r"^(?:(?!\p{Lu})[^.]+(?:[.]|$))*", 0), F.lit("."))


def class_prefix(fqn: Column) -> Column:
    """Up to and with the first segment that starts upper-case; the whole name if none does."""
    found = F.regexp_extract(fqn, r"^(?:(?!\p{Lu})[^.]+[.])*\p{Lu}[^.]*", 0)
    return F.when(found == "", fqn).otherwise(found)


def parent_name(fqn: Column) -> Column:
    """Without the last segment; a name of one segment stays."""
    return F.regexp_replace(fqn, r"\.[^.]*$", "")


def simple_name(fqn: Column) -> Column:
    return F.regexp_extract(fqn, r"[^.]*$", 0)


def snake_case(name: Column) -> Column:
    """Every capital after the first character gets an underscore before it, unless one stands there."""
    return F.lower(F.regexp_replace(name, r"(?<=[^_])(\p{Lu})", "_$1"))


def capitalised(name: Column) -> Column:
    return F.concat(F.upper(F.left(name, F.lit(1))), F.substring(name, F.lit(2), F.length(name)))


def is_accessor(label: Column) -> Column:
    return label.rlike(r"^(get|set|is)\p{Lu}")


#: Method name prefixes of repositories, in the order in which they are tried.
REPOSITORY_PREFIXES = (
    ("C", ("insert", "create", "persist", "register")),
    ("CU", ("save", "store", "add")),
    ("R", ("find", "get", "select", "load", "read", "count", "exists", "list", "search", "query", "fetch")),
    ("U", ("update", "merge", "modify")),
    ("D", ("delete", "remove", "purge")),
)


def repository_operation(method: Column) -> Column:
    """Letters of what a repository method does, letter case apart; null if its prefix says nothing."""
    out = F.lit(None).cast("string")
    for letters, prefixes in reversed(REPOSITORY_PREFIXES):
        out = F.when(F.lower(method).rlike("^(" + "|".join(prefixes) + ")"), F.lit(letters)).otherwise(out)
    return out


def repository_entity(name: Column) -> Column:
    """The entity in XRepository, XDao or XMapper; null for other names."""
    found = F.regexp_extract(name, r"^(.+?)(Repository|Dao|Mapper)$", 1)
    return F.when(found != "", found)


def getter_setter_access(line: Column, field: Column) -> dict[str, Column]:
    """Whether a line calls the field's getter or setter."""
    cap = capitalised(field)
    return {
        "getter": line.contains(F.concat(F.lit(".get"), cap, F.lit("("))) | line.contains(F.concat(F.lit(".is"), cap, F.lit("("))),
        "setter": line.contains(F.concat(F.lit(".set"), cap, F.lit("("))),
    }


def direct_access(line: Column, field: Column) -> dict[str, Column]:
    """Whether a line reads or writes ``.field``; only the first access counts."""
    after = F.call_function("regexp_extract", line, F.concat(F.lit(r"\."), field, F.lit(r"(?![\p{L}\p{N}_])\s*(==?|)")), F.lit(1))
    found = F.rlike(line, F.concat(F.lit(r"\."), field, F.lit(r"(?![\p{L}\p{N}_])")))
    return {"found": found, "write": found & (after == "=")}


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_logging_call(text: Column) -> Column:
    return text.rlike(r"^(logger\.|log\.|LOG\.|Logger\.|System\.out\.|System\.err\.)")


def tags_stripped(text: Column, most: int = 60) -> Column:
    """Mark-up removed, white space collapsed, cut to ``most`` characters with an ellipsis."""
    plain = normalised(F.regexp_replace(text, r"<[^>]*>", " "))
    return F.when(F.length(plain) > most, F.concat(F.left(plain, F.lit(most)), F.lit("…"))).otherwise(plain)


def class_of_file(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\.java$", ""), "/", ".")
