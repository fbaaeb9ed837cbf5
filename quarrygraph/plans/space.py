"""A space: the tables of one lifted project."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph import schema

if TYPE_CHECKING:
    from quarrygraph.sources.index import SpaceIndex


class SymbolNotFound(LookupError):
    """No entity has this name."""


@dataclass(frozen=True)
class Space:
    entities: DataFrame
    incidences: DataFrame
    cells: DataFrame
    unresolved: DataFrame | None = None
    annotations: DataFrame | None = None
    source_lines: DataFrame | None = None
    source_files: DataFrame | None = None
    obstructions: DataFrame | None = None
    space_id: str = "space"
    #: Lookup tables of entities, incidences and cells; None if there are none or these tables were exchanged.
    index: SpaceIndex | None = None
    #: Whether the incidences lie in files, so that it costs no more to read them again than a copy of them.
    stored: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.entities.sparkSession

    def table(self, name: str) -> DataFrame:
        """A table, empty with its schema if the space has none."""
        have = getattr(self, name)
        return have if have is not None else self.spark.createDataFrame([], getattr(schema, name.upper()))

    def with_tables(self, **tables: DataFrame) -> Space:
        same = not {"entities", "incidences", "cells"} & set(tables)
        return replace(self, index=self.index if same else None, stored=self.stored and "incidences" not in tables, **tables)

    def calls(self, *relations: str) -> DataFrame:
        """(src, dst) of incidences of these relations, one row an incidence."""
        out = self.incidences if not relations else self.incidences.where(F.col("relation_type").isin(*relations))
        return out.select(F.col("from_cell_id").alias("src"), F.col("to_cell_id").alias("dst"))


def resolve(space: Space, symbol: str) -> DataFrame:
    """The entity with this full name; else of those whose name ends with it the shortest, then the first by name.

    One row, or none.
    """
    exact = F.col("fqn") == symbol
    found = space.index.ending(symbol) if space.index else space.entities.where(exact | F.col("fqn").endswith("." + symbol))
    return found.orderBy(exact.desc(), F.length("fqn"), "fqn", "cell_id").limit(1)


def require(space: Space, symbol: str):
    """The resolved entity as a row; SymbolNotFound if there is none."""
    row = resolve(space, symbol).first()
    if row is None:
        raise SymbolNotFound(symbol)
    return row


def containing(space: Space, part: str) -> DataFrame:
    """Entities whose full name or label contains part, letter case apart."""
    low = part.lower()
    found = space.index.containing(low) if space.index else None
    return found if found is not None else space.entities.where(F.lower("fqn").contains(low) | F.lower("label").contains(low))


def members(names: DataFrame, of: DataFrame, name: str = "fqn", owner: str = "owner") -> DataFrame:
    """names joined with the owners (column ``owner``) that are a dotted prefix of them, by equality on every ancestor.

    A prefix comparison would be a nested-loop join; each name has few ancestors instead.
    """
    parts = F.split(F.col(name), r"\.")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    able = names.where(F.instr(name, ".") > 0).withColumn("_ancestor", F.explode(ancestors))
    return able.join(of, able["_ancestor"] == of[owner]).drop("_ancestor")
