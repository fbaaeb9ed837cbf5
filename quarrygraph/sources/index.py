"""Lookup tables of a stored space, clustered by what is looked up, so that an answer reads its part of them only.

- ``out`` and ``in``: incidences from and to each cell, bucketed by the cell; cells with very many have tables of their own.
- ``cells``: entities bucketed by cell.
- ``tails``: every dotted ending of every full name, bucketed by the ending.
- ``grams`` and ``names``: from each three letters of the lower-case names the entities that hold them, in blocks, bucketed by
  the letters; and entities bucketed by their number.
- ``labels``: for each cell the least cell that it is connected with, by calls and by all relations.

A bucketed table is read by equality or by a list of keys in a few files, and joined on its key without an exchange of it.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.plans import graph

#: Rows of a bucket, about.
BUCKET_ROWS = 500_000
#: Incidences of one cell above which they are kept apart, dealt by both ends.
HOT_EDGES = 1_000_000
#: Share of all names above which three letters tell nothing; and how many entities a posting has.
GRAM_SHARE, GRAM_LEAST, BLOCK = 1 / 8, 1000, 4096
#: Keys that a search carries as a list; more go on as a table.
FEW = 2000

_EDGE = "file STRING, start_line INT, end_line INT, confidence DOUBLE"
_ENTITY = "fqn STRING, cell_id STRING, entity_type STRING, label STRING, file STRING, start_line INT, end_line INT, start_col INT, end_col INT"
#: Bucketed tables: the column they are bucketed by, and all their columns.
TABLES = {
    "out": ("node", f"node STRING, other STRING, relation_type STRING, {_EDGE}"),
    "in": ("node", f"node STRING, other STRING, relation_type STRING, {_EDGE}"),
    "cells": ("cell_id", _ENTITY),
    "tails": ("tail", f"tail STRING, {_ENTITY}"),
    "grams": ("gram", "gram STRING, ids ARRAY<BIGINT>"),
    "names": ("id", f"id BIGINT, {_ENTITY}"),
}


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters; none of a shorter text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(0))), lambda k: F.substring(text, k, F.lit(3))))


@dataclass(frozen=True)
class SpaceIndex:
    spark: SparkSession
    root: str
    #: Bucket counts by table, and the cells whose incidences are kept apart.
    buckets: dict[str, int]
    hot: tuple[str, ...]

    def table(self, name: str) -> DataFrame:
        """A bucketed table; registered in the session's catalogue when first asked for."""
        known = f"quarry_{hashlib.sha1(self.root.encode()).hexdigest()[:16]}_{name}"
        if not self.spark.catalog.tableExists(known):
            key, columns = TABLES[name]
            place = self.root.replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {known} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets[name]} BUCKETS LOCATION '{place}/{name}'")
        return self.spark.table(known)

    def by_key(self, name: str, keys: list) -> DataFrame:
        """Rows of a bucketed table with one of a few keys: only their buckets are read."""
        return self.table(name).where(F.col(TABLES[name][0]).isin(keys))

    def near(self, nodes: list[str] | DataFrame, incoming: bool, relations: tuple[str, ...] = ()) -> DataFrame:
        """Incidences (node, other, relation_type, ...) of cells: a short list, or a frame(node)."""
        side = "in" if incoming else "out"
        wanted = (lambda df: df.where(F.col("relation_type").isin(*relations))) if relations else (lambda df: df)
        if isinstance(nodes, list):
            out = self.by_key(side, nodes)
            hot = [n for n in nodes if n in self.hot]
            apart = self._apart(side).where(F.col("node").isin(hot)) if hot else None
        else:
            out = self.table(side).join(nodes.select("node"), "node")
            apart = self._apart(side).join(F.broadcast(nodes.select("node").where(F.col("node").isin(*self.hot))), "node") if self.hot else None
        return wanted(out if apart is None else out.unionByName(apart))

    def _apart(self, side: str) -> DataFrame:
        return self.spark.read.schema(TABLES[side][1]).parquet(f"{self.root}/{side}-hot")

    def entities(self, cells: DataFrame, on: str = "cell_id") -> DataFrame:
        """cells with the entities of their column ``on``; the entities are not exchanged."""
        return cells.join(self.table("cells").withColumnRenamed("cell_id", on), on)

    def ending(self, symbol: str) -> DataFrame:
        """Entities whose full name is the symbol or ends with a dot and it."""
        return self.by_key("tails", [symbol]).drop("tail")

    def containing(self, part: str) -> DataFrame | None:
        """Entities whose lower-case full name or label contains part, which is in lower case. None if its letters are too few or
        too common to find them by: then about all names have to be looked at."""
        grams = sorted({part[k : k + 3] for k in range(len(part) - 2)})
        if not grams:
            return None
        size = {r.gram: r.n for r in self.by_key("grams", grams).groupBy("gram").agg(F.sum(F.when(F.size("ids") > 0, F.size("ids"))).alias("n")).collect()}
        if any(g not in size for g in grams):
            return self.table("names").drop("id").where("false")
        rarest = sorted((g for g in grams if size[g] is not None), key=lambda g: (size[g], g))[:3]
        if not rarest:
            return None
        found = self.by_key("grams", rarest).select("gram", F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest)).select("id")
        few = [r.id for r in found.limit(FEW + 1).collect()]
        held = self.by_key("names", few) if len(few) <= FEW else self.table("names").join(found, "id")
        return held.drop("id").where(F.lower("fqn").contains(part) | F.lower("label").contains(part))

    def labels(self) -> DataFrame:
        """(cell_id, by_calls, by_all)."""
        return self.spark.read.schema("cell_id STRING, by_calls STRING, by_all STRING").parquet(f"{self.root}/labels")

    def search(self, start: list[str], max_depth: int, relations: tuple[str, ...] = (), incoming: bool = False) -> tuple[DataFrame, bool]:
        """Breadth-first search: (node, depth) with the shortest depth; whether it ended before max_depth.

        While few cells are on the way they are looked up by key; from the first depth with more than FEW on, the frontier is a
        table that is joined with the bucketed incidences.
        """
        seen, frontier = dict.fromkeys(start, 0), sorted(set(start))
        for depth in range(1, max_depth + 1):
            near = self.near(frontier, incoming, relations).select(F.col("other").alias("node")).distinct()
            got = [r.node for r in near.limit(FEW + 1).collect()]
            if len(got) > FEW or len(seen) > 20 * FEW:
                return self._search_on(seen, frontier, depth, max_depth, relations, incoming)
            frontier = sorted(n for n in got if n not in seen)
            if not frontier:
                return self._found(seen), True
            seen |= dict.fromkeys(frontier, depth)
        return self._found(seen), False

    def _found(self, seen: dict[str, int]) -> DataFrame:
        return self.spark.createDataFrame(list(seen.items()), "node string, depth int")

    def _search_on(self, seen: dict[str, int], few: list[str], depth: int, max_depth: int, relations: tuple[str, ...], incoming: bool) -> tuple[DataFrame, bool]:
        from quarrygraph.session import keep

        found, near = self._found(seen), self.near(few, incoming, relations)
        while True:
            new = near.select(F.col("other").alias("node")).distinct().join(found.select("node"), "node", "left_anti")
            frontier = keep(new.withColumn("depth", F.lit(depth)))
            if frontier.isEmpty():
                return found, True
            found = found.unionByName(frontier)
            if depth == max_depth:
                return found, False
            near, depth = self.near(frontier, incoming, relations), depth + 1


# --- writing ---------------------------------------------------------------------------------------------------------


def _write(df: DataFrame, root: str, name: str, rows: int) -> int:
    """Writes a bucketed table, each bucket by one task; the number of buckets."""
    key, columns = TABLES[name]
    n = max(4, math.ceil(rows / BUCKET_ROWS))
    held = f"quarry_{hashlib.sha1(root.encode()).hexdigest()[:16]}_{name}"
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {held}")
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", f"{root}/{name}").mode("overwrite").saveAsTable(held)
    return n


def gram_postings(names: DataFrame) -> DataFrame:
    """(gram, ids): blocks of entity numbers; letters of more than GRAM_SHARE of all names have one empty block."""
    total = names.count()
    both = F.concat_ws("\n", F.lower("fqn"), F.lower("label"))
    pairs = names.select("id", F.explode(trigrams(both)).alias("gram"))
    size = pairs.groupBy("gram").agg(F.count("*").alias("n"))
    most = max(GRAM_LEAST, total * GRAM_SHARE)
    told = pairs.join(size.where(F.col("n") <= most).select("gram"), "gram")
    blocks = told.groupBy("gram", F.pmod(F.xxhash64("id"), F.lit(max(1, total // BLOCK))).alias("block")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return blocks.select("gram", "ids").unionByName(size.where(F.col("n") > most).select("gram", F.array().cast("array<bigint>").alias("ids")))


def component_labels(cells: DataFrame, incidences: DataFrame, calls: tuple[str, ...] = ("java.calls",)) -> DataFrame:
    """(cell_id, by_calls, by_all): the least cell that each is connected with, itself if with none."""
    edges = incidences.select(F.col("from_cell_id").alias("src"), F.col("to_cell_id").alias("dst"), "relation_type")
    by = lambda df, name: graph.connected(df).select(F.col("id").alias("cell_id"), F.col("component").alias(name))
    out = cells.select("cell_id").distinct().join(by(edges.where(F.col("relation_type").isin(*calls)), "by_calls"), "cell_id", "left")
    return out.join(by(edges, "by_all"), "cell_id", "left").select("cell_id", F.coalesce("by_calls", "cell_id").alias("by_calls"), F.coalesce("by_all", "cell_id").alias("by_all"))


def merged_labels(labels: DataFrame, column: str, links: DataFrame) -> DataFrame:
    """labels(cell_id, column) after more links(src, dst): only the labels that the links touch are connected anew."""
    ends = labels.select(F.col("cell_id"), F.col(column).alias("label"))
    between = links.join(ends.withColumnsRenamed({"cell_id": "src", "label": "a"}), "src").join(ends.withColumnsRenamed({"cell_id": "dst", "label": "b"}), "dst").where("a <> b").select("a", "b").distinct()
    moved = graph.connected(between, "a", "b").select(F.col("id").alias(column), F.col("component").alias("_to"))
    return labels.join(moved, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to").select(labels.columns)


def build(spark: SparkSession, root: str, entities: DataFrame, incidences: DataFrame, cells: DataFrame) -> SpaceIndex:
    """Writes all lookup tables below root."""
    links, named = incidences.count(), entities.count()
    buckets, hot = {}, set()
    for side, here, there in (("out", "from_cell_id", "to_cell_id"), ("in", "to_cell_id", "from_cell_id")):
        edges = incidences.select(F.col(here).alias("node"), F.col(there).alias("other"), "relation_type", "file", "start_line", "end_line", "confidence")
        many = [r.node for r in edges.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > HOT_EDGES).collect()]  # as many as HOT_EDGES goes into all
        apart = F.col("node").isin(many) if many else F.lit(False)
        buckets[side] = _write(edges.where(~apart), root, side, links)
        edges.where(apart).repartitionByRange("node", "other").write.mode("overwrite").parquet(f"{root}/{side}-hot")
        hot |= set(many)
    columns = [c.split()[0] for c in _ENTITY.split(", ")]
    every = entities.select(columns)
    buckets["cells"] = _write(every, root, "cells", named)
    parts = F.split("fqn", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    buckets["tails"] = _write(every.where("fqn IS NOT NULL").select(F.explode(F.array_distinct(tails)).alias("tail"), *columns), root, "tails", 4 * named)
    numbered = every.select(F.xxhash64(*columns).alias("id"), *columns)
    buckets["names"] = _write(numbered, root, "names", named)
    buckets["grams"] = _write(gram_postings(spark.read.schema(TABLES["names"][1]).parquet(f"{root}/names").select("id", "fqn", "label").distinct()), root, "grams", 4 * named)
    component_labels(cells, incidences).write.mode("overwrite").parquet(f"{root}/labels")
    index = SpaceIndex(spark, root, buckets, tuple(sorted(hot)))
    rows = [("buckets", k, n) for k, n in buckets.items()] + [("hot", c, 0) for c in hot]
    spark.createDataFrame(rows, "kind string, name string, n int").coalesce(1).write.mode("overwrite").parquet(f"{root}/about")
    return index


def open_index(spark: SparkSession, root: str) -> SpaceIndex:
    about = spark.read.schema("kind string, name string, n int").parquet(f"{root}/about").collect()
    return SpaceIndex(spark, root, {r.name: r.n for r in about if r.kind == "buckets"}, tuple(sorted(r.name for r in about if r.kind == "hot")))
