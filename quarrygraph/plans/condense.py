"""Strong components, and what can be reached, on the condensed graph.

Cells that reach each other reach the same things, so what is carried back along calls goes from strong component to strong
component: at most a row for each component, key and value kept, however many paths there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrygraph.plans.graph import FEW
from quarrygraph.session import keep

#: Rounds of peeling before colours are spread.
PEELS = 3


def peeled(edges: DataFrame) -> DataFrame:
    """Edges whose source has an incoming and whose target has an outgoing edge: all others are on no cycle."""
    into, out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst")


def _least_reaching(edges: DataFrame) -> DataFrame:
    """(node, colour): the least node that reaches each, itself included."""
    ends = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).distinct()
    colour = keep(ends.select("node", F.col("node").alias("colour"), F.lit(True).alias("new")))
    while True:
        told = edges.join(colour.where("new").withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("told"))
        better = F.coalesce(F.col("told") < F.col("colour"), F.lit(False))
        colour = keep(colour.drop("new").join(told, "node", "left").select("node", F.when(better, F.col("told")).otherwise(F.col("colour")).alias("colour"), better.alias("new")))
        if colour.where("new").isEmpty():
            return colour.drop("new")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all ends of edges(src, dst): the least node among those that reach it and are reached by it.

    Nodes that lie on no cycle are peeled off from both ends. Then each node takes the least node that reaches it as its
    colour; the nodes that reach their colour's own node within the colour are its component, and go; the rest again.
    """
    known = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    known = keep(known)
    nodes = known.select(F.col("src").alias("node")).unionAll(known.select("dst")).distinct()
    left, found = known.where("src <> dst"), None
    while True:
        for _ in range(PEELS):
            left = peeled(left)
        left = keep(left)
        if left.isEmpty():
            break
        colour = _least_reaching(left)
        a, b = colour.withColumnsRenamed({"node": "src", "colour": "a"}), colour.withColumnsRenamed({"node": "dst", "colour": "b"})
        within = keep(left.join(a, "src").join(b, "dst").where("a = b").select("src", "dst"))
        reached = frontier = colour.where("node = colour")
        while not frontier.isEmpty():
            back = within.join(frontier.select(F.col("node").alias("dst"), "colour"), "dst").select(F.col("src").alias("node"), "colour").distinct()
            frontier = keep(back.join(reached.select("node"), "node", "left_anti"))
            reached = reached.unionByName(frontier)
        reached = keep(reached)
        found = reached if found is None else found.unionByName(reached)
        gone = reached.select("node")
        left = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
    if found is None:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("colour", "node").alias("component"))


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(src, dst) between different components."""
    a, b = components.withColumnsRenamed({"node": "src", "component": "a"}), components.withColumnsRenamed({"node": "dst", "component": "b"})
    return edges.select("src", "dst").join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def _least(rows: DataFrame, most: int | None) -> DataFrame:
    """Of different (component, key, value) the ``most`` least values of each component and key."""
    if most is None:
        return rows
    rank = F.row_number().over(W.partitionBy("component", "key").orderBy("value"))
    return rows.withColumn("_n", rank).where(F.col("_n") <= most).drop("_n")


class Condensed:
    """A graph's strong components and the edges between them, kept for several questions."""

    def __init__(self, edges: DataFrame) -> None:
        self.components = keep(strong_components(edges))
        self.step = keep(condensed(edges, self.components))

    def carried_back(self, seeds: DataFrame, most: int | None = None) -> DataFrame:
        """(node, key, value): the values that seeds(node, key, value) has for any node that each node reaches, itself included;
        the ``most`` least of each key.

        Only what is new for a component goes on to those that lead to it. Nodes with seeds need not have edges.
        """
        lone = seeds.select("node").distinct().join(self.components.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
        every = self.components.unionByName(lone)
        state = keep(_least(seeds.where("value IS NOT NULL").join(every, "node").select("component", "key", "value").distinct(), most))
        delta = state
        while not delta.isEmpty():
            told = self.step.join(delta.withColumnRenamed("component", "dst"), "dst").select(F.col("src").alias("component"), "key", "value")
            new = told.distinct().join(state, ["component", "key", "value"], "left_anti")
            merged = keep(_least(state.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True))), most))
            state, delta = merged.drop("_new"), merged.where("_new").drop("_new")
        return every.join(state, "component").select("node", "key", "value")


def _plain(column: str) -> tuple[Column, Column]:
    """Whether an id is a letter and a number of up to 15 digits, and a number that only this id has among such."""
    letter, digits = F.substring(column, 1, 1), F.substring(column, 2, 15).try_cast("long")
    same = letter.between("A", "z") & (digits >= 0) & (F.concat(letter, digits.cast("string")) == F.col(column))
    return F.coalesce(same, F.lit(False)), F.ascii(letter).cast("long") * 10**15 + digits


def numbering(ids: DataFrame) -> Callable[[str], Column]:
    """A number for each text of ids(id), by the column's name: made of the text where all are a letter and digits; else a hash,
    with all ids counted against it and another seed taken until none share one."""
    if ids.where(~_plain("id")[0]).isEmpty():
        return lambda column: _plain(column)[1]
    ids, seed = keep(ids.distinct()), 0
    rows = ids.count()
    while ids.select(F.xxhash64(F.lit(seed), "id")).distinct().count() < rows:
        seed += 1
    return lambda column: F.xxhash64(F.lit(seed), column)


#: Links a source, on average, that sets are first carried over; sources with more to say of which a list is broadcast.
FIRST, NUMBERS = 8, 1_000_000


class ReachedSets:
    """Which values the nodes reach, for seeds(node, value) and edges(src, dst) that lie in files; nodes are texts.

    Values are bits, 64 of them a row, so a link carries words and not values. Sets first go over a share of the links, chosen by
    hash; a node that has every value then needs no more of its links. Only the links of the others are read in full.
    """

    def __init__(self, edges: DataFrame, seeds: DataFrame) -> None:
        edges = edges.where("src IS NOT NULL AND dst IS NOT NULL")
        seeds = seeds.where("node IS NOT NULL AND value IS NOT NULL")
        self.number = numbering(edges.select(F.col("src").alias("id")).unionAll(edges.select("dst")).unionAll(seeds.select("node")))
        links = edges.select(self.number("src").alias("src"), self.number("dst").alias("dst"))
        values = keep(seeds.select("value").distinct())
        n = values.count()
        # ids of a partition follow one another from a multiple of 64
        at = keep(values.repartition(max(1, -(-n // 4096))).select("value", F.monotonically_increasing_id().alias("at")))
        at = at.select("value", F.floor(F.col("at") / 64).alias("word"), (F.col("at") % 64).cast("int").alias("bit"))
        self.values = F.broadcast(at) if n <= FEW else at
        marked = seeds.join(self.values, "value").select(self.number("node").alias("n"), "word", F.expr("shiftleft(1L, bit)").alias("bits"))
        self.state = keep(marked.groupBy("n", "word").agg(F.bit_or("bits").alias("bits")))
        self._carry(links)

    def _carry(self, links: DataFrame) -> None:
        every = keep(self.state.groupBy("word").agg(F.bit_or("bits").alias("every")))
        words = every.count()
        sources = keep(links.select(F.col("src").alias("n")).distinct())
        rate = max(1, links.count() // max(1, FIRST * sources.count()))
        chosen = keep(links.where(F.pmod(F.xxhash64("src", "dst"), F.lit(rate)) == 0))
        self._spread(chosen, self.state)
        if rate == 1:
            return
        whole = self.state.join(F.broadcast(every) if words <= FEW else every, "word").where("bits = every")
        whole = whole.select("n") if words == 1 else whole.groupBy("n").count().where(F.col("count") == words).select("n")
        left = keep(sources.join(whole, "n", "left_anti").withColumnRenamed("n", "src"))
        rows = left.count()
        if not rows:
            return
        rest = keep(links.join(F.broadcast(left) if rows <= NUMBERS else left, "src", "left_semi"))
        delta = self._told(rest, self.state)
        self._spread(chosen.unionByName(rest), delta)

    def _told(self, links: DataFrame, news: DataFrame) -> DataFrame:
        """Adds to the state what news has for the ends of links; the rows that changed."""
        near = news.withColumnRenamed("n", "dst")
        told = links.join(F.broadcast(near) if news.count() <= FEW else near, "dst").groupBy(F.col("src").alias("n"), "word").agg(F.bit_or("bits").alias("told"))
        both = F.coalesce("bits", F.lit(0)).bitwiseOR(F.coalesce("told", F.lit(0)))
        merged = keep(self.state.join(told, ["n", "word"], "full_outer").select("n", "word", both.alias("bits"), F.coalesce(both != F.col("bits"), F.lit(True)).alias("new")))
        self.state = merged.drop("new")
        return merged.where("new").drop("new")

    def _spread(self, links: DataFrame, news: DataFrame) -> None:
        while not news.isEmpty():
            news = self._told(links, news)

    def of(self, named: DataFrame) -> DataFrame:
        """(name, value): the values that named(node, name) reach, itself included; once for a name that several nodes have."""
        sets = named.select(self.number("node").alias("n"), "name").where("n IS NOT NULL").join(self.state, "n").groupBy("name", "word").agg(F.bit_or("bits").alias("bits"))
        bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit("bits", k) == 1)
        return sets.select("name", "word", F.explode(bits).alias("bit")).join(self.values, ["word", "bit"]).select("name", "value")
