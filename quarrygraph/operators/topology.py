"""Domain clusters: zero-dimensional persistence over hop distances or any metric."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrygraph.functions.names import parent_name
from quarrygraph.plans import graph
from quarrygraph.plans.space import Space
from quarrygraph.session import keep


def min_combine(*distances: DataFrame) -> DataFrame:
    """(i, j, d): the least of several sparse distances; a missing pair is infinitely far."""
    every = distances[0].select("i", "j", "d")
    for d in distances[1:]:
        every = every.unionByName(d.select("i", "j", "d"))
    return every.groupBy("i", "j").agg(F.min("d").alias("d"))


def near_pairs(points: DataFrame, most: float) -> DataFrame:
    """(i, j, d) for i < j of points(k, x) on a line that are at most so far apart, by equality on cells of that width."""
    cell = F.floor(F.col("x") / most)
    a = points.select(F.col("k").alias("i"), F.col("x").alias("xi"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    b = points.select(F.col("k").alias("j"), F.col("x").alias("xj"), cell.alias("cell"))
    return a.join(b, "cell").where("i < j").select("i", "j", F.abs(F.col("xi") - F.col("xj")).alias("d")).where(F.col("d") <= most)


#: Null, undefined and infinite places are near none.
FINITE = "abs(x) < double('infinity')"


def near_places(points: DataFrame, most: float) -> DataFrame:
    """(x, y, d) for x <= y: different places of points(k, x) that are at most so far apart; a place with itself if it has several points."""
    places = points.where(FINITE).groupBy("x").agg(F.count("*").alias("n"))
    apart = near_pairs(places.select(F.col("x").alias("k"), "x"), most).select(F.col("i").alias("x"), F.col("j").alias("y"), "d")
    return apart.unionAll(places.where("n > 1").select("x", F.col("x").alias("y"), (F.col("x") - F.col("x")).alias("d")))


def near_values(points: DataFrame, most: float) -> DataFrame:
    """(d): the distances that near_pairs finds, from the different places alone; zero if a place has several points."""
    return near_places(points, most).select("d").distinct()


def ranked(values: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): the distinct values with their places from 1 in ascending order.

    The values are dealt by ranges; a value's place is its place in its partition plus the values of the partitions before,
    so only a row a partition passes through one task.
    """
    dealt = values.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column)
    dealt = keep(dealt.select(column, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    heads = dealt.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select("_part", (before - F.col("_first") + 1).alias("_shift"))
    return dealt.join(heads, "_part").select(column, (F.col("_at") + F.col("_shift")).alias(name))


def staged(pairs: DataFrame) -> DataFrame:
    """pairs(..., d) with the place of each distance among the different ones as its stage."""
    stages = keep(ranked(pairs, "d", "stage"))
    # few distances: each has a large share of the pairs, which must not meet in its task
    return pairs.join(F.broadcast(stages) if stages.count() <= graph.FEW else stages, "d")


def rips_stages(distances: DataFrame) -> DataFrame:
    """(i, j, d, stage) for i < j: stage 0 has the points, then one for each distinct finite distance, zero too."""
    pairs = distances.where("i < j AND d >= 0 AND d < double('infinity')").select("i", "j", "d")
    return staged(pairs).select("i", "j", "d", "stage")


#: Points of a place that are paired with others at once. Spark holds what becomes of one row of two exploded lists, so the
#: square of this counts.
CHUNK = 64


def near_stages(points: DataFrame, most: float, digits: int) -> DataFrame:
    """rips_stages of near_pairs of points(k, x), distances rounded.

    Distances and stages are those of places. The points of a place lie in chunks, and pairs of chunks are dealt over all
    cores, so that pairs of points are made where they are returned: none is shuffled, looked up or made in vain.
    """
    spark = points.sparkSession
    near = staged(keep(near_places(points, most).withColumn("d", F.round("d", digits))))
    numbered = points.where(FINITE).select("k", "x", F.monotonically_increasing_id().alias("_n"))
    parts = keep(numbered.groupBy("x").agg(F.ceil(F.count("*") / CHUNK).alias("parts"), F.count("*").alias("d")))
    rows = parts.agg(F.sum("d")).first()[0] or 0
    chunks = graph.join_hot(numbered, parts, "x", rows).groupBy("x", F.pmod("_n", "parts").alias("c")).agg(F.collect_list("k").alias("ks"))
    chunks = keep(chunks)
    a, b = chunks.withColumnsRenamed({"c": "a", "ks": "is"}), chunks.withColumnsRenamed({"x": "y", "c": "b", "ks": "js"})
    both = near.join(a, "x").join(b, "y").where("x < y OR a <= b")
    # a number of partitions is given, as the rows are few and what they become is not
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    dealt = both.repartition(n, "x", "a", "y", "b").select("is", "js", "d", "stage", ((F.col("x") == F.col("y")) & (F.col("a") == F.col("b"))).alias("same"))
    every = dealt.select(F.explode("is").alias("i"), "js", "d", "stage", "same").select("i", F.explode("js").alias("j"), "d", "stage", "same")
    return every.where("i < j OR i > j AND NOT same").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d", "stage")


def spanning_forest(stages: DataFrame) -> DataFrame:
    """(i, j, stage): the edges of a least spanning forest of the pairs, by (stage, i, j).

    Every component takes its least edge to another one, again and again: the number of components halves at least each time,
    however many stages there are.
    """
    edges = keep(stages.select("i", "j", "stage", F.col("i").alias("a"), F.col("j").alias("b")).where("a <> b"))
    found = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("c"), "i", "j", "stage", "a", "b").unionAll(edges.select(F.col("b").alias("c"), "i", "j", "stage", "a", "b"))
        least = both.groupBy("c").agg(F.min_by(F.struct("i", "j", "stage", "a", "b"), F.struct("stage", "i", "j")).alias("e"))
        taken = keep(least.select("e.*").distinct())
        found = taken.select("i", "j", "stage") if found is None else found.unionAll(taken.select("i", "j", "stage"))
        label = keep(graph.connected(taken, "a", "b"))
        near, far = label.withColumnsRenamed({"id": "a", "component": "x"}), label.withColumnsRenamed({"id": "b", "component": "y"})
        edges = edges.join(near, "a", "left").join(far, "b", "left").select("i", "j", "stage", F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a <> b")
        edges = keep(edges)
    return found if found is not None else stages.select("i", "j", "stage").where("false")


#: Parts into which a range of stages is split at each level of the merge tree.
FAN = 8


def deaths(forest: DataFrame, last: int) -> DataFrame:
    """(node, death): the stage at which each node's cluster is taken in by one with a lesser node; nodes that never are have no row.

    forest(i, j, stage) spans the components of every stage; stages go up to ``last``. Ranges of stages are split level by
    level: within a range, an edge of the p-th part joins what the parts before it have already joined, so its ends become the
    least nodes there. All ranges and parts of a level are one components plan. In a range of one stage, nodes that are not
    the least of their component die. Levels grow with the logarithm of the stages, however long the chains of merges are.
    """
    width = 1
    while width < last:
        width *= FAN
    edges = keep(forest.select("i", "j", F.col("stage").cast("long").alias("stage")))
    at = F.col("stage") - 1
    while width > 1:
        part, name = width // FAN, F.floor(at / width)
        digit = F.floor(at / part) % FAN
        told = edges.where(digit < FAN - 1).select("i", "j", name.alias("r"), F.explode(F.sequence(digit + 1, F.lit(FAN - 1).cast("long"))).alias("p"))
        own = lambda end: F.struct("r", "p", F.col(end).alias("v"))
        joined = graph.connected(told.select(own("i").alias("src"), own("j").alias("dst")))
        label = keep(joined.select("id.r", "id.p", "id.v", F.col("component.v").alias("least")))
        edges = edges.withColumns({"r": name, "p": digit})
        for end in ("i", "j"):
            edges = edges.join(label.withColumnsRenamed({"v": end, "least": "_least"}), ["r", "p", end], "left").withColumn(end, F.coalesce("_least", end)).drop("_least")
        edges, width = keep(edges.select("i", "j", "stage")), part
    own = lambda end: F.struct("stage", F.col(end).alias("v"))
    ends = graph.connected(edges.select(own("i").alias("src"), own("j").alias("dst")))
    return ends.select(F.col("id.v").alias("node"), F.col("id.stage").alias("death"))


class MergeTree:
    """The zero-dimensional persistence of points(node, ...) under distances(i, j, d), derived once for several questions.

    All points are born at stage 0; of clusters that merge, the one with the least node lives on.
    """

    def __init__(self, points: DataFrame, distances: DataFrame) -> None:
        self.points = points.select("node").distinct()
        stages = keep(rips_stages(distances))
        self.last = stages.agg(F.max("stage")).first()[0] or 0
        self.forest = keep(spanning_forest(stages))
        self.deaths = keep(deaths(self.forest, self.last))

    def intervals(self) -> DataFrame:
        """(node, birth, death, lifetime). Those that never merge have no death and live one stage more than there are after 0."""
        life = F.coalesce("death", F.lit(self.last + 1)).cast("long")
        return self.points.join(self.deaths, "node", "left").select("node", F.lit(0).cast("long").alias("birth"), "death", life.alias("lifetime"))

    def counts(self) -> DataFrame:
        """(stage, components) of stage 0 and of each stage at which clusters merge; up to the next one the count stays."""
        n = self.points.count()
        # sums before each range of stages, then within it: no window takes all stages
        dealt = self.deaths.groupBy(F.col("death").alias("stage")).agg(F.count("*").alias("n")).repartitionByRange("stage")
        dealt = keep(dealt.select("stage", "n", F.spark_partition_id().alias("_part")))
        before = F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        heads = dealt.groupBy("_part").agg(F.sum("n").alias("_sum")).select("_part", before.alias("_before"))
        here = F.sum("n").over(W.partitionBy("_part").orderBy("stage"))
        later = dealt.join(heads, "_part").select("stage", (F.lit(n) - F.col("_before") - here).alias("components"))
        return self.points.sparkSession.createDataFrame([(0, n)], "stage long, components long").unionByName(later)

    def cut_stage(self, min_lifetime: int) -> int:
        """The latest stage with as many components as there are intervals that live min_lifetime; else the last.

        As many live that long as there are components at stage min_lifetime - 1, and the count stays until the next death.
        """
        if min_lifetime > self.last + 1:
            return self.last
        then = self.deaths.where(F.col("death") >= max(min_lifetime, 1)).agg(F.min("death")).first()[0]
        return self.last if then is None else then - 1

    def members(self, min_lifetime: int = 2) -> DataFrame:
        """(component, node, lifetime, confidence): a row for each point of a cluster.

        A cluster is named by its least node and lives as long as that node's interval.
        """
        inner = self.forest.where(F.col("stage") <= self.cut_stage(min_lifetime)).select(F.col("i").alias("src"), F.col("j").alias("dst"))
        here = graph.components(self.points, inner)
        life = F.coalesce("death", F.lit(self.last + 1)).cast("long")
        out = here.join(self.deaths.withColumnRenamed("node", "component"), "component", "left").select("component", "node", life.alias("lifetime"))
        confidence = F.least(F.lit(1.0), F.col("lifetime") / self.last) if self.last else F.lit(1.0)
        return out.where(F.col("lifetime") >= min_lifetime).withColumn("confidence", confidence)


def clusters(points: DataFrame, distances: DataFrame, min_lifetime: int = 2) -> DataFrame:
    """(component, members, lifetime, confidence) by a metric, with lists of names for reading; points(node, fqn). The rows of very
    large clusters are those of MergeTree.members."""
    named = MergeTree(points, distances).members(min_lifetime).join(points.select("node", "fqn"), "node")
    out = named.groupBy("component", "lifetime", "confidence").agg(F.array_sort(F.collect_list("fqn")).alias("members"))
    return out.select("component", "members", "lifetime", "confidence").orderBy(F.col("lifetime").desc(), "members")


def _call_components(space: Space) -> DataFrame:
    """(node, component) by calls, direction ignored: the labels stored with the space, else computed."""
    nodes = space.cells.where("dimension = 0").select(F.col("cell_id").alias("node")).distinct()
    if space.index:
        return nodes.join(space.index.labels().select(F.col("cell_id").alias("node"), F.col("by_calls").alias("component")), "node")
    return graph.components(nodes, space.calls("java.calls"), space.stored)


def cluster_members(space: Space, min_lifetime: int = 2) -> DataFrame:
    """(component, fqn, package, lifetime): a row for each named member of a cluster over undirected call hops.

    All merges of a hop metric happen at distance one, so clusters are connected components (isolated cells too) unless
    min_lifetime is at most 1 (every cell by itself, if there is a call at all) or above the diameter + 1 (none).
    """
    nodes = space.cells.where("dimension = 0").select(F.col("cell_id").alias("node"))
    edges = space.calls("java.calls")
    names = space.entities.groupBy(F.col("cell_id").alias("node")).agg(F.min("fqn").alias("fqn"))
    have = not edges.where("src <> dst").isEmpty()
    diameter = (graph.hop_distances(edges, edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).distinct()).agg(F.max("d")).first()[0] or 0) if have and min_lifetime > 2 else int(have)
    if min_lifetime > diameter + 1 and (min_lifetime > 2 or not have):
        comp = nodes.select("node", F.col("node").alias("component")).where("false")
    elif min_lifetime <= 1 and have:
        comp = nodes.select("node", F.col("node").alias("component"))
    else:
        comp = _call_components(space)
    life = 1 if min_lifetime <= 1 else diameter + 1
    return comp.join(names, "node").select("component", "fqn", parent_name(F.col("fqn")).alias("package"), F.lit(life).alias("lifetime"))


def cluster_sizes(space: Space, min_lifetime: int = 2) -> DataFrame:
    """(component, members, packages, crosses_boundary): numbers only, whatever the clusters' sizes."""
    out = cluster_members(space, min_lifetime).groupBy("component").agg(F.count("*").alias("members"), F.countDistinct("package").alias("packages"))
    return out.withColumn("crosses_boundary", F.col("packages") > 1)


def domain_clusters(space: Space, min_lifetime: int = 2) -> DataFrame:
    """(component, members, packages, confidence, lifetime, crosses_boundary): clusters with their lists of names, for reading. The
    rows of very large clusters are those of cluster_members."""
    grouped = cluster_members(space, min_lifetime).groupBy("component", "lifetime").agg(F.array_sort(F.collect_list("fqn")).alias("members"), F.array_sort(F.collect_set("package")).alias("packages"))
    return grouped.select("component", "members", "packages", F.lit(1.0).alias("confidence"), "lifetime", (F.size("packages") > 1).alias("crosses_boundary"))
