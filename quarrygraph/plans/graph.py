"""Iterative plans over edge tables: bounded search, closure, components, cycles.

Every round is one join of a frontier with the edges and one anti join against what was seen, cut at the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarrygraph.session import keep


#: Rows up to which a counted frontier is broadcast, so that edges meet it where they are read; up to LISTED they are first
#: filtered by a list of its nodes, which files can skip by.
FEW, LISTED = 100_000, 2_000


def search(edges: DataFrame, start: DataFrame, max_depth: int, reverse: bool = False, stored: bool = False) -> tuple[DataFrame, bool]:
    """Breadth-first search. (node, depth) with the shortest depth, the start at 0; whether it ended before max_depth.

    edges(src, dst); start(node). stored: the edges lie in files, so rounds read those and no copy is made.
    """
    from_, to = ("dst", "src") if reverse else ("src", "dst")
    step = edges.select(F.col(from_).alias("node"), F.col(to).alias("next"))
    if not stored:
        step = keep(step.distinct()) if max_depth > 1 else step.distinct()  # else each round would derive the edges again
    seen = keep(start.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier, rows, exhausted = seen, seen.count(), False
    for depth in range(1, max_depth + 1):
        near, ways = F.broadcast(frontier) if rows <= FEW else frontier, step
        if rows <= LISTED:
            ways = step.where(F.col("node").isin([r.node for r in frontier.select("node").collect()]))
        new = near.join(ways, "node").select(F.col("next").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier = keep(new.withColumn("depth", F.lit(depth)))
        rows = frontier.count()
        if not rows:
            exhausted = True
            break
        seen = seen.unionByName(frontier)
    return seen, exhausted


def closure(edges: DataFrame, starts: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(start, node) for all nodes reachable from each start, itself included.

    starts(node), or starts(node, start) where several nodes go by one name.
    """
    step = keep(edges.select("src", "dst").distinct())
    name = F.col("start") if "start" in starts.columns else F.col("node")
    seen = keep(starts.select(name.alias("start"), "node").distinct())
    frontier, k = seen, 0
    while max_rounds is None or k < max_rounds:
        k += 1
        new = frontier.join(step, frontier["node"] == step["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier = keep(new.join(seen, ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if k % 4 == 0:
            seen = keep(seen)
    return seen


#: Keys with more than this share of all rows are hot, so there are at most its inverse of them.
HOT_SHARE, HOT_LEAST = 1 / 200, 1000


def join_hot(big: DataFrame, small: DataFrame, key: str, rows: int) -> DataFrame:
    """big joined with small(key, m, d) on key, without d. d: rows of big with this key, at most ``rows`` together.

    What few keys have a large share of all rows is known from the counts; those are broadcast (1 / HOT_SHARE rows at most),
    so that no task gets all rows of one of them. small must be written out.
    """
    hot = small.where(F.col("d") > max(HOT_LEAST, rows * HOT_SHARE)).drop("d").collect()
    small = small.drop("d")
    if not hot:
        return big.join(small, key)
    held = F.broadcast(big.sparkSession.createDataFrame(hot, small.schema))
    return big.join(held, key).unionByName(big.join(held.select(key), key, "left_anti").join(small, key))


def connected(links: DataFrame, a: str = "src", b: str = "dst", stored: bool = False) -> DataFrame:
    """(id, component) for each id that reaches a lesser one; the component is the least id reachable.

    Alternates large-star and small-star steps: two aggregations with map-side combining and two joins in which ids with very
    many links are handled apart. Rounds: about the logarithm of the longest chain. Null ends and links of an id with itself
    are left out. stored: the links lie in files, so the first round reads those; each pair need not be told apart before it.
    """
    able = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    if isinstance(links.schema[a].dataType, StringType):
        return _connected_texts(links.where(able).select(F.col(a).alias("src"), F.col(b).alias("dst")), stored)
    pairs, before = links.where(able).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")), None
    pairs = pairs if stored else keep(pairs.distinct())
    while True:
        if before is None and stored:
            now = (pairs.count(),)
        else:
            now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if not now[0] or now == before:
            break
        before = now
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(pairs.select("lo", "hi"))
        least = keep(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")).select("u", F.least("u", "m").alias("m"), "d"))
        above = pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v"))  # of both, those with v > u
        large = keep(join_hot(above, least, "u", 2 * now[0]).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        down = keep(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("d")))
        small = join_hot(large, down, "hi", now[0]).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        pairs = keep(small.unionAll(down.select("hi", F.col("m").alias("lo"))).distinct())
    return pairs.select(F.col("hi").alias("id"), F.col("lo").alias("component"))


def _connected_texts(links: DataFrame, stored: bool) -> DataFrame:
    """connected for texts: by numbers that stand for them, since for the least of texts all links would be sorted each time.

    The numbers are hashes; all ids are counted against them, and another seed is taken until none share one.
    """
    links = links if stored else keep(links.distinct())
    ids = keep(links.select(F.col("src").alias("id")).distinct().unionAll(links.select("dst").distinct()).distinct())
    rows, seed = ids.count(), 0
    while ids.select(_number("id", seed).alias("n")).distinct().count() < rows:
        seed += 1
    found = _by_forest(links.select(_number("src", seed).alias("src"), _number("dst", seed).alias("dst")))
    home = ids.select("id", _number("id", seed).alias("n")).join(found.withColumnRenamed("id", "n"), "n", "left")
    home = keep(home.select("id", F.coalesce("component", "n").alias("of")))
    least = keep(home.groupBy("of").agg(F.min("id").alias("component"), F.count("*").alias("d")))
    return join_hot(home, least, "of", rows).where("id <> component").select("id", "component")


def _by_forest(links: DataFrame) -> DataFrame:
    """(id, component) of all ends; a component has one name, not its least. links(src, dst) lie in files.

    First each id with its least and greatest neighbour alone: two rows an id, however many links. Then only links with an end
    outside the largest of the components so found can join others.
    """
    both = links.select(F.col("src").alias("id"), F.col("dst").alias("v")).unionAll(links.select("dst", "src"))
    ends = keep(both.groupBy("id").agg(F.min("v").alias("lo"), F.max("v").alias("hi")))
    first = connected(ends.select(F.col("id").alias("src"), F.explode(F.array("lo", "hi")).alias("dst")))
    home = keep(ends.select("id").join(first, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    largest = home.groupBy("component").count().orderBy(F.col("count").desc(), "component").first()
    apart = keep(home.where(F.col("component") != (largest.component if largest else None)))
    rows = apart.count()
    if not rows:
        return home
    near = F.broadcast(apart) if rows <= FEW else apart
    marked = links.join(near.select(F.col("id").alias("src"), F.col("component").alias("a")), "src", "left").join(near.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst", "left")
    rest = marked.where("a IS NOT NULL OR b IS NOT NULL").select(F.coalesce("a", F.lit(largest.component)).alias("src"), F.coalesce("b", F.lit(largest.component)).alias("dst"))
    more = connected(rest).select(F.col("id").alias("component"), F.col("component").alias("into"))
    moved = more.where(F.col("component") == largest.component).first()
    inner = home.where(F.col("component") == largest.component).select("id", F.lit(moved.into if moved else largest.component).alias("component"))
    return inner.unionByName(apart.join(more, "component", "left").select("id", F.coalesce("into", "component").alias("component")))


def _number(column: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), column)


def components(nodes: DataFrame, edges: DataFrame, stored: bool = False) -> DataFrame:
    """(node, component) of all nodes, isolated ones too, ignoring direction. stored: the edges lie in files."""
    linked = connected(edges, stored=stored).withColumnRenamed("id", "node")
    return nodes.select("node").distinct().join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def hop_distances(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(i, j, d) for all connected i <> j, hops ignoring direction."""
    step = keep(edges.select("src", "dst").unionAll(edges.select("dst", "src")).where("src <> dst").distinct())
    seen = keep(nodes.select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(0).alias("d")).distinct())
    frontier, d = seen, 0
    while True:
        d += 1
        new = frontier.join(step, frontier["j"] == step["src"]).select("i", F.col("dst").alias("j")).distinct()
        frontier = keep(new.join(seen.select("i", "j"), ["i", "j"], "left_anti").withColumn("d", F.lit(d)))
        if frontier.isEmpty():
            return seen.where("d > 0")
        seen = keep(seen.unionByName(frontier))


def cycles(edges: DataFrame, most: int | None = 10, longest: int = 20) -> DataFrame:
    """Simple cycles as ``path`` arrays that begin with their least node, shortest first, then by path; at most ``most`` of length
    up to ``longest``.

    Only edges within strong components are walked. Cycles of a length are closed by a join of the paths' ends with edges to
    their starts, before paths are made longer; when ``most`` are found no longer ones are looked for.
    """
    from .condense import strong_components

    step = keep(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    home = keep(strong_components(step))
    a, b = home.withColumnsRenamed({"node": "src", "component": "a"}), home.withColumnsRenamed({"node": "dst", "component": "b"})
    inner = keep(step.join(a, "src").join(b, "dst").where("a = b").select("src", "dst"))
    found = inner.where("src = dst").select(F.array("src").alias("path"))
    loops, inner = found.count(), keep(inner.where("src <> dst"))
    # paths of different nodes, none less than the first; last: where they end
    paths, have = inner.where("dst > src").select(F.array("src", "dst").alias("path"), F.col("src").alias("first"), F.col("dst").alias("last")), loops
    for size in range(2, longest + 1):
        if most is not None and have >= most:
            break
        paths = keep(paths)
        if paths.isEmpty():
            break
        ends = inner.select(F.col("src").alias("last"), F.col("dst").alias("first"))
        closed = keep(paths.join(ends, ["last", "first"], "left_semi").select("path"))
        found, have = found.unionAll(closed), have + closed.count()
        if size < longest:
            grown = paths.join(inner.select(F.col("src").alias("last"), F.col("dst").alias("next")), "last").where((F.col("next") > F.col("first")) & ~F.array_contains("path", F.col("next")))
            paths = grown.select(F.concat("path", F.array("next")).alias("path"), "first", F.col("next").alias("last"))
    out = found.orderBy(F.size("path"), "path")
    return out.limit(most) if most is not None else out
