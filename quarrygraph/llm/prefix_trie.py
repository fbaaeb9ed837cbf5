"""The prefix trie of conversations, built level by level.

A node of depth d is a sequence of d turns that some conversation begins with. Equal conversations are one class with a
weight. From the root down, each round groups the live classes by (parent node, next turn): a group is a node of the next
depth, named by its least conv_id. A node with one class left is the head of a chain of nodes with the same members, which
is written out at once; classes in it are no longer live. So there are as many rounds as the longest beginning that two
different conversations share. Then the levels are joined from the deepest up: children hand leaves and savings to parents.

Nothing is grouped into one row or task by a key that may be hot: turns are numbered from counts by range partition, sums
over chains go by blocks, and of the conversations that end in a node only packed ids in order pass through one task, which
a hash over all of them needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, written

#: Conversations whose shared turns come from the same one, and how many turns at most they take from it.
FAMILY, SHARED_PARTS = 20, 4
#: Turns of a chain summed as one block; ids packed into one row on their way to the hash of a node's ends.
BLOCK, PACK = 4096, 65_536
NO_ENDS = hashlib.sha256(b"").hexdigest()


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its family."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % SHARED_PARTS).cast("int")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, digest, words), written out; digest stands for role and text.

    The table is dealt by ranges of (conv_id, turn, digest), so a very long conversation spans many partitions; a turn's
    number is its place in the partition plus the turns that its conversation has in the partitions before.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = ["conv_id", "turn", "digest"]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.select("conv_id", "digest", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "trie-turns")
    heads = dealt.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select("conv_id", "part", (before - F.col("first") + 1).alias("shift"))
    return written(dealt.join(heads, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "digest", "words"), "trie-numbered")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, by depth in the files; and (conv_id) of all, those left without turns too."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("h", shared_turns(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    convs = written(convs, "trie-conversations")
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    plan = convs.join(sizes, "base", "left").withColumn("taken", F.least(F.col("h"), F.coalesce("there", F.lit(0))))
    first = turns.where(F.col("pos") < SHARED_PARTS).withColumnRenamed("conv_id", "base")
    shared = plan.select("conv_id", "base", "h").join(first, "base").where("pos <= h").select("conv_id", "pos", "digest", "words")
    rest = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "words")
    every = shared.unionByName(rest).repartitionByRange("pos", "conv_id").sortWithinPartitions("pos", "conv_id")
    return written(every, "trie-rebuilt"), convs.select("conv_id")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive ids of one class as text, at most PACK of them a row. In: n, a, b, conv_id, sorted."""
    names = ["n", "a", "b", "first", "count", "ids"]
    key, ids = None, []
    rows: list[tuple] = []

    def frame() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string())], names=names)

    def end() -> None:
        if ids:
            rows.append((*key, ids[0], len(ids), ",".join(map(str, ids))))
            ids.clear()

    for batch in batches:
        n, a, b, c = (batch.column(k).to_pylist() for k in range(4))
        for now, conv in zip(zip(n, a, b, strict=True), c, strict=True):
            if now != key or len(ids) >= PACK:
                end()
                key = now
                if len(rows) >= 1000 or rows and len(rows[-1][5]) > 200_000:
                    yield frame()
            ids.append(conv)
    end()
    if rows:
        yield frame()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a class: (rep, n, m, ends). In: n, a, b, first, count, ids, sorted."""
    key, rep, m, digest, rows = None, None, 0, None, []

    def frame() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["rep", "n", "m", "ends"])

    for batch in batches:
        for n, a, b, first, count, ids in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if (n, a, b) != key:
                if key is not None:
                    rows.append((rep, key[0], m, digest.hexdigest()))
                key, rep, m, digest = (n, a, b), first, 0, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
            m += count
        if rows:
            yield frame()
    if key is not None:
        rows.append((rep, key[0], m, digest.hexdigest()))
        yield frame()


def conversation_classes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(rep, n, m, ends): classes of equal conversations by two hashes of 64 bits over (place, digest) and their length n;
    rep is the least conv_id, m the number of conversations, ends the SHA-256 of their ids."""
    whole = turns.groupBy("conv_id").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("pos", "digest")).alias("a"), F.bit_xor(F.xxhash64("digest", "pos", F.lit(7))).alias("b")
    )
    by = ["n", "a", "b"]
    keyed = convs.join(whole, "conv_id", "left").select(*(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in by), "conv_id")
    packed = keyed.repartitionByRange(*by, "conv_id").sortWithinPartitions(*by, "conv_id").mapInArrow(_packed, "n long, a long, b long, first long, count long, ids string")
    return written(packed.repartition(*by).sortWithinPartitions(*by, "first").mapInArrow(_hashed, "rep long, n long, m long, ends string"), "trie-classes")


def chain_nodes(turns: DataFrame, alone: DataFrame) -> DataFrame:
    """All nodes of the chains alone(conv_id, n, m, ends, depth, parent): from depth to n, one below the other."""
    here = turns.join(alone, "conv_id").where("pos >= depth").withColumn("block", F.floor(F.col("pos") / BLOCK))
    many = here.where("m > 1")
    after = W.partitionBy("conv_id", "block").orderBy(F.col("pos").desc()).rowsBetween(W.unboundedPreceding, 0)
    later = W.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    blocks = many.groupBy("conv_id", "block").agg(F.sum("words").alias("sum")).select("conv_id", "block", F.coalesce(F.sum("sum").over(later), F.lit(0)).alias("later"))
    saved = many.withColumn("within", F.sum("words").over(after)).join(blocks, ["conv_id", "block"]).withColumn("saved", (F.col("m") - 1) * (F.col("within") + F.col("later")))
    single = here.where("m = 1").withColumn("saved", F.lit(0).cast("long"))
    last = F.col("pos") == F.col("n")
    return single.unionByName(saved.drop("within", "later")).select(
        "conv_id", F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("depth"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("m").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(NO_ENDS).alias("ends_sha256"), (F.col("pos") == F.col("depth")).alias("head"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations(conv_id, turn, role, text). Rows without conv_id belong to no conversation and are left out; null turns
    come first, equal turns by a digest of role and text; repeated rows are repeated turns. Null role or text is empty. A
    conversation may keep no turn and then ends in the root. An empty table has no node. Other columns are not looked at.
    """
    turns, convs = rebuilt_turns(numbered_turns(conversations))
    live = conversation_classes(turns, convs)
    live = live.withColumn("node", F.lit(live.agg(F.min("rep")).first()[0]).cast("long"))
    levels = [(live.groupBy("node").agg(F.sum("m").alias("n_convs")).withColumn("parent", F.lit(None).cast("long")).withColumn("words", F.lit(0).cast("long")))]
    ended, alone, depth = [live.where("n = 0").select("node", "ends")], [], 0
    while True:
        depth += 1
        step = turns.where(F.col("pos") == depth).select(F.col("conv_id").alias("rep"), "digest", "words")
        going = live.where(F.col("n") >= depth).join(step, "rep")
        key = ["node", "digest"]
        groups = going.groupBy(*key).agg(F.min("rep").alias("child"), F.sum("m").alias("n_convs"), F.count("*").alias("classes"), F.min("words").alias("words"))
        # a join that is cut at once: adaptive execution splits the classes of a very common turn over many tasks
        placed = written(going.drop("words").join(groups, key).select("rep", "n", "m", "ends", "node", "child", "n_convs", "classes", "words"), f"trie-level-{depth}")
        alone.append(placed.where("classes = 1").select(F.col("rep").alias("conv_id"), "n", "m", "ends", F.lit(depth).cast("long").alias("depth"), F.col("node").alias("parent")))
        live = placed.where("classes > 1").select("rep", "n", "m", "ends", F.col("child").alias("node"))
        if live.isEmpty():
            break
        levels.append(placed.where("classes > 1 AND rep = child").select(F.col("child").alias("node"), "n_convs", F.col("node").alias("parent"), "words"))
        ended.append(live.where(F.col("n") == depth).select("node", "ends"))

    heads = alone[0]
    for more in alone[1:]:
        heads = heads.unionByName(more)
    chains = written(chain_nodes(turns, heads), "trie-chains")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out, below = chains.select(columns), None
    for depth in range(len(levels) - 1, -1, -1):
        up = [F.col("parent_conv_id").alias("node"), "n_leaves", "saved_tokens"]
        children = chains.where(F.col("head") & (F.col("depth") == depth + 1)).select(up)
        children = children if below is None else children.unionByName(below.select(up))
        sums = children.groupBy("node").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        below = written(
            levels[depth].join(sums, "node", "left").join(ended[depth], "node", "left").select(
                F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n_convs").cast("long").alias("n_convs"),
                F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
                ((F.col("n_convs") - 1) * F.col("words") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
            ),
            f"trie-nodes-{depth}",
        )
        out = out.unionByName(below)
    return out
