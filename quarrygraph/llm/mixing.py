"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target in words. Whole copies of all its documents come first; what is left of the target is a budget
that whole documents are chosen to fill: documents are counted by exact length, the same share of each length is taken of
all but the last RESERVE words, and a bounded-knapsack program over the lengths still left closes the rest; the last
documents of very great lengths are left to it where shares would leave a gap. Which documents
of a length are taken follows a seeded hash, so reruns agree: those up to a key that is found for each source and length
from counts alone, so that texts are neither shuffled nor ranked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, let_go, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Words of a budget that are left to the knapsack program, and units that it reckons in at most.
RESERVE, PROGRAM = 1 << 15, 1 << 16
#: Documents of more than LONG words are chosen anew, UNDONE of a length at most, where shares leave a gap.
LONG, UNDONE = 1 << 12, 8
#: Bits of a document's 63-bit key by which documents of one (source, length) are counted at a time, from the first on.
KEY_BITS, LEVELS = 8, 2


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Target by source: share * all sizes dealt by weight, none above most * its size; the excess is dealt again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    budget, capped, free = share * sum(sizes.values()), {}, list(order)
    while free:
        total = sum(weight[s] for s in free)
        dealt = {s: budget * weight[s] / total for s in free}
        above = [s for s in free if dealt[s] > most * sizes[s]]
        if not above:
            return capped | dealt
        for s in above:
            capped[s] = most * sizes[s]
            budget -= capped[s]
        free = [s for s in free if s not in capped]
    return capped


def program(lengths: np.ndarray, left: np.ndarray, rest: int) -> np.ndarray:
    """How many of each length to take so that the sum is as near below rest as a bounded subset sum gets.

    Sums are reckoned in units of so many words that there are PROGRAM of them at most, lengths rounded up to units: a sum is
    never above rest, and below the best one by less than a unit for each document. With a rest of up to PROGRAM it is exact.
    """
    take, unit = np.zeros_like(left), max(1, -(-rest // PROGRAM))
    goal, sizes = rest // unit, -(-lengths // unit)
    # counts as powers of two; reached[s] is the first item with which s can be reached
    reached = np.full(goal + 1, -1, np.int64)
    sums, items, mask = 1, [], (1 << (goal + 1)) - 1
    for k in np.random.default_rng(0).permutation(len(lengths)):
        size, n, power = int(sizes[k]), int(min(left[k], goal // max(int(sizes[k]), 1))), 1
        if not 0 < size <= goal:
            continue
        while n > 0 and not sums >> goal & 1:
            m = min(power, n)
            new = (sums << (size * m)) & mask & ~sums
            if new:
                at = np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes(goal // 8 + 1, "little"), np.uint8), bitorder="little"))
                reached[at] = len(items)
                items.append((k, m, size * m))
                sums |= new
            n -= m
            power *= 2
    at = sums.bit_length() - 1
    while at > 0:
        k, m, size = items[reached[at]]
        take[k] += m
        at -= size
    return take


def closed(lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, budget: int) -> np.ndarray:
    """take with what the program adds to it, in finer and finer units, until nothing fits any more."""
    take = take.copy()
    while rest := budget - int((take * lengths).sum()):
        more = program(lengths, counts - take, rest)
        if not more.any():
            break
        take += more
    return take


def fit_subset(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum is near below budget, about the same share of each.

    The same share is taken of every length but for RESERVE words of the budget, which the program closes. Where that leaves a
    gap, up to UNDONE documents of each length above LONG words are given back and chosen by the program too, and the nearer
    result counts. Time and memory are bounded by the number of different lengths and PROGRAM, whatever counts and lengths are.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    # integer arithmetic in Python: the products may pass 64 bits
    shared = max(int(budget) - RESERVE, 0)
    shares = np.array([int(c) * shared // total for c in counts], np.int64)
    take, rest = shares.copy(), int(budget - (shares * lengths).sum())
    # what the rounding of shares left open, by the longest documents that fit
    for k in np.argsort(-lengths, kind="stable"):
        if rest <= PROGRAM:
            break
        if n := min(int(counts[k] - take[k]), (rest - RESERVE) // int(lengths[k]) if lengths[k] else 0):
            take[k] += n
            rest -= n * int(lengths[k])
    best = closed(lengths, counts, take, budget)
    gap = budget - int((best * lengths).sum())
    given = np.where(lengths > LONG, np.minimum(shares, UNDONE), 0)
    if gap and (lengths > LONG).any():
        other = closed(lengths, counts, shares - given, budget)
        if budget - int((other * lengths).sum()) < gap:
            return other
    return best


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """docs with added columns size, source_size, target and taken (words that the mix takes, repeats counted).

    Size is the number of words; null text has none. taken is 0, size, or size times the whole copies, never above
    ceil(most) times size. Null source is a source, last in order. Rows of one source that agree in doc_id and text are taken
    or left together. Empty table: empty result. Columns of docs that clash with the added ones are replaced. Two passes over
    the texts, which are not shuffled as long as the plan (a row for each source and length) is below Spark's limit for
    broadcasts, else once.
    """
    added = ("size", "source_size", "target", "taken")
    keep = [c for c in docs.columns if c.lower() not in added]
    # own columns carry a prefix, so that no column of docs can clash with them
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 1)
    sized = docs.select(*keep, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_q_words"), key.alias("_q_key"))
    slim = cut(sized.select("source", F.col("_q_words").alias("size"), F.col("_q_key").alias("key")))
    plan = written(chosen(slim, weights, share, most).withColumnsRenamed({c: f"_q_{c}" for c in ("source", "size", "source_size", "target", "copies", "last")}), "mix-plan")
    out = sized.join(plan, F.col("source").eqNullSafe(F.col("_q_source")) & (F.col("_q_words") == F.col("_q_size")))
    taken = (F.col("_q_copies") + (F.col("_q_key") <= F.col("_q_last")).cast("int")) * F.col("_q_words")
    return out.select(*keep, F.col("_q_words").alias("size"), F.col("_q_source_size").alias("source_size"), F.col("_q_target").alias("target"), taken.cast("long").alias("taken"))


def chosen(slim: DataFrame, weights, share: float, most: float) -> DataFrame:
    """By (source, size): source_size, target, copies of all, and the last key of those taken once more (-1: none)."""
    counts = cut(slim.groupBy("source", "size").agg(F.count("*").alias("n")))
    totals = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = targets({r.source: int(r.source_size) for r in totals.toLocalIterator()}, weights, share, most)
    goals = slim.sparkSession.createDataFrame([(s, float(t)) for s, t in goal.items()], "s string, target double")
    totals = totals.join(goals, F.col("source").eqNullSafe(F.col("s"))).select("s", "source_size", "target")
    hist = counts.join(totals, F.col("source").eqNullSafe(F.col("s"))).drop("s")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        let_go()
        pdf = pdf.sort_values("size").reset_index(drop=True)
        size, goal = int(pdf.source_size[0]), float(pdf.target[0])
        copies = int(goal // size) if size else 0
        take = fit_subset(pdf["size"].to_numpy(), pdf["n"].to_numpy(), round(goal - copies * size))
        return pdf.assign(copies=copies, take=take)[["source", "size", "source_size", "target", "copies", "take", "n"]]

    plan = cut(hist.groupBy("source").applyInPandas(fit, "source string, size long, source_size long, target double, copies int, take long, n long"))
    # the bin of leading bits in which the last one taken lies, bin by bin, then its place in the last bin
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    open_ = written(plan.where("take > 0 AND take < n").select(F.col("source").alias("s"), F.col("size").alias("z"), F.lit(0).cast("long").alias("bin"), F.col("take").alias("place")), "mix-open")
    for level in range(1, LEVELS + 1):
        kept, shift = 63 - KEY_BITS * (level - 1), 63 - KEY_BITS * level
        asked = slim.join(open_, same & (F.shiftright("key", kept) == F.col("bin"))) if level > 1 else slim.join(open_, same)
        bins = asked.groupBy("source", "size", "place", F.shiftright("key", shift).alias("b")).agg(F.count("*").alias("n"))
        upto = bins.withColumn("upto", F.sum("n").over(W.partitionBy("source", "size").orderBy("b")))
        hit = upto.where("upto >= place AND upto - n < place")
        open_ = written(hit.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("b").alias("bin"), (F.col("place") - F.col("upto") + F.col("n")).alias("place")), "mix-bins")
    within = slim.join(open_, same & (F.shiftright("key", 63 - KEY_BITS * LEVELS) == F.col("bin"))).withColumn("k", F.row_number().over(W.partitionBy("source", "size").orderBy("key")))
    last = within.where("k = place").select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("key").alias("last_key"))
    end = F.when(F.col("take") >= F.col("n"), F.lit(2**63 - 1)).otherwise(F.coalesce("last_key", F.lit(-1))).cast("long")
    return plan.join(last, same, "left").select("source", "size", "source_size", "target", "copies", end.alias("last"))
