"""Persistence of a metric against plain versions."""

from __future__ import annotations

import random

from quarrygraph.operators import topology


def plain_labels(nodes, links):
    """The least node each reaches."""
    label = {n: n for n in nodes}
    change = True
    while change:
        change = False
        for a, b in links:
            low = min(label[a], label[b])
            change |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def plain_persistence(nodes, distances):
    """Labels at each stage, and each node's death."""
    stages = [plain_labels(nodes, [])] + [plain_labels(nodes, [(a, b) for a, b, d in distances if d <= most]) for most in sorted({d for *_, d in distances})]
    return stages, {n: next((k for k, label in enumerate(stages) if label[n] != n), None) for n in nodes}


def scattered(seed, n, links, steps):
    rng = random.Random(seed)
    return [(a, b, rng.randrange(steps) / 4) for a, b in {tuple(sorted(rng.sample(range(n), 2))) for _ in range(links)}]


def test_a_tree_as_deep_as_its_points(spark):
    """Merges one after another, over two levels of ranges."""
    pairs = [(k, k + 1, 10 - k) for k in range(10)]
    forest = spark.createDataFrame(pairs, "i long, j long, stage long")
    assert {r.node: r.death for r in topology.deaths(forest, 10).collect()} == {k: d for k, d in plain_persistence(range(11), pairs)[1].items() if d}


def test_intervals_and_clusters(spark):
    n, pairs = 25, scattered(2, 25, 34, 8)
    points, d = spark.createDataFrame([(k, f"p.C{k:02}.m") for k in range(n)], "node long, fqn string"), spark.createDataFrame(pairs, "i long, j long, d double")
    stages, died = plain_persistence(range(n), pairs)
    last, life = len(stages) - 1, {k: len(stages) if v is None else v for k, v in died.items()}
    tree = topology.MergeTree(points, d)
    assert tree.last == last and {tuple(r) for r in tree.intervals().collect()} == {(k, 0, died[k], life[k]) for k in range(n)}
    counts = [len(set(label.values())) for label in stages]
    assert {r.stage: r.components for r in tree.counts().collect()} == {k: c for k, c in enumerate(counts) if k == 0 or c != counts[k - 1]}
    cuts = {m: max((k for k, c in enumerate(counts) if c == sum(v >= m for v in life.values())), default=last) for m in (0, 1, 2, 4, last, last + 1, last + 2)}
    assert {m: tree.cut_stage(m) for m in cuts} == cuts
    want = {(root, k, life[root], round(min(1.0, life[root] / last), 9)) for k, root in stages[cuts[2]].items() if life[root] >= 2}
    assert {(r.component, r.node, r.lifetime, round(r.confidence, 9)) for r in tree.members(2).collect()} == want
