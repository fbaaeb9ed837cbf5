"""Prefix trie, periodic runs and the language model against plain versions."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from conftest import SF

from quarrygraph.llm import periodic_runs, prefix_trie, recurrent_lm
from quarrygraph.llm.queries import TRIE_SQL, queries

TALK = "conv_id long, turn long, role string, text string, depth int, node string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- 11 ------------------------------------------------------------------------------------------------------------


def plain_trie(rows):
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0, digest(role or "", text or "")), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = (*own.get(c - int(math.fmod(c, 20)), [])[:h], *v[h:])
    members = collections.defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children = collections.defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    out = []

    def visit(key):
        leaves, saved = (0, 0) if children[key] else (1, 0)
        for k in children[key]:
            a, b = visit(k)
            leaves, saved = leaves + a, saved + b
        saved += (len(members[key]) - 1) * (len(WORD.findall(key[-1][1])) if key else 0)
        ends = sorted(c for c in members[key] if len(built[c]) == len(key))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(members[key]), len(key), min(members[key[:-1]]) if key else None, len(members[key]), len(children[key]), leaves, saved, sha))
        return leaves, saved

    if members:
        visit(())
    return sorted(out, key=str)


def trie_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names
    return sorted(map(tuple, df.collect()), key=str)


def talk(seed, convs=40):
    rng = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = rng.choice([rng.randrange(0, 45), rng.randrange(-30, 2000)])
        for k in range(rng.randrange(1, 7)):
            rows.append((c, rng.choice([k, k, k, None]), rng.choice(["user", "bot", None]), rng.choice(["hi", "a b", "", None, "x\ty z", "é ü"]), 1, "x"))
    return rows + [(None, 1, "user", "lost", 1, "x")] + rows[:3]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_on_odd_tables(spark, seed):
    rows = talk(seed)
    got = trie_rows(prefix_trie.prefix_trie(spark.createDataFrame(rows, TALK)))
    assert got == plain_trie(rows)
    con = duckdb.connect()
    frame = spark.createDataFrame(rows, TALK).select("conv_id", "turn", "role", "text").toArrow()  # noqa: F841
    con.execute("CREATE TABLE conversations AS SELECT * FROM frame")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(con.execute(f"SELECT {', '.join(names)} FROM ({TRIE_SQL})").fetchall(), key=str) == got


def test_trie_copies_and_long_chains(spark, monkeypatch):
    """Many copies of one long conversation; chains summed over several blocks; ids packed over several rows; ranges of turns."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "PACK", 3)
    rows = [(20 * c, k, "u", f"w{k} x", 0, "") for c in range(11) for k in range(17)] + [(7, k, "u", f"q{k}", 0, "") for k in range(60)]
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        got = trie_rows(prefix_trie.prefix_trie(spark.createDataFrame(rows, TALK).repartition(4)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert got == plain_trie(rows)


def test_trie_without_rows(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TALK)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "u", "x", 1, "")], TALK)).count() == 0


# --- 12 ------------------------------------------------------------------------------------------------------------


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                part = w[i : j + q]
                if not any(all(part[k] == part[k + p] for k in range(len(part) - p)) for p in range(1, q)):
                    out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = WORD.findall(text or "")
    h, n = None if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = None
    for s, m, q in runs:
        if best is None or m * best[2] > best[1] * q:
            best = (s, m, q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def spotted(seed):
    rng = random.Random(seed)
    n, v = rng.randint(0, 220), rng.choice([1, 2, 3, 5, 50])
    w = [rng.randrange(v) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        if n > 10:
            a, p, m = rng.randrange(n), rng.randint(1, 30), rng.randint(10, 120)
            for k in range(a + p, min(n, a + m)):
                w[k] = w[k - p]
    return w


@pytest.mark.parametrize("pairs,grid", [(0, 2), (50, 4), (4096, 16)])
def test_runs_of_random_words(monkeypatch, pairs, grid):
    """With all words heavy, some, and none; coarse and fine grids."""
    monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
    monkeypatch.setattr(periodic_runs, "GRID", grid)
    for seed in range(150):
        w = spotted(seed)
        most = len(w) // 3
        if most:
            count = periodic_runs.lag_matches(np.array(w), most)
            assert count.tolist()[1:] == [sum(w[i] == w[i + q] for i in range(len(w) - q)) for q in range(1, most + 1)]
        assert periodic_runs.runs_of(np.array(w, np.int32)) == plain_runs(w)


def test_periodic_runs_rows(spark):
    texts = [" ".join(map(str, spotted(k))) for k in range(120)] + ["", None, " \n", "a " * 100, "x", "A a " * 30, "日本 語 " * 40, "u v\x0bw　x " * 30]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(None, "b c " * 30, 1), (3, texts[3], 1), (3, "q r s " * 20, 1)]
    got = periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, start int"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((plain_digest(d, t) for d, t, _ in rows), key=str)
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_word_text_takes_one_scan():
    """A long text of one word, and of two words at random, stay far from quadratic work."""
    assert periodic_runs.runs_of(np.zeros(300_000, np.int32)) == [(0, 300_000, 1)]
    periodic_runs.runs_of(np.random.default_rng(0).integers(0, 2, 100_000).astype(np.int32))


# --- 13 ------------------------------------------------------------------------------------------------------------


def plain_base(rows):
    split = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + [None]
    count = collections.Counter()
    for d, t, *_ in rows:
        if d is not None and zlib.crc32(str(d).encode()) % 7 != 2:
            count.update(split(t))
    total, types = sum(count.values()), len(count)
    out = []
    for d, t, *_ in rows:
        w = split(t)
        held = d is not None and zlib.crc32(str(d).encode()) % 7 == 2
        out.append((d, held, len(w), sum(count[x] > 0 for x in w), total, round(sum(math.log10((count[x] + 1) / (total + types + 1)) for x in w), 6)))
    return sorted(out, key=str)


def based(df):
    rows = df.collect()
    assert df.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=str)


@pytest.mark.parametrize("frequent", [1 << 20, 6, 0])
def test_lm_counts_frequent_and_joined(spark, monkeypatch, frequent):
    """All counts known to tasks, a few, none but the end's: the join gives the same."""
    monkeypatch.setattr(recurrent_lm, "FREQUENT", frequent)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "The", "of", "a", "rare%d" % rng.randrange(60), "été", "日本"]) for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    rows = [(k, t, 1.0) for k, t in enumerate([*texts, "", None, " \t", "word"])] + [(None, "no id", 1.0), (5, texts[5], 1.0), (5, "other", 1.0)]
    got = recurrent_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string, score double"))
    assert based(got) == plain_base(rows)


def test_lm_without_training_rows(spark):
    assert recurrent_lm.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    r = recurrent_lm.score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()[0]
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


def network(seed=0, words=200):
    rng = np.random.default_rng(seed)
    h = np.sort(np.append(rng.integers(0, 2**63, words - 1, dtype=np.uint64), recurrent_lm.END))
    shape = recurrent_lm.Shape(h, rng.integers(1, 500, words), 70_000, 5000)
    return shape, shape.start() + rng.normal(0, 0.2, len(shape.start())).astype(np.float32)


def test_probabilities_add_up_to_one():
    shape, flat = network()
    state = np.random.default_rng(1).normal(0, 0.5, (3, recurrent_lm.STATE)).astype(np.float32)
    for row in state:
        every = np.exp(recurrent_lm.likelihood(shape.split(flat), shape, np.repeat(row[None], shape.size + 1, 0), np.arange(shape.size + 1)))
        assert abs(every.sum() - 1) < 1e-4


def test_state_runs_through_whole_documents(monkeypatch):
    """All documents side by side, settled in small parts, equal each one token by token."""
    monkeypatch.setattr(recurrent_lm, "ROWS", 7)
    shape, flat = network()
    p, rng = shape.split(flat), np.random.default_rng(2)
    size = [1, 90, 3, 1, 40]
    begins = np.concatenate([[0], np.cumsum(size)])
    ids = rng.integers(0, shape.size + 1, begins[-1]).astype(np.uint16)
    got = recurrent_lm.document_likelihoods(p, shape, ids, begins)
    for a, b, g in zip(begins[:-1], begins[1:], got):
        h, before, want = np.zeros((1, recurrent_lm.STATE), np.float32), shape.end, 0.0
        for t in ids[a:b].astype(int):
            x = p["E"][before] @ p["W"] + p["b"]
            s = recurrent_lm.STATE
            u = (h @ p["U"])[0]
            z, r = (1 / (1 + np.exp(-(x[k * s : k * s + s] + u[k * s : k * s + s]))) for k in (0, 1))
            n = np.tanh(x[2 * s :] + r * u[2 * s :])
            h = (n + z * (h[0] - n))[None]
            want += float(recurrent_lm.likelihood(p, shape, h, np.array([t]))[0])
            before = t
        assert abs(g - want) < 1e-3 * max(1, abs(want))


def test_gradient_by_differences():
    shape, flat = network(words=30)
    rng = np.random.default_rng(3)
    flat = flat.astype(np.float64)
    inputs, target = rng.integers(0, shape.size + 1, (5, 4)), rng.integers(0, shape.size + 1, (5, 4))
    fresh = inputs == shape.end
    fresh[2, 1] = True

    def loss(f):
        p, h, total = shape.split(f), np.zeros((4, recurrent_lm.STATE)), 0.0
        for t in range(5):
            h = recurrent_lm.step((p["E"] @ p["W"] + p["b"])[inputs[t]], h * (~fresh[t])[:, None], p["U"])[0]
            total -= recurrent_lm.likelihood(p, shape, h, target[t]).sum()
        return total / 20

    g, _ = recurrent_lm.gradient(shape.split(flat), shape, inputs, target, fresh, np.zeros((4, recurrent_lm.STATE)))
    g = np.concatenate([x.ravel() for x in g.values()])
    for k in rng.choice(np.flatnonzero(np.abs(g) > 1e-4), 40):
        e = np.zeros_like(flat)
        e[k] = 1e-5
        assert abs((loss(flat + e) - loss(flat - e)) / 2e-5 - g[k]) < 1e-3 * abs(g[k]) + 1e-6


def test_a_column_a_lane_gives_what_a_row_a_lane_gives():
    """States, gates and logits lie a row a feature, so that work for all lanes goes along memory."""
    shape, flat = network()
    p, rng = shape.split(flat.astype(np.float64)), np.random.default_rng(5)
    h, gates = rng.uniform(-1, 1, (6, recurrent_lm.STATE)), rng.normal(0, 3, (6, 3 * recurrent_lm.STATE))
    new, zr, n, an = recurrent_lm.move(recurrent_lm.halved(gates.T), h.T, recurrent_lm.halved(p["U"].T))
    a, s = h @ p["U"], recurrent_lm.STATE
    z, r = (1 / (1 + np.exp(-(gates + a)[:, k * s : k * s + s])) for k in (0, 1))
    want = np.tanh(gates[:, 2 * s :] + r * a[:, 2 * s :])
    assert np.allclose(new.T, want + z * (h - want)) and np.allclose(zr.T, np.hstack([z, r])) and np.allclose(n.T, want) and np.allclose(an.T, a[:, 2 * s :])
    target = np.array([0, shape.size, 3, shape.size - 1, 3, 7])
    assert np.allclose(recurrent_lm.likelihoods(p, shape, h.T, target), recurrent_lm.likelihood(p, shape, h, target))
    huge = recurrent_lm.shares(np.full((2, s), 50.0, np.float32), np.zeros(2, np.float32), np.ones((s, 1), np.float32))
    assert np.isfinite(huge).all()


def test_places_of_hashes():
    rng, top = np.random.default_rng(6), 2**64 - 1
    for words in (0, 1, 300, 5000):
        h = np.unique(np.append(rng.integers(0, 2**60 if words == 300 else top, words, dtype=np.uint64), np.array([0, top], np.uint64)[: words // 300]))
        asked = np.concatenate([h, rng.integers(0, top, 500, dtype=np.uint64), np.array([0, 1, top - 1, top], np.uint64)])
        at = {int(x): k for k, x in enumerate(h)}
        assert recurrent_lm.Places(h).find(asked).tolist() == [at.get(int(x), len(h)) for x in asked]
    shape = recurrent_lm.Shape(np.sort(rng.integers(0, top, 3000, dtype=np.uint64)), rng.integers(1, 500, 3000), 2_000_000, 5000).index()
    asked = np.append(shape.hashes, np.uint64(5))
    assert shape.numbers(asked).tolist() == [*shape.number[:-1].tolist(), shape.size]


def test_small_batches_are_put_together():
    """Each of them would take as many steps as its longest text has words."""
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array(["x" * 40])], names=["k", "text"]) for k in range(7)]
    got = list(recurrent_lm.gathered(iter(batches), 1, 100))
    assert [k for b in got for k in b.column(0).to_pylist()] == list(range(7)) and [b.num_rows for b in got] == [3, 3, 1]


def test_training_is_the_same_whatever_the_size(spark, monkeypatch):
    """All training documents take part, each once, in a corpus that counts as small and in one that counts as huge."""
    kept, own = [], recurrent_lm.written
    monkeypatch.setattr(recurrent_lm, "written", lambda df, name: kept.append(own(df, name)) or kept[-1])
    shape, _ = network()
    docs = spark.createDataFrame([(k, "a few words of document %d" % k) for k in range(300)], "doc_id long, text string").coalesce(1)
    small, huge = recurrent_lm.trained(docs, shape, 5_000), recurrent_lm.trained(docs, shape, 10**10)
    want = sum(zlib.crc32(str(k).encode()) % 7 != 2 for k in range(300))
    assert [df.count() for df in kept] == [want, want]
    assert np.allclose(small, huge, atol=1e-6)


def test_held_out_texts_are_likelier_than_by_counts(spark):
    rows = queries()["op13_lm_scoring"](spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
