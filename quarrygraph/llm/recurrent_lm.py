"""A gated recurrent language model over words, with a class-factored softmax.

Words of all training documents are counted by Spark; words are known by 64-bit hashes. The most frequent ones get an input
and an output of the network; classes of the output layer hold words of like frequency. All other words are one more class,
within which a word's probability follows its count, so every text has a probability and those of all words add up to one.
Output biases start at the logarithms of the counts, so training starts from a unigram model.

Training runs where the data is: in each round every task walks over its documents of that round with truncated
backpropagation (windows of WINDOW tokens, the state carried from window to window, cleared where a document begins), and the
weights of all tasks are averaged by tokens. Every training document takes part once, in the round that a hash of its doc_id
says, whatever the size of the corpus.

A score is the log-likelihood of a whole document: its state goes on from window to window to its end.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let_go, sliced, text_bytes, worker_cache, written
from .wordhash import hash_words

HELD_OUT_PARTS, HELD_OUT = 7, 2
#: Hash of the token that ends a document.
END = np.uint64(0x51AB1E0DD5EED5E7)
END_KEY = int(END.view(np.int64))
#: Words whose counts every task knows; the counts of all rarer words are joined.
FREQUENT = 1 << 20
#: Words of the network, most of a class, and the sizes of inputs and state.
VOCABULARY, CLASS_MOST, INPUTS, STATE = 2048, 64, 16, 24
#: Training: rounds, tokens of a window, most lanes side by side (a stream is at least 64 windows long), tokens of a stream.
ROUNDS, WINDOW, LANES, STREAM = 4, 32, 512, 2_000_000
RATE = (0.012, 0.008, 0.005, 0.003)
#: Bytes of text and tokens of the output layer that are worked on together when scoring.
SLICE, ROWS = 12_000_000, 16_384


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_PARTS


# --- counts ----------------------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): hash and count of every token of the training documents, written out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in sliced(batches, 0):
            h, _ = hash_words(text_bytes(batch.column(0)))
            word, n = np.unique(h, return_counts=True)
            word, n = np.append(word, END), np.append(n, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "c"])

    trained = docs.where(remainder(F.col("doc_id")) != HELD_OUT).select("text")
    return written(trained.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "lm-counts")


def frequent_words(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes (sorted) and counts of the end and of the words of at least the third value's count, the lowest that leaves
    FREQUENT of them at most. What is collected is bounded by FREQUENT words and some thousand histogram rows."""
    c = F.col("c")
    bucket = F.when(c < 1024, c).otherwise(1024 + F.floor(F.log2(c / 1024) * 64)).alias("bucket")
    steps = counts.groupBy(bucket).agg(F.count("*").alias("words"), F.min("c").alias("least")).collect()
    have, least = 0, None
    for s in sorted(steps, key=lambda s: -s.bucket):
        have += s.words
        if have > FREQUENT:
            break
        least = s.least
    least = least or 1 << 62  # none, or more than FREQUENT words share the highest bucket
    table = counts.where((c >= least) | (F.col("h") == END_KEY)).toArrow()
    h, n = table["h"].to_numpy().view(np.uint64), table["c"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order], least


# --- the network -----------------------------------------------------------------------------------------------------


class Places:
    """Places of hashes among sorted ones, by a table of where the hashes with each beginning are."""

    def __init__(self, hashes: np.ndarray) -> None:
        bits = max(1, (2 * len(hashes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.hashes = np.append(hashes, np.uint64(2**64 - 1))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash; their number for those that are not there."""
        place = self.starts.take((h >> self.shift).astype(np.int64))
        late = np.flatnonzero(self.hashes.take(place) < h)
        while len(late):
            place[late] += 1
            late = late[self.hashes[place[late]] < h[late]]
        place[self.hashes.take(place) != h] = len(self.hashes) - 1
        return place


class Shape:
    """The vocabulary: per frequent word its network number (VOCABULARY's end for all others), classes and start biases."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, types: int) -> None:
        self.hashes, self.counts = hashes, counts
        best = np.lexsort((hashes, -counts))[:VOCABULARY]
        if len(hashes) and END not in hashes[best]:
            best = np.append(best[: VOCABULARY - 1], np.searchsorted(hashes, END))
        self.size = len(best)
        self.number = np.full(len(hashes) + 1, self.size, np.uint16)  # one more entry: words that are not frequent
        self.number[best] = np.arange(self.size)
        self.end = int(self.number[np.searchsorted(hashes, END)]) if len(hashes) else self.size
        weight = np.sqrt(counts[best].astype(float))
        klass, first = np.zeros(self.size, np.int64), [0]
        bins = max(1.0, self.size / CLASS_MOST * 1.5)
        share = np.cumsum(weight) / max(weight.sum(), 1) * bins
        for k in range(1, self.size):
            if k - first[-1] >= CLASS_MOST or int(share[k]) > int(share[first[-1]]):
                first.append(k)
        for j, a in enumerate(first):
            klass[a:] = j
        self.first = np.array([*first, self.size] if self.size else [0], np.int64)
        self.classes = len(self.first) - 1
        self.klass = np.append(klass, self.classes)
        known = int(counts[best].sum())
        #: what the counts of all words outside the vocabulary, each and an unseen one more, add up to
        self.others = total - known + types - self.size + 1
        count = np.append(counts[best], self.others).astype(float)
        per_class = np.bincount(self.klass, count, self.classes + 1)
        self.class_bias = np.log(per_class / per_class.sum())
        self.word_bias = np.log(count[:-1] / per_class[self.klass[:-1]])
        v, c = self.size + 1, self.classes + 1
        self.parts = {"E": (v, INPUTS), "W": (INPUTS, 3 * STATE), "b": (3 * STATE,), "U": (STATE, 3 * STATE), "C": (STATE, c), "cb": (c,), "O": (self.size, STATE), "ob": (self.size,)}

    def start(self) -> np.ndarray:
        rng = np.random.default_rng(13)
        at = {k: rng.normal(0, 0.1 if k in "EW" else 0.2 if k == "U" else 0.0, s) for k, s in self.parts.items()}
        at["cb"], at["ob"] = self.class_bias, self.word_bias
        return np.concatenate([x.ravel() for x in at.values()]).astype(np.float32)

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, s in self.parts.items():
            n = math.prod(s)
            out[k] = flat[at : at + n].reshape(s)
            at += n
        return out

    def index(self) -> Shape:
        """With what a worker looks words up by: all frequent ones, and those of the network alone."""
        own = np.flatnonzero(self.number[:-1] < self.size)
        self.every, self.own, self.own_number = Places(self.hashes), Places(self.hashes[own]), np.append(self.number[own], self.number[-1])
        return self

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Network numbers of hashes."""
        return self.own_number.take(self.own.find(h))


def halved(x: np.ndarray) -> np.ndarray:
    """A copy of x(3 * STATE, ...) with its gates z and r halved, since the sigmoid of x is half of 1 + tanh(x / 2)."""
    x = np.array(x, order="C")
    x[: 2 * STATE] *= 0.5
    return x


def move(gates: np.ndarray, h: np.ndarray, Ut: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of the unit, a column a lane, from the inputs' gates: new state, gates zr, candidate n, and what the state adds to
    it. gates and Ut are halved()."""
    a = Ut @ h
    zr = gates[: 2 * STATE] + a[: 2 * STATE]
    np.tanh(zr, out=zr)
    zr *= 0.5
    zr += 0.5
    an = a[2 * STATE :]
    n = zr[STATE:] * an
    n += gates[2 * STATE :]
    np.tanh(n, out=n)
    new = h - n
    new *= zr[:STATE]
    new += n
    return new, zr, n, an


def step(gates: np.ndarray, h: np.ndarray, U: np.ndarray) -> tuple[np.ndarray, ...]:
    """move() with a row a lane and weights as they are."""
    return tuple(x.T for x in move(halved(gates.T), h.T, halved(U.T)))


def shares(weights: np.ndarray, bias: np.ndarray, states: np.ndarray) -> np.ndarray:
    """exp of the logits, a column a state. They are kept between -60 and 60 where weights are large enough to go beyond 40 for
    states between -1 and 1."""
    logits = weights @ states
    logits += bias[:, None]
    if len(bias) and (np.abs(weights).sum(1) + np.abs(bias)).max() > 40:
        np.clip(logits, -60, 60, out=logits)
    return np.exp(logits, out=logits)


def by_class(shape: Shape, target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of the targets by class, and (class, first, last) of those in it; the last class has no words of its own."""
    klass = shape.klass[target].astype(np.int16)
    order = np.argsort(klass, kind="stable")
    edge = np.searchsorted(klass[order], np.arange(shape.classes + 2)).tolist()
    return order, [(k, a, b) for k, (a, b) in enumerate(zip(edge[:-1], edge[1:])) if b > a]


def likelihood(p: dict, shape: Shape, states: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log P of each target word's class and of the word in it; for words outside the vocabulary of their class alone."""
    return likelihoods(p, shape, states.T, target)


def likelihoods(p: dict, shape: Shape, states: np.ndarray, target: np.ndarray) -> np.ndarray:
    """likelihood() with a column a state."""
    order, parts = by_class(shape, target)
    states, word = states.take(order, axis=1), target[order]
    q = shares(p["C"].T, p["cb"], states)
    of, within = q.sum(0), np.ones(len(word), q.dtype)
    picked = np.empty_like(within)
    for k, a, b in parts:
        picked[a:b] = q[k, a:b]
        if k < shape.classes:
            first, last = shape.first[k], shape.first[k + 1]
            own = shares(p["O"][first:last], p["ob"][first:last], states[:, a:b])
            within[a:b] = own[word[a:b] - first, np.arange(b - a)] / own.sum(0)
    out = np.empty_like(within)
    out[order] = np.log(picked) - np.log(of) + np.log(within)
    return out


def gradient(p: dict, shape: Shape, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradient of the mean negative log-likelihood of a window (time x lanes), and the state after it.

    Arrays hold a row a feature, so that what is done for all lanes goes along memory."""
    steps, lanes = inputs.shape
    word, target, real = inputs.ravel(), targets.ravel(), p["U"].dtype
    size, live, U, Ut = len(target), (~fresh).astype(real), p["U"], halved(p["U"].T)
    x = np.ascontiguousarray(p["E"].T).take(word, axis=1)
    gates = p["W"].T @ x
    gates += p["b"][:, None]
    gates[: 2 * STATE] *= 0.5
    gates = gates.reshape(3 * STATE, steps, lanes)
    before, states, n, an = (np.empty((STATE, steps, lanes), real) for _ in range(4))
    zr = np.empty((2 * STATE, steps, lanes), real)
    h = np.ascontiguousarray(h.T)
    for t in range(steps):
        h = h * live[t]
        before[:, t] = h
        h, zr[:, t], n[:, t], an[:, t] = move(gates[:, t], h, Ut)
        states[:, t] = h
    g = {"O": np.zeros_like(p["O"]), "ob": np.zeros_like(p["ob"])}
    order, parts = by_class(shape, target)
    flat, told = states.reshape(STATE, size).take(order, axis=1), target[order]
    q = shares(p["C"].T, p["cb"], flat)
    q /= q.sum(0)
    for k, a, b in parts:
        q[k, a:b] -= 1
    g["C"], g["cb"] = flat @ q.T, q.sum(1)
    d = p["C"] @ q
    for k, a, b in parts:
        if k < shape.classes:
            first, last = shape.first[k], shape.first[k + 1]
            own = flat[:, a:b]
            q = shares(p["O"][first:last], p["ob"][first:last], own)
            q /= q.sum(0)
            q[told[a:b] - first, np.arange(b - a)] -= 1
            g["O"][first:last], g["ob"][first:last] = q @ own.T, q.sum(1)
            d[:, a:b] += p["O"][first:last].T @ q
    place = np.empty_like(order)
    place[order] = np.arange(size)
    d = d.take(place, axis=1).reshape(STATE, steps, lanes)
    # what a state's gradient is multiplied by on its way into z, r and what the state adds to the candidate
    z, r, ways = zr[:STATE], zr[STATE:], np.empty((3, STATE, steps, lanes), real)
    candidate = (1 - z) * (1 - n * n)
    ways[0] = (before - n) * z * (1 - z)
    ways[2] = candidate * r
    ways[1] = ways[2] * an * (1 - r)
    dh = np.zeros((STATE, lanes), real)
    for t in range(steps - 1, -1, -1):
        now = d[:, t]
        now += dh
        dh = U @ (ways[:, :, t] * now).reshape(3 * STATE, lanes)
        dh += now * z[:, t]
        dh *= live[t]
    ways *= d
    into = ways.reshape(3 * STATE, size)
    g["U"] = before.reshape(STATE, size) @ into.T
    into[2 * STATE :] = (candidate * d).reshape(STATE, size)
    g["b"], g["W"] = into.sum(1), x @ into.T
    g["E"] = np.stack([np.bincount(word, back, shape.size + 1) for back in p["W"] @ into], 1)
    return {k: g[k].astype(np.float32) / size for k in shape.parts}, h.T


def walk(shape: Shape, flat: np.ndarray, streams: Iterator[np.ndarray], rate: float) -> tuple[np.ndarray, int]:
    """Weights after truncated backpropagation over the streams (documents one after the other, each with its end)."""
    flat, first, second, k, seen = flat.copy(), np.zeros_like(flat), np.zeros_like(flat), 0, 0
    for stream in streams:
        lanes = int(min(LANES, max(8, len(stream) // (WINDOW * 64))))
        length = len(stream) // lanes
        if not length:
            continue
        target = stream[: lanes * length].reshape(lanes, length).T.astype(np.int64)
        before = np.concatenate([[shape.end], stream[:-1]])[: lanes * length].reshape(lanes, length).T.astype(np.int64)
        h = np.zeros((lanes, STATE), np.float32)
        for a in range(0, length, WINDOW):
            inputs = before[a : a + WINDOW]
            g, h = gradient(shape.split(flat), shape, inputs, target[a : a + WINDOW], inputs == shape.end, h)
            grad = np.concatenate([x.ravel() for x in g.values()])
            norm = float(np.sqrt((grad * grad).sum()))
            if norm > 1:
                grad /= norm
            k += 1
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            flat -= rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-6)
        seen += lanes * length
    return flat, seen


def document_likelihoods(p: dict, shape: Shape, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """log-likelihood of each document ids[begins[k]:begins[k+1]], its end among them; the state runs through all of it."""
    size = np.diff(begins)
    order = np.argsort(-size, kind="stable")
    at, length = begins[:-1][order], size[order]
    out, h = np.zeros(len(size)), np.zeros((STATE, len(size)), np.float32)
    table, Ut = halved((p["E"] @ p["W"] + p["b"]).T), halved(p["U"].T)
    active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left").tolist()
    before = np.full(len(size), shape.end, np.int64)
    states, targets, owners, ready = [], [], [], 0

    def settle() -> None:
        state, target, owner = np.concatenate(states, axis=1), np.concatenate(targets).astype(np.int64), np.concatenate(owners)
        for a in range(0, len(target), ROWS):
            part = slice(a, a + ROWS)
            np.add(out, np.bincount(owner[part], likelihoods(p, shape, state[:, part], target[part]), len(out)), out=out)
        for x in (states, targets, owners):
            x.clear()

    lane = np.arange(len(size))
    for t, n in enumerate(active):
        h = move(table.take(before[:n], axis=1), h[:, :n], Ut)[0]
        before = ids[at[:n] + t]
        states.append(h)
        targets.append(before)
        owners.append(lane[:n])
        ready += n
        if ready >= 4 * ROWS:
            settle()
            ready = 0
    if ready:
        settle()
    result = np.empty(len(size))
    result[order] = out
    return result


# --- on Spark --------------------------------------------------------------------------------------------------------


def with_ends(h: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes with an end after each document, and the documents' begins."""
    return np.insert(h, begins[1:], END), begins + np.arange(len(begins))


def gathered(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold size bytes of the text column, since a pass takes as many steps as the longest text of
    its batch has words."""
    held, have = [], 0
    for batch in batches:
        held.append(batch)
        have += batch.column(column).nbytes
        if have >= size:
            yield pa.concat_batches(held)
            held, have = [], 0
    if held:
        yield pa.concat_batches(held)


def trained(docs: DataFrame, shape: Shape, tokens: int) -> np.ndarray:
    """Weights after ROUNDS rounds over all training documents, each in one of them. How many tokens there are decides nothing
    but whether there is anything to learn. Task weights meet in a tree: 64 sums, then one; a sum holds one set of weights."""
    spark = docs.sparkSession
    flat = shape.start()
    if not tokens or not shape.size:
        return flat
    shared = spark.sparkContext.broadcast(shape)
    name = f"lm-shape {uuid.uuid4().hex}"  # workers outlive a corpus, so what they keep goes by its own name

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = worker_cache(name, lambda: shared.value.index())
        for batch in sliced(batches, 1):
            every, begins = with_ends(*hash_words(text_bytes(batch.column(1))))
            number = shape.numbers(every)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([number[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:])], pa.binary())], names=["round", "ids"])

    turn = F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(ROUNDS)).cast("int")
    every = docs.where(remainder(F.col("doc_id")) != HELD_OUT).select(turn.alias("round"), "text")
    every = written(every.mapInArrow(ids, "round int, ids binary"), "lm-ids")
    for k in range(ROUNDS):
        now, rate = spark.sparkContext.broadcast(flat), RATE[k]

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shape = worker_cache(name, lambda: shared.value.index())

            def streams() -> Iterator[np.ndarray]:
                parts, have = [], 0
                for batch in batches:
                    for x in batch.column(0).to_pylist():
                        parts.append(np.frombuffer(x, np.uint16))
                        have += len(parts[-1])
                        if have >= STREAM:
                            yield np.concatenate(parts)
                            parts.clear()
                            have = 0
                if have:
                    yield np.concatenate(parts)

            weights, seen = walk(shape, now.value, streams(), rate)
            if seen:
                from pyspark import TaskContext

                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 64], pa.int32()), pa.array([float(seen)]), pa.array([(weights * np.float64(seen)).tobytes()], pa.binary())], names=["salt", "seen", "sum"])

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, total = 0.0, None
            for batch in batches:
                for n, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    seen, x = seen + n, np.frombuffer(x, np.float64)
                    total = x.copy() if total is None else total + x
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([seen]), pa.array([total.tobytes()], pa.binary())], names=["salt", "seen", "sum"])

        schema = "salt int, seen double, sum binary"
        rows = every.where(F.col("round") == k).select("ids").mapInArrow(learn, schema).repartition("salt").mapInArrow(fold, schema).repartition(1).mapInArrow(fold, schema).collect()
        if rows:
            flat = (np.frombuffer(rows[0]["sum"], np.float64) / rows[0]["seen"]).astype(np.float32)
    return flat


def score_texts(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is empty and has its end alone. Rows without doc_id are not held out and not learnt from. Rows that repeat or
    share a doc_id are counted and scored each by its own text. Without training documents every word is unseen: base_score
    and score are 0 for every text, since one unseen type holds all probability. Empty table: empty result; other columns are
    left out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = word_counts(docs)
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    hashes, frequency, least = frequent_words(counts)
    shape = Shape(hashes, frequency, total, types)
    weights = trained(docs, shape, total)
    model = spark.sparkContext.broadcast((shape, weights))
    name = f"lm-model {uuid.uuid4().hex}"
    log_others = math.log10(shape.others)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, weights = worker_cache(name, lambda: (model.value[0].index(), model.value[1]))
        p = shape.split(weights)
        log_count = np.append(np.log10(shape.counts + 1.0), 0.0)
        for batch in sliced(gathered(batches, 3), 3, 2 * SLICE):
            every, begins = with_ends(*hash_words(text_bytes(batch.column(3))))
            place = shape.every.find(every)
            number = shape.number[place]
            owner = np.repeat(np.arange(batch.num_rows), np.diff(begins))
            frequent = place < len(shape.hashes)
            outside = number == shape.size
            sums = lambda w: np.bincount(owner, w, batch.num_rows)
            net = document_likelihoods(p, shape, number, begins) / math.log(10) + sums(outside * (log_count[place] - log_others))
            rare = np.flatnonzero(~frequent)
            ends = np.searchsorted(rare, begins).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)), pa.array(np.diff(begins)), pa.array(sums(frequent).astype(np.int64)), pa.array(sums(log_count[place])), pa.array(net), pa.ListArray.from_arrays(ends, pa.array(every[rare].view(np.int64)))],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "logs", "net", "rare"],
            )

    held = F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out")
    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, net double, rare array<long>"
    scored = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held, "text").mapInArrow(score, schema), "lm-scored")
    # words that are not frequent: each has fewer than ``least`` rows in the training documents, so no key of this join is hot there
    seen = counts.where((F.col("c") < least) & (F.col("h") != END_KEY))
    found = scored.select("row", F.explode("rare").alias("h")).join(seen, "h").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("more_logs"))
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("more_logs", F.lit(0.0))
    return scored.drop("rare").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") + logs - F.col("n_tokens") * F.lit(math.log10(total + types + 1))).alias("base_score"), (F.col("net") + logs).alias("score"),
    )
