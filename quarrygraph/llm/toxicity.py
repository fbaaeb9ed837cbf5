"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) over the terms of a text. The pairwise part learns that
two terms together (an insult and a group's name) weigh more, or less, than each alone. Terms are runs of letters,
lower-cased, and their first STEMS bytes, hashed to 2**TERM_BITS places. Every place that the labelled sample holds enters
the machine, whatever it says of the label by itself. Most words of a sample occur in a few texts only, and hundreds of
them together could tell any text by heart; so x_i is no plain 1 but a prior trust in the term: it grows with the texts
that hold the term, and, for rare terms, with how clearly those go with the label. Frequent terms that are neutral alone
are trusted too, so a pair of them can be learnt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, let_go, release, sliced, text_bytes
from .wordhash import NON_LETTERS, batches, hash_words

TERM_BITS, STEMS = 22, (5, 8)
#: The documented sample bound: labelled rows of each label in the order of a hash of doc_id, and terms of all of them together.
SAMPLE, SAMPLE_TERMS = 8_000, 16_000_000
FACTORS, EPOCHS, RATE, DECAY, BATCH = 6, 30, 0.1, 0.1, 256
#: What a text labelled 1 counts against one labelled 0.
POSITIVE = 2.0


def terms(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Distinct hashed terms of each text."""
    lowered = [t if t.isascii() else t.decode("utf-8", "replace").lower().encode() for t in texts]
    for first, last in batches(lowered):
        hashed = [hash_words(lowered[first:last], NON_LETTERS, most) for most in (None, *STEMS)]
        places = [(h >> np.uint64(64 - TERM_BITS)).astype(np.int32) for h, _ in hashed]
        at = hashed[0][1]
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield np.unique(np.concatenate([x[a:b] for x in places]))


class Machine:
    """Weights of the terms (numbered as in places), already times the trust in them."""

    def __init__(self, places: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> None:
        self.places, self.w0, self.w, self.v = places, w0, w, v

    def table(self) -> np.ndarray:
        """By hashed place the number of the term, -1 for terms outside."""
        out = np.full(1 << TERM_BITS, -1, np.int32)
        out[self.places] = np.arange(len(self.places))
        return out

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """rows: numbers of the terms in each text."""
        n = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
        owner, out = np.repeat(np.arange(len(rows)), n), np.full(len(rows), self.w0)
        out += np.bincount(owner, self.w[flat], len(rows))
        for f in range(self.v.shape[1]):
            x = self.v[flat, f]
            out += 0.5 * (np.bincount(owner, x, len(rows)) ** 2 - np.bincount(owner, x * x, len(rows)))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def trust(n: np.ndarray, hits: np.ndarray, rate: float) -> np.ndarray:
    """x_i of terms in n sampled texts, hits of them labelled 1, never 0: the more of how settled a term's effect is by its
    frequency and by its standardised difference between the labels."""
    z = np.abs(hits - n * rate) / np.sqrt(np.maximum(n * rate * (1 - rate), 1e-12))
    return np.maximum((n / (n + 100)) ** 2, np.clip((z - 2) / 4, 0, 1) ** 2 * n / (n + 3)).astype(np.float32)


class Batch:
    """Some sampled texts: their terms, numbered within the batch, text by text, and the number of the text of each."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, scale: np.ndarray) -> None:
        n = np.fromiter(map(len, rows), np.int64, len(rows))
        self.terms, at = np.unique(np.concatenate(rows), return_inverse=True)
        self.at, self.first = at.astype(np.int32), np.cumsum(n) - n
        self.owner = np.repeat(np.arange(len(rows), dtype=np.int32), n)
        self.scale, self.y, self.weight = scale[self.terms, None], y, weight / len(rows)


def learn(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = 11) -> Machine:
    """Logistic loss, AdaGrad on small batches. rows: hashed terms of each text; weight: what each text counts."""
    rate = float(np.clip((y * weight).sum() / weight.sum(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    w0 = float(np.log(rate / (1 - rate)))
    rng = np.random.default_rng(seed)
    able = [k for k in rng.permutation(len(rows)) if len(rows[k])]
    if not able or len(np.unique(y)) < 2:
        return Machine(np.zeros(0, np.int32), w0, np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
    n, hits = np.zeros(1 << TERM_BITS, np.int32), np.zeros(1 << TERM_BITS, np.int32)
    for k in able:
        n[rows[k]] += 1
        hits[rows[k]] += int(y[k])
    places = np.flatnonzero(n).astype(np.int32)
    number = Machine(places, 0.0, n, n).table()
    scale, size = trust(n[places], hits[places], float(y[able].mean())), len(places)
    parts = [able[k : k + BATCH] for k in range(0, len(able), BATCH)]
    held = [Batch([number[rows[k]] for k in part], y[part], weight[part], scale) for part in parts]
    seen = np.zeros(size, np.float32)
    for b in held:
        seen[b.terms] += 1
    # DECAY / texts at every step for every term, paid where the term occurs
    decay = DECAY / len(able) * len(held) / seen
    both = np.zeros((size, FACTORS + 1), np.float32)  # a term's factors, then its weight
    both[:, :FACTORS] = rng.normal(0, 0.05, (size, FACTORS))
    squares, w0_squares = np.full((size, FACTORS + 1), 1e-4, np.float32), 1e-4
    for _ in range(EPOCHS):
        for k in rng.permutation(len(held)):
            # x_i is the same in every text, so a text's sums and a term's gradient are sums of rows of two small tables
            b = held[k]
            now = both.take(b.terms, axis=0)
            x = now * b.scale
            of_terms = np.concatenate([x, np.einsum("ij,ij->i", x[:, :FACTORS], x[:, :FACTORS])[:, None]], axis=1)
            of_texts = np.add.reduceat(of_terms.take(b.at, axis=0), b.first, axis=0)
            sums = of_texts[:, :FACTORS]
            margin = w0 + of_texts[:, FACTORS] + 0.5 * ((sums**2).sum(1) - of_texts[:, FACTORS + 1])
            err = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - b.y) * b.weight).astype(np.float32)
            pulls = [*(sums * err[:, None]).T, err]
            step = np.stack([np.bincount(b.at, p.take(b.owner)) for p in pulls], axis=1).astype(np.float32) * b.scale
            step[:, :FACTORS] -= x[:, :FACTORS] * step[:, FACTORS:]
            step += decay[b.terms, None] * now
            grown = squares.take(b.terms, axis=0) + step**2
            squares[b.terms] = grown
            both[b.terms] = now - RATE * step / np.sqrt(grown)
            w0_squares += float(err.sum()) ** 2
            w0 -= RATE * float(err.sum()) / np.sqrt(w0_squares)
    return Machine(places, float(w0), both[:, FACTORS] * scale, both[:, :FACTORS] * scale[:, None])


def train(docs: DataFrame, labels: DataFrame, label: str) -> Machine:
    """Learns from SAMPLE labelled rows of each label at most, none held out, and SAMPLE_TERMS terms of them together.

    The rows of a label weigh so much that both labels count as in the table, and label 1 POSITIVE times that. One task gets
    the hashed terms of the sampled rows, the driver the weights.
    """
    y = (F.col(label) > 0).cast("int")
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), y.alias("y"))
    total = {r.y: r["count"] for r in known.groupBy("y").count().collect()}  # two rows
    in_order = lambda value: known.where(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    some = in_order(0).unionByName(in_order(1))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id").select("doc_id", "y", "text")

    def hashed(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in sliced(batched, 2):
            found = list(terms(text_bytes(batch.column(2))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(map(len, found)), pa.int64()), pa.array([t.tobytes() for t in found], pa.binary())], names=["doc_id", "y", "n", "t"])

    rows = cut(texts.mapInArrow(hashed, "doc_id long, y int, n long, t binary"))
    sampled = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y", F.xxhash64("t")).limit(2 * SAMPLE).select("y", "n", "t")

    def fit(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        got = pa.Table.from_batches(batched, pa.schema([("y", pa.int32()), ("n", pa.int64()), ("t", pa.binary())]))
        got = got.slice(0, int(np.searchsorted(np.cumsum(got["n"].to_numpy()), SAMPLE_TERMS, "right")))
        y, found = got["y"].to_numpy().astype(np.float32), [np.frombuffer(t, np.int32) for t in got["t"].to_pylist()]
        weight = np.ones(len(y), np.float32)
        for value in (0, 1):
            mine = y == value
            if mine.any():
                weight[mine] = total[value] / mine.sum() * (POSITIVE if value else 1.0)
        m = learn(found, y, weight / max(float(weight.mean()), 1e-9) if len(y) else weight)
        del got, found
        release()
        yield pa.RecordBatch.from_arrays([pa.array([m.w0]), *(pa.array([x.tobytes()], pa.binary()) for x in (m.places, m.w, m.v))], names=["w0", "places", "w", "v"])

    # in one task of the sample's size, so that it is repeated elsewhere if the executor is lost, and the driver stays small
    m = sampled.coalesce(1).mapInArrow(fit, "w0 double, places binary, w binary, v binary").first()
    if m is None:
        return learn([], np.zeros(0, np.float32), np.zeros(0, np.float32))
    return Machine(np.frombuffer(m.places, np.int32), m.w0, np.frombuffer(m.w, np.float32), np.frombuffer(m.v, np.float32).reshape(-1, FACTORS))


def judge(rows: DataFrame, docs: DataFrame, labels: DataFrame, label: str, threshold: float, keep: list[int], schema: str) -> DataFrame:
    """The columns keep of rows, with score and predicted, learnt from docs; schema is that of the result. A row's text is its
    column ``text``."""
    machine, at = rows.sparkSession.sparkContext.broadcast(train(docs, labels, label)), rows.columns.index("text")

    def apply(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        table = machine.value.table()
        for batch in sliced(batched, at):
            found = [c[c >= 0] for c in (table[t] for t in terms(text_bytes(batch.column(at))))]
            s = machine.value.scores(found)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[*(batch.schema.names[k] for k in keep), "score", "predicted"])
        release()

    return rows.mapInArrow(apply, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    Learns from labelled rows that are not held out; a score sees the whole text alone. Null and empty texts have no
    terms: the base rate. With one label only, every score is the base rate of that; without labelled rows 0.5. Repeated
    labels of a doc_id all count; null labels and labels without doc_id are left out. Rows that share a doc_id, or have
    none, are scored each by its own text. Empty table: empty result; other columns are left out. One pass over all texts,
    no shuffle of them.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return judge(known, docs, labels, label, threshold, [0, 1], "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score_toxicity does not predict 1, each judged by its own text, in the same pass over them."""
    fields = [*docs.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double, predicted int"
    clash = {"score", "predicted"} & {f.name.lower() for f in fields}
    if clash:
        raise ValueError(f"columns {sorted(clash)} clash with the scores")
    return judge(docs, docs, labels, label, threshold, list(range(len(fields))), schema).where("predicted = 0").select(*(f"`{f.name}`" for f in fields))
