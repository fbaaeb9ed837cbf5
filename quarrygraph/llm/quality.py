"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration.

Statistics of a whole text are standardised by the labelled rows' mean and spread. cos(Wx + b) with Gaussian W
approximates a Gaussian kernel, so ridge regression on these features approximates kernel ridge regression. Each task
sums its rows' part of the normal equations; the sums are added on the executors and one small matrix reaches the driver.
Scores are calibrated by pooling adjacent violators over a fixed grid of score bins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, let_go, sliced, text_bytes
from .wordhash import SPACES, batches, hash_words

FEATURES = 160
BINS = 512
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#$%&*|<>{}[]=~^_\\@+")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:!?'\"()-")] = True
NAMES = (
    "bytes", "words", "word_length", "upper", "digits", "symbols", "punctuation", "other_alphabets", "lines", "line_length", "distinct_words",
    "distinct_pairs", "top_word", "distinct_lines", "marks_at_end", "shouting", "letters", "stops",
)


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of len(NAMES) numbers for each text; all zero for an empty one."""
    out = np.zeros((len(texts), len(NAMES)))
    for first, last in batches(texts):
        group = texts[first:last]
        words, at = hash_words(group, SPACES)
        pairs = words[:-1] * np.uint64(31) + words[1:]
        for k, t in enumerate(group):
            if not t:
                continue
            n = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
            size, w = len(t), words[at[k] : at[k + 1]]
            m = max(len(w), 1)
            _, c = np.unique(w, return_counts=True)
            lines = t.split(b"\n")
            low, up, high = n[97:123].sum(), n[65:91].sum(), n[128:].sum()
            letters = max(low + up + high, 1)
            doubles = len(np.unique(pairs[at[k] : at[k + 1] - 1])) if len(w) > 1 else 1
            out[first + k] = (
                np.log1p(size), np.log1p(len(w)), size / m, up / letters, n[48:58].sum() / size, n[_SYMBOLS].sum() / size, n[_PUNCT].sum() / size, high / size, np.log1p(len(lines)), np.log1p(size / len(lines)),
                len(c) / m, doubles / max(len(w) - 1, 1), c.max() / m if len(c) else 0, len(set(lines)) / len(lines),
                len(re.findall(rb"[^\w\s.,;:]{2,}(?=\s|$)", t)) / m, n[33] / m, letters / size, n[46] / m,
            )
    return out


class Map:
    """Standardised statistics to random Fourier features, with a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, width: float = 3.0, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.normal(0, 1 / width, (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8) @ self.w + self.b
        return np.hstack([np.cos(z) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))])


def isotonic(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Non-decreasing rates that fit positive / total best (pool adjacent violators); bins without rows take the one before."""
    blocks: list[list[float]] = []
    for k in np.flatnonzero(total):
        blocks.append([float(positive[k]), float(total[k]), int(k)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, t, _ = blocks.pop()
            blocks[-1][0] += p
            blocks[-1][1] += t
    out, level = np.zeros(len(total)), [b[2] for b in blocks]
    if not blocks:
        return np.full(len(total), 0.5)
    for k in range(len(total)):
        p, t, _ = blocks[max(int(np.searchsorted(level, k, "right")) - 1, 0)]
        out[k] = (p + 1) / (t + 2)
    return np.maximum.accumulate(out)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, ridge: float = 1e-3) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    Learns from all labelled rows that are not held out (no sample); a score sees the text alone. Null and empty texts
    have all-zero statistics and are scored like any other. Null labels are left out; several labels of a doc_id all
    count. Without labelled rows every score is 0.5. One pass over the texts; statistics are written once and reread.
    """
    spark = docs.sparkSession
    k = len(NAMES)

    def measure(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in sliced(batched, 2):
            x = statistics(text_bytes(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(x.ravel()))], names=["doc_id", "held_out", "x"])

    schema = "doc_id long, held_out boolean, x array<double>"
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(measure, schema))
    known = labels.where(F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    train = cut(rows.where("NOT held_out").select("doc_id", "x").join(known, "doc_id").select("x", "y"))
    sums = train.select(*(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(k)), *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(k)), F.count("*").alias("n")).first()
    if not sums.n:
        return rows.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(int(0.5 >= threshold)).alias("predicted"))
    feature = spark.sparkContext.broadcast(Map(np.array(sums[:k], float), np.array(sums[k : 2 * k], float)))
    d = FEATURES + 1

    def equations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = np.zeros((d, d + 1))
        for pdf in frames:
            if len(pdf):
                f = feature.value(np.stack(pdf["x"].to_numpy()))
                a += f.T @ np.hstack([f, pdf["y"].to_numpy()[:, None]])
        yield pd.DataFrame({"part": [0], "a": [a.ravel()]})

    # added up by element on the executors; the driver gets one matrix
    parts = train.mapInPandas(equations, "part int, a array<double>").select(F.posexplode("a").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    flat = np.zeros(d * (d + 1))
    for r in parts.toLocalIterator():
        flat[r["at"]] = r["v"]
    a = flat.reshape(d, d + 1)
    weight = np.linalg.solve(a[:, :d] + ridge * sums.n * np.eye(d) / d, a[:, d])
    model = spark.sparkContext.broadcast(weight)

    def raw(x: np.ndarray) -> np.ndarray:
        return np.clip(((feature.value(x) @ model.value) + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)

    def binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield pd.DataFrame({"bin": raw(np.stack(pdf["x"].to_numpy())), "y": pdf["y"].to_numpy()})

    total, positive = np.zeros(BINS), np.zeros(BINS)
    for r in train.mapInPandas(binned, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect():
        total[r.bin], positive[r.bin] = r.n, r.p
    curve = spark.sparkContext.broadcast(isotonic(total, positive))

    def apply(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            s = curve.value[raw(x)] if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")
