"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages and weighted by TF-IDF, with document frequencies from all documents. A distributed
randomised SVD of that passage matrix gives a latent space. Every window of every document is folded into it and compared
with every passage. A pair is a leak by either of two routes, each with a check of order, the longest common subsequence of
the passage and the words around the window, and a check of the passage's answer terms, its rarest third:

- latent: the cosine reaches ``cosine``; then ``near_cover`` of the passage in order and ``near_answer`` of its answer terms
  are enough. So reworded copies are found, with other words here and there and clauses in another place.
- verbatim: whatever the cosine (a short passage is a small part of a window's vector), ``cover`` of the passage in order and
  ``answer`` of its answer terms.

Texts on the same subject that share words but neither sequence nor answers are not leaks, however near they are.

Items of fewer than SHORT words must stand in the text word for word, since their words in order with others between say
little. Of the benchmark blocks of items are held, TOGETHER at a time: their words, a matrix of words by rank, passages.
Documents are streamed once to count words, and once for each TOGETHER blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, release, sliced, text_bytes
from .wordhash import NON_WORD, batches, hash_words

#: Words of half a window, and of an item's passages.
HALF, PASSAGE, SHORT = 32, 48, 8
#: The rank is RANK, or GROWTH times the root of the number of passages if that is more.
RANK, GROWTH, EXTRA, POWER = 192, 6, 16, 2
#: Words of more than half of all documents say nothing of a window and are left out of its vector.
LOUD = math.log(2)
#: Documents times benchmark words whose presence is marked at once, and windows times passages compared at once.
MARKS, PRODUCTS = 1 << 22, 1 << 21
#: Characters of the benchmark items of a block, about (items go whole), and blocks that are searched in one pass.
BENCHMARK, TOGETHER = 500_000, 8


class Rules(NamedTuple):
    """When a pair of window and passage is a leak: see the two routes above. At least one answer term must be there."""

    cosine: float = 0.4
    near_cover: float = 0.4
    near_answer: float = 0.4
    cover: float = 0.6
    answer: float = 0.5


def word_ids(texts: list[bytes], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words in a sorted vocabulary of hashes, -1 outside, and where each text begins."""
    lowered = [t if t.isascii() else t.decode("utf-8", "replace").lower().encode() for t in texts]
    words, at = hash_words(lowered, NON_WORD)
    if not len(vocabulary):
        return np.full(len(words), -1, np.int32), at
    place = _slots(vocabulary)[words >> np.uint64(64 - SLOT_BITS)]
    found = vocabulary[place] == words
    missed = np.flatnonzero(~found & (place > 0))  # another word may have the slot
    if len(missed):
        again = np.minimum(np.searchsorted(vocabulary, words[missed]), len(vocabulary) - 1)
        place[missed], found[missed] = again, vocabulary[again] == words[missed]
    place[~found] = -1
    return place, at


SLOT_BITS = 20
_SLOTS: list[tuple[np.ndarray, np.ndarray]] = []


def _slots(vocabulary: np.ndarray) -> np.ndarray:
    """By the first bits of a hash a vocabulary word that has them, 0 if none has."""
    if not _SLOTS or _SLOTS[0][0] is not vocabulary:
        table = np.zeros(1 << SLOT_BITS, np.int32)
        table[vocabulary >> np.uint64(64 - SLOT_BITS)] = np.arange(len(vocabulary), dtype=np.int32)
        _SLOTS[:] = [(vocabulary, table)]
    return _SLOTS[0][1]


def passages(n: int) -> list[tuple[int, int]]:
    """Cuts n words into runs of PASSAGE words at most and about equal length."""
    k = max(1, -(-n // PASSAGE))
    edge = [round(i * n / k) for i in range(k + 1)]
    return list(zip(edge[:-1], edge[1:], strict=True)) if n else []


def common_length(a: np.ndarray, masks: dict[int, int], n: int) -> int:
    """Length of the longest common subsequence of a with the n words whose places masks has, in bit parallel."""
    v = full = (1 << n) - 1
    for w in a.tolist():
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def in_a_row(a: np.ndarray, words: np.ndarray) -> bool:
    """Whether the words stand in a one after another."""
    n = len(words)
    return len(a) >= n and bool((np.lib.stride_tricks.sliding_window_view(a, n) == words).all(1).any())


def answer_terms(words: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The rarest third of a passage's different words."""
    terms = np.unique(words)
    return terms[np.argsort(-idf[terms], kind="stable")][: max(1, len(terms) // 3)]


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The count numbers from first on of each entry, and which entry each is of."""
    k = np.repeat(np.arange(len(first)), count)
    return np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count) + first[k], k


class Index:
    """What is known of the benchmark, for the executors."""

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, basis: np.ndarray, items: list[int], words: list[np.ndarray]) -> None:
        self.vocabulary, self.items, self.words = vocabulary, items, words
        self.fold = (basis * idf[:, None]).astype(np.float32)
        self.loud = idf > LOUD
        latent = np.stack([self.fold[w[self.loud[w]]].sum(0) for w in words]) if words else np.zeros((0, basis.shape[1]), np.float32)
        self.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        self.masks = []
        for w in words:
            m: dict[int, int] = {}
            for k, x in enumerate(w.tolist()):
                m[x] = m.get(x, 0) | 1 << k
            self.masks.append(m)
        answers = [answer_terms(w, idf) for w in words]
        self.needed = np.array([len(x) for x in answers], float)
        # by word the passages that it is an answer term of: asked_by[asked_at[w] : asked_at[w + 1]]
        term = np.concatenate([*answers, np.zeros(0, np.int64)]).astype(np.int64)
        self.asked_by = np.repeat(np.arange(len(answers)), list(map(len, answers)))[np.argsort(term, kind="stable")] if answers else np.zeros(0, np.int64)
        self.asked_at = np.searchsorted(np.sort(term), np.arange(len(vocabulary) + 1))

    def holding(self, ids: np.ndarray, at: np.ndarray, base: np.ndarray, answer: float) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys (window * passages + passage) of all windows with enough answer terms of a passage around them, and one
        at least; and the share of its answer terms that are there."""
        n = len(self.words)
        place = np.flatnonzero(ids >= 0)
        place = place[self.asked_at[ids[place] + 1] > self.asked_at[ids[place]]]
        doc = np.searchsorted(at, place, "right") - 1
        inner = place - at[doc]
        # the windows around which the place lies
        low = np.maximum(-(-(inner - 2 * HALF - PASSAGE // 2 + 1) // HALF), 0)
        high = np.minimum((inner + PASSAGE // 2) // HALF, base[doc + 1] - base[doc] - 1)
        window, k = spread(base[doc] + low, high - low + 1)
        word = ids[place][k]
        asked, k = spread(self.asked_at[word], self.asked_at[word + 1] - self.asked_at[word])
        key = window[k] * n + self.asked_by[asked]
        # most pairs have too few places; words are told apart only in the others
        pairs, of, count = np.unique(key, return_inverse=True, return_counts=True)
        enough = (count >= np.maximum(answer * self.needed[pairs % n], 1))[of]
        distinct = np.unique(np.stack([key[enough], word[k][enough]]), axis=1)[0]
        pairs, count = np.unique(distinct, return_counts=True)
        enough = count >= np.maximum(answer * self.needed[pairs % n], 1)
        return pairs[enough], (count / self.needed[pairs % n])[enough]

    def leaks(self, texts: list[bytes], rules: Rules) -> list[tuple[int, int, float, float]]:
        """(number of the text, item, covered share, cosine) of each leak, the best for each text and item."""
        found: dict[tuple[int, int], tuple[float, float]] = {}
        for first, last in batches(texts):
            ids, at = word_ids(texts[first:last], self.vocabulary)
            size = np.diff(at)
            halves = np.maximum(-(-size // HALF), 1)
            base = np.concatenate([[0], np.cumsum(halves)])
            place = np.flatnonzero((ids >= 0) & self.loud[np.maximum(ids, 0)]) if len(self.loud) else np.zeros(0, int)
            if not len(place):
                continue
            doc = np.searchsorted(at, place, "right") - 1
            half = base[doc] + (place - at[doc]) // HALF
            seen, begin = np.unique(half, return_index=True)
            sums = np.zeros((int(base[-1]) + 1, self.fold.shape[1]), np.float32)
            # the first words of all halves, then the second words of those that have two ...
            count = np.diff(begin, append=len(place))
            order = np.argsort(-count, kind="stable")
            for k in range(0, len(order), 1024):
                some = order[k : k + 1024]
                total = self.fold[ids[place[begin[some]]]]
                for j in range(1, int(count[some[0]])):
                    more = some[: np.searchsorted(-count[some], -j)]
                    total[: len(more)] += self.fold[ids[place[begin[more] + j]]]
                sums[seen[some]] = total
            owner = np.repeat(np.arange(last - first), halves)
            window = sums[:-1].copy()
            joined = np.flatnonzero(owner[1:] == owner[:-1])
            window[joined] += sums[1:-1][joined]
            norm = np.linalg.norm(window, axis=1)
            some = np.flatnonzero(norm > 1e-6)
            pairs, share = self.holding(ids, at, base, min(rules.answer, rules.near_answer))
            near = []
            step = max(64, PRODUCTS // len(self.words))
            for k in range(0, len(some), step):
                part = some[k : k + step]
                rows, passage = np.nonzero((window[part] / norm[part, None]) @ self.latent.T >= rules.cosine)
                near.append(part[rows] * len(self.words) + passage)
            latent = np.isin(pairs, np.concatenate([*near, np.zeros(0, np.int64)])) & (share >= rules.near_answer)
            verbatim = share >= rules.answer
            for key, by_cosine, by_words in zip(pairs.tolist(), latent.tolist(), verbatim.tolist(), strict=True):
                if not by_cosine and not by_words:
                    continue
                h, p = divmod(key, len(self.words))
                d = owner[h]
                begins = at[d] + (h - base[d]) * HALF
                a = ids[max(at[d], begins - PASSAGE // 2) : min(at[d + 1], begins + 2 * HALF + PASSAGE // 2)]
                n = len(self.words[p])
                cover = common_length(a, self.masks[p], n) / n if n >= SHORT else float(in_a_row(a, self.words[p]))
                least = 1.0 if n < SHORT else min(rules.near_cover if by_cosine else 1.0, rules.cover if by_words else 1.0)
                if cover >= least:
                    leak = (first + int(d), self.items[p])
                    found[leak] = max(found.get(leak, (0.0, 0.0)), (cover, float(window[h] @ self.latent[p] / max(norm[h], 1e-9))))
        return [(t, i, s, c) for (t, i), (s, c) in sorted(found.items())]


def document_frequency(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each benchmark word occurs, and how many documents there are. All documents count."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        n, rows, step = np.zeros(len(held.value), np.int64), 0, max(1, min(256, MARKS // max(1, len(held.value))))
        for batch in sliced(batched, 0):
            texts = text_bytes(batch.column(0))
            rows += len(texts)
            for first, last in batches(texts):
                ids, at = word_ids(texts[first:last], held.value)
                known = np.flatnonzero(ids >= 0)
                doc = np.repeat(np.arange(last - first, dtype=np.int64), np.diff(at))[known]
                for a in range(0, last - first, step):
                    x, y = np.searchsorted(doc, (a, a + step))
                    seen = np.zeros((min(step, last - first - a), len(n)), bool)
                    seen[doc[x:y] - a, ids[known[x:y]]] = True
                    n += seen.sum(0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(n[some], rows), pa.int64())], names=["word", "n"])

    got = docs.select("text").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary) + 1, np.int64)  # the last place holds what stands for all documents
    out[got["word"].to_numpy()] = got["n"].to_numpy()
    return out[:-1], int(out[-1])


def latent_basis(rows: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 3) -> np.ndarray:
    """Right singular vectors (words by rank) of the TF-IDF matrix whose rows are arrays of word numbers.

    Randomised range finding on A'A: each task multiplies its rows, the products are dealt by word and added on the
    executors; the driver gets and orthonormalises a matrix of words by rank + EXTRA.
    """
    spark, d, k = rows.sparkSession, len(idf), min(rank + EXTRA, len(idf))
    parts = max(1, min(64, d * k // 1_000_000))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, k)))[0]

    def emit(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype("<f8").tobytes() for v in sums.values()], pa.binary())], names=["word", "y"])

    def add(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batched:
            for c, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out[c] = out.get(c, 0) + np.frombuffer(v, "<f8")
        yield emit(out)

    for _ in range(POWER):
        held = spark.sparkContext.broadcast((q, idf))

        def multiply(batched: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            q, idf = held.value
            out: dict[int, np.ndarray] = {}
            for batch in batched:
                for w in batch.column(0).to_pylist():
                    w = np.array(w)
                    x = idf[w] / max(np.linalg.norm(idf[w]), 1e-9)
                    y = x @ q[w]
                    for c, v in zip(w.tolist(), x.tolist(), strict=True):
                        out[c] = out.get(c, 0) + v * y
            yield emit(out)

        got = rows.mapInArrow(multiply, "word int, y binary").repartition(parts, "word").mapInArrow(add, "word int, y binary").toArrow()
        y = np.zeros((d, k))
        for word, v in zip(got["word"].to_pylist(), got["y"].to_pylist(), strict=True):
            y[word] = np.frombuffer(v, "<f8")
        q, s, _ = np.linalg.svd(y, full_matrices=False)
    return q[:, :rank] * (s[:rank] > 1e-9 * max(s[0], 1e-300))


def blocks(benchmark: DataFrame) -> list[DataFrame]:
    """(item_id, text) of the items in parts of about BENCHMARK characters; all texts of an item are in one."""
    items = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    n = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BENCHMARK))
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else items for k in range(n)]


def block_words(items: DataFrame) -> tuple[list[int], list[np.ndarray], np.ndarray]:
    """Item and word numbers of each passage of a block, and the block's vocabulary."""
    held = [(r.item_id, r.text) for r in items.orderBy("item_id", "text").collect()]
    raw = [t.encode("utf-8", "replace") for _, t in held]
    lowered = [t if t.isascii() else t.decode().lower().encode() for t in raw]
    vocabulary = np.unique(hash_words(lowered, NON_WORD)[0])
    ids, at = word_ids(raw, vocabulary)
    numbers, words = [], []
    for (item, _), a, b in zip(held, at[:-1], at[1:], strict=True):
        for s, e in passages(int(b - a)):
            numbers.append(item)
            words.append(ids[a + s : a + e])
    return numbers, words, vocabulary


def build_indexes(docs: DataFrame, benchmark: DataFrame) -> list[Index]:
    """An Index for each block; the words of all of them are counted in one pass over the documents."""
    spark = docs.sparkSession
    parts = [p for p in map(block_words, blocks(benchmark)) if p[1]]
    if not parts:
        return []
    vocabulary = np.unique(np.concatenate([v for _, _, v in parts]))
    counted, n = document_frequency(docs, vocabulary)
    out = []
    for items, words, own in parts:
        df = counted[np.searchsorted(vocabulary, own)]
        # rare words weigh most; a word of every document still weighs a little
        idf = np.maximum(np.log((n + 1) / (df + 1)), 0.05)
        # an item that very many documents contain makes its own words common: its rarest ones keep a weight
        asked = np.unique(np.concatenate([answer_terms(w, idf) for w in words]))
        idf[asked] = np.maximum(idf[asked], LOUD + 0.2)
        rows = spark.createDataFrame([(w.tolist(),) for w in words], "words array<int>").repartition(max(1, min(64, len(words) // 64)))
        out.append(Index(own, idf, latent_basis(rows, idf, max(RANK, math.ceil(GROWTH * math.sqrt(len(words))))), items, words))
    return out


def groups_of(docs: DataFrame, benchmark: DataFrame) -> list:
    """Broadcasts of TOGETHER indexes each."""
    every = build_indexes(docs, benchmark)
    return [docs.sparkSession.sparkContext.broadcast(every[k : k + TOGETHER]) for k in range(0, len(every), TOGETHER)]


FOUND = "doc_id long, item_id long, covered double, cosine double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(doc_id, item_id, covered, cosine) for each document and benchmark item that it contains; clean documents have no row.

    Null and empty texts and items match nothing. A null doc_id is reported as null. Rows that share a doc_id, repeated ones
    too, report their leaks each. Items under SHORT words must stand in the text word for word. Several texts of an item_id
    are one item. Empty tables: empty result. Other columns are left out. One pass over the texts to count the benchmark's
    words and one for each TOGETHER blocks of it, no shuffle of them; of the corpus only those counts are gathered.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], FOUND)
    for held in groups_of(docs, benchmark):

        def search(batched: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            let_go()
            for batch in sliced(batched, 1):
                raw = text_bytes(batch.column(1))
                got = [leak for index in held.value for leak in index.leaks(raw, rules)]
                t, i, s, c = (list(x) for x in zip(*got, strict=True)) if got else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(t, pa.int64())), pa.array(i, pa.int64()), pa.array(s, pa.float64()), pa.array(c, pa.float64())], names=["doc_id", "item_id", "covered", "cosine"])
            release()

        out = out.unionByName(texts.mapInArrow(search, FOUND))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs in which find_leaks finds no item, each judged by its own text, with all their columns."""
    at, out = docs.columns.index("text"), docs
    for held in groups_of(docs, benchmark):

        def keep(batched: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            let_go()
            for batch in sliced(batched, at):
                raw, clean = text_bytes(batch.column(at)), np.ones(batch.num_rows, bool)
                for index in held.value:
                    clean[[t for t, *_ in index.leaks(raw, rules)]] = False
                yield batch.filter(pa.array(clean))
            release()

        out = out.mapInArrow(keep, docs.schema)
    return out
