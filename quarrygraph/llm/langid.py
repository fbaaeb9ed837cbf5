"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed from left to right into the longest
phrases that occur in that text; the fewer phrases, the nearer the language. With n symbols of labelled text and m
symbols in the parsed text, the cross entropy is phrases * log2(n) / m bits a symbol; the least wins.

Symbols are all lower-case letters that the labelled texts hold, one for each, one for any other letter, and one mark for
everything between words. The moves of an automaton lie in one table as long as their number asks, however many letters a
script has, so many pieces of text advance together, one symbol a step, in numpy. A long text is cut
into pieces that are parsed side by side; then each piece is parsed again from the state in which the piece before it
ended, until a phrase begins where one began the first time or the states are the same: from there on both parses are. So the
count is that of one parse of the whole text.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import held_out, sliced

#: The documented sample bound: labelled documents a language looked at, in the order of a hash of doc_id, and characters of
#: those learnt from. Documents are taken whole; one that would pass the bound is passed over (the shortest if all would).
TRAIN_DOCS, TRAIN_CHARS = 200, 32_000
PIECE = 1024
GAP, OTHER, FIRST = 1, 2, 3
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


def symbols(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Classes of code points, runs of gaps as one gap, none at the ends."""
    out = classes[points]
    gap = out == GAP
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    out = out[keep]
    first, last = int(len(out) > 0 and out[0] == GAP), len(out) - int(len(out) > 0 and out[-1] == GAP)
    return out[first : max(last, first)]


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Next states by symbol of each state; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        cur = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return step


class Automaton:
    """The moves of all states in one table, those of the root by symbol.

    A state is the place where its moves begin: its move by symbol c stands at state + c, beside the state that it belongs
    to. States are strewn so that no two moves share a place; the table is four times as large as their number.
    """

    def __init__(self, text: np.ndarray, width: int, seed: int = 0) -> None:
        step = suffix_automaton(text)
        rng, size = random.Random(seed), 4 * sum(map(len, step)) + width
        # the states of many moves first, while the table is empty; the root has none in it
        begin, used, owner = [0] * len(step), {0}, {}
        for state in sorted(range(1, len(step)), key=lambda s: -len(step[s])):
            while (at := rng.randrange(1, size)) in used or any(at + c in owner for c in step[state]):
                pass
            begin[state] = at
            used.add(at)
            owner.update((at + c, (at, t)) for c, t in step[state].items())
        # place -> owner of the move * 2**32 + where it leads; no owner: -1
        self.table = np.full(size + width, -1, np.int64)
        places = np.fromiter(owner, np.int64, len(owner))
        self.table[places] = [at << 32 | begin[t] for at, t in owner.values()]
        self.root = np.zeros(width, np.int64)
        for c, t in step[0].items():
            self.root[c] = begin[t]

    def move(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and whether a phrase begins with the symbol: at the root, and where the phrase before cannot go on.
        A symbol that the language lacks is a phrase of its own and leads back to the root."""
        found = self.table.take(state + symbol)
        new = (found >> 32) != state
        return np.where(new, self.root.take(symbol), found & 0xFFFFFFFF), new

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text."""
        pieces = [(k, s[a : a + PIECE]) for k, s in enumerate(texts) for a in range(0, len(s), PIECE)]
        if not pieces:
            return np.zeros(len(texts), np.int64)
        owner, size = np.array([k for k, _ in pieces]), np.array([len(s) for _, s in pieces])
        order = np.argsort(-size, kind="stable")
        lane = np.empty(len(order), np.int64)
        lane[order] = np.arange(len(order))
        grid = np.zeros((int(size.max()), len(pieces)), np.int64)
        for k, (_, s) in enumerate(pieces):
            grid[: len(s), lane[k]] = s
        active = np.searchsorted(-size[order], -np.arange(len(grid)), "left").tolist()
        state, begins, states = np.zeros(len(pieces), np.int64), np.zeros(grid.shape, bool), np.zeros(grid.shape, np.int64)
        for t, n in enumerate(active):
            state[:n], begins[t, :n] = self.move(state[:n], grid[t, :n])
            states[t, :n] = state[:n]
        count = begins.sum(0)[lane]
        # pieces that go on from another one, from the state in which that ended
        later = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        here, now, length = lane[later], state[lane[later - 1]], size[later]
        change, t, lost = np.zeros(len(pieces), np.int64), 0, np.zeros(len(texts), bool)
        while len(later):
            over = length <= t
            if over.any():  # parsed to its end without meeting the first parse: a piece after it began in a wrong state
                ended = later[over]
                lost[owner[ended[np.append(owner, -1)[ended + 1] == owner[ended]]]] = True
                later, here, now, length = (x[~over] for x in (later, here, now, length))
                continue
            now, mine = self.move(now, grid[t, here])
            first = begins[t, here]
            met = (first & mine) | (now == states[t, here])
            change[later] += mine.astype(np.int64) - first
            later, here, now, length = (x[~met] for x in (later, here, now, length))
            t += 1
        out = np.bincount(owner, count + change, len(texts)).astype(np.int64)
        for k in np.flatnonzero(lost):
            out[k] = self.plain(texts[k])
        return out

    def plain(self, text: np.ndarray) -> int:
        """The same of one text, symbol by symbol."""
        state, n, moves = np.zeros(1, np.int64), 0, text.astype(np.int64)
        for k in range(len(moves)):
            state, new = self.move(state, moves[k : k + 1])
            n += int(new[0])
        return n


class Model:
    """Picklable: the languages, the letters of all of them, one automaton a language."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.langs = sorted(samples)
        points = {g: [code_points(t) for t in samples[g]] for g in self.langs}
        every = np.concatenate([np.zeros(0, np.uint32), *(p for g in self.langs for p in points[g])])
        self.letters = np.unique(every[letter_table()[every]])
        classes = self.classes()
        self.automata, self.bits = [], []
        for g in self.langs:
            text = np.concatenate([np.zeros(0, np.int64), *(np.append(symbols(p, classes), GAP) for p in points[g])])
            self.automata.append(Automaton(text, FIRST + len(self.letters)))
            self.bits.append(math.log2(max(len(text), 2)))

    def classes(self) -> np.ndarray:
        out = np.where(letter_table(), OTHER, GAP).astype(np.int32)
        out[self.letters] = np.arange(FIRST, FIRST + len(self.letters))
        return out

    def entropies(self, texts: list[str], classes: np.ndarray) -> np.ndarray:
        """Bits a symbol by (text, language); inf for a text without a letter."""
        parts = [symbols(code_points(t), classes) for t in texts]
        total = np.array([len(s) for s in parts], np.int64)
        out = np.full((len(texts), len(self.langs)), np.inf)
        for g, automaton in enumerate(self.automata):
            out[:, g] = automaton.phrases(parts) * self.bits[g] / np.maximum(total, 1)
        out[total == 0] = np.inf
        return out

    def predict(self, texts: list[str], classes: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and a score of 0 to 1: how much the least entropy stands out (a softmax with base 2**8)."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        h, n = np.zeros((0, len(self.langs))), 0
        parts, size, group = [], 0, []
        for t in texts:
            group.append(t)
            size += len(t)
            if size > 8_000_000:
                parts.append(self.entropies(group, classes))
                group, size = [], 0
        if group:
            parts.append(self.entropies(group, classes))
        h = np.concatenate(parts) if parts else h
        best = h.argmin(1) if len(h) else np.zeros(0, int)
        known = np.isfinite(h).any(1)
        low = np.where(known[:, None], h, 0).min(1) if len(h) else np.zeros(0)
        share = np.where(known, 1 / np.exp2(8 * (low[:, None] - np.where(known[:, None], h, 0))).sum(1), 0.0)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], share


def training_sample(docs: DataFrame) -> dict[str, list[str]]:
    """Whole texts by language within the bounds above, none of them held out.

    The ranking keeps TRAIN_DOCS rows a language in each task before it shuffles, and moves lengths instead of texts. What is
    broadcast and gathered is bounded by TRAIN_DOCS ids and about TRAIN_CHARS characters a language.
    """
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id", "size"))
    able = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sized = able.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"), F.length("text").alias("size"), F.xxhash64("text").alias("t"))
    room: dict[str, int] = {}
    chosen, shortest = [], {}
    for r in sized.withColumn("k", rank).where(F.col("k") <= TRAIN_DOCS).orderBy("lang", "k").toLocalIterator():
        if r["size"] <= room.setdefault(r.lang, TRAIN_CHARS):
            room[r.lang] -= r["size"]
            chosen.append((r.doc_id, r.lang, r.t, r.k))
        if r.lang not in shortest or r["size"] < shortest[r.lang][0]:
            shortest[r.lang] = (r["size"], (r.doc_id, r.lang, r.t, r.k))
    have = {c[1] for c in chosen}
    chosen += [row for lang, (_, row) in shortest.items() if lang not in have]
    ids = docs.sparkSession.createDataFrame(chosen, "doc_id long, lang string, t long, k int")
    same = able.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64("text").alias("t"), "text").join(F.broadcast(ids), ["doc_id", "lang", "t"]).groupBy("lang", "k", "t").agg(F.first("text").alias("text"))
    out: dict[str, list[str]] = {}
    for r in same.orderBy("lang", "k", "t").toLocalIterator():
        out.setdefault(r.lang, []).append(r.text)
    return out


def language_id(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score.

    Learns from text and lang of rows that are not held out; a prediction sees the text alone. Null text or a text
    without a letter: ``und``, score 0. Without labelled rows everything is ``und``. Ties go to the language that sorts
    first. Rows that repeat, share a doc_id or have none are predicted each by its own text (rows without doc_id are not
    learnt from). Empty table: empty result; other columns are left out. One pass, no shuffle of texts.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Model(training_sample(docs)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = model.value.classes()
        for batch in sliced(batches, 2):
            langs, score = model.value.predict([t or "" for t in batch.column(2).to_pylist()], classes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
