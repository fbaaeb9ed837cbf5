"""Periodic runs of words in whole texts, found by counting matches at every lag.

A run of period q and length L has L - q consecutive words that equal the word q places on, so at lag q a text with such a
run has at least ``need(q)`` matches. The matches of all lags are counted exactly: for frequent words (heavy) the power
spectra of their indicators are added and turned back by one FFT, for all others (light) the differences of places are
counted. Only lags with enough matches are scanned for islands of consecutive matches; an island is first looked for on a grid
so coarse that an island long enough covers many of its points, then measured around them.

What known runs with a period that divides q explain is taken off the count of lag q: a new run shares fewer than 2p
matches with a run of period p (else p would be its period too), so a text of one repeated word has one lag to scan.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, sliced

#: A run is at least LEAST words long and holds its period at least TIMES times.
LEAST, TIMES = 24, 3
#: A word is heavy if its pairs of places are more than a transform's cost: PAIRS plus n log2(n) / 4.
PAIRS = 4096
#: Grid points that an island of the least length covers, at least.
GRID = 16
#: Texts whose crc32 is divisible by REPEATED repeat their words from a place on, with a period from the same number.
REPEATED, SPREAD = 10, 8


def need(q: int) -> int:
    """Consecutive matches at lag q in the shortest run of period q."""
    return max(LEAST, TIMES * q) - q


def fast_size(n: int) -> int:
    """The least 2^a 3^b 5^c that is n at least: its transforms are quick."""
    best = 1 << (n - 1).bit_length() if n > 1 else 1
    p5 = 1
    while p5 < best:
        p35 = p5
        while p35 < best:
            p = p35 << max(0, (-(-n // p35) - 1).bit_length())
            best = min(best, p)
            p35 *= 3
        p5 *= 5
    return best


def lag_matches(ids: np.ndarray, most: int) -> np.ndarray:
    """M[q] = number of i with ids[i] == ids[i + q], for q up to most; M[0] is 0. ids: word numbers from 0."""
    n = len(ids)
    count = np.bincount(ids)
    heavy = np.flatnonzero(count * count > 2 * PAIRS + n * n.bit_length() // 2)
    total = np.zeros(most + 1, np.int64)
    if len(heavy):
        size = fast_size(n + most + 1)
        power = np.zeros(size // 2 + 1)
        for w in heavy:
            f = np.fft.rfft(ids == w, size)
            power += f.real * f.real + f.imag * f.imag
        total += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    light = count >= 2
    light[heavy] = False
    place = np.flatnonzero(light[ids])
    if len(place):
        word = ids[place]
        order = np.argsort(word, kind="stable")
        word, place = word[order], place[order]
        left = np.arange(len(place))  # the places that have a k-th next one of the same word
        for k in range(1, int(count[light].max())):
            left = left[left + k < len(place)]
            left = left[word[left + k] == word[left]]
            if not len(left):
                break
            gap = place[left + k] - place[left]
            near = gap <= most  # gaps only grow with k
            left = left[near]
            total += np.bincount(gap[near], minlength=most + 1)
    total[0] = 0
    return total


def islands(ids: np.ndarray, q: int) -> list[tuple[int, int]]:
    """(first, end) of all maximal stretches of at least need(q) matches at lag q."""
    n, least = len(ids), need(q)
    step = max(1, least // GRID)
    same = ids[: n - q : step] == ids[q::step]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
    out = []
    for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
        if b - a < least // step:
            continue
        # grid points a..b-1 match, a-1 and b do not: ends lie between
        low, high = max(0, (a - 1) * step + 1), min(n - q, b * step)
        if step == 1:
            out.append((low, high))
            continue
        here = ids[low:high] == ids[low + q : high + q]
        cut = np.flatnonzero(np.diff(np.concatenate([[False], here, [False]])))
        out += [(low + x, low + y) for x, y in zip(cut[0::2].tolist(), cut[1::2].tolist(), strict=True) if y - x >= least]
    return out


def prime_factors(q: int) -> list[int]:
    out, f = [], 2
    while f * f <= q:
        if q % f == 0:
            out.append(f)
            while q % f == 0:
                q //= f
        f += 1
    return out + [q] * (q > 1)


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) by start, then period. ids: word numbers from 0."""
    n = len(ids)
    most = n // TIMES
    if n < LEAST or not most:
        return []
    left = lag_matches(ids, most)
    least = np.maximum(LEAST, TIMES * np.arange(most + 1)) - np.arange(most + 1)
    out = []
    for q in np.flatnonzero(left >= least).tolist():
        if left[q] < least[q]:  # what runs found meanwhile explain is off
            continue
        found = []
        for first, end in islands(ids, q):
            # with a shorter period, q / f would be one too for a prime f
            if not any(np.array_equal(ids[first : first + q], ids[first + q // f : first + q // f + q]) for f in prime_factors(q)):
                found.append((first, end - first + q, q))
        for run in found:
            lags = np.arange(2 * q, min(most, run[1]) + 1, q)
            left[lags] -= np.maximum(0, run[1] - lags - 2 * q)
        out += found
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeated_from(n: int, number: int) -> tuple[int, int]:
    """(a, p): from word a on, the words a .. a+p-1 are repeated."""
    g = number // REPEATED
    a = g % n
    return a, 1 + (n - a) // (TIMES + g % SPREAD)


def text_runs(text: bytes, number: int | None = None) -> tuple[list[tuple[int, int, int]], list[bytes], np.ndarray]:
    """Runs of a text, its words, and which of them stay when runs are collapsed. number: crc32 of the document's id."""
    words = text.split()
    n = len(words)
    if n and number is not None and number % REPEATED == 0:
        a, p = repeated_from(n, number)
        words = words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]
    table: dict[bytes, int] = defaultdict(itertools.count().__next__)
    ids = np.fromiter(map(table.__getitem__, words), np.int32, n)
    runs = runs_of(ids)
    stays = np.ones(n, bool)
    for start, length, period in runs:
        stays[start + period : start + length] = False
    return runs, words, stays


def digest(text: bytes, number: int | None) -> tuple:
    runs, words, stays = text_runs(text, number)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    kept = words if stays.all() else list(itertools.compress(words, stays.tolist()))
    return (
        len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(),
    )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256.

    Null or empty text has no word and no run. Rows without doc_id keep their words as they are. Rows that repeat or share a
    doc_id are judged each by its own text. Empty table: empty result; other columns are left out. One pass without a
    shuffle; memory is some forty bytes a word of the longest text.
    """
    kinds = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in sliced(batches, 2):
            rows = [digest((t or "").encode("utf-8", "replace"), h) for h, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True))], names=["doc_id", *(name for name, _ in kinds)])

    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), number.alias("number"), "text").mapInArrow(find, schema)
