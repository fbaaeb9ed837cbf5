"""64-bit hashes of all words of many texts at once (numpy, no Python loop over words).

A word's hash is the polynomial sum of its bytes' random values, taken from prefix sums modulo 2^64 and mixed;
it depends on the word alone, not on its place.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
BLOCK = 1 << 20

_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
#: Random value of each byte, A-Z lower-cased.
_LOWER_BYTE = _BYTE[_ASCII_LOWER]
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII that is no letter; bytes of other characters count as letters.
NON_LETTERS = np.ones(256, bool)
NON_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: The same, but digits are kept.
NON_WORD = NON_LETTERS.copy()
NON_WORD[48:58] = False

_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 2**64))
        have = np.concatenate([have, have * step])
    _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose results look random."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _hash_block(data: np.ndarray, separator: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """data ends with a separator and begins a word or separators. Of each word the first most bytes count."""
    gap = separator[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(data) and not gap[0]:
        edge = np.concatenate([np.zeros(1, edge.dtype), edge])
    starts, ends = edge[0::2], edge[1::2]
    if most:
        ends = np.minimum(ends, starts + most)
    total = np.cumsum(_LOWER_BYTE[data] * _power(_BASE, len(data)), dtype=np.uint64)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    return mix((total[ends - 1] - before) * _power(_INVERSE, len(data))[starts]), starts


def hash_words(texts: list[bytes], separator: np.ndarray = SPACES, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and where each text's words begin (one more entry ends the last).

    With most, hashes of the first so many bytes of each word; a word that is no longer hashes as without.

    Works through blocks of about BLOCK bytes that end between words, so memory stays bounded by the longest word.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths)])
    hashes, places, at = [], [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data):
            stop = np.flatnonzero(separator[data[end : end + BLOCK]])
            if len(stop):
                end += int(stop[0]) + 1
                break
            end = min(end + BLOCK, len(data))
        h, s = _hash_block(data[at:end], separator, most)
        hashes.append(h)
        places.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), begins)


def batches(texts: list[bytes], size: int = 2 * BLOCK):
    """(first, last) ranges of texts of about size bytes together."""
    first, have = 0, 0
    for k, t in enumerate(texts):
        have += len(t)
        if have >= size:
            yield first, k + 1
            first, have = k + 1, 0
    if first < len(texts):
        yield first, len(texts)
