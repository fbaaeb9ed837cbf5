"""Token counts by byte-pair merging with a heap and a linked list; no ids are made.

For a sentencepiece BPE model: a text's symbols are its characters, white space escaped, with the model's dummy prefix.
The adjacent pair whose joined piece has the best rank is merged, leftmost first, again and again. The count is the
initial symbols minus the merges, plus for each symbol left outside the vocabulary the bytes beyond its first that byte
fallback writes. Merges never join across the start of a word, since no piece has the space mark after another
character; so a text is counted word by word and equal words once. A model that has such pieces is counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced, worker_cache

MARK = "▁"
#: Cached words in one Python worker; beyond it the cache is emptied.
CACHE = 600_000


class Merger:
    """ranks: the piece of every possible merge to its rank, the least first; size(c): tokens of an unmerged symbol."""

    def __init__(self, path: str) -> None:
        import sentencepiece as sp

        lib = sp.SentencePieceProcessor(model_file=path)
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(lib.serialized_model_proto())
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("needs a byte-pair model with the identity normalizer that keeps all white space")
        if any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        normal = [(p.piece, p.score) for p in model.pieces if p.type == 1]
        # equal scores merge leftmost first, so they share a rank
        order = {s: k for k, s in enumerate(sorted({s for _, s in normal}, reverse=True))}
        self.ranks = {p: order[s] for p, s in normal}
        self.fallback = model.trainer_spec.byte_fallback
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.ranks)
        self.known: dict[str, int] = {}

    def merged(self, text: str) -> int:
        """Tokens of a text whose white space is escaped."""
        n = len(text)
        if n < 2:
            return self._size(text) if n else 0
        symbols: list = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.ranks.get
        heap = [(r, i, x) for i in range(n - 1) if (r := rank(x := symbols[i] + symbols[i + 1])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            _, i, joined = heappop(heap)
            left = symbols[i]
            if left is None or (j := after[i]) >= n or len(left) + len(symbols[j]) != len(joined) or left + symbols[j] != joined:
                continue  # one of the pair was merged meanwhile
            symbols[i], symbols[j] = joined, None
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(x := joined + symbols[k])) is not None:
                    heappush(heap, (r, i, x))
            if (h := before[i]) >= 0 and (r := rank(x := symbols[h] + joined)) is not None:
                heappush(heap, (r, h, x))
        return n - merges + sum(self._size(s) - 1 for s in symbols if s is not None and len(s) == 1)

    def _size(self, symbol: str) -> int:
        return 1 if symbol in self.ranks or not self.fallback else len(symbol.encode("utf-8", "replace"))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_word:
            return self.merged((MARK if self.prefix else "") + text.replace(" ", MARK))
        words = text.split(" ")
        known, total, spaces = self.known, 0, 0 if self.prefix else -1
        try:
            if self.prefix and "" not in words and MARK not in text:
                return sum(map(known.__getitem__, words))
        except KeyError:
            pass
        if MARK in text:
            words = text.replace(MARK, " ").split(" ")
        for k, w in enumerate(words):
            if k or self.prefix:
                spaces += 1
            if not w and k < len(words) - 1:
                continue
            if spaces == 1 and w:
                if (c := known.get(w)) is None:
                    if len(known) >= CACHE:
                        known.clear()
                    c = self.merged(MARK + w)
                    if len(w) < 64:
                        known[w] = c
                total += c
            else:
                total += self.merged(MARK * spaces + w)
            spaces = 0
        return total


def merger(path: str) -> Merger:
    return worker_cache(f"words {path}", lambda: Merger(path))


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens, over_limit. Null text counts as empty: 0 and 0.

    Rows keep their partitions: one pass, no shuffle. Repeated rows come out repeated, an empty table empty; other
    columns are left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(model)
        for batch in sliced(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [m.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) if t.isascii() else len(t.encode("utf-8", "replace")) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
