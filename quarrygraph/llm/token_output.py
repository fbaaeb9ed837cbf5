"""Token-id output in directly addressable codes.

Every id is split into chunks of ``chunk_bits`` bits, lowest chunk first. Level k holds the k-th chunk of all ids that
need it, one after another, with a bitmap that says which of them continue at level k+1, and a rank directory: the number
of set bits before each block of RANK_BLOCK bits. The token at position p is found by reading chunk p of level 0; while
its bit is set, the position in the next level is the rank of that bit, one directory entry and at most RANK_BLOCK bits
away. No block is decoded.

The file format is a Parquet folder, one row for each document in ascending doc_id order within and across part files:
``seq`` (row number in its part), ``part``, ``n_tokens``, and arrays ``chunks``, ``bitmaps``, ``ranks`` by level.
Parquet rows go through Spark's committer, so a lost executor leaves no half-written file.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, let_go, planned_bytes, worker_cache

CHUNK_BITS = 8
RANK_BLOCK = 512
#: Input bytes, as stored, for each partition that is written, at most about.
PART_BYTES = 64 << 20
#: Cached encodings in one Python worker; beyond it the seldom used half goes.
CACHE = 1_200_000


# --- the code --------------------------------------------------------------------------------------------------


def dac_encode(ids: np.ndarray, chunk_bits: int = CHUNK_BITS) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, bitmaps and rank directories by level. No ids: no levels. chunk_bits is 8 or 16."""
    kind = {8: np.uint8, 16: np.uint16}[chunk_bits]
    rest, chunks, bitmaps, ranks = np.asarray(ids, np.uint32), [], [], []
    while len(rest):
        chunks.append((rest & np.uint32((1 << chunk_bits) - 1)).astype(kind).astype(f"<u{chunk_bits // 8}").tobytes())
        higher = rest >> np.uint32(chunk_bits)
        more = higher > 0
        bitmaps.append(np.packbits(more, bitorder="little").tobytes())
        sums = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), RANK_BLOCK))
        ranks.append((np.cumsum(sums) - sums).astype("<u4").tobytes())
        rest = higher[more]
    return chunks, bitmaps, ranks


def dac_columns(ids: np.ndarray, begins: np.ndarray, chunk_bits: int = CHUNK_BITS) -> list[pa.Array]:
    """What dac_encode gives for each document ids[begins[k]:begins[k+1]], as three columns of lists of bytes, levels of all
    documents at once."""
    kind, docs = {8: np.uint8, 16: np.uint16}[chunk_bits], len(begins) - 1
    rest, n, levels, owners = np.asarray(ids, np.uint32), np.diff(begins), ([], [], []), []
    from_lengths = lambda x: np.concatenate([np.zeros(1, np.int64), np.cumsum(x, dtype=np.int64)])
    binary = lambda data, at: pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
    while len(rest):
        have = np.flatnonzero(n)
        n, at = n[have], from_lengths(n[have])
        owners.append(have if not owners else owners[-1][have])
        higher = rest >> np.uint32(chunk_bits)
        more = higher > 0
        wide, blocks = -(-n // 8), -(-n // RANK_BLOCK)
        byte, block = from_lengths(wide), from_lengths(blocks)
        padded = np.zeros(8 * byte[-1], bool)
        padded[np.arange(len(more)) + np.repeat(8 * byte[:-1] - at[:-1], n)] = more
        sums = np.add.reduceat(more.astype(np.uint32), np.repeat(at[:-1] - RANK_BLOCK * block[:-1], blocks) + RANK_BLOCK * np.arange(block[-1]))
        before = np.cumsum(sums, dtype=np.uint32) - sums
        for column, data, place in zip(levels, (
            rest.astype(kind).astype(f"<u{chunk_bits // 8}"), np.packbits(padded, bitorder="little"), (before - np.repeat(before[block[:-1]], blocks)).astype("<u4"),
        ), (at * (chunk_bits // 8), byte, 4 * block), strict=True):
            column.append(binary(data, place))
        n, rest = np.add.reduceat(more, at[:-1], dtype=np.int64), higher[more]
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    offsets, order = from_lengths(np.bincount(owner, minlength=docs)).astype(np.int32), np.argsort(owner, kind="stable")
    return [pa.ListArray.from_arrays(offsets, (pa.concat_arrays(c) if c else pa.array([], pa.large_binary())).take(pa.array(order)).cast(pa.binary())) for c in levels]


def dac_decode(n: int, chunks: list[bytes], bitmaps: list[bytes], chunk_bits: int = CHUNK_BITS) -> np.ndarray:
    """All ids, level by level."""
    out, at = np.zeros(n, np.uint32), np.arange(n)
    for k, (c, b) in enumerate(zip(chunks, bitmaps, strict=True)):
        out[at] |= np.frombuffer(c, f"<u{chunk_bits // 8}").astype(np.uint32) << np.uint32(k * chunk_bits)
        at = at[np.unpackbits(np.frombuffer(b, np.uint8), count=len(at), bitorder="little").astype(bool)]
    return out


def dac_get(p: int, chunks: list[bytes], bitmaps: list[bytes], ranks: list[bytes], chunk_bits: int = CHUNK_BITS) -> int:
    """The id at position p: per level one chunk, one bit, one directory entry and at most RANK_BLOCK bits."""
    wide, value, shift = chunk_bits // 8, 0, 0
    for c, b, r in zip(chunks, bitmaps, ranks, strict=True):
        value |= int.from_bytes(c[p * wide : (p + 1) * wide], "little") << shift
        if not b[p >> 3] >> (p & 7) & 1:
            return value
        block = p // RANK_BLOCK
        first = int.from_bytes(b[block * RANK_BLOCK // 8 : (p >> 3) + 1], "little") & ((1 << (p - block * RANK_BLOCK)) - 1)
        p = int.from_bytes(r[4 * block : 4 * block + 4], "little") + first.bit_count()
        shift += chunk_bits
    raise IndexError("a set bit at the last level")


# --- the tokenizer ---------------------------------------------------------------------------------------------

_CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
#: Texts with other white space than single spaces and line ends within.
SPACE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}"
ODD = rf"[{SPACE}][{SPACE}]|\A[{SPACE}]|[{SPACE}]\z|[\t\r\f\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]"
#: Pieces in one run, runs in one call of the library, and bytes of text handled at once (one text at least).
RUN, CALL, GROUP = 200, 64, 8_000_000


#: Places in the cached ids and in those of a group: far below 2**31, and half as wide as the default.
PLACE = np.int32


def runs_of(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n numbers from first on of each entry, one entry after another."""
    ends = np.cumsum(n, dtype=PLACE)
    out = np.repeat(first - ends + n, n)
    out += np.arange(len(out), dtype=PLACE)
    return out


class PieceEncoder:
    """Ids of whole texts with the tokenizers library, each different space-led piece encoded once.

    A text is cut before each single space, and around each single line end, that stands between two characters that are
    no white space. The byte-level pre-tokenizer starts a new unit there in any case, so the pieces' ids put together are
    the text's ids; a vocabulary with another pre-tokenizer, a normalizer or added tokens that reach over spaces is
    encoded whole instead.
    """

    def __init__(self, path: str, cache: int = CACHE, group: int = GROUP) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        spec = json.loads(self.lib.to_str())
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        self.by_piece = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
            and not any(re.search(r"\s", a["content"]) or a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)
        )
        self.mark = next((a["content"] for a in added if a["special"] and not a["normalized"]), None)
        self.by_piece = self.by_piece and self.mark is not None
        #: bytes of each id's text: a character of a byte-level token stands for one byte
        self.bytes = np.zeros(max(self.lib.get_vocab(with_added_tokens=True).values(), default=-1) + 1, np.int64)
        for token, k in self.lib.get_vocab(with_added_tokens=False).items():
            self.bytes[k] = len(token)
        for a in added:
            self.bytes[a["id"]] = len(a["content"].encode())
        self.mark_id = self.lib.token_to_id(self.mark) if self.mark else -1
        self.cache, self.group = cache, group
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.begin, self.hits = np.zeros(0, np.uint32), np.zeros(1, PLACE), np.zeros(0, np.int32)

    def shrink(self) -> None:
        """Keeps the pieces that occurred in the most groups, half of the cache at most."""
        least = 2
        while (self.hits >= least).sum() > self.cache // 2:
            least += 1
        keep = np.flatnonzero(self.hits >= least)
        names = list(self.known)
        n = self.begin[keep + 1] - self.begin[keep]
        self.flat = self.flat[runs_of(self.begin[keep], n)]
        self.begin, self.hits = np.concatenate([np.zeros(1, PLACE), np.cumsum(n, dtype=PLACE)]), self.hits[keep] - 1
        self.known = {names[k]: i for i, k in enumerate(keep.tolist())}

    def learn(self, pieces: list[str]) -> None:
        """Encodes pieces in joined runs. Those that a space leads and that end in no white space are cut from their neighbours
        by the pre-tokenizer; their ids are told apart by the bytes that ids stand for. Between others the end-of-text string,
        one known id, is put; pieces that hold it are runs of their own."""
        led, apart, alone = [], [], []
        for p in pieces:
            (alone if self.mark in p else led if p[:1] == " " and not (p[1:2] or " ").isspace() and not p[-1].isspace() else apart).append(p)
        names, flat, begin, size = [], [self.flat], [self.begin], len(self.flat)
        # a bounded number at a time: the library's results are many times as large as their ids
        for group, between, most in ((led, "", RUN * CALL), (apart, self.mark, RUN * CALL), (alone, None, CALL)):
            for k in range(0, len(group), most):
                some = group[k : k + most]
                ids, ends = self._run(some, between)
                if ids is None:  # bytes that no id stands for
                    apart += some
                    continue
                names.append(some)
                begin.append((size + ends).astype(PLACE))
                flat.append(ids)
                size += len(ids)
        self.flat, self.begin = np.concatenate(flat), np.concatenate(begin)
        self.hits = np.concatenate([self.hits, np.zeros(len(pieces), np.int32)])
        self.known.update(zip(chain(*names), range(len(self.known), len(self.known) + len(pieces)), strict=True))

    def _run(self, pieces: list[str], between: str | None) -> tuple[np.ndarray | None, np.ndarray]:
        """Ids of the pieces, encoded in runs with ``between`` between them (None: each by itself), and where each one's end."""
        joined = pieces if between is None else [between.join(pieces[k : k + RUN]) for k in range(0, len(pieces), RUN)]
        parts = [e.ids for e in self.lib.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(parts), np.uint32, sum(map(len, parts)))
        if between == "":
            after = np.cumsum(self.bytes[ids])
            stop = np.cumsum(pc.binary_length(pa.array(pieces, pa.large_string())).to_numpy(zero_copy_only=False))
            ends = np.searchsorted(after, stop)
            fits = len(after) and after[-1] == stop[-1] and bool((after[ends] == stop).all())
            return (ids if fits else None), ends + 1
        ends = np.cumsum([len(x) for x in parts], dtype=np.int64)
        if between is not None and len(ids):
            cut = ids == self.mark_id
            inner = np.flatnonzero(cut)
            ends = np.sort(np.concatenate([inner, ends]))
            ends -= np.searchsorted(inner, ends)
            ids = ids[~cut]
        return ids, ends

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, null as empty."""
        return [ids[a:b] for _, ids, at in self.groups(texts) for a, b in zip(at[:-1], at[1:], strict=True)]

    def groups(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids of it and those after it, where each text's ids begin, with one more entry) for groups of texts of
        about ``group`` bytes."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes, first = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + self.group, "right")))
            yield first, *self._group(texts.slice(first, last - first))
            first = last

    def _group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_piece or pc.any(pc.match_substring(texts, "\0")).as_py():
            parts = self.whole(texts.to_pylist())
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum([0, *map(len, parts)], dtype=np.int64)
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        cut = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
        if odd.any():
            cut = cut.to_pylist()
            for k in np.flatnonzero(odd):
                cut[k] = "\0".join(_CUT.split(texts[int(k)].as_py()))
            cut = pa.array(cut, pa.large_string())
        parts = pc.split_pattern(cut, "\0")
        coded = parts.values.dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
        place = np.fromiter(map(self.known.get, pieces, repeat(-1)), PLACE, len(pieces))
        new = np.flatnonzero(place < 0)
        if len(self.known) + len(new) > self.cache:
            self.shrink()
            place = np.fromiter(map(self.known.get, pieces, repeat(-1)), PLACE, len(pieces))
            new = np.flatnonzero(place < 0)
        if len(new):
            missing = [pieces[k] for k in new]
            self.learn(missing)
            place[new] = np.fromiter(map(self.known.__getitem__, missing), PLACE, len(new))
            del missing
        self.hits[place] += 1
        k = place[coded.indices.to_numpy()]
        offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        del cut, parts, coded, pieces
        first = self.begin[k]
        n = self.begin[k + 1] - first
        ids = self.flat[runs_of(first, n)]
        return ids, np.concatenate([np.zeros(1, np.int64), np.cumsum(n, dtype=np.int64)])[offsets]


def encoder(path: str, cache: int = CACHE, group: int = GROUP) -> PieceEncoder:
    return worker_cache(f"pieces {path} {cache} {group}", lambda: PieceEncoder(path, cache, group))


# --- Spark -----------------------------------------------------------------------------------------------------

_LEVELS = T.ArrayType(T.BinaryType())
CODED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("chunks", _LEVELS), T.StructField("bitmaps", _LEVELS), T.StructField("ranks", _LEVELS),
])
READ = "doc_id long, part int, seq long, n_tokens long, ids_crc32 long"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, partitions: int | None = None, cache: int = CACHE, group: int = GROUP) -> None:
    """Writes the ids of every whole text, end_id after each document, in ascending (doc_id, text) order.

    Null text: only the end id. Null doc_id: first. Rows that share a doc_id stay next to each other, ordered by text.
    An empty table gives an empty folder. Other columns are left out. One shuffle: a range exchange
    on doc_id, whose bounds are sampled from that column alone.
    """
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, (planned_bytes(docs) or 0) // PART_BYTES)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer, cache, group)
        for batch in batches:
            for first, found, at in enc.groups(batch.column(1)):
                m = len(at) - 1
                ids, at = np.insert(found, at[1:], np.uint32(end_id)), at + np.arange(m + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, m), pa.array([part] * m, pa.int32()), pa.array(range(seq, seq + m), pa.int64()), pa.array(np.diff(at)), *dac_columns(ids, at)],
                    names=CODED.names,
                )
                seq += m
            pa.default_memory_pool().release_unused()

    ordered.mapInArrow(code, CODED).write.mode("overwrite").parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """The files as they are."""
    return spark.read.schema(CODED).parquet(path)


def token_digest(spark, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, part, seq.

    Starts come from running sums within a part plus the sums of the parts before it; only one row for each part is
    gathered for that.
    """
    from pyspark.sql import Window as W

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            n, chunks, bits = (batch.column(k).to_pylist() for k in (3, 4, 5))
            crc = [zlib.crc32(dac_decode(m, c, b).astype("<u4").tobytes()) for m, c, b in zip(n, chunks, bits, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], names=["doc_id", "part", "seq", "n_tokens", "ids_crc32"])

    found = read_tokens(spark, path).drop("ranks").mapInArrow(digest, READ)
    sums = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("all"))
    sums = sums.select("part", (F.sum("all").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("all")).alias("base"))
    within = F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n_tokens")
    return found.withColumn("within", within).join(F.broadcast(sums), "part").select("doc_id", (F.col("base") + F.col("within")).cast("long").alias("start"), "n_tokens", "ids_crc32", "part", "seq")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, cache: int = CACHE, group: int = GROUP) -> DataFrame:
    """Writes the files below the shared folder (or to path) and returns what token_digest reads back from them.

    cache (pieces) and group (bytes of text) trade time for the memory of a Python worker; the ids do not depend on them.
    """
    path = path or fresh_path(docs.sparkSession, "token-ids")
    write_tokens(docs, path, tokenizer, end_id, cache=cache, group=group)
    return token_digest(docs.sparkSession, path)
