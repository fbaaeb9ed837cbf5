"""MinHash near-duplicates: banded MinHash, odd sketches to verify candidates, full shingle sets to confirm links.

A document's set holds its distinct ``shingle``-word shingles (64-bit hashes). Documents with equal sets are one class.
The least ``bands * rows`` hash values of a class give its bands; their parities, folded into a bitmap of SKETCH bits,
give its odd sketch. Classes that share a band are candidates. Of two sketches, the population count z of their XOR
estimates the number of different samples as -SKETCH/2 * ln(1 - 2z/SKETCH), so the similarity as one less that over twice
the samples; at high similarity this is far more exact than bands. Candidates that the sketches cannot rule out are
compared on their full sets.

Buckets of all bands with the same least member, the lead, are one group: any two classes that share a bucket share its
least member, so every candidate pair lies in such a group, and a class is sent once for each group instead of once a band.
A group is cut into blocks by its size, and every block gets the lead as well. First each block is compared within; what
links to the lead, in whatever block, is one component. A group of near copies of one text is settled by that. Then only
members outside the component of most of their group are compared with the other members, block by block, as far as they
are not connected by then. Tasks give back the links that connect, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, let_go, sliced, text_bytes, written
from .components import Labels, connected_components
from .wordhash import batches, hash_words, mix

#: .8 similar documents share none of 32 bands of 4 with a chance of 5e-8.
BANDS, ROWS, SKETCH = 32, 4, 512
#: Estimates lie within this of the truth but for about one pair in ten million (5 standard deviations and more).
MARGIN = 0.25
#: A block has so many classes and shingles at most (one larger class is a block of its own).
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1_000_000
#: Copies of sets sent on in one batch.
SENT = 512

_RNG = np.random.default_rng(7)
_MUL = _RNG.integers(1, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_BAND = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(texts: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words the whole sequence is one; no words: empty."""
    words, at = hash_words(texts)
    place = _PLACE[np.arange(shingle) % 8] ^ np.arange(shingle, dtype=np.uint64)
    n = max(len(words) - shingle + 1, 0)
    whole = np.zeros(n, np.uint64)
    for k in range(shingle):
        whole += words[k : n + k] * (place[k] | np.uint64(1))
    whole = mix(whole)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= shingle:
            yield np.unique(whole[a : b - shingle + 1])
        elif b > a:
            short = sum(int(w) * (int(p) | 1) for w, p in zip(words[a:b], place, strict=False)) * 31 + int(b - a)
            yield mix(np.array([short % 2**64], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def minima(s: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set."""
    x, out = (s >> np.uint64(32)).astype(np.uint32), np.full(len(_MUL), 2**32 - 1, np.uint32)
    for k in range(0, len(x), 4096):
        t = x[k : k + 4096, None] * _MUL[None, :]
        t += _ADD
        np.minimum(out, t.min(axis=0), out=out)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps (rows of SKETCH / 8 bytes) of rows of samples."""
    bit = (mix(samples.astype(np.uint64) + _SALT[None, :]) & np.uint64(SKETCH - 1)).astype(np.int64)
    flat = bit + np.arange(len(samples))[:, None] * SKETCH
    odd = np.bincount(flat.ravel(), minlength=len(samples) * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(samples), SKETCH), axis=1)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity estimated from sketches (arrays of uint64 words, last axis)."""
    z = np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)
    return 1 + SKETCH / (4 * BANDS * ROWS) * np.log(np.maximum(1 - 2 * z / SKETCH, 1e-9))


def farthest(near: float) -> int:
    """The most differing bits of two sketches whose estimate reaches near."""
    z = np.arange(SKETCH // 2 + 1)
    return int(z[1 + SKETCH / (4 * BANDS * ROWS) * np.log(np.maximum(1 - 2 * z / SKETCH, 1e-9)) >= near].max(initial=-1))


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys, sketch; one pass over the texts, no shuffle."""

    def sign(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in sliced(batched, 1):
            texts = text_bytes(batch.column(1))
            n = np.zeros(len(texts), np.int64)
            digest = np.zeros((len(texts), 2), np.uint64)
            samples = np.zeros((len(texts), BANDS * ROWS), np.uint32)
            for a, b in batches(texts):
                for k, s in enumerate(shingle_sets(texts[a:b], shingle), a):
                    n[k] = len(s)
                    if len(s):
                        digest[k] = s.sum(), mix(s).sum()
                        samples[k] = minima(s)
            keys = np.zeros((len(texts), BANDS), np.uint64)
            for r in range(ROWS):
                keys += samples.reshape(-1, BANDS, ROWS)[:, :, r] * _BAND[None, :, r]
            keys = mix(keys + np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            sketch = odd_sketches(samples) if len(texts) else np.zeros((0, SKETCH // 8), np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel())), pa.array([r.tobytes() for r in sketch], pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch binary")


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    Documents link where 100 * intersection >= percent * union of their sets; component_id is the least doc_id reachable.
    Null or empty texts link with nothing. A row without doc_id links with nothing, gets null component_id and is kept. Rows
    that share a doc_id are one document with several sets: each keeps its own n_shingles, and they are of one component.
    Empty table: empty result. Other columns are left out.
    """
    signed = cut(signatures(docs, shingle))
    reps = cut(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    )
    classes = reps.select("d1", "d2", F.col("n_shingles").alias("m"), "rep")
    out = signed.join(classes, (signed.d1 == classes.d1) & (signed.d2 == classes.d2) & (signed.n_shingles == F.col("m")) & signed.doc_id.isNotNull(), "left")
    out = cut(out.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")))
    # a doc_id with several sets joins their classes
    several = out.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("doc_id")
    same = out.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comp = class_components(docs, reps, same, shingle, percent)
    out = out.join(comp, "rep", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "rep")).cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def class_components(docs: DataFrame, reps: DataFrame, more: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(rep, component_id) of representatives that link to another; more(a, b): links known beforehand."""
    spark = docs.sparkSession
    banded = reps.select("rep", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1").select("band", "lead")
    groups = cut(banded.join(shared, "band").select("lead", "rep").distinct().join(reps.select("rep", "n_shingles", "sketch"), "rep"))
    # written, so that the joins below are broadcasts, or of plain exchanges in which adaptive execution can split a hot lead
    size = written(groups.groupBy("lead").agg(F.count("*").alias("members"), blocks().alias("nb")).where("members > 1").drop("members"), "near-sizes")
    groups = groups.join(size, "lead")
    parts = max(spark.sparkContext.defaultParallelism, min(100_000, groups.count() // (4 * BLOCK_ROWS)))

    # within blocks, and against the lead
    own = F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")
    mine = groups.where("rep <> lead").withColumn("i", own)
    leads = groups.where("rep = lead").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    near = mine.unionByName(leads).select("lead", "i", F.lit(0).alias("j"), "rep", F.col("rep").alias("label"), F.lit(None).cast("boolean").alias("left"), "n_shingles", "sketch", "nb")
    links = cut(confirmed(docs, near, parts, shingle, percent).unionByName(more))
    first = connected_components(links, "a", "b").withColumnRenamed("id", "rep")

    # what is not of the component of most of its group, against all others of the group
    large = cut(groups.where("nb > 1").join(first, "rep", "left").withColumn("label", F.coalesce("component_id", "rep")).select("lead", "rep", "label", "nb", "n_shingles", "sketch"))
    most = written(large.groupBy("lead", "label").agg(F.count("*").alias("n")).groupBy("lead").agg(F.max_by("label", F.struct("n", "label")).alias("most")), "near-most")
    rest = large.join(most, "lead").where("label <> most").drop("most")
    rows = written(rest.groupBy("lead").agg(blocks().alias("nr")), "near-rest")
    if rows.isEmpty():
        return first
    left = rest.join(rows, "lead").withColumn("i", F.pmod(F.xxhash64("rep"), F.col("nr")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("left", F.lit(True))
    right = large.join(rows, "lead").withColumn("j", own).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nr") - 1))).withColumn("left", F.lit(False))
    cols = ["lead", "i", "j", "rep", "label", "left", "n_shingles", "sketch", "nb"]
    second = connected_components(cut(confirmed(docs, left.select(*cols).unionByName(right.select(*cols)), parts, shingle, percent)), "a", "b")
    second = second.select(F.col("id").alias("label"), F.col("component_id").alias("final"))
    # labels that are no member's own id are in no row of first
    labelled = first.select("rep", F.col("component_id").alias("label")).unionByName(second.select(F.col("label").alias("rep"), "label")).distinct()
    return labelled.join(second, "label", "left").groupBy("rep").agg(F.min(F.coalesce("final", "label")).alias("component_id"))


def blocks():
    return F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")


def confirmed(docs: DataFrame, dealt: DataFrame, parts: int, shingle: int, percent: int) -> DataFrame:
    """(a, b) links between labels, enough to connect those that the rows of one (lead, i, j) connect on their full sets.

    dealt: lead, i, j, rep, label, left, n_shingles, sketch, nb. Rows of one label are not compared; where left is not null,
    left rows are compared with the others only. Groups of one block are dealt out in bins of about BLOCK_ROWS rows, since a
    call for each would cost more than its comparisons.
    """
    limit = farthest(percent / 100 - MARGIN)

    def plausible(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows with a partner that neither size nor sketch rules out."""
        let_go()
        pdf = pdf.sort_values(["lead", "n_shingles"], kind="stable")
        n, label, left = pdf["n_shingles"].to_numpy(), pdf["label"].to_numpy(), sides(pdf["left"])
        sketch, ok = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(len(pdf), -1), np.zeros(len(pdf), bool)
        for first, last in runs(pdf["lead"].to_numpy()):
            for a in range(first, last, 32):
                b = min(a + 32, last)
                end = a + int(np.searchsorted(n[a:last], n[b - 1] * 100 // percent, "right"))
                hit = np.bitwise_count(sketch[a:b, None] ^ sketch[None, a:end]).sum(-1, dtype=np.int64) <= limit
                hit &= (label[a:b, None] != label[None, a:end]) & (n[None, a:end] <= n[a:b, None] * 100 // percent) & ((left[a:b, None] != left[None, a:end]) | (left[a:b, None] < 0))
                hit &= np.arange(end - a)[None, :] > np.arange(b - a)[:, None]
                ok[a:b] |= hit.any(1)
                ok[a:end] |= hit.any(0)
        return pdf[ok][["bin", "lead", "i", "j", "rep", "label", "left", "sketch"]]

    keys = "bin long, lead long, i int, j int, rep long, label long, left boolean, sketch binary"
    # a bin for each block of a large group; a fixed number of partitions, since adaptive execution would merge by bytes what takes long
    spot = ["bin", F.when(F.col("bin") < 0, F.col("lead")).alias("of"), "i", "j"]
    dealt = dealt.withColumn("bin", F.when(F.col("nb") == 1, F.pmod(F.xxhash64("lead"), F.lit(4 * parts))).otherwise(F.lit(-1)).cast("long")).drop("nb")
    able = dealt.repartition(parts, *spot).groupBy(*spot).applyInPandas(plausible, keys)
    sent = written(able.groupBy("rep").agg(F.first("sketch").alias("sketch"), F.collect_set(F.struct("bin", "lead", "i", "j", "label", "left")).alias("to")), "near-sent")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(sent, "rep")

    def expand(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in sliced(batched, 1):
            raw = text_bytes(batch.column(1))
            for a, b in batches(raw):
                sets = pa.array([s.astype("<u8").tobytes() for s in shingle_sets(raw[a:b], shingle)], pa.binary())
                to = batch.column(3).slice(a, b - a)
                flat, owner = to.flatten(), np.repeat(np.arange(b - a), np.diff(to.offsets.to_numpy()))
                # a lead goes to every block of its group
                for k in range(0, len(owner), SENT):
                    some = pa.array(owner[k : k + SENT])
                    rep, sketch = (batch.column(c).slice(a, b - a).take(some) for c in (0, 2))
                    yield pa.RecordBatch.from_arrays([*flat.slice(k, SENT).flatten(), rep, sketch, sets.take(some)], names=["bin", "lead", "i", "j", "label", "left", "rep", "sketch", "set"])

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        let_go()
        # a doc_id may stand for several texts; the one sketch that was sent with them rules none of them out
        repeated = pdf.duplicated(["lead", "rep", "left"], keep=False).to_numpy()
        sets = [np.frombuffer(s, "<u8") for s in pdf["set"]]
        sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(len(sets), -1)
        label, left, lead = pdf["label"].to_numpy(), sides(pdf["left"]), pdf["lead"].to_numpy()
        order, found = np.lexsort([np.fromiter(map(len, sets), np.int64, len(sets)), lead]), []
        for first, last in runs(lead[order]):
            k = order[first:last]
            found += set_links([sets[x] for x in k], label[k], percent, left[k], sketch[k], repeated[k], limit)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    spread = texts.mapInArrow(expand, "bin long, lead long, i int, j int, label long, left boolean, rep long, sketch binary, set binary")
    return spread.repartition(parts, *spot).groupBy(*spot).applyInPandas(confirm, "a long, b long")


def runs(key: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the runs of equal keys."""
    edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]).tolist()
    return list(zip(edge[:-1], edge[1:], strict=True)) if len(key) else []


def sides(left: pd.Series) -> np.ndarray:
    """1 left, 0 right, -1 where there are no sides."""
    return np.where(left.isna(), -1, left.eq(True)).astype(np.int8)


def set_links(sets: list[np.ndarray], ids: np.ndarray, percent: int, left: np.ndarray, sketch: np.ndarray, free: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links that connect the sets with 100 * intersection >= percent * union. sets ascend by size.

    Only pairs of which not both are known to be connected are compared, only a left one with a right one where there are
    sides, and only what the sketches do not rule out (unless one of the two is free of that).
    """
    if len(sets) < 2:
        return []
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(size)])
    mark, label = np.zeros(int(code.max(initial=0)) + 1, np.int32), Labels(ids)
    for u in range(len(sets) - 1):
        end = int(np.searchsorted(size, size[u] * 100 // percent, "right"))
        rest = slice(u + 1, end)
        able = (label.label[rest] != label.label[u]) & (size[rest] > 0)
        if left[u] >= 0:
            able &= left[rest] != left[u]
        able &= free[u] | free[rest] | (np.bitwise_count(sketch[rest] ^ sketch[u]).sum(-1, dtype=np.int64) <= limit)
        others = u + 1 + np.flatnonzero(able)
        if not len(others) or not size[u]:
            continue
        mark[code[begin[u] : begin[u + 1]]] = 1
        first = np.cumsum(size[others]) - size[others]
        at = np.arange(int(size[others].sum())) + np.repeat(begin[others] - first, size[others])
        both = np.add.reduceat(mark[code[at]], first)
        mark[code[begin[u] : begin[u + 1]]] = 0
        hit = 100 * both >= percent * (size[u] + size[others] - both)
        if hit.any():
            label.join(u, others[hit])
    return label.edges
