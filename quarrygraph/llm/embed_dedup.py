"""Embedding near-duplicates: spherical k-means cells, blocked cosine products between cells, one kept for each group.

Equal vectors are one class and compared once. Each class lies at home in the cell of its nearest centre and visits every
other cell that could be the home of a vector within the threshold: for unit x, y with |x - y| <= d and centres p
(nearest to x) and q (nearest to y), (q - p).y <= d |p - q|. So no link is lost for slack = 1; a smaller slack scales that
margin and trades recall for fewer visits where vectors are spread in many directions.

Cells lie one after another in a few blocks, near ones together; a cell with more vectors than a block lies in several. A
vector goes to the pairs of its own block with those in which a cell that it visits lies, so it is dealt a block's number of
times at most, however many cells it visits; in a pair's task, of two cells only those vectors are multiplied that visit the
other one. Nothing grows with the square of the number of centres.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, let_go
from .components import connected_components

#: Vectors a cell aimed at; sample bound for the centres in rows and bytes; a block's rows and bytes (as doubles) at most; blocks
#: at least, where there are vectors for a cell in each.
CELL, SAMPLE, SAMPLE_BYTES, BLOCK, BLOCK_BYTES, BLOCKS = 1024, 20_000, 64 << 20, 1 << 17, 64 << 20, 8
#: Products with centres held at once; rows and columns of those of vectors.
PRODUCTS, TILE = 1 << 20, 1024


def unit_rows(vectors: list) -> tuple[list, list, list]:
    """(digest of the unit vector or None, the components as packed little-endian floats, dimension).

    Floats of four bytes where these hold every component exactly, else of eight.
    """
    key, packed, dim = [], [], []
    for v in vectors:
        x = None if v is None or any(c is None for c in v) else np.asarray(v, np.float64)
        if x is not None and len(x) and np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
            with np.errstate(over="ignore"):
                short = x.astype("<f4")
            packed.append((short if np.array_equal(short, x) else x.astype("<f8")).tobytes())
            x = x / top
            key.append(hashlib.blake2b((x / math.sqrt(float(x @ x))).astype("<f8").tobytes(), digest_size=16).digest())
            dim.append(len(x))
        else:
            key.append(None)
            packed.append(None)
            dim.append(0)
    return key, packed, dim


def unpacked(packed: list[bytes], dim: int) -> np.ndarray:
    """The unit vectors of packed components, a row each."""
    x, width = np.empty((len(packed), dim)), np.array([len(p) // dim for p in packed], int)
    for n, kind in ((4, "<f4"), (8, "<f8")):
        at = np.flatnonzero(width == n)
        x[at] = np.frombuffer(b"".join([packed[k] for k in at]), kind).reshape(-1, dim)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def centres_of(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Spherical k-means on a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        centre = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-300)[:, None], centre)
    return centre


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unit rows of a and of b."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def margin(threshold: float, slack: float) -> float:
    """The distance of unit vectors at the threshold, scaled."""
    return slack * math.sqrt(max(2 - 2 * threshold, 0))


def visited(near: np.ndarray, own: np.ndarray, between: np.ndarray, d: float) -> np.ndarray:
    """Boolean by (vector, cell), from products with the cells' centres and with the own one, and the centres' distances from that."""
    return own[:, None] - near <= d * between + 1e-9


def cells(x: np.ndarray, centre: np.ndarray, threshold: float, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, own) of each vector's home and of its visits."""
    d, rows, out = margin(threshold, slack), max(1, PRODUCTS // len(centre)), []
    for a in range(0, len(x), rows):
        near = x[a : a + rows] @ centre.T
        home = near.argmax(1)
        r, c = np.nonzero(visited(near, near[np.arange(len(near)), home], apart(centre[home], centre), d))
        out.append((a + r, c, home[r] == c))
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, int) for k in range(3))


class Blocks:
    """Which blocks the cells of one dimension lie in. Sizes of cells are those of a sample, scaled to all n vectors."""

    def __init__(self, centre: np.ndarray, sample: np.ndarray, n: int, blocks: int) -> None:
        count = np.bincount((sample @ centre.T).argmax(1), minlength=len(centre))
        self.centre, self.size, self.blocks = centre, np.maximum(count * n // len(sample), 1), blocks
        # near cells one after another: by groups of centres
        group = (centre @ centres_of(centre, min(blocks, len(centre))).T).argmax(1)
        order = np.argsort(group, kind="stable")
        self.first = np.empty(len(centre), np.int64)
        self.first[order] = np.cumsum(self.size[order]) - self.size[order]
        self.rows = -(-int(self.size.sum()) // blocks)
        lo, hi = self.first // self.rows, (self.first + self.size - 1) // self.rows
        self.holds = (lo[:, None] <= np.arange(blocks)) & (np.arange(blocks) <= hi[:, None])

    def place(self, x: np.ndarray, key: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, own block, block, cell) for every block in which a cell that the vector visits lies; key deals a cell over its blocks."""
        rows, out = max(1, PRODUCTS // len(self.centre)), []
        for a in range(0, len(x), rows):
            near = x[a : a + rows] @ self.centre.T
            home = near.argmax(1)
            seen = visited(near, near[np.arange(len(near)), home], apart(self.centre[home], self.centre), d)
            r, block = np.nonzero(seen.astype(np.float32) @ self.holds.astype(np.float32))
            own = (self.first[home] + key[a : a + rows] % self.size[home]) // self.rows
            out.append((a + r, own[r], block, home[r]))
        return tuple(np.concatenate(o) for o in zip(*out))


class Rows:
    """Vectors of one side of a pair of blocks, ordered by cell."""

    def __init__(self, table: pa.Table, dim: int) -> None:
        cell = table["cell"].to_numpy()
        order = np.argsort(cell, kind="stable")
        self.cell, self.start = np.unique(cell[order], return_index=True)
        self.end = np.append(self.start[1:], len(cell))
        self.no, self.rep, self.copies = (table[c].to_numpy()[order] for c in ("no", "rep", "copies"))
        self.x = unpacked(table["packed"].to_pylist(), dim)[order]
        self.links = np.zeros(len(cell), np.int64)

    def visiting(self, k: int, other: Rows, centre: np.ndarray | None, d: float) -> np.ndarray:
        """Boolean by (row of the k-th cell, cell of other)."""
        x = self.x[self.start[k] : self.end[k]]
        if centre is None:
            return np.ones((len(x), len(other.cell)), bool)
        own, to = centre[self.cell[k]], centre[other.cell]
        return visited(x @ to.T, x @ own, apart(own[None], to), d)


class Groups:
    """Groups of rows that are linked, each row with a lesser one of its group or itself."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, rows: np.ndarray) -> np.ndarray:
        at = self.up[rows]
        while ((on := self.up[at]) != at).any():
            at = on
        self.up[rows] = at
        return at

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.root(a), self.root(b)
            if not len(a := a[(other := a != b)]):
                return
            b = b[other]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean by (row of a, row of b): cosine in double precision at least the threshold."""
    return a @ b.T >= threshold


def embedding_links(vectors: DataFrame, threshold: float = 0.95, cell: int = CELL, slack: float = 1.0) -> DataFrame:
    """Per row of vectors: vec_id, n_links, component_id, kept.

    n_links: other rows with cosine >= threshold, equal vectors among them. Null, empty, zero and non-finite vectors link
    with nothing, vectors of different dimension neither, and rows without a vec_id take no part: n_links 0, component_id
    their own vec_id (null), kept. Rows that share a vec_id are one id with several vectors: each reports its own links, and
    all of them the least id that the id reaches by any. Empty table: empty result. Labels and other columns are left out.
    """

    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, packed, dim = unit_rows(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.binary()), pa.array(packed, pa.binary()), pa.array(dim, pa.int32())], names=["vec_id", "key", "packed", "dim"])

    rows = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(norm, "vec_id long, key binary, packed binary, dim int"))
    able = F.col("key").isNotNull() & F.col("vec_id").isNotNull()
    alone = rows.where(~able).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    # equal unit vectors have one digest; the components of any of them stand for all
    classes = rows.where(able).groupBy("key").agg(F.first("packed").alias("packed"), F.first("dim").alias("dim"), F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("no", F.monotonically_increasing_id()))
    per = class_links(classes, threshold, cell, slack)
    counted = classes.select("no", "key", "rep", "copies").join(per["counts"], "no", "left").select("key", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    held = cut(rows.where(able).select("vec_id", "key").join(counted, "key").select("vec_id", "rep", "n_links"))
    # an id with several vectors joins their classes
    several = held.groupBy("vec_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("vec_id")
    same = held.join(several, "vec_id").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    comp = connected_components(per["edges"].unionByName(same), "a", "b").withColumnRenamed("id", "rep")
    joined = held.join(comp, "rep", "left").select("vec_id", "n_links", F.coalesce("component_id", "rep").alias("component_id"))
    return joined.unionByName(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def dealt(classes: DataFrame, threshold: float, cell: int, slack: float) -> tuple[DataFrame, Broadcast]:
    """classes(no, key, packed, dim, rep, copies) by pairs of blocks (dim, i, j), left for those of block i; what the centres are."""
    spark = classes.sparkSession
    n = classes.groupBy("dim").agg(F.count("*").alias("n")).collect()  # a row for each dimension
    plan: dict[int, Blocks] = {}
    for r in n:
        if (k := -(-r.n // cell)) > 1:
            most = max(2, min(SAMPLE, SAMPLE_BYTES // (8 * r.dim)))
            rows = classes.where(F.col("dim") == r.dim).select("key", "packed").orderBy("key").limit(most).collect()
            sample = unpacked([bytes(s.packed) for s in rows], r.dim)
            block = max(64, min(BLOCK, BLOCK_BYTES // (8 * r.dim)))
            # a centre for four vectors of the sample at most
            centre = centres_of(sample, max(2, min(k, len(sample) // 4)))
            plan[r.dim] = Blocks(centre, sample, r.n, max(-(-r.n // block), min(BLOCKS, k)))
    held, d = spark.sparkContext.broadcast(plan), margin(threshold, slack)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, dims = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            key = np.array([int.from_bytes(k[:7]) for k in batch.column(2).to_pylist()], np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if (blocks := held.value.get(int(dim))) is None:
                    row, own, block, home = np.arange(len(at)), *np.zeros((3, len(at)), int)
                else:
                    row, own, block, home = blocks.place(unpacked([packed[k] for k in at], int(dim)), key[at], d)
                i, j = np.minimum(own, block), np.maximum(own, block)
                for s in range(0, len(row), 16384):
                    part = slice(s, s + 16384)
                    kept = batch.select([0, 1, 3, 4, 5]).take(pa.array(at[row[part]]))
                    yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c[part].astype(np.int32)) for c in (i, j, home)), pa.array((own == i)[part])], names=["packed", "dim", "no", "rep", "copies", "i", "j", "cell", "left"])

    placed = classes.select("packed", "dim", "key", "no", "rep", "copies").mapInArrow(place, "packed binary, dim int, no long, rep long, copies long, i int, j int, cell int, left boolean")
    pairs = sum(b.blocks * (b.blocks + 1) // 2 for b in plan.values()) + len(n) - len(plan)
    # more partitions than pairs, so that few share one
    return placed.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2 * pairs, 10_000)), "dim", "i", "j"), held


def class_links(classes: DataFrame, threshold: float, cell: int, slack: float) -> dict[str, DataFrame]:
    """counts(no, links): rows linked in other classes. edges(a, b): enough links between representatives to connect."""
    rows, held = dealt(classes, threshold, cell, slack)
    d = margin(threshold, slack)

    def compare(table: pa.Table) -> pa.Table:
        let_go()
        dim, i, j = (table[c][0].as_py() for c in ("dim", "i", "j"))
        centre = plan.centre if (plan := held.value.get(dim)) else None
        a = Rows(table.filter(table["left"]), dim)
        b = a if i == j else Rows(table.filter(pc.invert(table["left"])), dim)
        del table
        offset = 0 if i == j else len(a.x)
        groups = Groups(offset + len(b.x))

        def multiply(ra: np.ndarray, rb: np.ndarray, same: bool) -> None:
            for s in range(0, len(ra), TILE):
                for t in range(0, len(rb), TILE):
                    u, v = ra[s : s + TILE], rb[t : t + TILE]
                    hit = linked(a.x[u], b.x[v], threshold)
                    if same:
                        hit &= u[:, None] < v
                    if not hit.any():
                        continue
                    p, q = np.nonzero(hit)
                    p, q = u[p], v[q]
                    np.add.at(a.links, p, b.copies[q])
                    np.add.at(b.links, q, a.copies[p])
                    groups.join(p, offset + q)

        back = [b.visiting(m, a, centre, d) for m in range(len(b.cell))]
        for k in range(len(a.cell)):
            to = a.visiting(k, b, centre, d)
            for m in range(k if i == j else 0, len(b.cell)):
                if i == j and k == m:
                    ra = rb = np.arange(a.start[k], a.end[k])
                else:
                    ra, rb = a.start[k] + np.flatnonzero(to[:, m]), b.start[m] + np.flatnonzero(back[m][:, k])
                if len(ra) and len(rb):
                    multiply(ra, rb, i == j and k == m)
        sides = [a] if i == j else [a, b]
        no, links, rep = (np.concatenate([getattr(side, c) for side in sides]) for c in ("no", "links", "rep"))
        root, some = groups.root(np.arange(len(no))), links > 0
        other = root != np.arange(len(no))
        one = pa.table({"no": no[some], "links": links[some]})
        two = pa.table({"a": rep[other], "b": rep[root[other]]})
        return pa.concat_tables([one, two], promote_options="default").select(["no", "links", "a", "b"])

    found = cut(rows.groupBy("dim", "i", "j").applyInArrow(compare, "no long, links long, a long, b long"))
    return {"counts": found.where("links IS NOT NULL").groupBy("no").agg(F.sum("links").alias("links")), "edges": found.where("a IS NOT NULL").select("a", "b")}
