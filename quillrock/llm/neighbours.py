"""The k most similar vectors of every vector.

Vectors are made unit length and projected to a few dimensions by a Gaussian matrix (a
2-stable projection: the projected difference of two vectors at distance ``d`` is normal with
deviation ``d`` in every dimension). A kd-tree over the projected space gives each vector a
leaf, and a leaf is one task's work: there the tree goes on down to boxes of a few hundred
vectors, and every vector visits boxes from its own outwards, computing true similarities with
their vectors. Then comes the stopping test: a vector nearer than the k-th best so far can only be
missed if it projects beyond the faces that part it from an unvisited box, or from the rest of
the tree, whose probability follows from the distances to these faces (a chi-square test of one
degree of freedom a face). Boxes that pass the test stay unvisited; while the product of the
probabilities left over exceeds ``miss``, the vector goes on as a query in another projection
and tree; vectors that are done stay as data only. The number of trees does not depend on the
number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows the trees are fitted on, at most twice as many; all rows are indexed.
FIT_ROWS = 16_384
#: Rows of a leaf and of a box in it, on average.
LEAF_ROWS, BOX_ROWS = 32_768, 512
#: A node with fewer sampled rows is cut where its next ancestor with so many would be.
NODE_SAMPLE = 16
PROJECTED = 16
ROUNDS = 8
#: Boxes that hold a missed neighbour with a smaller probability are not visited.
UNLIKELY = 0.03
#: Queries whose visits are listed at once.
QUERIES = 8_192
#: Copies of one vector that are searched for: with k + 1 of them, the copies are the answer.
_GRID = 1e5
#: Between rounds a vector travels as 16-bit fixed point, its largest component being ``_FIXED``: an
#: error of a few millionths in a similarity.
_FIXED = 32767


def packed(x: np.ndarray) -> pa.Array:
    largest = np.maximum(np.abs(x).max(1, keepdims=True, initial=0), 1e-9)
    return pa.array([r.tobytes() for r in np.round(x * (_FIXED / largest)).astype(np.int16)], pa.binary())


def unpacked(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(-1, dim).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 26.2.17, error under 1e-7."""
    z = np.abs(x)
    t = 1 / (1 + 0.2316419 * z)
    p = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * p
    return np.where(x >= 0, 1 - tail, tail)


def usable(dim: int, embedding: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the vectors with ``dim`` finite components, not all zero; and they, unit length."""
    length = np.asarray(embedding.value_lengths().fill_null(0))
    at = np.flatnonzero(length == dim)
    if not len(at):
        return at, np.zeros((0, dim), np.float32)
    x = embedding.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(float("nan"))
    x = np.asarray(x).reshape(-1, dim)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    x, at = x[good], at[good]
    x = x / np.abs(x).max(1, keepdims=True)
    return at, (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


class Tree:
    """A kd-tree with a median split of the widest dimension, over one Gaussian projection.

    Its depth follows from the wanted number of leaves alone: below nodes that hold too little of
    the sample, the cuts of other dimensions are those of the next ancestor that holds enough.
    """

    def __init__(self, sample: np.ndarray, leaves: int, seed: int):
        dim = sample.shape[1]
        self.matrix = np.random.default_rng(seed).normal(size=(dim, PROJECTED)).astype(np.float32)
        p = sample @ self.matrix
        depth = max(0, math.ceil(math.log2(max(1, leaves))))
        dims, cuts, below, parent = [-1], [0.0], [0], [-1]  # of a leaf the dimension is -1; its sides are below, below + 1
        every = np.arange(len(p))
        stack = [(0, every, every, 0, depth)]
        while stack:
            node, rows, by, used, left = stack.pop()
            if len(rows) >= NODE_SAMPLE:
                by, used = rows, 0
            for d in np.argsort(-p[by].var(0)) if left and len(by) > 1 else ():
                cut = float(np.median(p[by, d]))
                if used >> int(d) & 1 or not (p[by, d] < cut).any():
                    continue
                low = p[rows, d] < cut
                dims[node], cuts[node], below[node] = int(d), cut, len(dims)
                for part in (rows[low], rows[~low]):
                    stack.append((len(dims), part, by, used | 1 << int(d), left - 1))
                    dims.append(-1)
                    cuts.append(0.0)
                    below.append(0)
                    parent.append(node)
                break
        self.dims, self.cuts = np.array(dims, np.int8), np.array(cuts, np.float32)
        self.below, self.parent = np.array(below, np.int32), np.array(parent, np.int32)
        self.depth = depth

    def leaf(self, x: np.ndarray) -> np.ndarray:
        p, at, row = x @ self.matrix, np.zeros(len(x), np.int32), np.arange(len(x))
        for _ in range(self.depth):
            d = self.dims[at]
            down = self.below[at] + (p[row, d] >= self.cuts[at])
            at = np.where(d < 0, at, down).astype(np.int32)
        return at

    def box(self, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.full(PROJECTED, -np.inf), np.full(PROJECTED, np.inf)
        while leaf:
            up = self.parent[leaf]
            d, cut = self.dims[up], self.cuts[up]
            if leaf == self.below[up]:
                hi[d] = min(hi[d], cut)
            else:
                lo[d] = max(lo[d], cut)
            leaf = up
        return lo, hi

    def outside(self, p: np.ndarray, leaf: int, distance: np.ndarray) -> np.ndarray:
        """The probability that a point at ``distance`` from those projected to ``p`` is outside the leaf."""
        lo, hi = self.box(leaf)
        d = np.maximum(distance, 1e-6)[:, None]
        inside = _normal_cdf((hi - p) / d) - _normal_cdf((lo - p) / d)
        return 1 - np.clip(inside, 0, 1).prod(1)


def boxes_of(p: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows, lower and upper faces of the boxes of a kd-tree with ``size`` rows a box at most (more only
    of equal projections)."""
    dim = p.shape[1]
    done, stack = [], [(np.arange(len(p)), np.full(dim, -np.inf, np.float32), np.full(dim, np.inf, np.float32))]
    while stack:
        rows, lo, hi = stack.pop()
        d = int(p[rows].var(0).argmax()) if len(rows) > size else 0
        cut = np.median(p[rows, d]) if len(rows) > size else np.inf
        low = p[rows, d] < cut
        if low.all() or not low.any():
            done.append((rows, lo, hi))
            continue
        hi_low, lo_high = hi.copy(), lo.copy()
        hi_low[d] = lo_high[d] = cut
        stack += [(rows[low], lo, hi_low), (rows[~low], lo_high, hi)]
    return [x[0] for x in done], np.array([x[1] for x in done]), np.array([x[2] for x in done])


def chances(p: np.ndarray, distance: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The probability, of rows projected to ``p`` and boxes, that a point at ``distance`` lies beyond the
    faces between (the upper tail of the normal distribution, to a thousandth)."""
    z = np.maximum(np.maximum(lo[None] - p[:, None], p[:, None] - hi[None]), 0) / np.maximum(distance, 1e-3).astype(np.float32)[:, None, None]
    return np.exp(np.where(z > 0, -0.693 - z * (0.717 + 0.416 * z), 0).sum(2))


class Best:
    """The k best ids of every row of a leaf, and their similarities; ties go to the smaller id."""

    def __init__(self, near: np.ndarray, sims: np.ndarray):
        self.near, self.sims, self.k = near, sims, near.shape[1]

    def floor(self, rows: np.ndarray) -> np.ndarray:
        return self.sims[rows, self.k - 1]

    def distance(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.clip(2 - 2 * self.floor(rows), 0, 4))

    def merge(self, rows: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        if not len(rows):
            return
        own = np.unique(rows)
        rows = np.concatenate([rows, np.repeat(own, self.k)])
        ids, sims = np.concatenate([ids, self.near[own].ravel()]), np.concatenate([sims, self.sims[own].ravel()])
        order = np.lexsort((ids, -np.round(sims, 6), rows))
        rows, ids, sims = rows[order], ids[order], sims[order]
        # a pair seen twice has the same similarity up to rounding, hence stands beside itself or nearly so
        again = np.zeros(len(rows), bool)
        by_id = np.lexsort((ids, rows))
        again[by_id[1:]] = (rows[by_id[1:]] == rows[by_id[:-1]]) & (ids[by_id[1:]] == ids[by_id[:-1]])
        rows, ids, sims = rows[~again], ids[~again], sims[~again]
        start = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
        kept = rank < self.k
        self.near[own], self.sims[own] = np.iinfo(np.int64).max, -2
        self.near[rows[kept], rank[kept]], self.sims[rows[kept], rank[kept]] = ids[kept], sims[kept]


def search_leaf(x: np.ndarray, p: np.ndarray, ids: np.ndarray, asking: np.ndarray, best: Best, box_rows: int = BOX_ROWS) -> np.ndarray:
    """Bring the ``best`` of the rows ``asking`` up to date with the leaf's vectors; returns, of each, the
    probability that an unvisited box of the leaf holds a nearer one."""
    members, lo, hi = boxes_of(p, box_rows)
    asks = np.zeros(len(x), bool)
    asks[asking] = True
    own = [rows[asks[rows]] for rows in members]
    left = np.zeros(len(x))

    def compare(rows: np.ndarray, with_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = []
        for s in range(0, len(with_), 4 * box_rows):  # a box of equal projections may be larger
            w = with_[s : s + 4 * box_rows]
            dots = x[rows] @ x[w].T
            dots[rows[:, None] == w[None]] = -2
            floor = best.floor(rows)
            if len(w) > best.k:
                floor = np.maximum(floor, np.partition(dots, len(w) - best.k, axis=1)[:, len(w) - best.k])
            i, j = np.nonzero((dots >= (floor - 1e-6)[:, None]) & (dots > -2))
            found.append((rows[i], ids[w[j]], dots[i, j]))
        return tuple(np.concatenate([f[k] for f in found]) for k in range(3))

    for rows, w in zip(own, members):
        if len(rows):
            for s in range(0, len(rows), 2 * box_rows):
                best.merge(*compare(rows[s : s + 2 * box_rows], w))
    if len(members) == 1:
        return left[asking]
    start = 0
    while start < len(members):
        stop, n = start, 0
        while stop < len(members) and (n == 0 or n + len(own[stop]) <= QUERIES):
            n += len(own[stop])
            stop += 1
        for nearest in (True, False):  # first the likeliest box alone, which makes the test sharper
            visits = []
            for b in range(start, stop):
                rows = own[b]
                for s in range(0, len(rows), 2 * box_rows):
                    part = rows[s : s + 2 * box_rows]
                    chance = chances(p[part], best.distance(part), lo, hi)
                    chance[:, b] = 0
                    if nearest:
                        i, j = np.arange(len(part)), chance.argmax(1)
                        go = chance[i, j] >= UNLIKELY
                        i, j = i[go], j[go]
                    else:
                        i, j = np.nonzero(chance >= UNLIKELY)
                        left[part] = np.where(chance < UNLIKELY, chance, 0).sum(1)
                    visits.append((part[i], j))
            if visits:
                rows, to = (np.concatenate([v[k] for v in visits]) for k in (0, 1))
                order = np.argsort(to, kind="stable")
                rows, to = rows[order], to[order]
                cut = np.searchsorted(to, np.arange(len(members) + 1))
                found = [compare(rows[cut[b] + s : min(cut[b] + s + 2 * box_rows, cut[b + 1])], members[b]) for b in range(len(members)) for s in range(0, cut[b + 1] - cut[b], 2 * box_rows)]
                if found:
                    best.merge(*(np.concatenate([f[k] for f in found]) for k in range(3)))
        start = stop
    return left[asking]


def nearest_vectors(
    vectors: DataFrame, k: int = 5, dim: int = 64, id_col: str = "row_id", vector_col: str = "embedding",
    leaf_rows: int = LEAF_ROWS, miss: float = 0.01, rounds: int = ROUNDS, seed: int = 1,
) -> DataFrame:
    """``(id, neighbour, similarity)``: up to k rows for every usable vector, by cosine (ties:
    smaller id).

    Defined results: vectors that are null, of another length, not finite or all zero take no
    part. Copies of a vector are each other's neighbours; of more than k + 1 copies those with
    the smallest ids stand for all, which gives every copy its exact answer and keeps leaves
    bounded. Ids are taken as unique; null ids take no part. A table of one usable row has no
    pairs. Extra columns are not read.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where("id is not null")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            v = b.column(1)
            at, x = usable(dim, v if isinstance(v, pa.ListArray) else v.cast(pa.list_(pa.float32())))
            grid = np.round(x * _GRID).astype(np.int32)
            keys = np.array([xxhash.xxh3_64_intdigest(r.tobytes()) for r in grid], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), pa.array(keys, pa.int64()), packed(x)],
                names=["id", "copy", "x"],
            )

    cleaned = source.mapInArrow(clean, "id bigint, copy bigint, x binary")
    n = source.count()
    leaves = max(1, math.ceil(n / leaf_rows))
    thin = max(1, n // FIT_ROWS)
    fit = cleaned.where(F.pmod(F.xxhash64("id"), F.lit(thin)) == 0) if thin > 1 else cleaned
    fit_rows = fit.select("copy", "x").limit(2 * FIT_ROWS).toPandas().drop_duplicates("copy")
    sample = unpacked(pa.array(fit_rows["x"], pa.binary()), dim)
    trees = spark.sparkContext.broadcast([Tree(sample, leaves, seed * 1000 + t) for t in range(rounds)]) if len(sample) else None
    if trees is None:
        return spark.createDataFrame([], "id bigint, neighbour bigint, similarity float")

    first = F.row_number().over(Window.partitionBy("copy").orderBy("id"))
    few = cleaned.withColumn("nth", first).where(F.col("nth") <= k + 1)
    state = "id bigint, x binary, near binary, sims binary, miss double, leaf int"
    names = ["id", "x", "near", "sims", "miss", "leaf"]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.full(k, np.iinfo(np.int64).max).tobytes(), np.full(k, -2, np.float32).tobytes())
        for b in batches:
            m = b.num_rows
            x = unpacked(b.column(1), dim)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([none[0]] * m, pa.binary()), pa.array([none[1]] * m, pa.binary()), pa.array(np.ones(m)), pa.array(trees.value[0].leaf(x))],
                names=names,
            )

    def round_of(t: int):
        def run(group: pa.Table) -> pa.Table:
            tree = trees.value[t]
            x = unpacked(group.column("x"), dim)
            ids = group.column("id").to_numpy()
            near = np.frombuffer(b"".join(group.column("near").to_pylist()), np.int64).reshape(-1, k).copy()
            sims = np.frombuffer(b"".join(group.column("sims").to_pylist()), np.float32).reshape(-1, k).copy()
            missed = group.column("miss").to_numpy().copy()
            asking = np.flatnonzero(missed > miss)
            if len(asking):
                p, best = x @ tree.matrix, Best(near, sims)
                within = search_leaf(x, p, ids, asking, best)
                beyond = tree.outside(p[asking].astype(np.float64), int(group.column("leaf")[0].as_py()), best.distance(asking))
                missed[asking] *= np.minimum(1, within + beyond)
            after = trees.value[t + 1].leaf(x) if t + 1 < rounds else np.zeros(len(x), np.int32)
            return pa.table(
                [group.column("id"), group.column("x") if t + 1 < rounds else pa.nulls(len(x), pa.binary()), pa.array([r.tobytes() for r in near], pa.binary()), pa.array([r.tobytes() for r in sims], pa.binary()), pa.array(missed), pa.array(after)],
                names=names,
            )

        return run

    step = few.select("id", "x").mapInArrow(begin, state)
    for t in range(rounds):
        step = step.groupBy("leaf").applyInArrow(round_of(t), state)

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
            sims = np.frombuffer(b"".join(b.column(2).to_pylist()), np.float32)
            ids = np.repeat(b.column(0).to_numpy(), k)
            real = sims > -2
            yield pa.RecordBatch.from_arrays([pa.array(ids[real]), pa.array(near[real]), pa.array(sims[real])], names=["id", "neighbour", "similarity"])

    found = step.select("id", "near", "sims").mapInArrow(end, "id bigint, neighbour bigint, similarity float")
    copies = few.select("id", "copy").groupBy("copy").agg(F.array_sort(F.collect_list("id")).alias("ids")).where(F.size("ids") > k)
    rest = cleaned.select("id", "copy").join(copies, "copy").where(~F.array_contains("ids", F.col("id")))
    rest = rest.select("id", F.explode(F.slice("ids", 1, k)).alias("neighbour"), F.lit(1.0).cast("float").alias("similarity"))
    return found.unionByName(rest)


def neighbour_pairs(nearest: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, smaller first: one of the two is among the nearest of the other."""
    return nearest.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
