"""Vector search over the rows that a plan permits: filter, then score, then top-k.

Scores are cosines in double precision, summed in component order. Ties go to the row that
stands first (``row_id``). The wrong order, top-k first and filter after, exists as a
measured baseline only.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrock.plans.compiler import bindings, overlaps


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def usable(a: Column, dim: int) -> Column:
    """A vector of the right length, all finite."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(a) == dim) & finite, F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Unchecked:
    """Hits of the index: a hint, not an answer. Only ``rechecked`` makes them showable."""

    rows: DataFrame


@dataclass(frozen=True)
class Hits:
    """Hits that the live tuples allow."""

    rows: DataFrame
    epoch: int


def permitted(chunks: DataFrame, plan: dict) -> DataFrame:
    """The chunks (``object_ref, object_id, grant_tokens``) that one compiled plan admits.

    Tokens (as many as the principal has usersets) are tested in the scan; ids, of which a plan
    carries ``EXACT_SCAN_MAX`` at most, are a semi-join with a table of that bound.
    """
    strategy, tokens, ids = plan["strategy"], plan["grant_tokens"], plan["explicit_ids"]
    if strategy == "unfiltered":
        return chunks
    by_tokens, by_ids = strategy == "grant_tokens" or bool(tokens), strategy == "enumerate" or bool(ids)
    if not (by_tokens or by_ids) or (by_tokens and not tokens) or (by_ids and not ids):
        return chunks.limit(0)
    if by_tokens:
        chunks = chunks.where(overlaps(F.col("grant_tokens"), F.array(*[F.lit(t) for t in tokens])))
    if by_ids:
        listed = chunks.sparkSession.createDataFrame([(i,) for i in ids], "__id string")
        chunks = chunks.join(F.broadcast(listed), (F.col("__id") == F.col("object_ref")) | (F.col("__id") == F.col("object_id")), "left_semi")
    return chunks


def permitted_pairs(chunks: DataFrame, plans: DataFrame) -> DataFrame:
    """``principal, row_id, matched_token`` of what plans that are not unfiltered admit.

    Chunks and plans meet on equal tokens and on equal ids, both exploded; each plan then keeps
    the rows that meet all conditions it binds, so one that binds an empty set keeps none.
    """
    by_tokens, by_ids = bindings(F.col("strategy"), F.col("grant_tokens"), F.col("explicit_ids"))
    p = plans.where("strategy <> 'unfiltered'").select("principal", "grant_tokens", "explicit_ids", by_tokens.alias("by_tokens"), by_ids.alias("by_ids"))
    c = chunks.select("row_id", "object_ref", "object_id", "grant_tokens")
    token = c.select("row_id", F.explode("grant_tokens").alias("token")).join(p.select("principal", F.explode("grant_tokens").alias("token")), "token")
    token = token.groupBy("principal", "row_id").agg(F.min("token").alias("matched_token"))
    ids = p.select("principal", F.explode("explicit_ids").alias("id"))
    named = c.select("row_id", F.explode(F.array_distinct(F.array("object_ref", "object_id"))).alias("id")).where("id is not null")
    listed = named.join(ids, "id").select("principal", "row_id").distinct().withColumn("listed", F.lit(True))
    met = token.join(listed, ["principal", "row_id"], "full").join(p.select("principal", "by_tokens", "by_ids"), "principal")
    held = (~F.col("by_tokens") | F.col("matched_token").isNotNull()) & (~F.col("by_ids") | F.col("listed").isNotNull()) & (F.col("by_tokens") | F.col("by_ids"))
    return met.where(held).select("principal", "row_id", "matched_token")


def ranked(scored: DataFrame, query: str, k: int) -> DataFrame:
    """The k best rows of each query, by score and then position; ``rank`` from 1."""
    w = Window.partitionBy(query).orderBy(F.desc("score"), "row_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k_of_pairs(pairs: DataFrame, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, row_id, score`` over the permitted ``principal, row_id`` pairs of the queries
    ``query_id, embedding, principal``; ``k`` of zero or less gives none."""
    v = chunks.select("row_id", F.col("embedding").alias("v"))
    q = queries.select("query_id", F.col("embedding").alias("q"), "principal")
    scored = pairs.select("principal", "row_id").join(v, "row_id").join(q, "principal").withColumn("score", cosine(F.col("v"), F.col("q")))
    return ranked(scored.where(~F.isnan("score")).select("query_id", "row_id", "score"), "query_id", max(0, k))


#: Rows and queries of one matrix product, and cells of the table of filters by rows.
ROWS, COLUMNS, ADMITTED = 2_048, 1_024, 16_000_000


class Asked:
    """Queries by what they may see: ``filters`` of ``(tokens, ids)`` (None: does not bind; an empty set
    admits nothing), ``of`` the filter of each query. Zero vectors, to which every row scores 0, stand last."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, filters: list[tuple[Collection[str] | None, Collection[str] | None]], of: np.ndarray):
        n = np.linalg.norm(vectors, axis=1)
        order = np.lexsort((of, ~(n > 0)))
        self.ids, self.q = ids[order], (vectors / np.where(n > 0, n, 1)[:, None])[order]
        self.q32, of, self.directed = self.q.astype(np.float32), of[order], int((n > 0).sum())
        parts = (of[: self.directed], 0), (of[self.directed :], self.directed)
        numbers = np.arange(len(filters))
        self.slices = [(np.searchsorted(x, numbers) + at, np.searchsorted(x, numbers, "right") + at) for x, at in parts]
        self.n_filters = len(filters)
        self.free, self.by = [], []
        for side in (0, 1):
            self.free.append(np.array([f[side] is None for f in filters], bool))
            by: dict[str, list[int]] = {}
            for i, f in enumerate(filters):
                for v in f[side] or ():
                    by.setdefault(v, []).append(i)
            self.by.append({v: np.array(x, np.int32) for v, x in by.items()})


def _where(values: pa.Array, rows: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """Each value with the rows it stands in."""
    coded = values.dictionary_encode()
    there = values.is_valid().to_numpy(zero_copy_only=False)
    codes = coded.indices.drop_null().to_numpy()
    order = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))
    return zip(coded.dictionary.to_pylist(), np.split(rows[there][order], ends[:-1])) if len(ends) else iter(())


class Best:
    """The ``k`` best rows so far of each query of a block; only a row that can be among them is kept.

    Matrix products in single precision, whose error is below ``slack``, tell which rows can; those are
    scored in double precision, so scores and ties are the exact ones.
    """

    def __init__(self, asked: Asked, k: int):
        self.asked, self.k = asked, max(1, k)
        self.score = np.full((len(asked.ids), self.k), -np.inf)
        self.row = np.full((len(asked.ids), self.k), np.iinfo(np.int64).max)
        self.slack = 2e-7 * asked.q.shape[1]

    def see(self, ids: np.ndarray, x: np.ndarray, tokens: pa.Array, names: tuple[pa.Array, ...] = ()) -> None:
        """Rows with their vectors, tokens and the ids they go by."""
        n = np.linalg.norm(x, axis=1)
        x = x / np.where(n > 0, n, 1)[:, None]
        x32, step = x.astype(np.float32), max(256, ADMITTED // max(1, self.asked.n_filters))
        for i in range(0, len(ids), step):
            at = slice(i, i + step)
            self._admit(ids[at], x[at], x32[at], tokens[at], [v[at] for v in names])

    def _admit(self, ids: np.ndarray, x: np.ndarray, x32: np.ndarray, tokens: pa.Array, names: list[pa.Array]) -> None:
        a, every = self.asked, np.arange(len(ids))
        held = []
        for side, stands in ((0, [(tokens.flatten(), tokens)]), (1, [(v, None) for v in names])):
            held.append(np.repeat(a.free[side][:, None], len(ids), 1))
            for values, lists in stands if a.by[side] else ():
                for v, rows in _where(values, every if lists is None else lists.value_parent_indices().to_numpy()):
                    if (own := a.by[side].get(v)) is not None:
                        held[side][np.ix_(own, rows)] = True
        held = held[0] & held[1]
        common = held.all(0)
        rows = np.flatnonzero(common)
        self._offer(ids[rows], x[rows], x32[rows], [(0, a.directed), (a.directed, len(a.ids))])
        held &= ~common
        for f in np.flatnonzero(held.any(1)):
            rows = np.flatnonzero(held[f])
            self._offer(ids[rows], x[rows], x32[rows], [(lo[f], hi[f]) for lo, hi in a.slices])

    def _offer(self, ids: np.ndarray, x: np.ndarray, x32: np.ndarray, parts: list[tuple[int, int]]) -> None:
        (lo, hi), (zero, end) = parts
        if not len(ids):
            return
        for i in range(0, len(ids), ROWS):
            for j in range(lo, hi, COLUMNS):
                self._product(ids[i : i + ROWS], x[i : i + ROWS], x32[i : i + ROWS], j, min(hi, j + COLUMNS))
        if end > zero:
            first = np.sort(ids)[: self.k]
            self._merge(np.repeat(np.arange(zero, end), len(first)), np.tile(first, end - zero), np.zeros(len(first) * (end - zero)))

    def _product(self, ids: np.ndarray, x: np.ndarray, x32: np.ndarray, lo: int, hi: int) -> None:
        s = self.asked.q32[lo:hi] @ x32.T
        cut = (self.score[lo:hi, -1] - self.slack).astype(np.float32)
        hit = s >= cut[:, None]
        if len(ids) > self.k and np.count_nonzero(hit) > 4 * self.k * len(s):
            least = np.partition(s, len(ids) - self.k, axis=1)[:, len(ids) - self.k] - np.float32(2 * self.slack)
            hit = s >= np.maximum(cut, least)[:, None]
        at = np.flatnonzero(hit)
        if len(at):
            q, r = np.divmod(at, len(ids))
            q += lo
            exact = np.einsum("ij,ij->i", self.asked.q[q], x[r])
            can = exact >= self.score[q, -1]
            self._merge(q[can], ids[r[can]], exact[can])

    def _merge(self, q: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        own = np.unique(q)
        q = np.concatenate([q, np.repeat(own, self.k)])
        row, score = np.concatenate([row, self.row[own].ravel()]), np.concatenate([score, self.score[own].ravel()])
        order = np.lexsort((row, -score, q))
        starts = np.searchsorted(q[order], own)
        order = order[(starts[:, None] + np.arange(self.k)).ravel()]
        self.row[own], self.score[own] = row[order].reshape(-1, self.k), score[order].reshape(-1, self.k)

    def rows(self) -> pa.RecordBatch:
        q, at = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.asked.ids[q]), pa.array(self.row[q, at]), pa.array(self.score[q, at])], names=["query_id", "row_id", "score"])


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def asked_top_k(chunks: DataFrame, asked: Asked, k: int, dim: int = 64) -> DataFrame:
    """``query_id, rank, row_id, score`` of a block of queries over the rows that their filters admit.

    Each task keeps its own k best per query, so what is shuffled grows with tasks, not rows.
    """
    block = chunks.sparkSession.sparkContext.broadcast(asked)
    named = ["object_ref", "object_id"] if asked.by[1] else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(block.value, k)
        for b in batches:
            best.see(b.column(0).to_numpy(), vectors_of(b.column(1), dim), b.column(2), tuple(b.columns[3:]))
        yield best.rows()

    rows = chunks.where(usable(F.col("embedding"), dim)).select("row_id", "embedding", "grant_tokens", *named)
    return ranked(rows.mapInArrow(run, "query_id bigint, row_id bigint, score double"), "query_id", k)


def block_top_k(chunks: DataFrame, queries: list[tuple[int, list[float], frozenset[str] | None]], k: int, dim: int = 64) -> DataFrame:
    """``query_id, rank, row_id, score`` for a block of queries ``(id, vector, tokens)``; ``tokens`` of
    None is unfiltered, an empty set admits nothing."""
    number: dict[frozenset[str] | None, int] = {}
    of = np.array([number.setdefault(t, len(number)) for _, _, t in queries], np.int64)
    vectors = np.array([v for _, v, _ in queries], np.float64).reshape(-1, dim)
    return asked_top_k(chunks, Asked(np.array([i for i, _, _ in queries], np.int64), vectors, [(t, None) for t in number], of), k, dim)


def post_filtered(top: DataFrame, k: int, allowed: Column) -> DataFrame:
    """The baseline: of an unfiltered top-k, what the plan allows; never padded back to k."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return top.where(allowed).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall(found: Column, truth: Column) -> Column:
    """The share of the truth that was found; 1 where there is nothing to find."""
    return F.when(F.size(truth) == 0, 1.0).otherwise(F.size(F.array_intersect(found, truth)) / F.size(truth))


def upserted(base: DataFrame, changes: DataFrame, key: str = "chunk_id", order: str = "row_id") -> DataFrame:
    """Insert or replace by key: the last write's columns at the first write's position."""
    every = base.unionByName(changes)
    others = [c for c in every.columns if c not in (key, order)]
    agg = every.groupBy(key).agg(F.min(order).alias(order), F.max_by(F.struct(*others), order).alias("__v"))
    return agg.select(key, order, "__v.*")
