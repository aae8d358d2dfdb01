"""Approximate search over the stamped index: cells around centres, of which a query visits a few.

Centres are fitted by a few rounds of k-means on a bounded sample; every vector goes to its
nearest centre. A query visits the cells of its nearest centres and is answered exactly there,
among the rows its tokens admit. Filtering stands before the top-k, as everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrock.operators.search import Asked, Best, ranked, usable, vectors_of

#: Rows the centres are fitted on, at most, and the rounds of the fit.
FIT_ROWS, FIT_ROUNDS = 16_384, 8
#: Cells a query visits.
PROBES = 16


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit_centres(chunks: DataFrame, cells: int, dim: int = 64, seed: int = 1, n: int | None = None) -> np.ndarray:
    """``cells`` unit vectors, fitted on a sample by hash of ``FIT_ROWS`` rows at most, of ``n``.

    Hashes are even, so the least ``FIT_ROWS`` are among those under twice that share: each task would
    else send as many rows as are wanted in all.
    """
    live = chunks.where(usable(F.col("embedding"), dim))
    n = live.count() if n is None else n
    if n > 2 * FIT_ROWS:
        live = live.where(F.xxhash64("row_id") < (2 * FIT_ROWS << 64) // n - (1 << 63))
    rows = live.orderBy(F.xxhash64("row_id"), "row_id").select("embedding").limit(FIT_ROWS).collect()
    x = _unit(np.array([r[0] for r in rows], np.float64).reshape(-1, dim))
    x = x[(x != 0).any(1)]
    if not len(x):
        return np.zeros((1, dim))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(FIT_ROUNDS):
        nearest = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        empty = ~(sums != 0).any(1)
        sums[empty] = centres[empty]
        centres = _unit(sums)
    return centres


def with_cells(rows: DataFrame, centres: np.ndarray, probes: int, vector: str = "embedding") -> DataFrame:
    """The rows with ``cells``: their ``probes`` nearest centres, nearest first."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    dim = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = vectors_of(b.column(b.schema.get_field_index(vector)), dim) @ shared.value.T
            near = s.argmax(1)[:, None] if probes == 1 else np.argsort(-s, axis=1, kind="stable")[:, :probes]
            near = near.astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(near), pa.list_(pa.int32()))], names=[*b.schema.names, "cells"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, cells array<int>")


def approximate_top_k(chunks: DataFrame, queries: DataFrame, k: int, dim: int = 64, cells: int | None = None, probes: int = PROBES) -> DataFrame:
    """``query_id, rank, row_id, score`` of the queries ``query_id, embedding, tokens`` (null tokens:
    unfiltered), among the rows of the visited cells that the tokens admit.

    ``cells`` defaults to the square root of the number of rows, so both a cell and the list of
    centres grow with the root of the index. Each row is compared only with queries that visit its cell.
    """
    live = chunks.where(usable(F.col("embedding"), dim)).select("row_id", "embedding", "grant_tokens")
    n = live.count()
    centres = fit_centres(live, cells or max(1, math.isqrt(n)), dim, n=n)
    held = with_cells(live, centres, 1).select(F.col("cells")[0].alias("cell"), "row_id", "embedding", "grant_tokens")
    asked = with_cells(queries.where(usable(F.col("embedding"), dim)).select("query_id", "embedding", "tokens"), centres, probes)
    asked = asked.select(F.explode("cells").alias("cell"), "query_id", "embedding", "tokens")

    def met(rows: pa.Table, visits: pa.Table) -> pa.Table:
        number: dict[frozenset[str] | None, int] = {}
        of = [number.setdefault(None if t is None else frozenset(t), len(number)) for t in visits["tokens"].to_pylist()]
        vectors = vectors_of(visits["embedding"].combine_chunks(), dim)
        best = Best(Asked(visits["query_id"].to_numpy(), vectors, [(t, None) for t in number], np.array(of, np.int64)), k)
        if visits.num_rows:
            for b in rows.to_batches():
                best.see(b["row_id"].to_numpy(), vectors_of(b["embedding"], dim), b["grant_tokens"])
        return pa.Table.from_batches([best.rows()])

    scored = held.groupBy("cell").cogroup(asked.groupBy("cell")).applyInArrow(met, "query_id bigint, row_id bigint, score double")
    return ranked(scored, "query_id", max(0, k))
