"""Search of blocks of queries under plans against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrock.operators.approximate import approximate_top_k, fit_centres, with_cells
from quillrock.operators.search import block_top_k, usable
from quillrock.queries import searching

K = 7
SCHEMA = "row_id bigint, object_ref string, object_id string, grant_tokens array<string>, embedding array<double>"
#: ``principal, strategy, grant_tokens, explicit_ids``
PLANS = [
    ("user:all", "unfiltered", ["t9"], []), ("user:a", "grant_tokens", ["t1", "t2"], []), ("user:b", "exact_scan", ["t1", "t3"], ["doc:1", "doc:4", "doc:no"]),
    ("user:c", "enumerate", [], ["2", "doc:5"]), ("user:d", "enumerate", ["t2"], []), ("user:e", "grant_tokens", [], []), ("user:f", "exact_scan", [], []),
    ("user:g", "exact_scan", ["t2"], []), ("user:h", "grant_tokens", ["t1"], ["doc:1"]),
]


def rows_of(n=600, seed=3):
    """Rows in no order of ``row_id``, with equal, opposite and zero vectors, and vectors that are not usable."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 64))
    out = []
    for i in rng.permutation(n):
        i = int(i)
        v = base[i % 40] * (1 if i % 3 else 2.0) + (0 if i % 2 else 1e-7) * rng.normal(size=64)
        v = np.zeros(64) if i % 50 == 1 else -v if i % 50 == 2 else v
        v = None if i % 50 == 3 else [float("nan")] * 64 if i % 50 == 4 else v.tolist()[: 63 if i % 50 == 5 else 64]
        ref = None if i % 11 == 0 else f"doc:{i % 9}"
        out.append((i, ref, ref and ref[4:], None if i % 13 == 0 else [f"t{j}" for j in range(1, 4) if (i * 7 + j) % 4 == 0], v))
    return out


def admitted(plan, row):
    _, strategy, tokens, ids = plan
    if strategy == "unfiltered":
        return True
    by_tokens, by_ids = strategy == "grant_tokens" or bool(tokens), strategy == "enumerate" or bool(ids)
    held = (not by_tokens or bool(set(tokens) & set(row[3] or ()))) and (not by_ids or row[1] in ids or row[2] in ids)
    return (by_tokens or by_ids) and held


def best(rows, plan, q, k=K):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    can = [(r[0], float(unit(r[4]) @ unit(q))) for r in rows if r[4] and len(r[4]) == 64 and np.isfinite(r[4]).all() and admitted(plan, r)]
    return [round(s, 9) for _, s in sorted(can, key=lambda x: (-round(x[1], 12), x[0]))[:k]]


@pytest.fixture(scope="module")
def world(spark):
    rows = rows_of()
    chunks = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    rng = np.random.default_rng(5)
    q = [(i, np.zeros(64).tolist() if i % 10 == 9 else (rows[i][4] if i % 2 and rows[i][4] and len(rows[i][4]) == 64 and np.isfinite(rows[i][4]).all() else rng.normal(size=64).tolist()), PLANS[i % len(PLANS)][0]) for i in range(90)]
    asked = spark.createDataFrame(q, "query_id bigint, embedding array<double>, principal string")
    plans = spark.createDataFrame(PLANS, "principal string, strategy string, grant_tokens array<string>, explicit_ids array<string>")
    return rows, chunks, q, asked, plans


def scores(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.row_id, r.score))
    return out


@pytest.mark.parametrize("block, ids, batch", [(1_000, 1_000, 10_000), (7, 1_000, 37), (1_000, 2, 10_000)])
def test_under_plans(spark, world, monkeypatch, block, ids, batch):
    rows, chunks, q, asked, plans = world
    monkeypatch.setattr(searching, "BLOCK", block)
    monkeypatch.setattr(searching, "BLOCK_IDS", ids)
    monkeypatch.setattr("quillrock.operators.search.ROWS", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = scores(searching._searched_under(chunks, asked, plans, K))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = {p[0]: p for p in PLANS}
    for i, v, who in q:
        assert [round(s, 9) for _, s in got.get(i, [])] == best(rows, plan[who], v), (i, who)
        assert len({r for r, _ in got.get(i, [])}) == len(got.get(i, []))
    zero = [i for i, _, who in q if i % 10 == 9 and who == "user:all"]
    usable = sorted(r[0] for r in rows if r[4] and len(r[4]) == 64 and np.isfinite(r[4]).all())
    assert zero and all([r for r, _ in got[i]] == usable[:K] for i in zero)


def test_equal_scores_go_to_the_first_row(spark):
    v = [1.0] + [0.0] * 63
    rows = [(i, "doc:1", "1", ["t1"], v) for i in range(500, 0, -1)]
    got = scores(block_top_k(spark.createDataFrame(rows, SCHEMA).repartition(4), [(1, v, None), (2, v, frozenset({"t1"})), (3, v, frozenset())], K))
    assert {i: [r for r, _ in x] for i, x in got.items()} == {1: [1, 2, 3, 4, 5, 6, 7], 2: [1, 2, 3, 4, 5, 6, 7]}


def test_no_asked(spark, world):
    _, chunks, _, asked, plans = world
    assert searching._searched_under(chunks, asked.limit(0), plans, K).count() == 0


def test_planned_makes_no_pairs(spark, sf, monkeypatch):
    """A row per principal and permitted chunk, met with each query, was what took the time."""

    def pairs(*_):
        raise AssertionError("pairs of principals and chunks")

    monkeypatch.setattr(searching, "permitted_pairs", pairs)
    assert searching.search_planned(spark, sf).where(F.col("rank") == 1).count() > 0


@pytest.mark.parametrize("cells, probes", [(5, 5), (6, 2), (1, 1)])
def test_approximate_is_exact_in_the_visited_cells(spark, world, cells, probes):
    """Each cell is met with its visitors as a whole: no row, and no expression, per row and query."""
    rows, chunks, q, _, _ = world
    sets = {0: None, 1: ["t1", "t2"], 2: [], 3: ["t3"]}
    asked = spark.createDataFrame([(i, v, sets[i % 4]) for i, v, _ in q], "query_id bigint, embedding array<double>, tokens array<string>")
    found = approximate_top_k(chunks, asked, K, cells=cells, probes=probes)
    assert "zip_with" not in found._jdf.queryExecution().toString()
    got = scores(found)
    live = chunks.where(usable(F.col("embedding"), 64)).select("row_id", "embedding")
    centres = fit_centres(live, cells)
    cell = {r.row_id: r.cells[0] for r in with_cells(live, centres, 1).collect()}
    visits = {r.query_id: set(r.cells) for r in with_cells(asked, centres, probes).collect()}
    for i, v, _ in q:
        plan = ("", "unfiltered" if sets[i % 4] is None else "grant_tokens", sets[i % 4], [])
        assert [round(s, 9) for _, s in got.get(i, [])] == best([r for r in rows if cell.get(r[0]) in visits[i]], plan, v), i


def test_the_fitted_sample_is_the_same_when_cut(spark, world, monkeypatch):
    from quillrock.operators import approximate

    _, chunks, _, _, _ = world
    monkeypatch.setattr(approximate, "FIT_ROWS", 64)
    assert np.array_equal(fit_centres(chunks, 5), fit_centres(chunks, 5, n=1))
