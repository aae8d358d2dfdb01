import numpy as np

import pytest

from quillrock.llm import neighbours as N
from quillrock.llm.neighbours import nearest_vectors, neighbour_pairs


def frame(spark, rows):
    return spark.createDataFrame([(i, v, i % 2) for i, v in rows], "row_id bigint, embedding array<float>, id int")


def brute(x, ids, k):
    s = np.round(x @ x.T, 5)
    np.fill_diagonal(s, -9)
    return {(int(ids[i]), int(ids[j])) for i in range(len(x)) for j in sorted(range(len(x)), key=lambda j: (-s[i, j], ids[j]))[:k]}


@pytest.mark.parametrize("leaf_rows", [150, 3_000])
def test_recall_against_brute_force(spark, leaf_rows):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 64))
    x = (centres[rng.integers(0, 60, 2400)] + 0.15 * rng.normal(size=(2400, 64))) * rng.uniform(0.1, 9, (2400, 1))
    ids = rng.permutation(2400)
    got = {(r.id, r.neighbour) for r in nearest_vectors(frame(spark, [(int(i), v.tolist()) for i, v in zip(ids, x)]), leaf_rows=leaf_rows).collect()}
    want = brute(x / np.linalg.norm(x, axis=1, keepdims=True), ids, 5)
    assert len(got & want) / len(want) >= 0.9 and len(got) == len(want)


def test_copies_and_unusable(spark):
    a, b = np.eye(64)[0].tolist(), np.eye(64)[1].tolist()
    rows = [(i, a) for i in range(1, 41)] + [(100, b), (101, None), (102, [0.0] * 64), (103, [1.0] * 3), (104, [float("nan")] * 64), (105, [float("inf")] + [0.0] * 63), (106, []), (None, a)]
    got = {}
    for r in nearest_vectors(frame_null(spark, rows)).collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert set(got) == set(range(1, 41)) | {100}
    assert all(sorted(v) == [x for x in range(1, 7) if x != i][:5] for i, v in got.items() if i < 100)
    assert len(got[100]) == 5
    pairs = neighbour_pairs(nearest_vectors(frame_null(spark, rows)))
    assert pairs.where("id_a >= id_b").count() == 0


def frame_null(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, embedding array<float>")


def test_small(spark):
    assert nearest_vectors(frame_null(spark, [])).count() == 0
    assert nearest_vectors(frame_null(spark, [(1, np.eye(64)[0].tolist())])).count() == 0
    assert nearest_vectors(frame_null(spark, [(1, np.eye(64)[0].tolist()), (2, np.eye(64)[1].tolist())])).count() == 2


def clumps(rng, n, groups=80, spread=0.15):
    x = rng.normal(size=(groups, 64))[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, 64))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_leaves_stay_bounded_with_a_small_sample():
    """More leaves than the sample has rows: cuts of ancestors go on, and every leaf is a small part."""
    rng = np.random.default_rng(4)
    x = clumps(rng, 60_000, 3_000, 0.4)
    tree = N.Tree(x[:256], 1024, 1)
    size = np.bincount(tree.leaf(x))
    size = size[size > 0]
    assert len(size) > 700 and size.max() < 20 * len(x) / 1024
    leaf = tree.leaf(x[:500])
    for i in range(500):
        lo, hi = tree.box(int(leaf[i]))
        p = x[i] @ tree.matrix
        assert (p >= lo - 1e-4).all() and (p <= hi + 1e-4).all()


def test_boxes_of_a_leaf():
    """Visits of likely boxes find nearly all that a comparison with the whole leaf finds, whatever is split."""
    rng = np.random.default_rng(5)
    x = clumps(rng, 4_000)
    ids = rng.permutation(4_000).astype(np.int64)
    p = x @ rng.normal(size=(64, N.PROJECTED)).astype(np.float32)
    members, lo, hi = N.boxes_of(p, 128)
    assert sorted(np.concatenate(members)) == list(range(4_000)) and max(map(len, members)) <= 128
    want = brute(x, ids, 5)
    for queries in (N.QUERIES, 300):
        N.QUERIES, before = queries, N.QUERIES
        best = N.Best(np.full((4_000, 5), np.iinfo(np.int64).max), np.full((4_000, 5), -2, np.float32))
        left = N.search_leaf(x, p, ids, np.arange(4_000), best, 128)
        N.QUERIES = before
        got = {(int(i), int(j)) for i, row in zip(ids, best.near) for j in row}
        assert len(got & want) / len(want) > 0.9 and (left >= 0).all()
        assert all(len(set(row)) == 5 for row in best.near)


def test_equal_projections_and_ties():
    """All rows are one point but for a digit: one box holds them all, ties go to the smaller id."""
    x = np.zeros((700, 64), np.float32)
    x[:, 0] = 1
    best = N.Best(np.full((700, 5), np.iinfo(np.int64).max), np.full((700, 5), -2, np.float32))
    N.search_leaf(x, np.zeros((700, 16), np.float32), np.arange(700), np.arange(700), best, 100)
    for i in (0, 3, 600):
        assert sorted(best.near[i]) == [j for j in range(6) if j != i][:5]
