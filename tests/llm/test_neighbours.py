import datetime as dt

import numpy as np

from folioflow.llm.neighbours import Neighbours, _apart, _beyond, nearest_vectors, neighbour_pairs

SCHEMA = "row_id bigint, embedding array<float>, indexed_at timestamp, cell int, near string"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, t, 1, "clash") for i, e, t in rows], SCHEMA)


def brute(vectors, k):
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    cos = (m @ m.T).round(6)
    np.fill_diagonal(cos, -9)
    order = np.argsort(-cos, axis=1, kind="stable")[:, : min(k, len(ids) - 1)]
    return {i: [ids[j] for j in row] for i, row in zip(ids, order)}


def result(spark, rows, p):
    return {r.row_id: r.neighbours for r in nearest_vectors(frame(spark, rows), p).collect()}


def recall(found, expected):
    return sum(len(set(found[i]) & set(e)) for i, e in expected.items()) / sum(map(len, expected.values()))


def test_quantile_of_chi_square():
    assert abs(Neighbours(projected=2, stop=0.5).chi_square() - 1.3862943611) < 1e-6
    assert abs(Neighbours(projected=6, stop=0.9).chi_square() - 10.6446407) < 1e-5


def test_boxes_are_no_farther_apart_than_their_points():
    rng = np.random.default_rng(6)
    groups = [rng.standard_normal((30, 3)) + rng.standard_normal(3) * 4 for _ in range(12)]
    low, high = np.array([g.min(axis=0) for g in groups]), np.array([g.max(axis=0) for g in groups])
    apart = _apart(low[:6], high[:6], low[6:], high[6:])
    nearest = np.array([_beyond(g, low[6:], high[6:]).min(axis=0) for g in groups[:6]])
    assert (apart <= nearest + 1e-9).all() and (apart > 0).any()


def test_many_cells_find_almost_all(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16))
    vectors = {i: (centres[i % 40] + rng.standard_normal(16) * 0.7).tolist() for i in range(3000)}
    p = Neighbours(dims=16, block=300, leaf=32, sample=1500)
    found = result(spark, [(i, v, None) for i, v in vectors.items()], p)
    assert found.keys() == vectors.keys()
    assert recall(found, brute(vectors, 10)) > 0.97


def test_hot_cell_of_copies_and_ties(spark):
    rng = np.random.default_rng(4)
    same = [1.0, 2.0, 3.0, 4.0]
    vectors = {i: same if i % 3 == 0 else rng.standard_normal(4).tolist() for i in range(600)}
    p = Neighbours(dims=4, projected=4, stop=0.99, block=64, leaf=16, k=5)
    found = result(spark, [(i, v, None) for i, v in vectors.items()], p)
    assert found[0] == [3, 6, 9, 12, 15] and found[597] == [0, 3, 6, 9, 12] and found[6] == [0, 3, 9, 12, 15]
    assert recall(found, brute(vectors, 5)) > 0.99


def test_which_vectors_are_usable(spark):
    day = dt.datetime(2031, 1, 1)
    v = [1.0, 0.0]
    rows = [
        (1, v, day), (2, [2.0, 0.1], day), (3, None, day), (4, [1.0], day), (5, [0.0, 0.0], day), (6, [float("nan"), 1.0], day),
        (7, [float("inf"), 1.0], day), (8, v, day), (8, None, day + dt.timedelta(1)), (9, None, None), (9, [0.0, 3.0], day),
        (2, [2.0, 0.1], day), (10, [1.0, None], day), (None, v, day), (11, [-1e-30, 1e-30], day),
    ]
    found = result(spark, rows, Neighbours(dims=2, projected=2))
    assert found == {1: [2, 9, 11], 2: [1, 9, 11], 9: [11, 2, 1], 11: [9, 2, 1]}
    pairs = neighbour_pairs(nearest_vectors(frame(spark, rows), Neighbours(dims=2, projected=2, k=1))).collect()
    assert {tuple(r) for r in pairs} == {(1, 2), (9, 11)}


def test_empty_and_single(spark):
    p = Neighbours(dims=2, projected=2)
    assert result(spark, [], p) == {}
    assert result(spark, [(1, [1.0, 0.0], None)], p) == {1: []}
