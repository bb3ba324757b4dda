"""Factor models against numpy and planted factors."""

from __future__ import annotations

import numpy as np
import pytest

from tutorlens.operators import factors


def cells_of(spark, matrix, users, items):
    rows = [(int(users[i]), int(items[j]), float(matrix[i, j])) for i, j in zip(*np.nonzero(matrix), strict=True)]
    return spark.createDataFrame(rows, "user_id long, content_id long, s double")


@pytest.mark.parametrize(("shape", "rank", "spare"), [((30, 12), 4, 8), ((25, 40), 5, 6), ((6, 9), 8, 10)])
def test_truncated_svd_equals_numpy_up_to_sign(spark, shape, rank, spare):
    """More items than directions and fewer, ids that are sparse and beyond 2 ** 53."""
    rng = np.random.default_rng(7)
    matrix = np.where(rng.random(shape) < 0.6, rng.normal(size=shape), 0.0)
    if shape[1] == 40:  # a spectrum that falls, so that few steps are enough
        matrix = (rng.normal(size=(25, 8)) * 0.5 ** np.arange(8)) @ rng.normal(size=(8, 40))
    users, items = np.arange(shape[0]) * 17 + 3, 2**53 + 1 + np.arange(shape[1]) * 5
    left, right, values = factors.truncated_svd(cells_of(spark, matrix, users, items), rank, spare=spare)
    u, s, vt = np.linalg.svd(matrix, full_matrices=False)
    rank = min(rank, len(s))
    assert np.allclose(values[:rank], s[:rank], rtol=1e-6)
    got_u, got_v = {r.user_id: r.u for r in left.collect()}, {r.content_id: r.v for r in right.collect()}
    approx = np.array([got_u.get(i, [0.0] * len(values)) for i in users]) @ np.array([got_v.get(j, [0.0] * len(values)) for j in items]).T
    assert np.allclose(approx, (u[:, :rank] * s[:rank]) @ vt[:rank], atol=1e-6)
    for k in range(rank):
        assert np.isclose(abs(np.dot([got_v[j][k] for j in items], vt[k])), 1, atol=1e-5)


def test_svd_of_low_rank_and_empty_matrices(spark):
    one = np.outer([1.0, 2.0, 0.0], [3.0, 0.0, 1.0, 1.0])
    left, _, values = factors.truncated_svd(cells_of(spark, one, range(3), range(4)), 3)
    assert np.isclose(values[0], np.linalg.svd(one)[1][0]) and all(v < 1e-6 for v in values[1:])
    assert {r.user_id for r in left.collect()} == {0, 1}
    left, right, values = factors.truncated_svd(cells_of(spark, np.zeros((2, 2)), range(2), range(2)), 2)
    assert left.count() == right.count() == 0 and values == []


def test_machine_recovers_planted_factors(spark):
    """Scores are a mean, biases and products of two planted factors; three quarters of the cells are shown, the others told."""
    rng = np.random.default_rng(5)
    n, m = 40, 25
    planted = 0.3 + rng.normal(size=(n, 1)) * 0.3 + rng.normal(size=(1, m)) * 0.2 + rng.normal(size=(n, 2)) @ rng.normal(size=(2, m)) * 0.5
    shown = rng.random((n, m)) < 0.75
    rows = lambda mask: [(int(i), int(j), float(planted[i, j])) for i, j in zip(*np.nonzero(mask), strict=True)]
    train = spark.createDataFrame(rows(shown), "user_id long, content_id long, score double")
    people, items = factors.factorisation_machine(train, rank=3, penalty=1e-3, rounds=12)
    pairs = spark.createDataFrame(rows(~shown), "user_id long, content_id long, score double")
    got = np.array([(r.predicted, planted[r.user_id, r.content_id]) for r in factors.scores(pairs, people, items).collect()])
    left_over = ((got[:, 0] - got[:, 1]) ** 2).mean() / got[:, 1].var()
    assert left_over < 0.05
    unknown = factors.scores(spark.createDataFrame([(999, 998), (None, None)], "user_id long, content_id long"), people, items).collect()
    assert [r.predicted for r in unknown] == [0.0, 0.0]


def test_machine_of_few_and_odd_rows(spark):
    rows = [(1, 1, 0.5), (1, 1, 0.5), (None, 1, 0.2), (2, None, 0.2), (2, 3, None), (2, 3, 0.9)]
    people, items = factors.factorisation_machine(spark.createDataFrame(rows, "user_id long, content_id long, score double"), rank=2, rounds=2)
    assert {r.user_id for r in people.collect()} == {1, 2} and {r.content_id for r in items.collect()} == {1, 3}
