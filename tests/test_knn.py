"""Nearest neighbours against brute force, with many cells, small blocks and hot groups."""

import numpy as np
import pytest

from tidemark.operators import knn

FEATURES = ["a", "b", "c"]


def _frames(spark, seed, hot):
    rng = np.random.default_rng(seed)
    def make(n, offset):
        x = rng.normal(size=(n, 3)).round(3)
        if hot:     # a third of the rows are copies of one point
            x[: n // 3] = [0.25, -0.5, 0.75]
        return [(offset + i, *map(float, row), float(i % 3 == 0)) for i, row in enumerate(x)]
    schema = "id int, a double, b double, c double, label double"
    train, queries = make(300, 0), make(90, 1000)
    return (train, queries, spark.createDataFrame(train, schema),
            spark.createDataFrame(queries, schema))


def _brute(train, queries, k):
    out = {}
    for q in queries:
        d = sorted((np.sqrt(sum((a - b) ** 2 for a, b in zip(q[1:4], t[1:4]))), t[0], t[4])
                   for t in train)
        out[q[0]] = d[:k]
    return out


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("pivots,block", [(1, 1000), (12, 1000), (12, 20)])
def test_equals_brute_force(spark, hot, pivots, block):
    train, queries, t, q = _frames(spark, 7, hot)
    near = knn.nearest_neighbours(t, q, FEATURES, 5, ("id",), ("label",), pivots, block).persist()
    want = _brute(train, queries, 5)
    got = {}
    for r in near.collect():
        got.setdefault(r["id"], []).append((r["rank"], r["n_id"], r["distance"]))
    assert set(got) == set(want)
    for i, rows in got.items():
        rows.sort()
        assert [x[1] for x in rows] == [x[1] for x in want[i]]
        assert [x[2] for x in rows] == pytest.approx([x[0] for x in want[i]])

    votes = {r["id"]: r["predicted"] for r in knn.knn_classify(near, ("id",)).collect()}
    means = {r["id"]: r["predicted"] for r in knn.knn_regress(near, ("id",)).collect()}
    for i, rows in want.items():
        exact = [d == 0 for d, _, _ in rows]
        w = [float(e) for e in exact] if any(exact) else [1 / d for d, _, _ in rows]
        up = sum(x for x, (_, _, y) in zip(w, rows) if y == 1)
        down = sum(x for x, (_, _, y) in zip(w, rows) if y == 0)
        assert votes[i] == float(round(up, 9) > round(down, 9))
        assert means[i] == pytest.approx(up / (up + down))


def test_fewer_training_rows_than_neighbours(spark):
    _, _, t, q = _frames(spark, 1, False)
    near = knn.nearest_neighbours(t.limit(3).persist(), q, FEATURES, 5, ("id",), ("label",), 2)
    assert near.count() == 90 * 3
