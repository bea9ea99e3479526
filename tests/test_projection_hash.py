"""Approximate neighbours against the exact ones."""

import numpy as np
import pytest

from tidemark.operators import knn, projection_hash

FEATURES = [f"f{i}" for i in range(8)]
SCHEMA = "id int, " + ", ".join(f"{c} double" for c in FEATURES) + ", label double"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, *map(float, v), float(i % 2))
                                  for i, v in enumerate(x)], SCHEMA).persist()


def hits(found, exact):
    """Share of the exact neighbours that were found."""
    a = {(r.id, r.n_id) for r in exact.collect()}
    return len(a & {(r.id, r.n_id) for r in found.collect()}) / len(a)


@pytest.mark.parametrize("kind", ["even", "clusters", "copies"])
def test_recall_against_the_exact_search(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 8))
    if kind == "clusters":
        x = rng.normal(size=(40, 8))[rng.integers(0, 40, 3000)] * 5 + x * 0.3
    if kind == "copies":
        x[:1000] = x[0]                             # one point holds a third of the rows
    train, queries = frame(spark, x), frame(spark, x[::25] + rng.normal(size=(120, 8)) * 0.05, 10_000)
    exact = knn.nearest_neighbours(train, queries, FEATURES, 5, ("id",)).persist()
    found = projection_hash.approximate_neighbours(train, queries, FEATURES, 5, ("id",)).persist()
    assert found.columns == exact.columns or set(found.columns) == set(exact.columns)
    assert found.groupBy("id").count().where("count <> 5").count() == 0
    told = projection_hash.recall(found, exact, ("id",)).first()
    assert hits(found, exact) >= 0.9 and (told.n_queries, told.n_wanted) == (120, 600)
    true = {(r.id, r.n_id): r.distance for r in exact.collect()}
    for r in found.collect():
        if (r.id, r.n_id) in true:
            assert r.distance == pytest.approx(true[r.id, r.n_id], abs=1e-12)


def test_far_queries_and_few_rows_go_to_the_exact_search(spark):
    rng = np.random.default_rng(4)
    train = frame(spark, rng.normal(size=(50, 8)))
    far = frame(spark, rng.normal(size=(5, 8)) + 1000, 500)
    for rows in (train, train.limit(3).persist(), train.limit(0)):
        found = projection_hash.approximate_neighbours(rows, far, FEATURES, 5, ("id",))
        exact = knn.nearest_neighbours(rows, far, FEATURES, 5, ("id",)) if rows.count() else None
        want = sorted((r.id, r.rank, r.n_id) for r in exact.collect()) if exact else []
        assert sorted((r.id, r.rank, r.n_id) for r in found.collect()) == want
    assert projection_hash.approximate_neighbours(train, far.limit(0), FEATURES, 5,
                                                  ("id",)).collect() == []


def test_probes_find_more_and_keys_are_spread():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 8))
    hashes = projection_hash.Hashes(8, 1.0, 3, 4, 1)
    own, probed = hashes.buckets(x, 0), hashes.buckets(x, 6)
    assert own.shape == (500, 3) and probed.shape == (500, 21) and (probed[:, :3] == own).all()
    assert all(len(set(row)) == 21 for row in probed.tolist())
    moved = hashes.buckets(x + 0.02, 0)
    assert (moved == own).mean() < np.mean([[b in row for b in new] for row, new in
                                            zip(probed.tolist(), moved.tolist())])
