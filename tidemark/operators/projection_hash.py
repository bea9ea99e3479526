"""Approximate k nearest neighbours by hashed projections, for training sets too large for ``knn``.

Each of ``tables`` hash tables takes ``projections`` random directions from a normal distribution,
which is 2-stable: the difference of two rows' projections is their distance times a standard normal
number.  A row's bucket is its projections, shifted and cut into steps of one width, so near rows
often share it.  A query row looks into its own bucket of every table and, with ``probes``, into the
neighbouring buckets whose borders are nearest to it.  Candidates are then ranked by their true
distances, so what is returned is exact but for neighbours that shared no bucket.

Tables and queries meet in an equi-join on the bucket, which adaptive execution splits where a bucket
is hot; of equal training rows only the ``k`` first are hashed, since the others can never be among
the nearest ``k``, so copies make no bucket hot.  No task holds a bucket, and each task passes on only
the best candidates of a query row.  The width comes from the distances within a sample of at most
``SAMPLE`` training rows.  A query row with fewer than ``k`` candidates is given to the exact search.

Defined results: as in ``knn``: a null or NaN feature counts as 0, ties go by the neighbour's key, and
fewer training rows than ``k`` give as many neighbours as there are; an empty side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import knn
from tidemark.runtime import materialize, ship_by_value

ship_by_value(__name__)

TABLES = 12
PROJECTIONS = 4
PROBES = 8
SAMPLE = 2_000                 # training rows that the width is taken from
STEPS = 4.0                    # width in distances of a sampled row's k-th neighbour
SEED = 17


def vector(features: list[str]):
    return F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
                     for c in features])


def sampled_width(kept: DataFrame, n_key: list[str], k: int) -> float:
    """``STEPS`` times the median distance of a sampled row to its k-th neighbour in the sample."""
    drawn = kept.orderBy(F.xxhash64(*n_key), *n_key).limit(SAMPLE).select("t_vec").collect()
    x = np.array([r["t_vec"] for r in drawn], dtype=float)
    if len(x) < 2:
        return 1.0
    nearest = [np.sort(np.sqrt(((x - row) ** 2).sum(axis=1)))[min(k, len(x) - 1)] for row in x]
    return float(STEPS * np.median(nearest)) or 1.0


class Hashes:
    """The directions and shifts of all tables, drawn from the seed."""

    def __init__(self, size: int, width: float, tables: int, projections: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.directions = rng.normal(size=(size, tables * projections))
        self.shifts = rng.uniform(0, width, tables * projections)
        self.factors = rng.integers(1, 1 << 62, size=(tables, projections)) * 2 + 1
        self.width, self.tables, self.projections = width, tables, projections

    def places(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, projections): projections in steps of the width."""
        return ((x @ self.directions + self.shifts) / self.width).reshape(
            len(x), self.tables, self.projections)

    def keys(self, steps: np.ndarray) -> np.ndarray:
        """One number a bucket and table."""
        key = np.arange(self.tables)[None, :] + np.zeros((len(steps), 1), np.int64)
        with np.errstate(over="ignore"):
            for j in range(self.projections):
                key = (key ^ (steps[:, :, j] * self.factors[None, :, j])) * np.int64(-7046029254386353131)
                key ^= key >> np.int64(29)
        return key

    def buckets(self, x: np.ndarray, probes: int) -> np.ndarray:
        """(rows, tables * (1 + probes)): own buckets first, then those beyond the nearest borders."""
        places = self.places(x)
        steps = np.floor(places).astype(np.int64)
        rest = places - steps
        out = [self.keys(steps)]
        # Moves of one projection by one step, and of two, by the squared ways to the borders.
        ways = np.concatenate([rest, 1 - rest], axis=2) ** 2
        moves = [(j,) for j in range(2 * self.projections)]
        moves += [(a, b) for a in range(2 * self.projections) for b in range(a)
                  if a % self.projections != b % self.projections]
        cost = np.stack([ways[:, :, m].sum(axis=2) for m in map(list, moves)], axis=2)
        order = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
        change = np.zeros((len(moves), self.projections), np.int64)
        for i, move in enumerate(moves):
            for j in move:
                change[i, j % self.projections] += -1 if j < self.projections else 1
        out += [self.keys(steps + change[order[:, :, t]]) for t in range(order.shape[2])]
        return np.concatenate(out, axis=1)


def approximate_neighbours(train: DataFrame, queries: DataFrame, features: list[str], k: int = 5,
                           key: tuple[str, ...] = ("ticker", "event_date"),
                           carry: tuple[str, ...] = ("label",), tables: int = TABLES,
                           projections: int = PROJECTIONS, probes: int = PROBES,
                           width: float | None = None, seed: int = SEED) -> DataFrame:
    """As ``knn.nearest_neighbours``, but a neighbour may be missed for one that is further away.

    Both inputs are read several times and should be stored.  A larger ``width``, more ``tables`` and
    more ``probes`` find more at a higher price.
    """
    n_key, n_carry = [f"n_{c}" for c in key], [f"n_{c}" for c in carry]
    kept = train.select(*[F.col(c).alias(f"n_{c}") for c in (*key, *carry)],
                        vector(features).alias("t_vec"))
    same = W.partitionBy("t_vec").orderBy(*n_key)
    kept = kept.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k).drop("copy")
    asked = queries.select(*key, vector(features).alias("q_vec"))
    hashes = Hashes(len(features), width or sampled_width(kept, n_key, k), tables, projections, seed)

    def hashed(rows: DataFrame, column: str, more: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for i in range(0, len(pdf), 2_000):
                    part = pdf.iloc[i:i + 2_000]
                    x = np.stack(part[column].to_numpy()).astype(float)
                    yield part.assign(buckets=list(hashes.buckets(x, more)))

        schema = T.StructType(rows.schema.fields
                              + [T.StructField("buckets", T.ArrayType(T.LongType()))])
        return rows.mapInPandas(run, schema).withColumn("bucket", F.explode("buckets")).drop("buckets")

    pairs = hashed(kept, "t_vec", 0).join(hashed(asked, "q_vec", probes), "bucket")
    square = F.aggregate(F.zip_with("t_vec", "q_vec", lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                         lambda total, d: total + d)
    near = pairs.select(*key, *n_key, *n_carry, F.sqrt(square).alias("distance"))
    order = W.partitionBy(*key).orderBy("distance", *n_key)
    # A training row is in one bucket a table, so it comes at most once a table.
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k * tables)
    best = best.drop("rank").dropDuplicates([*key, *n_key])
    best = materialize(best.withColumn("rank", F.row_number().over(order))
                       .where(F.col("rank") <= k), "hashed-neighbours")
    full = best.where(F.col("rank") == k).select(*key)
    short = materialize(queries.join(full, list(key), "left_anti"), "short-of-neighbours")
    if short.isEmpty():
        return best
    exact = knn.nearest_neighbours(train, short, features, k, key, carry)
    return best.join(short.select(*key).distinct(), list(key), "left_anti").unionByName(exact)


def recall(found: DataFrame, exact: DataFrame, key: tuple[str, ...] = ("ticker", "event_date")
           ) -> DataFrame:
    """One row: query rows, neighbours wanted, and the share found at least as near, rank by rank."""
    other = exact.select(*key, "rank", F.col("distance").alias("wanted"))
    both = other.join(found.select(*key, "rank", "distance"), [*key, "rank"], "left")
    hit = F.coalesce(F.col("distance") <= F.col("wanted") * (1 + 1e-9) + 1e-12, F.lit(False))
    return both.agg(F.count_distinct(*key).alias("n_queries"), F.count("*").alias("n_wanted"),
                    F.try_divide(F.count_if(hit), F.count("*")).alias("recall"))
