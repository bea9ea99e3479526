"""Exact k nearest neighbours between two tables, without a cross join.

The training rows are grouped around pivots, whose number grows with the root of the rows.  From the distances to the pivots and
the radius of each group, the triangle inequality gives every query row an upper bound for its k-th
neighbour and with it the groups that can hold one; only those are visited.  Groups are cut into
blocks of bounded size on both sides, so a group that holds a large part of the data becomes many
tasks.  A task keeps the best k per query row, and the final top k is taken over those.  Nothing is
dropped: a group is skipped only when it provably cannot contribute.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.runtime import ship_by_value

ship_by_value(__name__)

PIVOT_SHARE = 8
_SLACK = 1e-9      # relative slack on pruning bounds against floating-point error


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all rows of ``b``, from true differences."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(out)


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.empty((0, width))


def _smallest(d: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the ``take`` smallest values of each row, ties by column."""
    limit = np.partition(d, take - 1, axis=1)[:, take - 1]
    rows, cols = np.nonzero(d <= limit[:, None])
    order = np.lexsort((cols, d[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, np.arange(len(d)))
    keep = np.arange(len(rows)) - first[rows] < take
    return rows[keep], cols[keep]


def _place(kept: DataFrame, asked: DataFrame, n_key: list[str], wanted: int, width: int, k: int
           ) -> tuple[int, DataFrame, DataFrame, dict[int, int]]:
    """Draw pivots, put every training row in the cell of its nearest pivot and every query row in
    each cell that can hold one of its ``k`` nearest.  Returns the number of cells, both tables
    with their ``cell``, and the training rows per cell."""
    # a pseudo-random draw by key, so that many copies of one point yield one pivot among others
    drawn = (kept.orderBy(F.xxhash64(*n_key), *n_key).limit(4 * wanted)
             .select("t_vec").collect())          # a few vectors a pivot
    centres = np.array(list(dict.fromkeys(tuple(r["t_vec"]) for r in drawn))[:wanted],
                       dtype=float).reshape(-1, width)

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = _distances(_matrix(pdf["t_vec"], width), centres)
            cell = d.argmin(axis=1)
            yield pdf.assign(cell=cell.astype("int32"), reach=d[np.arange(len(d)), cell])

    placed = kept.mapInPandas(to_cells, T.StructType(
        kept.schema.fields + [T.StructField("cell", T.IntegerType()),
                              T.StructField("reach", T.DoubleType())]))

    closest = W.partitionBy("cell").orderBy("reach")
    sizes = {r["cell"]: r for r in placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("reach").alias("radius")).collect()}
    nearest_members = (placed.select("cell", "reach", F.row_number().over(closest).alias("i"))
                       .where(F.col("i") <= k).collect())       # at most k numbers a pivot
    radius = np.array([sizes[c]["radius"] if c in sizes else -np.inf for c in range(len(centres))])
    members = np.full((len(centres), k), np.inf)
    for r in nearest_members:
        members[r["cell"], r["i"] - 1] = r["reach"]

    def to_candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = _distances(_matrix(pdf["q_vec"], width), centres)
            bounds = (d[:, :, None] + members[None, :, :]).reshape(len(d), -1)
            if bounds.shape[1] > k:
                limit = np.partition(bounds, k - 1, axis=1)[:, k - 1]
            else:
                limit = np.full(len(d), np.inf)
            near = d - radius[None, :] <= (limit + _SLACK * (1 + np.abs(limit)))[:, None]
            near &= np.isfinite(radius)[None, :]
            rows, cells = np.nonzero(near)
            yield pdf.iloc[rows].assign(cell=cells.astype("int32"))

    candidates = asked.mapInPandas(to_candidates, T.StructType(
        asked.schema.fields + [T.StructField("cell", T.IntegerType())]))
    return (len(centres), placed.drop("reach"), candidates,
            {c: r["n"] for c, r in sizes.items()})


def nearest_neighbours(train: DataFrame, queries: DataFrame, features: list[str], k: int = 5,
                       key: tuple[str, ...] = ("ticker", "event_date"),
                       carry: tuple[str, ...] = ("label",), pivots: int | None = None,
                       block_rows: int = 20_000) -> DataFrame:
    """The ``k`` nearest training rows of each query row.

    Returns the query key, ``n_<key>`` and ``n_<carry>`` of each neighbour, ``distance`` and
    ``rank`` (ties by neighbour key).  Both inputs are read several times and should be stored.
    A null or NaN feature counts as 0, the mean of a scaled one.  ``pivots`` is by default about a
    ``PIVOT_SHARE``-th of the square root of the training rows.
    """
    vector = F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
                       for c in features])
    n_key = [f"n_{c}" for c in key]
    n_carry = [f"n_{c}" for c in carry]
    kept = train.select(*[F.col(c).alias(f"n_{c}") for c in (*key, *carry)], vector.alias("t_vec"))
    asked = queries.select(*key, vector.alias("q_vec"))

    wanted = pivots or 1 + math.isqrt(kept.count()) // PIVOT_SHARE
    width = len(features)
    cells, placed, candidates, rows_per_cell = _place(kept, asked, n_key, wanted, width, k)
    asked_per_cell = {r["cell"]: r["count"] for r in candidates.groupBy("cell").count().collect()}

    def blocks(counts: dict) -> F.Column:
        parts = [F.lit(max(1, -(-counts.get(c, 0) // block_rows))) for c in range(cells)]
        return F.element_at(F.array(*parts), F.col("cell") + 1)

    t_blocks = blocks(rows_per_cell)
    q_blocks = blocks(asked_per_cell)

    def spread(rows: DataFrame, own: str, own_blocks, own_key, other: str, other_blocks):
        mine = F.pmod(F.xxhash64(*own_key), own_blocks).cast("int")
        return rows.withColumns({
            own: mine, other: F.explode(F.sequence(F.lit(0), other_blocks - 1))})

    left = spread(placed, "tb", t_blocks, n_key, "qb", q_blocks)
    right = spread(candidates, "qb", q_blocks, list(key), "tb", t_blocks)

    out_schema = T.StructType(
        [queries.schema[c] for c in key]
        + [T.StructField(f.name, f.dataType) for f in kept.schema if f.name != "t_vec"]
        + [T.StructField("distance", T.DoubleType())])

    def best_in_block(t: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        names = [f.name for f in out_schema]
        if t.empty or q.empty:
            return pd.DataFrame({n: [] for n in names})
        t = t.sort_values(n_key, kind="stable").reset_index(drop=True)
        tv = _matrix(t["t_vec"], width)
        take = min(k, len(t))
        out = []
        step = max(1, 4_000_000 // len(t))
        for start in range(0, len(q), step):
            part = q.iloc[start:start + step]
            d = _distances(_matrix(part["q_vec"], width), tv)
            rows, cols = _smallest(d, take)
            block = part.iloc[rows][list(key)].reset_index(drop=True)
            for c in n_key + n_carry:
                block[c] = t[c].to_numpy()[cols]
            block["distance"] = d[rows, cols]
            out.append(block)
        return pd.concat(out)[names]

    grid = ["cell", "tb", "qb"]
    found = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInPandas(
        best_in_block, out_schema)
    order = W.partitionBy(*key).orderBy("distance", *n_key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbour_weights(neighbours: DataFrame, key: tuple[str, ...] = ("ticker", "event_date")
                      ) -> DataFrame:
    """Add ``weight`` = 1 / distance; neighbours at distance 0 share all the weight."""
    mine = W.partitionBy(*key)       # at most k rows
    exact = F.count_if(F.col("distance") == 0).over(mine)
    return neighbours.withColumn("weight", F.when(exact > 0, (F.col("distance") == 0).cast("double"))
                                 .otherwise(F.try_divide(F.lit(1.0), F.col("distance"))))


def knn_classify(neighbours: DataFrame, key: tuple[str, ...] = ("ticker", "event_date"),
                 label: str = "n_label") -> DataFrame:
    """Weighted vote of the neighbours; equal votes go to the smaller label."""
    votes = (neighbour_weights(neighbours, key).groupBy(*key, label)
             .agg(F.round(F.sum("weight"), 9).alias("vote")))
    return votes.groupBy(*key).agg(
        F.min_by(label, F.struct(-F.col("vote"), F.col(label))).cast("double").alias("predicted"))


def knn_regress(neighbours: DataFrame, key: tuple[str, ...] = ("ticker", "event_date"),
                target: str = "n_label") -> DataFrame:
    """Weighted mean of the neighbours' targets."""
    return neighbour_weights(neighbours, key).groupBy(*key).agg(
        (F.sum(F.col("weight") * F.col(target)) / F.sum("weight")).alias("predicted"))
