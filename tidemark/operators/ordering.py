"""Ordered computations that do not fit one task: ranks, running products, exact medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import settings
from tidemark.runtime import materialize

_BEFORE = (W.unboundedPreceding, -1)


def ordered_slices(df: DataFrame, order: list[str], slice_name: str = "_slice") -> DataFrame:
    """``df`` range-partitioned by ``order`` and stored, with the number of each row's slice.

    Slices are consecutive ranges of the whole order, of about equal size whatever the key
    distribution.  They are stored because the ranges come from sampling: later passes must see
    the same ones.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order])
    return materialize(ranged.withColumn(slice_name, F.spark_partition_id()), "slices")


def _slice_offsets(slices: DataFrame, by: list[str], total: Column, running) -> DataFrame:
    """Per group and slice, the combined total of all earlier slices (one row per slice)."""
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(*_BEFORE)
    return (slices.groupBy(*by, "_slice").agg(total.alias("_total"))
            .select(*by, "_slice", running(F.col("_total")).over(before).alias("_offset")))


def average_rank(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Add the average rank of ``value`` within each ``by`` group (ties share their mean rank).

    Equal values are collapsed to one counted row first, so ties of any size cost one row.  Ranks
    come back by a join that adaptive execution splits where one value has very many rows.  A null
    value has a null rank.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    slices = ordered_slices(counts, [*by, value])
    offsets = _slice_offsets(slices, by, F.sum("_n"), F.sum)
    inside = W.partitionBy(*by, "_slice").orderBy(value).rowsBetween(*_BEFORE)
    placed = (
        slices.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(offsets, [*by, "_slice"])
        .withColumn("_before", F.col("_inside") + F.coalesce("_offset", F.lit(0)))
    )
    ranks = placed.select(*by, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, [*by, value], "left")


def running_products(df: DataFrame, by: list[str], order: list[str], factors: dict[str, str],
                     index: str | None = None) -> DataFrame:
    """Add cumulative products of the ``factors`` (output name -> column) in ``order``.

    ``index`` optionally names a 0-based position column.  ``order`` must be unique per group.
    """
    slices = ordered_slices(df, [*by, *order])
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(*_BEFORE)
    totals = slices.groupBy(*by, "_slice").agg(
        F.count("*").alias("_n"), *[F.product(c).alias(f"_t_{n}") for n, c in factors.items()])
    offsets = totals.select(
        *by, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"),
        *[F.coalesce(F.product(f"_t_{n}").over(before), F.lit(1.0)).alias(f"_o_{n}")
          for n in factors])
    inside = (W.partitionBy(*by, "_slice").orderBy(*order)
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    out = slices.join(offsets, [*by, "_slice"]).withColumns(
        {n: F.product(c).over(inside) * F.col(f"_o_{n}") for n, c in factors.items()})
    if index:
        out = out.withColumn(index, F.count("*").over(inside) - 1 + F.col("_at"))
    return out.drop("_slice", "_at", *[f"_o_{n}" for n in factors])


def exact_medians(df: DataFrame, columns: list[str],
                  limit: int = settings.BRACKET_VALUES) -> dict[str, float | None]:
    """Exact medians of numeric columns (mean of the middle two), without a shuffle of values.

    Each pass brackets the wanted order statistics of all columns with approximate quantiles and
    counts what lies below, until at most ``limit`` values are left between the brackets; one more
    pass then looks at all of those exactly.  ``limit`` bounds what a task holds, and the result is
    the same for any.  Only a few numbers per column reach the driver in each pass.

    ``df`` is read several times and should be a stored table.
    """
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    # one target per wanted order statistic: column, 0-based rank inside the open bracket
    found: dict[tuple[str, int], float] = {}
    targets = {}
    for c in columns:
        for rank in {(counts[c] - 1) // 2, counts[c] // 2} if counts[c] else ():
            targets[(c, rank)] = {"rank": rank, "size": counts[c], "lo": None, "hi": None}
    while items := [(k, t) for k, t in targets.items() if t["size"] > limit]:
        brackets = df.agg(*[
            F.percentile_approx(_inside(k[0], t), _bracket(t), 20_000).alias(f"q{i}")
            for i, (k, t) in enumerate(items)]).first()
        checks = []
        for i, (k, _) in enumerate(items):
            lo, hi = brackets[f"q{i}"]
            v = _inside(k[0], targets[k])
            checks += [F.count_if(v < lo).alias(f"b{i}"), F.count_if(v == lo).alias(f"l{i}"),
                       F.count_if((v > lo) & (v < hi)).alias(f"m{i}")]
        seen = df.agg(*checks).first()
        for i, (k, t) in enumerate(items):
            lo, hi = brackets[f"q{i}"]
            rank = t["rank"] - seen[f"b{i}"]
            if rank < seen[f"l{i}"]:
                found[k] = lo
                del targets[k]
            elif rank - seen[f"l{i}"] >= seen[f"m{i}"]:
                found[k] = hi
                del targets[k]
            else:
                targets[k] = {"rank": rank - seen[f"l{i}"], "size": seen[f"m{i}"],
                              "lo": lo, "hi": hi}
    if targets:
        items = list(targets.items())
        rest = df.agg(*[
            F.element_at(F.array_sort(F.collect_list(_inside(k[0], t))), t["rank"] + 1)
            .alias(f"v{i}") for i, (k, t) in enumerate(items)]).first()
        found.update((k, rest[f"v{i}"]) for i, (k, _) in enumerate(items))
    out: dict[str, float | None] = {}
    for c in columns:
        values = [v for (name, _), v in sorted(found.items()) if name == c]
        out[c] = sum(values) / len(values) if values else None
    return out


def _inside(column: str, target: dict) -> Column:
    value = F.col(column).cast("double")
    if target["lo"] is None:
        return value
    return F.when((value > target["lo"]) & (value < target["hi"]), value)


def _bracket(target: dict) -> Column:
    """Quantile levels just around the target rank; wider than the sketch's rank error."""
    level = target["rank"] / max(target["size"] - 1, 1)
    return F.array(F.lit(max(level - 0.001, 0.0)), F.lit(min(level + 0.001, 1.0)))
