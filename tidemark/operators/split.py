"""Chronological split, scaling statistics and class weights."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import settings
from tidemark.runtime import materialize

KEY = list(settings.META_COLUMNS)


@dataclass(frozen=True)
class Boundary:
    """The last training row in (event_date, ticker) order; no ``ticker`` takes the whole day."""

    day: date | None
    ticker: str | None = None

    def is_train(self) -> Column:
        at = F.col("event_date")
        if self.day is None:
            return F.lit(False)
        if self.ticker is None:
            return at <= F.lit(self.day)
        return (at < F.lit(self.day)) | ((at == F.lit(self.day)) & (F.col("ticker") <= self.ticker))


def find_boundary(matrix: DataFrame, ratio: float = settings.TRAIN_RATIO,
                  slice_rows: int = settings.BRACKET_VALUES) -> Boundary:
    """Where the first ``int(n * ratio)`` rows in (event_date, ticker) order end.

    Rows are counted per day (at most one number per calendar day), and only the boundary day is
    looked at by ticker, in range slices of at most about ``slice_rows`` rows.  The result is a plain predicate that the
    scan of a stored matrix can use.
    """
    days = matrix.groupBy("event_date").agg(F.count("*").alias("n"))
    sofar = W.orderBy("event_date").rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = days.withColumn("upto", F.sum("n").over(sofar))
    cut = F.floor(F.max("upto").over(W.partitionBy()) * F.lit(ratio)).cast("long")
    row = (totals.withColumn("cut", cut).where(F.col("upto") - F.col("n") < F.col("cut"))
           .orderBy(F.col("event_date").desc()).first())
    if row is None:
        return Boundary(None)
    if row["upto"] <= row["cut"]:
        return Boundary(row["event_date"])
    inside = row["cut"] - (row["upto"] - row["n"])
    return Boundary(row["event_date"],
                    _ticker_at(matrix.where(F.col("event_date") == F.lit(row["event_date"])),
                               inside, row["n"], slice_rows))


def _ticker_at(day_rows: DataFrame, position: int, rows: int, slice_rows: int) -> str:
    """The ``position``-th ticker (1-based) of one day's rows.

    Counted tickers are range-sliced so that a slice stays small however large the day is; slice
    totals lead to the one slice that holds the position.
    """
    names = day_rows.groupBy("ticker").agg(F.count("*").alias("n"))
    ranged = names.repartitionByRange(-(-rows // slice_rows), "ticker")
    slices = materialize(ranged.withColumn("_slice", F.spark_partition_id()), "slices")
    totals = slices.groupBy("_slice").agg(F.sum("n").alias("n")).orderBy("_slice")
    for part in totals.toLocalIterator():
        if position <= part["n"]:
            break
        position -= part["n"]
    upto = F.sum("n").over(W.orderBy("ticker"))
    inside = slices.where(F.col("_slice") == part["_slice"]).withColumn("upto", upto)
    return inside.where(F.col("upto") >= position).orderBy("ticker").first()["ticker"]


def chronological_split(matrix: DataFrame, ratio: float = settings.TRAIN_RATIO
                        ) -> tuple[DataFrame, DataFrame]:
    """The first ``int(n * ratio)`` rows by date for training, the rest for testing."""
    train = find_boundary(matrix, ratio).is_train()
    return matrix.where(train), matrix.where(~train)


def direction_label(value: Column) -> Column:
    """1 for a return of at least 0, else 0; null stays null."""
    return (value >= 0).cast("int")


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight of each class: ``label, n, weight`` with n_total / (n_classes * n)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    every = W.partitionBy()      # one row per class
    return counts.withColumn("weight", F.sum("n").over(every) / (F.count("*").over(every)
                                                                 * F.col("n")))


def scaling_statistics(train: DataFrame, columns=settings.FEATURE_COLUMNS
                       ) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of each column; a constant column gets scale 1."""
    row = train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def scale(rows: DataFrame, statistics: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns({c: (F.col(c) - m) / s for c, (m, s) in statistics.items()})
