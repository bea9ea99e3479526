"""Joins of dated events with the dated rows around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import materialize

HEAVY_BUCKETS = 10_000         # at most so many can hold more than their share of all rows


def rows_around(events: DataFrame, rows: DataFrame, before: int, after: int,
                entity: str = "ticker", at: str = "event_date", day: str = "date",
                salts: int = 1, heavy_rows: int | None = None) -> DataFrame:
    """Pairs of events and rows of the same entity with ``at - before <= day < at + after``.

    Time is cut into buckets as wide as the window.  An event reaches into at most two of them and
    a row lies in one, so the range join is an equi join on (entity, bucket) with a residual range
    check.  The work is spread over time even when one entity owns a large part of the rows, the
    optimizer broadcasts the events only when their measured size is small, and adaptive skew
    splitting applies otherwise.  With ``salts`` > 1 the rows of each bucket are dealt to that many
    tasks and the (few) events of the bucket are copied to each, for data where one entity has very
    many rows per day.

    ``heavy_rows`` salts by itself: rows are counted once a bucket, and only those of buckets with
    more rows than that (or than a ten-thousandth of all, whichever is more) are dealt to as many
    tasks as they fill.  So the table of heavy buckets is short at any size, and is broadcast.
    """
    width = before + after
    first, last = F.date_sub(at, before), F.date_add(at, after - 1)

    def bucket(date):
        return F.floor(F.unix_date(date) / F.lit(width)).cast("int")

    spread = events.withColumn("_bucket", F.explode(F.sequence(bucket(first), bucket(last))))
    # The outermost dates, as scalars that the scan of the rows gets as plain bounds.
    spans = events.agg(F.min(first).alias("first"), F.max(last).alias("last"))
    placed = rows.where((F.col(day) >= spans.select("first").scalar())
                        & (F.col(day) <= spans.select("last").scalar()))
    placed = placed.withColumn("_bucket", bucket(F.col(day)))
    on = [entity, "_bucket"]
    if heavy_rows is not None:
        heavy = heavy_buckets(placed, on, heavy_rows)
        on.append("_salt")
        spread = spread.join(F.broadcast(heavy), on[:2], "left").withColumn("_salt", F.explode(
            F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
        placed = placed.join(F.broadcast(heavy), on[:2], "left").withColumn("_salt", F.pmod(
            F.xxhash64(*rows.columns), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    elif salts > 1:
        on.append("_salt")
        spread = spread.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        placed = placed.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts))
                                   .cast("int"))
    return (
        spread.join(placed, on)
        .where((F.col(day) >= first) & (F.col(day) <= last))
        .drop("_bucket", "_salt")
    )


def heavy_buckets(placed: DataFrame, by: list[str], rows: int) -> DataFrame:
    """``by`` and ``_salts``: the groups of more than ``rows`` rows, and how many tasks each fills.

    At most ``HEAVY_BUCKETS`` groups: a group must also exceed that fraction of all rows.  The counts
    combine before their shuffle and read no columns but ``by``.
    """
    counts = materialize(placed.groupBy(*by).agg(F.count("*").alias("_n")), "bucket-counts")
    share = counts.agg(F.expr(f"coalesce(sum(_n), 0) div {HEAVY_BUCKETS}").alias("share"))
    limit = F.greatest(share.scalar(), F.lit(rows))
    return counts.where(F.col("_n") > limit).select(
        *by, F.ceil(F.col("_n") / limit).cast("int").alias("_salts"))
