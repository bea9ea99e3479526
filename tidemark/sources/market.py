"""Daily bars and event calendars."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import schemas, settings

_BAR_COLUMNS = ("open", "high", "low", "close", "volume")


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", start=None, end=None,
              entities: Iterable[str] | None = None) -> DataFrame:
    """Stored OHLCV bars; the date range (end exclusive) and entities are pushed to the scan."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.schema(schemas.BARS).option("header", True)
    return clean_bars(reader.load(path), start, end, entities)


def clean_bars(bars: DataFrame, start=None, end=None,
               entities: Iterable[str] | None = None) -> DataFrame:
    """Known columns only, one zone-free date, no bars without a close."""
    known = {c.lower(): c for c in bars.columns}
    kept = bars.select(
        F.col(known["ticker"]).alias("ticker"), F.col(known["date"]).cast("date").alias("date"),
        *[F.col(known[c]).cast("double").alias(c) for c in _BAR_COLUMNS if c in known],
    )
    if start is not None:
        kept = kept.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        kept = kept.where(F.col("date") < F.lit(end).cast("date"))
    if entities is not None:
        kept = kept.where(F.col("ticker").isin(list(entities)))
    return kept.where(F.col("close").isNotNull()) if "close" in known else kept


def read_calendar(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored calendar rows ``ticker, event_ts`` whose local wall time is kept as it is."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.schema(schemas.CALENDAR).option("header", True)
    return reader.load(path).select("ticker", F.col("event_ts").cast("timestamp_ntz")
                                    .alias("event_ts"))


def calendar_events(calendar: DataFrame, as_of=None) -> DataFrame:
    """Distinct past events ``ticker, event_date``; an event later on the ``as_of`` day is future."""
    rows = calendar.where(F.col("event_ts").isNotNull())
    if as_of is not None:
        rows = rows.where(F.col("event_ts") <= F.lit(str(as_of)).cast("timestamp_ntz"))
    return rows.select("ticker", F.to_date("event_ts").alias("event_date")).distinct()


def latest_events(events: DataFrame, n: int = settings.MAX_EVENTS_PER_ENTITY,
                  entity: str = "ticker", at: str = "event_date") -> DataFrame:
    """The latest ``n`` events of each entity.

    Written as ``row_number <= n`` so that every task cuts its share to ``n`` rows per entity
    before the shuffle, however many rows one entity has.
    """
    newest = W.partitionBy(entity).orderBy(F.col(at).desc())
    return (events.withColumn("_rank", F.row_number().over(newest))
            .where(F.col("_rank") <= n).drop("_rank"))
