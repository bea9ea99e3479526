"""Event-keyed raw store, manifest and feature-matrix files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas, settings
from tidemark.runtime import materialize, remove_folders

KEY = list(settings.META_COLUMNS)


def write_partitioned(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ("ticker",),
                      mode: str = "overwrite", only_given: bool = False) -> None:
    """Write ``rows`` partitioned by entity.

    With ``only_given`` an overwrite replaces the partitions that ``rows`` has and no others; new
    files are staged beside the table and take the old ones' place when the job is committed.

    The rebalance hint lets adaptive execution cut a hot entity into several evenly sized files
    and pack many small ones into few tasks, instead of one task per entity.
    """
    (rows.hint("rebalance", *partition_by)
     .write.mode(mode).option("partitionOverwriteMode", "dynamic" if only_given else "static")
     .partitionBy(*partition_by).parquet(path))


def not_stored(events: DataFrame, stored: DataFrame | None, force: bool = False,
               key: list[str] | None = None) -> DataFrame:
    """Events that still have to be collected: those without a stored row, or all when forced."""
    if force or stored is None:
        return events
    key = key or KEY
    return events.join(stored.select(*key), key, "left_anti")


def read_if_stored(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The table at ``path``, or None when nothing was ever stored there.

    The schema is given, so an empty table can be read and a partition value keeps its type.
    """
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def append_missing(events: DataFrame, produce, path: str, stored: DataFrame | None,
                   force: bool = False, partition_by: tuple[str, ...] = ("ticker",)) -> None:
    """Produce and store rows for the events that are not stored yet.

    ``produce`` maps an event table to the rows to keep.  With ``force`` the rows of the given
    events are replaced and all others stay.  Only partitions that hold a given event are read and
    rewritten; their new content is complete in the shared folder before any of them changes.
    """
    if not force or stored is None:
        rows = produce(not_stored(events, stored, force))
        write_partitioned(rows, path, partition_by, "overwrite" if stored is None else "append")
        return
    given = materialize(events.select(*{*KEY, *partition_by}).distinct(), "forced-events")
    # Small next to the rows: the optimizer broadcasts it and prunes the scan to its partitions.
    touched = stored.join(given.select(*partition_by).distinct(), list(partition_by), "left_semi")
    kept = touched.join(given, KEY, "left_anti").select(*stored.columns)
    rows = materialize(kept.unionByName(produce(events).select(*stored.columns)), "replaced")
    # An overwrite leaves partitions alone of which nothing is left, so those are deleted.
    folder = F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1).alias("folder")
    emptied = (stored.select(*partition_by, folder).distinct()
               .join(given.select(*partition_by).distinct(), list(partition_by), "left_semi")
               .join(rows.select(*partition_by).distinct(), list(partition_by), "left_anti"))
    gone = [r["folder"] for r in emptied.toLocalIterator()]        # at most one an entity
    write_partitioned(rows, path, partition_by, only_given=True)
    remove_folders(events.sparkSession, gone)


def build_manifest(events: DataFrame, texts: DataFrame, bars: DataFrame) -> DataFrame:
    """What is available for each event: ``ticker, event_date, has_text, has_prices``.

    Events are the given ones and every stored one, so collecting some never hides the others.
    """
    keys = [d.select(*KEY) for d in (events, texts, bars)]
    known = keys[0].unionByName(keys[1]).unionByName(keys[2]).distinct()
    return _flags(known, texts, bars, "left")


def scan_manifest(texts: DataFrame, bars: DataFrame) -> DataFrame:
    """The manifest derived from stored rows alone."""
    return _flags(None, texts, bars, "full_outer")


def _flags(events: DataFrame | None, texts: DataFrame, bars: DataFrame, how: str) -> DataFrame:
    has_text = texts.select(*KEY).distinct().withColumn("has_text", F.lit(True))
    has_prices = bars.select(*KEY).distinct().withColumn("has_prices", F.lit(True))
    left = has_text if events is None else events.join(has_text, KEY, "left")
    both = left.join(has_prices, KEY, how)
    return both.select(*KEY, *[F.coalesce(c, F.lit(False)).alias(c)
                               for c in ("has_text", "has_prices")])


def manifest_or_scan(spark: SparkSession, manifest_path: str, texts: DataFrame,
                     bars: DataFrame) -> DataFrame:
    """The stored manifest when there is one, else the one derived from the store."""
    stored = read_if_stored(spark, manifest_path, schemas.MANIFEST)
    return scan_manifest(texts, bars) if stored is None else stored


def coverage(manifest: DataFrame) -> DataFrame:
    """One row: number of events, with text, with prices."""
    return manifest.agg(
        F.count("*").alias("n_events"),
        F.count_if("has_text").alias("n_text"),
        F.count_if("has_prices").alias("n_prices"),
    )


def chronological(matrix: DataFrame) -> DataFrame:
    return matrix.orderBy("event_date", "ticker")


def write_matrix(matrix: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The ordered matrix; the sort is a range shuffle, so file order is date order."""
    writer = chronological(matrix).write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def read_matrix(spark: SparkSession, path: str, fmt: str = "parquet",
                horizons=settings.TARGET_HORIZONS) -> DataFrame:
    reader = spark.read.schema(schemas.feature_matrix(horizons)).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)
