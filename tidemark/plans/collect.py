"""From registry, filing indexes and documents to filings, and from those to the raw store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas, settings
from tidemark.operators import documents, prices
from tidemark.plans import features
from tidemark.runtime import materialize
from tidemark.sources import filings as index
from tidemark.sources import store

KEY = list(settings.META_COLUMNS)


def filings_from_index(registry: DataFrame, recent: DataFrame, archives: list[DataFrame],
                       pages: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """The filings of registered entities with their texts, as ``collect_events`` takes them.

    ``registry`` is ``ticker, cik``; ``recent`` and ``archives`` are blocks of filing indexes;
    ``pages`` holds the documents of filings: ``cik, accession, doc_no`` (0 = primary), ``name`` and
    ``text``.  ``tickers`` (one column, ``ticker``, in any case) limits the entities before anything
    is exploded or shuffled.

    Only index rows of wanted forms and with a valid date are joined with texts; the ids of those
    filings reduce ``pages`` before a text is chosen.  An unknown entity has no filings.  An entity
    registered under several names files under each.  A filing without a text stays, with a null
    text, and can then not be chosen.  ``ord`` is the place in the index: equal dates go by it.
    """
    wanted = registry
    if tickers is not None:
        names = tickers.select(F.upper("ticker").alias("ticker")).distinct()
        wanted = registry.join(names, "ticker", "left_semi")
    wanted = wanted.where(F.col("cik").isNotNull()).distinct()
    own = [b.join(wanted.select("cik").distinct(), "cik", "left_semi") for b in (recent, *archives)]
    listed = documents.valid_dates(documents.of_forms(index.full_history(own[0], own[1:])))
    listed = materialize(listed.select("cik", "accession", "form", "filing_date", F.struct(
        "source_no", "block_no", "pos").alias("ord")), "listed-filings")
    held = pages.join(listed.select("cik", "accession"), ["cik", "accession"], "left_semi")
    texts = documents.primary_or_alternate(
        held.select(F.struct("cik", "accession").alias("filing"), "doc_no", "name", "text"),
        "filing").select("filing.*", "text")
    rows = listed.join(texts, ["cik", "accession"], "left").join(wanted, "cik")
    return rows.select("ticker", "cik", "accession", "form", "filing_date", "text", "ord")


def collect_events(spark: SparkSession, events: DataFrame, filings: DataFrame, bars: DataFrame,
                   root: str, force: bool = False, causal: bool = False) -> DataFrame:
    """Fill ``root`` with what is not stored yet, write the manifest and return it.

    Layout: ``texts`` (one row per event with a text), ``bars`` (the bar window of each event) and
    ``manifest``.  A second call without ``force`` only works on new events; with it the rows of the
    given events are replaced.  The manifest covers all stored events and those of this call.

    The events are stored first: every join with them reads them several times, and each time would
    work out again whatever they are derived from.
    """
    events = materialize(events, "events")
    parts = {
        "texts": (lambda e: features.event_texts(e, filings, causal),
                  features.event_texts_schema(events, filings)),
        "bars": (lambda e: prices.event_bars(e, bars), prices.event_bars(events, bars).schema),
    }
    stored = {}
    for name, (produce, schema) in parts.items():
        path = f"{root}/{name}"
        present = store.read_if_stored(spark, path, schema)
        store.append_missing(events, produce, path, present, force)
        stored[name] = spark.read.schema(schema).parquet(path)
    manifest = store.build_manifest(events, stored["texts"], stored["bars"])
    manifest.write.mode("overwrite").parquet(f"{root}/manifest")
    return spark.read.schema(schemas.MANIFEST).parquet(f"{root}/manifest")


def stored_parts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The stored texts and bar windows of an earlier collection."""
    return (spark.read.schema(schemas.STORED_TEXTS).parquet(f"{root}/texts"),
            spark.read.schema(schemas.STORED_BARS).parquet(f"{root}/bars"))
