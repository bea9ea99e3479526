"""From events, filings and bars to the feature matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark import settings
from tidemark.functions.text import long_enough
from tidemark.operators import documents, fusion, prices, textual
from tidemark.runtime import materialize

EVENT = list(settings.META_COLUMNS)
FILING = ["ticker", "accession"]      # several filers may share an accession


def event_filings(events: DataFrame, filings: DataFrame, causal: bool = False) -> DataFrame:
    """The filing chosen for each event: ``ticker, event_date, accession, form, filing_date``.

    The texts are reduced to a yes/no at the scan; only narrow rows are shuffled.
    """
    narrow = documents.of_forms(filings).select(
        "ticker", "accession", "form", "filing_date", "ord",
        long_enough(F.col("text")).alias("usable"))
    return documents.pick_filing(events, narrow, [], F.col("usable"), causal=causal,
                                 heavy_rows=settings.HEAVY_BUCKET_ROWS)


def event_texts(events: DataFrame, filings: DataFrame, causal: bool = False) -> DataFrame:
    """The chosen filing with its text.

    Only texts that could be chosen at all (preferred form, long enough) are joined.  The picks are
    stored first: their measured size decides whether they are broadcast, so that no text is
    shuffled, or a runtime filter built from them keeps other texts out of the shuffle.
    """
    picks = materialize(event_filings(events, filings, causal), "picks")
    return picks.join(_pickable(filings), FILING).select(
        *EVENT, "accession", "form", "filing_date", "text")


def event_texts_schema(events: DataFrame, filings: DataFrame) -> StructType:
    """The columns of ``event_texts``, known without choosing anything."""
    return StructType([events.schema[c] for c in EVENT] + [
        filings.schema[c] for c in ("accession", "form", "filing_date", "text")])


def _pickable(filings: DataFrame) -> DataFrame:
    """Key and text of the filings that may be chosen; both filters run in the scan."""
    wanted = filings.where(F.col("form").isin(*settings.FORM_TYPES))
    return wanted.where(long_enough(F.col("text"))).select(*FILING, "text")


def event_text_features(events: DataFrame, filings: DataFrame,
                        scorer: textual.TextScorer | None = None,
                        causal: bool = False) -> DataFrame:
    """The eight text features of each event that has a usable filing.

    Filings are chosen on narrow rows and stored; only the chosen ones' texts are scored.  With the
    bundled scorer that is a projection over them and no text is ever shuffled, as long as the picks
    are small enough to be broadcast.
    """
    scorer = scorer or textual.LexiconScorer()
    if not isinstance(scorer, textual.LexiconScorer):
        picks = materialize(event_filings(events, filings, causal), "picks")
        chosen = _pickable(filings).join(picks.select(*FILING).distinct(), FILING, "left_semi")
        chosen = chosen.select(F.struct(*FILING).alias("filing"), "text")
        features = textual.text_features(chosen, "filing", scorer).select(
            "filing.*", *settings.TEXT_FEATURES)
        return picks.join(features, FILING).select(*EVENT, *settings.TEXT_FEATURES)

    narrow = documents.of_forms(filings).select(
        "ticker", "accession", "form", "filing_date", "ord",
        long_enough(F.col("text")).alias("usable"))
    picks = materialize(documents.pick_filing(events, narrow, ["ord"], F.col("usable"),
                                              causal=causal), "picks")
    # An entry of the filings is known by all these; rows equal in them are one entry.
    entry = F.struct("ticker", "accession", "form", "filing_date", "ord").alias("entry")
    wanted = picks.select(entry).distinct()
    chosen = filings.select(entry, "text").join(wanted, "entry", "left_semi")
    scored = scorer.in_place(chosen.where(long_enough(F.col("text"))))
    features = scored.groupBy("entry").agg(F.min(F.struct(*settings.TEXT_FEATURES)).alias("f"))
    return picks.select(*EVENT, entry).join(features, "entry").select(*EVENT, "f.*")


def event_price_features(events: DataFrame, bars: DataFrame,
                         horizons=settings.TARGET_HORIZONS) -> DataFrame:
    return prices.price_features(prices.event_bars(events, bars), horizons)


def raw_matrix(events: DataFrame, filings: DataFrame, bars: DataFrame,
               scorer: textual.TextScorer | None = None,
               horizons=settings.TARGET_HORIZONS, causal: bool = False) -> DataFrame:
    """The fused matrix before imputation.

    The events are stored first, as every part of the matrix reads them several times.
    """
    events = materialize(events, "events")
    return fusion.fuse(events, event_text_features(events, filings, scorer, causal),
                       event_price_features(events, bars, horizons), horizons)


def matrix_from_store(manifest: DataFrame, texts: DataFrame, windowed: DataFrame,
                      scorer: textual.TextScorer | None = None,
                      horizons=settings.TARGET_HORIZONS) -> DataFrame:
    """The fused matrix from the raw store: one text and one bar window per stored event."""
    doc = texts.where(long_enough(F.col("text"))).withColumn("_key", F.struct(*EVENT))
    features = textual.text_features(doc, "_key", scorer)
    text = features.select("_key.*", *settings.TEXT_FEATURES)
    return fusion.fuse(manifest, text, prices.price_features(windowed, horizons), horizons)


def feature_matrix(raw: DataFrame, impute_targets: bool = True,
                   fit_on: DataFrame | None = None, approximate: bool = False) -> DataFrame:
    """Impute the raw matrix, which is stored first because medians need their own pass.

    By default the medians are those of all rows; pass ``fit_on`` (for example the training rows)
    to learn them elsewhere, or ``impute_targets=False`` to leave missing returns missing.
    """
    stored = materialize(raw, "matrix")
    columns = fusion.imputed_columns(stored, impute_targets)
    medians = fusion.column_medians(stored if fit_on is None else fit_on, columns, approximate)
    return fusion.impute(stored, medians)
