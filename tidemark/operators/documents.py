"""Choosing the document that belongs to an event."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import settings
from tidemark.functions.text import long_enough
from tidemark.operators.windows import rows_around
from tidemark.runtime import materialize

EVENT = list(settings.META_COLUMNS)


def form_matches(form: Column, form_types: Iterable[str] = settings.FORM_TYPES) -> Column:
    """Case-insensitive match of a form type or its amendment (``X/A``)."""
    wanted = [t.upper() for t in form_types]
    return F.upper(form).isin(wanted + [t + "/A" for t in wanted])


def of_forms(filings: DataFrame, form_types: Iterable[str] = settings.FORM_TYPES) -> DataFrame:
    return filings.where(form_matches(F.col("form"), form_types))


def valid_dates(filings: DataFrame, date: str = "filing_date") -> DataFrame:
    """Parse ISO dates and drop the rows whose date does not parse."""
    parsed = filings.withColumn(date, F.try_to_date(F.col(date), "yyyy-MM-dd"))
    return parsed.where(F.col(date).isNotNull())


def newest_first(filings: DataFrame) -> DataFrame:
    """Each filer's filings from the newest on, equal dates in listed order, with their position."""
    order = W.partitionBy("cik").orderBy(F.col("filing_date").desc(), "ord")
    return filings.withColumn("position", F.row_number().over(order)).orderBy("cik", "position")


def filings_near(events: DataFrame, filings: DataFrame, window_days: int,
                 causal: bool = False, salts: int = 1,
                 heavy_rows: int | None = None) -> DataFrame:
    """Filings at most ``window_days`` calendar days from an event, with their ``gap_days``.

    The window is symmetric; ``causal`` keeps only filings up to the event day.
    """
    near = rows_around(events, filings, window_days, window_days + 1, day="filing_date",
                       salts=salts, heavy_rows=heavy_rows)
    near = near.withColumn("gap_days", F.abs(F.datediff("filing_date", "event_date")))
    return near.where(F.col("filing_date") <= F.col("event_date")) if causal else near


def filings_with_fallback(events: DataFrame, filings: DataFrame,
                          window_days: int = settings.FILING_WINDOW_DAYS,
                          fallback_days: int = settings.FILING_FALLBACK_DAYS,
                          causal: bool = False, salts: int = 1,
                          heavy_rows: int | None = None) -> DataFrame:
    """Filings in the narrow window, or in the wide one for events that have none in the narrow.

    One interval join; the window over an event holds the filings around it.
    """
    wide = filings_near(events, filings, fallback_days, causal, salts, heavy_rows)
    near = F.count_if(F.col("gap_days") <= window_days).over(W.partitionBy(*EVENT))
    return (
        wide.withColumn("_n_near", near)
        .where((F.col("gap_days") <= window_days) | (F.col("_n_near") == 0))
        .drop("_n_near")
    )


def pick_filing(events: DataFrame, filings: DataFrame, payload: Sequence[str],
                usable: Column, window_days: int = settings.FILING_WINDOW_DAYS,
                fallback_days: int = settings.FILING_FALLBACK_DAYS,
                preference: Iterable[str] = settings.FORM_TYPES,
                causal: bool = False, salts: int = 1,
                heavy_rows: int | None = None) -> DataFrame:
    """The one filing used for each event, with the ``payload`` columns.

    Among the filings of the window (narrow, else wide) the first usable one counts, in the order
    of preferred forms and then newest first.  Forms match exactly here, so an amendment keeps the
    window narrow but is never picked.  Everything is one aggregation that combines before its
    shuffle; events without a pick do not appear.
    """
    forms = ", ".join(f"'{p}'" for p in preference)
    near = filings_near(events, filings.withColumn("_usable", usable), fallback_days, causal, salts,
                        heavy_rows)
    ranked = near.selectExpr(
        *EVENT, f"gap_days <= {int(window_days)} as _narrow",
        f"if(_usable and form in ({forms}), struct(array_position(array({forms}), form) as a,"
        " -unix_date(filing_date) as b, ord as c), null) as _order",
        f"struct(accession, form, filing_date, {', '.join(payload)}) as _doc"
        if payload else "struct(accession, form, filing_date) as _doc")
    best = ranked.groupBy(*EVENT).agg(
        F.expr("count_if(_narrow) as _n_near"),
        F.expr("min_by(_doc, if(_narrow, _order, null)) as _near"),
        F.expr("min_by(_doc, _order) as _wide"))
    return (best.selectExpr(*EVENT, "if(_n_near > 0, _near, _wide) as _pick")
            .where("_pick is not null").select(*EVENT, "_pick.*"))


def primary_or_alternate(documents: DataFrame, key: str = "accession",
                         min_words: int = settings.MIN_FILING_WORDS) -> DataFrame:
    """The text that stands for a filing made of several documents.

    ``documents`` has the filing key, ``doc_no`` (0 = primary), ``name`` and ``text``.  A primary
    text of enough words is taken; else the first other ``.htm``/``.html`` document with enough
    words in listed order; else the short primary text.  Without a primary text there is nothing.
    """
    enough = long_enough(F.col("text"), min_words) if min_words > 0 else F.lit(True)
    primary = F.col("doc_no") == 0
    page = F.col("name").endswith(".htm") | F.col("name").endswith(".html")
    choice = (
        F.when(primary & enough, 0)
        .when(~primary & page & enough, 1)
        .when(primary & (F.length("text") > 0), 2)
    )
    order = F.when(choice.isNotNull(), F.struct(choice, F.col("doc_no")))
    best = documents.groupBy(key).agg(
        F.min_by("doc_no", order).alias("doc_no"), F.bool_or(primary).alias("_has_primary"))
    # Chosen on narrow rows and stored, so that their measured size decides how texts are fetched.
    chosen = materialize(best.where(F.col("_has_primary") & F.col("doc_no").isNotNull())
                         .select(key, "doc_no"), "chosen-documents")
    return documents.join(chosen, [key, "doc_no"]).select(key, "doc_no", "text")
