"""Feature matrix: joining the modalities, flagging and imputing what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import settings
from tidemark.operators.ordering import exact_medians

KEY = list(settings.META_COLUMNS)


def fuse(events: DataFrame, text: DataFrame, prices: DataFrame,
         horizons=settings.TARGET_HORIZONS) -> DataFrame:
    """One row per event with its text and price features; what is missing is null and flagged.

    ``text`` holds only events whose document was usable, so a missing row is a missing text.
    """
    targets = [f"ret_{h}d" for h in horizons]
    marked = text.select(*KEY, *settings.TEXT_FEATURES, F.lit(True).alias("_has_text"))
    wide = (
        events.select(*KEY)
        .join(marked, KEY, "left")
        .join(prices.select(*KEY, *settings.PRICE_FEATURES, *targets), KEY, "left")
    )
    return wide.select(
        *KEY, F.col("_has_text").isNull().alias(settings.MISSING_FLAG),
        *settings.TEXT_FEATURES, *settings.PRICE_FEATURES, *targets)


def imputed_columns(matrix: DataFrame, include_targets: bool = True) -> list[str]:
    """Columns that get imputed: everything but key and flag, targets optional."""
    skip = {*KEY, settings.MISSING_FLAG}
    return [c for c in matrix.columns
            if c not in skip and (include_targets or not c.startswith("ret_"))]


def column_medians(matrix: DataFrame, columns: list[str], approximate: bool = False
                   ) -> dict[str, float | None]:
    """Medians by column; ``approximate`` trades exactness for a single sketch pass."""
    if approximate:
        row = matrix.agg(*[F.percentile_approx(c, 0.5).alias(c) for c in columns]).first()
        return row.asDict()
    return exact_medians(matrix, columns)


def impute(matrix: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    """Replace nulls by the given medians; a column without a median stays as it is."""
    return matrix.withColumns({
        c: F.coalesce(F.col(c), F.lit(m)) for c, m in medians.items() if m is not None})


def missing_counts(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """Long table ``column_name, n_missing`` from one pass over the matrix."""
    counts = matrix.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing"))
                      for c in columns])
    return counts.select(F.inline(pairs))


def complete_schema(matrix: DataFrame, columns=settings.FEATURE_COLUMNS) -> DataFrame:
    """Every feature column as a number: absent ones, NaN and what is no number become 0."""
    def number(name: str):
        if name not in matrix.columns:
            return F.lit(0.0)
        kind = matrix.schema[name].dataType.simpleString()
        value = F.col(name).cast("int") if kind == "boolean" else F.col(name)
        return F.coalesce(F.nanvl(value.try_cast("double"), F.lit(0.0)), F.lit(0.0))

    return matrix.withColumns({c: number(c) for c in columns})
