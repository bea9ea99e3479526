"""Data behind the figures: return curves, histograms, coefficient rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import settings
from tidemark.operators.metrics import with_labels
from tidemark.operators.ordering import running_products


def return_curves(predictions: DataFrame) -> DataFrame:
    """Cumulative long/short strategy return and buy-and-hold return of each direction model.

    Long when the predicted label is 1, short when it is 0, in (event_date, ticker) order.
    """
    rows = with_labels(predictions).select(
        "model", "event_date", "ticker", "actual", "predicted_label")
    position = F.when(F.col("predicted_label") == 1, 1.0).when(F.col("predicted_label") == 0, -1.0)
    rows = rows.withColumns({
        "position": position,
        "growth_strategy": 1 + position * F.col("actual"),
        "growth_buyhold": 1 + F.col("actual"),
    })
    out = running_products(
        rows, ["model"], ["event_date", "ticker"],
        {"cum_strategy": "growth_strategy", "cum_buyhold": "growth_buyhold"},
        index="event_index")
    return out.select("model", "event_index", "event_date", "ticker", "position",
                      "cum_strategy", "cum_buyhold")


def histogram(rows: DataFrame, columns: tuple[str, ...] = ("sentiment_score", "uncertainty_ratio"),
              bins: int = settings.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width histograms: ``column_name, bin, lower, upper, n`` with empty bins included.

    Nulls are ignored, the last bin is closed.  A constant column gets a range of width 1 around
    its value.  Two passes, both combining before their (tiny) shuffle.
    """
    present = [c for c in columns if c in rows.columns]
    long = rows.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x"))
        for c in present]))).where(F.col("x").isNotNull())
    flat = F.min("x") == F.max("x")
    ranges = long.groupBy("column_name").agg(      # one row per column
        F.when(flat, F.min("x") - 0.5).otherwise(F.min("x")).alias("low"),
        F.when(flat, F.max("x") + 0.5).otherwise(F.max("x")).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    number = F.least(F.floor((F.col("x") - F.col("low")) / width).cast("int") + 1, F.lit(bins))
    # One row a named column, so the broadcast does not grow with the data.
    counts = (long.join(F.broadcast(ranges), "column_name")
              .groupBy("column_name", number.alias("bin")).agg(F.count("*").alias("n")))
    grid = ranges.select("column_name", "low", width.alias("width"),
                         F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return grid.join(counts, ["column_name", "bin"], "left").select(
        "column_name", "bin",
        (F.col("low") + (F.col("bin") - 1) * F.col("width")).alias("lower"),
        (F.col("low") + F.col("bin") * F.col("width")).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"))


def coefficient_ranking(spark: SparkSession, name: str, coefficients,
                        features=settings.FEATURE_COLUMNS) -> DataFrame | None:
    """Coefficients of a linear model by growing magnitude; None when they do not fit."""
    values = [float(v) for v in coefficients]
    if len(values) != len(features):
        return None
    rows = [(name, f, v) for f, v in zip(features, values)]
    return (spark.createDataFrame(rows, "model string, feature string, coefficient double")
            .withColumn("magnitude", F.abs("coefficient")).orderBy("magnitude", "feature"))
