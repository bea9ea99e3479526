"""Evaluation of the long predictions table, all models at once.

Input columns: ``model, model_type, horizon, ticker, event_date, actual, predicted``.  Direction
models predict a label (0 or 1) and are judged against the sign of ``actual``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import settings
from tidemark.functions.numeric import correlation_p_value, ratio_or_zero
from tidemark.operators.ordering import average_rank
from tidemark.operators.split import direction_label


def of_type(predictions: DataFrame, model_type: str) -> DataFrame:
    return predictions.where(F.col("model_type") == model_type)


def with_labels(predictions: DataFrame) -> DataFrame:
    """Direction rows with ``actual_label`` and ``predicted_label``."""
    return of_type(predictions, "direction").withColumns({
        "actual_label": direction_label(F.col("actual")),
        "predicted_label": F.col("predicted").cast("int"),
    })


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """Always 2 x 2 per model: ``tn, fp, fn, tp``."""
    a, p = F.col("actual_label"), F.col("predicted_label")
    return with_labels(predictions).groupBy("model").agg(
        F.count_if((a == 0) & (p == 0)).alias("tn"), F.count_if((a == 0) & (p == 1)).alias("fp"),
        F.count_if((a == 1) & (p == 0)).alias("fn"), F.count_if((a == 1) & (p == 1)).alias("tp"))


def class_metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of the up class; a zero denominator gives 0."""
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return confusion_matrix(predictions).select(
        "model",
        ratio_or_zero(F.col("tp") + F.col("tn"), n).alias("accuracy"),
        ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        ratio_or_zero(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def classification_report(predictions: DataFrame) -> DataFrame:
    """Rows ``0``, ``1``, ``accuracy``, ``macro avg``, ``weighted avg`` per model.

    A class that is neither actual nor predicted has no row and no part in the averages.
    """
    def side(cls, hit, extra, missed, support):
        return F.struct(
            F.lit(cls).alias("section"),
            ratio_or_zero(hit, hit + extra).alias("precision"),
            ratio_or_zero(hit, hit + missed).alias("recall"),
            ratio_or_zero(2 * hit, 2 * hit + extra + missed).alias("f1"),
            support.alias("support"),
            (hit + extra + missed > 0).alias("present"))

    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    cm = confusion_matrix(predictions)
    classes = cm.select("model", F.inline(F.array(
        side("0", tn, fn, fp, tn + fp), side("1", tp, fp, fn, tp + fn)))
    ).where("present").drop("present")
    numbers = ("precision", "recall", "f1")
    macro = classes.groupBy("model").agg(
        F.lit("macro avg").alias("section"), *[F.avg(c).alias(c) for c in numbers],
        F.sum("support").alias("support"))
    weighted = classes.groupBy("model").agg(
        F.lit("weighted avg").alias("section"),
        *[ratio_or_zero(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c)
          for c in numbers],
        F.sum("support").alias("support"))
    n = tn + fp + fn + tp
    overall = cm.select(
        "model", F.lit("accuracy").alias("section"),
        *[ratio_or_zero(tp + tn, n).alias(c) for c in numbers], n.alias("support"))
    return classes.unionByName(overall).unionByName(macro).unionByName(weighted)


def error_metrics(predictions: DataFrame) -> DataFrame:
    """MAE, RMSE and R2 of the magnitude models, in one combining aggregation."""
    error = F.col("actual") - F.col("predicted")
    sums = of_type(predictions, "magnitude").groupBy("model").agg(
        F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"), F.var_pop("actual").alias("spread"))
    r2 = (F.when(F.col("n") <= 1, F.lit(None))
          .when(F.col("spread") == 0, F.when(F.col("mse") == 0, 1.0).otherwise(0.0))
          .otherwise(1 - F.try_divide("mse", "spread")))
    return sums.select("model", "n", "mae", F.sqrt("mse").alias("rmse"), r2.alias("r2"))


def rank_correlation(predictions: DataFrame) -> DataFrame:
    """Spearman correlation of actual and predicted per magnitude model, with its p-value.

    Null for fewer than three rows or a constant side.
    """
    rows = of_type(predictions, "magnitude").select("model", "actual", "predicted")
    ranked = average_rank(rows, ["model"], "actual", "ra")
    ranked = average_rank(ranked, ["model"], "predicted", "rp")
    parts = ranked.groupBy("model").agg(
        F.count("*").alias("n"), F.covar_pop("ra", "rp").alias("c"),
        F.var_pop("ra").alias("va"), F.var_pop("rp").alias("vp"))
    ic = F.when(F.col("n") > 2, F.try_divide("c", F.sqrt(F.col("va") * F.col("vp"))))
    bounded = F.when(ic.isNotNull(), F.greatest(F.least(ic, F.lit(1.0)), F.lit(-1.0)))
    return parts.select("model", "n", bounded.alias("ic")).withColumn(
        "ic_pval", correlation_p_value(F.col("ic"), F.col("n")))


def regression_metrics(predictions: DataFrame) -> DataFrame:
    return error_metrics(predictions).join(
        rank_correlation(predictions).drop("n"), "model", "left")


def accuracy_by_entity(predictions: DataFrame) -> DataFrame:
    hit = F.col("actual_label") == F.col("predicted_label")
    return with_labels(predictions).groupBy("model", "ticker").agg(
        F.count("*").alias("n"), F.avg(hit.cast("double")).alias("accuracy"))


def mae_by_entity(predictions: DataFrame) -> DataFrame:
    return of_type(predictions, "magnitude").groupBy("model", "ticker").agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mae"))


def _worst(rows: DataFrame, badness: str, k: int) -> DataFrame:
    """Top ``k`` per model; every task keeps only k rows per model before the shuffle."""
    order = W.partitionBy("model").orderBy(F.col(badness).desc(), "event_date", "ticker")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def worst_directions(predictions: DataFrame, k: int = settings.FAILURE_TOP_K) -> DataFrame:
    """Wrong labels with the largest moves."""
    wrong = with_labels(predictions).where(F.col("actual_label") != F.col("predicted_label"))
    return _worst(wrong.withColumn("abs_return", F.abs("actual")), "abs_return", k).select(
        "model", "rank", "ticker", "event_date", "actual", "predicted_label", "abs_return")


def worst_magnitudes(predictions: DataFrame, k: int = settings.FAILURE_TOP_K) -> DataFrame:
    """Predictions furthest from the actual return."""
    rows = of_type(predictions, "magnitude").withColumn(
        "error", F.col("actual") - F.col("predicted"))
    return _worst(rows.withColumn("abs_error", F.abs("error")), "abs_error", k).select(
        "model", "rank", "ticker", "event_date", "actual", "predicted", "error", "abs_error")


def direction_leaderboard(metrics: DataFrame) -> DataFrame:
    """Direction models by F1; all that share the best one are marked.  One row per model."""
    best = F.max("f1").over(W.partitionBy())
    return metrics.select(
        "model", "accuracy", "precision", "recall", "f1", (F.col("f1") == best).alias("is_best"),
        (F.col("accuracy") > 0.5).alias("above_random")).orderBy(F.col("f1").desc(), "model")


def magnitude_leaderboard(metrics: DataFrame) -> DataFrame:
    """Magnitude models by MAE; all that share the best one are marked.  One row per model."""
    best = F.min("mae").over(W.partitionBy())
    return metrics.select("model", "mae", "rmse", "r2", "ic",
                          (F.col("mae") == best).alias("is_best")).orderBy("mae", "model")


def prediction_extents(predictions: DataFrame, margin: float = settings.EXTENT_MARGIN
                       ) -> DataFrame:
    """Common axis limits of actual and predicted per magnitude model."""
    return of_type(predictions, "magnitude").groupBy("model").agg(
        (F.least(F.min("actual"), F.min("predicted")) - margin).alias("lower"),
        (F.greatest(F.max("actual"), F.max("predicted")) + margin).alias("upper"))
