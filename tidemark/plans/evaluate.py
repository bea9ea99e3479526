"""All metrics of a predictions table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators import curves, metrics


def evaluate_all(predictions: DataFrame) -> dict[str, DataFrame]:
    """Every evaluation table by name, each planned over the same predictions; ranks and curves
    store their sorted slices when planned.

    Pass a stored table (:func:`tidemark.plans.train.score_all` returns one): each metric then
    scans only the columns it needs and no model is run again.
    """
    classes = metrics.class_metrics(predictions)
    errors = metrics.regression_metrics(predictions)
    return {
        "confusion": metrics.confusion_matrix(predictions),
        "class_metrics": classes,
        "class_report": metrics.classification_report(predictions),
        "regression_metrics": errors,
        "accuracy_by_entity": metrics.accuracy_by_entity(predictions),
        "mae_by_entity": metrics.mae_by_entity(predictions),
        "worst_directions": metrics.worst_directions(predictions),
        "worst_magnitudes": metrics.worst_magnitudes(predictions),
        "direction_leaderboard": metrics.direction_leaderboard(classes),
        "magnitude_leaderboard": metrics.magnitude_leaderboard(errors),
        "extents": metrics.prediction_extents(predictions),
        "return_curves": curves.return_curves(predictions),
    }
