"""Queries over fitted models, at the default settings.  Predictions depend on the solver, so most
have no SQL; the estimators are tested against closed forms in the test suite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import settings
from tidemark.operators import curves, models
from tidemark.plans import evaluate, report, train
from verification.oracles import PERSISTED
from verification.views import Views

def _fitted(v: Views, direction, magnitude, horizons=(1, 3)):
    return train.train_all(v.imputed, horizons, direction, magnitude)


def train_grid(v: Views) -> DataFrame:
    """Predictions of the default grid on the test rows."""
    trained, test = _fitted(v, ("logistic", "random_forest", "gradient_boosting"),
                            ("ridge", "random_forest", "gradient_boosting"))
    return train.score_all(trained, test)


def optional_models(v: Views) -> DataFrame:
    """Predictions of the models that are off by default."""
    trained, test = _fitted(v, ("svm", "knn"), ("lasso", "svr", "knn"))
    return train.score_all(trained, test)


def model_persistence(v: Views) -> DataFrame:
    """Rows on which saved and reloaded models predict something else than the fitted ones (a count
    per model)."""
    from verification.catalog import unique_path
    path = unique_path(v.spark, "models")
    trained, test = train.train_all(v.imputed, settings.TARGET_HORIZONS, PERSISTED["direction"],
                                    PERSISTED["magnitude"], output=path)
    before = train.score_all(trained, test)
    after = train.score_all(train.load_all(v.spark, path), test)
    key = ["model", "ticker", "event_date"]
    both = before.select(*key, F.col("predicted").alias("fitted")).join(
        after.select(*key, "predicted"), key, "full_outer")
    return both.groupBy("model").agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("fitted").eqNullSafe(F.col("predicted"))).alias("n_changed"))


def coefficient_ranking(v: Views) -> DataFrame:
    trained, _ = _fitted(v, ("logistic",), ("ridge", "lasso"))
    tables = [curves.coefficient_ranking(v.spark, m.name, models.coefficients(m.model))
              for m in trained]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def model_evaluation(v: Views) -> DataFrame:
    """Leaderboard values of fitted linear models, long form."""
    trained, test = _fitted(v, ("logistic",), ("ridge",))
    tables = evaluate.evaluate_all(train.score_all(trained, test))
    direction = tables["direction_leaderboard"].select(
        "model", F.col("f1").alias("value"), "is_best")
    return direction.unionByName(tables["magnitude_leaderboard"].select(
        "model", F.col("mae").alias("value"), "is_best"))


def evaluation_report(v: Views) -> DataFrame:
    """The text report over the rule predictor, written and read back."""
    from verification.catalog import unique_path
    from tidemark.runtime import materialize
    tables = evaluate.evaluate_all(materialize(v.predictions, "predictions"))
    path = unique_path(v.spark, "report")
    report.write_report(report.report_lines(tables), path)
    return v.spark.read.text(path).withColumnRenamed("value", "line")


QUERIES = {f.__name__: f for f in (
    train_grid, optional_models, model_persistence, coefficient_ranking, model_evaluation,
    evaluation_report)}
