"""Metric operators against published numbers of one evaluation run."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.numeric import correlation_p_value
from tidemark.operators import metrics

# --- fixed values: published confusion matrices and scores --------------------------------------
RUNS = {
    "direction_1d_logistic": ((15, 12, 9, 12), (0.5625, 0.5000, 0.5714, 0.5333)),
    "direction_1d_random_forest": ((19, 8, 11, 10), (0.6042, 0.5556, 0.4762, 0.5128)),
    "direction_1d_gradient_boosting": ((15, 12, 10, 11), (0.5417, 0.4783, 0.5238, 0.5000)),
    "direction_3d_logistic": ((17, 10, 10, 11), (0.5833, 0.5238, 0.5238, 0.5238)),
    "direction_3d_random_forest": ((17, 10, 14, 7), (0.5000, 0.4118, 0.3333, 0.3684)),
    "direction_3d_gradient_boosting": ((16, 11, 13, 8), (0.5000, 0.4211, 0.3810, 0.4000)),
}
P_VALUES = {0.1245: 0.3991, 0.1469: 0.3192, 0.0994: 0.5013, 0.1493: 0.3113, 0.2188: 0.1351,
            0.0580: 0.6955}
MAGNITUDES = [("magnitude_1d_ridge", 0.046114), ("magnitude_1d_random_forest", 0.046805),
              ("magnitude_3d_random_forest", 0.054620),
              ("magnitude_1d_gradient_boosting", 0.059108), ("magnitude_3d_ridge", 0.060700),
              ("magnitude_3d_gradient_boosting", 0.063142)]


@pytest.fixture(scope="module")
def predictions(spark):
    rows = []
    for model, ((tn, fp, fn, tp), _) in RUNS.items():
        cells = [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn + [(1, 1)] * tp
        for i, (actual, predicted) in enumerate(cells):
            rows.append((model, "direction", 1, f"T{i % 8}",
                         dt.date(2024, 1, 1) + dt.timedelta(i),
                         0.01 if actual else -0.01, float(predicted)))
    return spark.createDataFrame(
        rows, "model string, model_type string, horizon int, ticker string, event_date date, "
              "actual double, predicted double").persist()


def test_class_metrics(predictions):
    got = {r["model"]: r for r in metrics.class_metrics(predictions).collect()}
    for model, (_, scores) in RUNS.items():
        for name, want in zip(("accuracy", "precision", "recall", "f1"), scores):
            assert got[model][name] == pytest.approx(want, abs=5e-5)


def test_classification_report(predictions):
    got = {r["section"]: r for r in metrics.classification_report(predictions)
           .where("model = 'direction_1d_logistic'").collect()}
    # fixed values: the published report, to two digits
    want = {"0": (0.62, 0.56, 0.59, 27), "1": (0.50, 0.57, 0.53, 21),
            "macro avg": (0.56, 0.56, 0.56, 48), "weighted avg": (0.57, 0.56, 0.56, 48)}
    for section, numbers in want.items():
        row = got[section]
        assert (row["precision"], row["recall"], row["f1"]) == pytest.approx(numbers[:3], abs=6e-3)
        assert row["support"] == numbers[3]
    assert got["accuracy"]["f1"] == pytest.approx(0.5625)


def test_leaderboards(spark, predictions):
    board = metrics.direction_leaderboard(metrics.class_metrics(predictions)).collect()
    assert [r["model"] for r in board] == [
        "direction_1d_logistic", "direction_3d_logistic", "direction_1d_random_forest",
        "direction_1d_gradient_boosting", "direction_3d_gradient_boosting",
        "direction_3d_random_forest"]
    assert [r["is_best"] for r in board] == [True] + [False] * 5
    table = spark.createDataFrame([(m, v, v, v, v) for m, v in reversed(MAGNITUDES)],
                                  "model string, mae double, rmse double, r2 double, ic double")
    board = metrics.magnitude_leaderboard(table).collect()
    assert [r["model"] for r in board] == [m for m, _ in MAGNITUDES]
    assert board[0]["is_best"] and not board[1]["is_best"]


def test_entity_accuracy_averages_to_the_overall_one(predictions):
    by_entity = metrics.accuracy_by_entity(predictions).groupBy("model").agg(
        F.sum("n").alias("n"), F.avg("accuracy").alias("mean"))
    for r in by_entity.collect():
        assert r["n"] == 48
        assert r["mean"] == pytest.approx(RUNS[r["model"]][1][0], abs=5e-5)


def test_published_p_values(spark):
    rows = spark.createDataFrame([(k, 48) for k in P_VALUES], "r double, n int")
    for r in rows.select("r", correlation_p_value(F.col("r"), F.col("n")).alias("p")).collect():
        assert r["p"] == pytest.approx(P_VALUES[r["r"]], abs=5e-4)
