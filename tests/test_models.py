"""Fitted models against closed forms, and the rules around the grid."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import settings
from tidemark.operators import models, split
from tidemark.operators.fusion import complete_schema
from tidemark.plans import train as training

FEATURES = list(settings.FEATURE_COLUMNS)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 160
    x = rng.normal(size=(n, len(FEATURES))) * rng.uniform(0.5, 3, len(FEATURES))
    x[:, -1] = rng.integers(0, 2, n)
    x[:, 5] = 2.5                                     # a constant column
    x[:, 0] = x[:, 1] - x[:, 2]                       # a collinear one
    y = 0.03 * x[:, 1] - 0.02 * x[:, 8] + 0.01 * rng.normal(size=n)
    rows = [(f"T{i % 8}", dt.date(2020, 1, 1) + dt.timedelta(int(i)), *map(float, r), float(t))
            for i, (r, t) in enumerate(zip(x, y))]
    schema = ("ticker string, event_date date, " + ", ".join(f"{c} double" for c in FEATURES)
              + ", y double")
    return x, y, spark.createDataFrame(rows, schema).coalesce(1).persist()


def _scaled(x):
    s = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(s == 0, 1, s)


def test_scaling(data):
    x, _, df = data
    stats = split.scaling_statistics(df)
    got = np.array(split.scale(df, stats).orderBy("event_date").select(*FEATURES).collect())
    assert np.allclose(got, _scaled(x), atol=1e-12)


def test_ridge(data):
    x, y, df = data
    model = models.fit_model("ridge", "magnitude", df.withColumn("label", F.col("y")))
    z = _scaled(x)
    want = np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ (y - y.mean()))
    assert np.allclose(models.coefficients(model), want, atol=1e-8)
    got = np.array([r[0] for r in model.transform(df).orderBy("event_date")
                    .select("prediction").collect()])
    assert np.allclose(got, z @ want + y.mean(), atol=1e-8)


def test_lasso(data):
    x, y, df = data
    model = models.fit_model("lasso", "magnitude", df.withColumn("label", F.col("y")))
    z, r = _scaled(x), y - y.mean()
    w = np.zeros(z.shape[1])
    for _ in range(3000):
        for j in range(len(w)):
            if not z[:, j].any():
                continue
            rho = z[:, j] @ (r - z @ w + z[:, j] * w[j]) / len(y)
            w[j] = np.sign(rho) * max(abs(rho) - 0.001, 0) / (z[:, j] @ z[:, j] / len(y))
    got = np.array(models.coefficients(model))
    objective = lambda v: ((r - z @ v) ** 2).mean() / 2 + 0.001 * np.abs(v).sum()
    assert objective(got) == pytest.approx(objective(w), abs=1e-8)


def test_logistic(data):
    x, y, df = data
    label = (y >= 0).astype(float)
    model = models.fit_model("logistic", "direction",
                             df.withColumn("label", (F.col("y") >= 0).cast("double")))
    z = np.hstack([_scaled(x), np.ones((len(y), 1))])
    weight = np.where(label == 1, len(y) / (2 * label.sum()), len(y) / (2 * (1 - label).sum()))
    penalty = np.diag([1.0] * len(FEATURES) + [0.0])
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        gradient = z.T @ (weight * (p - label)) + penalty @ w
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + penalty
        w -= np.linalg.solve(hessian + 1e-12 * np.eye(len(w)), gradient)
    assert np.allclose(models.coefficients(model), w[:-1], atol=2e-4)


@pytest.mark.parametrize("key,kind", [("svm", "direction"), ("svr", "magnitude"),
                                      ("random_forest", "direction"),
                                      ("gradient_boosting", "magnitude"), ("knn", "magnitude")])
def test_other_models_learn(data, key, kind):
    _, y, df = data
    label = (F.col("y") >= 0).cast("double") if kind == "direction" else F.col("y")
    quick = models.ModelSettings(trees=20, rounds=5, fourier_features=64)
    model = models.fit_model(key, kind, df.withColumn("label", label), quick)
    rows = model.transform(df).select("y", "prediction").collect()
    got, want = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    if kind == "direction":
        assert (got == (want >= 0)).mean() > 0.8
    else:
        assert np.corrcoef(got, want)[0, 1] > 0.5


def test_unknown_keys_fail_first(spark, data):
    with pytest.raises(ValueError):
        training.train_all(data[2], direction=["perceptron"])
    with pytest.raises(ValueError):
        models.check_key("logistic", "magnitude")


def test_small_and_missing_targets_are_skipped(spark, data):
    _, _, df = data
    few = df.withColumn("ret_1d", F.when(F.dayofyear("event_date") <= 4, F.col("y")))
    trained, _ = training.train_all(few, horizons=(1, 3), direction=(), magnitude=("ridge",))
    assert trained == []


def test_grid_names_and_saved_models(spark, data, tmp_path):
    _, _, df = data
    matrix = df.withColumn("ret_1d", F.col("y")).withColumn("ret_3d", -F.col("y"))
    trained, test = training.train_all(matrix, direction=("logistic",), magnitude=("ridge",),
                                       output=str(tmp_path))
    assert [m.name for m in trained] == ["direction_1d_logistic", "magnitude_1d_ridge",
                                         "direction_3d_logistic", "magnitude_3d_ridge"]
    assert test.count() == 48
    loaded = training.load_all(spark, str(tmp_path))
    assert sorted(m.name for m in trained) == [m.name for m in loaded]


def test_complete_schema(spark):
    rows = spark.createDataFrame([("1.5", None, True), ("x", 2.0, False)],
                                 "a string, b double, c boolean")
    got = complete_schema(rows, ("a", "b", "c", "d")).collect()
    assert [tuple(r) for r in got] == [(1.5, 0.0, 1.0, 0.0), (0.0, 2.0, 0.0, 0.0)]


@pytest.mark.parametrize("ratio", [0.0, 0.1, 0.333, 0.5, 0.7, 1.0])
@pytest.mark.parametrize("slice_rows", [1, 1000])
def test_split_with_hot_days(spark, ratio, slice_rows):
    rng = np.random.default_rng(5)
    # a third of the rows fall on one day
    days = [2 if rng.random() < 0.34 else int(rng.integers(0, 6)) for _ in range(90)]
    rows = [(f"T{i:03d}", dt.date(2020, 1, 1) + dt.timedelta(d)) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "ticker string, event_date date")
    train = split.find_boundary(df, ratio, slice_rows).is_train()
    got = {tuple(r) for r in df.where(train).collect()}
    want = sorted(rows, key=lambda r: (r[1], r[0]))[: int(len(rows) * ratio)]
    assert got == set(want)
    assert df.where(~train).count() == len(rows) - len(want)
