"""Linear models from sums against the library's fits and against Newton's steps in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import settings
from tidemark.operators import linear, models

FEATURES = list(settings.FEATURE_COLUMNS)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, len(FEATURES))) * rng.uniform(0.01, 5, len(FEATURES)) + 0.3
    x[:, 1] = x[:, 0] - x[:, 2]                     # collinear, as the sentiment columns are
    x[:, 4] = 1.0                                   # constant
    y = 0.02 * x[:, 0] - 0.03 * x[:, 5] + rng.normal(size=400) * 0.05
    data = [(f"t{i}", i % 2, *map(float, v), float(t), float(t > 0))
            for i, (v, t) in enumerate(zip(x, y))]
    data += [("none", 0, *map(float, x[0]), None, None), ("nan", 1, *map(float, x[0]),
                                                          float("nan"), float("nan"))]
    schema = "ticker string, horizon int, " + ", ".join(f"{c} double" for c in FEATURES)
    return spark.createDataFrame(data, schema + ", ret double, label double").persist()


def of(rows, horizon, label):
    return linear.with_target(rows, label).where(F.col("horizon") == horizon).withColumn(
        "label", F.col(label))


def standardised(rows, horizon, label):
    got = of(rows, horizon, label).toPandas()
    x, y = got[FEATURES].to_numpy(), got["label"].to_numpy()
    deviation = x.std(axis=0)
    deviation[deviation < 1e-12] = 1
    return (x - x.mean(axis=0)) / deviation, y


def test_ridge_and_lasso_equal_the_library(rows):
    found = linear.moments(rows, FEATURES, "ret", "horizon")
    for horizon, m in found.items():
        assert m.n == 200
        for key, model, close in (("ridge", linear.ridge(m, FEATURES), 1e-8),
                                  ("lasso", linear.lasso(m, FEATURES), 1e-6)):
            fitted = models.fit_model(key, "magnitude", of(rows, horizon, "ret")).stages[-1]
            if key == "ridge":
                assert model.coefficients == pytest.approx(fitted.coefficients, abs=close)
            assert model.intercept == pytest.approx(fitted.intercept, abs=close)
            x, y = standardised(rows, horizon, "ret")
            miss = y - model.intercept - x @ model.coefficients
            b = model.coefficients
            if key == "ridge":
                assert np.abs(x.T @ miss - b).max() < 1e-9
            else:
                pull = x.T @ miss / len(y)
                assert np.abs(np.where(b != 0, pull - 0.001 * np.sign(b),
                                       np.maximum(np.abs(pull) - 0.001, 0))).max() < 1e-10
                theirs = np.array(fitted.coefficients)

                def loss(v):
                    return 0.5 * np.mean((y - y.mean() - x @ v) ** 2) + 0.001 * np.abs(v).sum()
                assert loss(b) <= loss(theirs) + 1e-12


def test_a_small_deviation_from_a_large_mean(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, len(FEATURES)))
    y = x[:, 0] * 0.1 + rng.normal(size=300) * 0.1
    data = [(1, *map(float, v * 1e-5 + 1000), float(t)) for v, t in zip(x, y)]
    df = spark.createDataFrame(data, "horizon int, " + ", ".join(f"{c} double" for c in FEATURES)
                               + ", ret double")
    model = linear.lasso(linear.moments(df, FEATURES, "ret", "horizon")[1], FEATURES)
    got = linear.optimality(df, model, "ret", "lasso", 0.001).collect()
    assert max(abs(r.residual) for r in got) < 1e-8 and model.coefficients[0] > 0.05


def test_all_linear_fits_take_one_scan(rows, monkeypatch):
    jobs = []
    plain = type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda df: jobs.append(df) or plain(df))
    found = linear.moments(rows, FEATURES, "ret", "horizon")
    for m in found.values():
        for alpha in (0.1, 1.0, 10.0):
            linear.ridge(m, FEATURES, alpha), linear.lasso(m, FEATURES, alpha)
    assert len(jobs) == 2                           # the first reads one row
    assert "Limit 1" in jobs[0]._jdf.queryExecution().optimizedPlan().toString()
    plan = jobs[1]._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("InMemoryTableScan") == 1 and "partial_sum" in plan


def test_logistic_equals_newton(rows):
    found = linear.fit_logistic(rows, FEATURES, "label", "horizon")
    for horizon, model in found.items():
        x, y = standardised(rows, horizon, "label")
        design = np.column_stack([x, np.ones(len(x))])
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
        penalty = np.append(np.ones(len(FEATURES)), 0)
        b = np.zeros(design.shape[1])
        for _ in range(50):
            q = 1 / (1 + np.exp(-design @ b))
            gradient = design.T @ (w * (q - y)) + penalty * b
            b = b - np.linalg.lstsq(design.T @ (design * (w * q * (1 - q))[:, None])
                                    + np.diag(penalty), gradient, rcond=None)[0]
        assert np.append(model.coefficients, model.intercept) == pytest.approx(b, abs=1e-8)
        fitted = models.fit_model("logistic", "direction", of(rows, horizon, "label")).stages[-1]
        assert model.coefficients == pytest.approx(fitted.coefficients, abs=1e-4)


def test_optimality_tells_an_optimum_from_another_point(rows):
    m = linear.moments(rows, FEATURES, "ret", "horizon")[0]
    best, other = linear.ridge(m, FEATURES), linear.ridge(m, FEATURES, 50.0)
    for model, low, high in ((best, 0, 1e-10), (other, 1e-6, 1)):
        got = linear.optimality(of(rows, 0, "ret"), model, "ret", "ridge", 1.0).collect()
        assert {r.feature for r in got} == {*FEATURES, "intercept"} and got[0].n == 200
        assert low <= max(abs(r.residual) for r in got) < high


def test_one_class_nulls_and_no_rows(spark, rows):
    one = rows.where("label = 1").withColumn(FEATURES[0], F.lit(None).cast("double"))
    model = linear.fit_logistic(one, FEATURES, "label", "horizon", steps=8)[0]
    assert model.coefficients[0] == 0 and model.intercept > 3
    assert linear.moments(rows.limit(0), FEATURES, "ret", "horizon") == {}
    assert linear.fit_logistic(rows.limit(0), FEATURES, "label", "horizon") == {}


def test_predicted_is_the_linear_sum(rows):
    model = linear.ridge(linear.moments(rows, FEATURES, "ret", "horizon")[0], FEATURES)
    x, _ = standardised(rows, 0, "ret")
    got = of(rows, 0, "ret").select(model.predicted().alias("p")).toPandas()["p"].to_numpy()
    assert got == pytest.approx(model.intercept + x @ model.coefficients, abs=1e-9)
