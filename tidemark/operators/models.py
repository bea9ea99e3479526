"""Spark ML pipelines behind the model keys, and their saved form."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import settings
from tidemark.operators import knn
from tidemark.operators.split import scaling_statistics
from tidemark.runtime import ship_by_value

ship_by_value(__name__)

DIRECTION_KEYS = ("logistic", "random_forest", "gradient_boosting", "svm", "knn")
MAGNITUDE_KEYS = ("ridge", "lasso", "random_forest", "gradient_boosting", "svr", "knn")
LINEAR_KEYS = ("logistic", "ridge", "lasso")

FEATURES = list(settings.FEATURE_COLUMNS)


@dataclass(frozen=True)
class ModelSettings:
    """Model parameters; the defaults are fixed values that results depend on."""

    trees: int = 200
    forest_depth: int = 6
    rounds: int = 200
    boosting_depth: int = 4
    learning_rate: float = 0.05
    logistic_c: float = 1.0
    logistic_iterations: int = 1000
    ridge_alpha: float = 1.0
    lasso_alpha: float = 0.001
    lasso_iterations: int = 2000
    neighbours: int = 5
    fourier_features: int = 256     # size of the random-feature stand-in for an RBF kernel
    seed: int = settings.SEED


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed,
                      DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features of an RBF kernel (Rahimi & Recht 2007).

    A linear model on them approximates the kernel machine and, unlike it, trains in passes over
    partitioned data.  The projection is drawn from the seed, so only parameters are saved.
    """

    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)

    def __init__(self, inputCol="scaled", outputCol="features", size=256, gamma=1.0, seed=42):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, size=size, gamma=gamma, seed=seed)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, gamma = self.getOrDefault("size"), self.getOrDefault("gamma")
        seed = self.getOrDefault("seed")

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def project(vectors: pd.Series) -> pd.Series:
            if vectors.empty:
                return pd.Series([], dtype=object)
            x = np.stack(vectors.to_numpy())
            rng = np.random.default_rng(seed)
            w = rng.normal(scale=math.sqrt(2 * gamma), size=(x.shape[1], size))
            b = rng.uniform(0, 2 * math.pi, size)
            z = math.sqrt(2.0 / size) * np.cos(x @ w + b)
            return pd.Series(list(z))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(
            project(vector_to_array(F.col(self.getInputCol())))))


def scaling_stages(statistics: dict[str, tuple[float, float]], output: str) -> list[Transformer]:
    """Stages that scale the feature columns with population statistics into one vector.

    A SQL stage keeps the exact means and scales in the saved pipeline and runs as generated code.
    """
    scaled = ", ".join(f"({c} - {m!r}D) / {s!r}D as z_{c}" for c, (m, s) in statistics.items())
    return [
        SQLTransformer(statement=f"select *, {scaled} from __THIS__"),
        VectorAssembler(inputCols=[f"z_{c}" for c in statistics], outputCol=output),
    ]


def check_key(key: str, model_type: str) -> None:
    known = DIRECTION_KEYS if model_type == "direction" else MAGNITUDE_KEYS
    if key not in known:
        raise ValueError(f"unknown {model_type} model {key!r}, choose from {list(known)}")


def _balanced(train: DataFrame) -> DataFrame:
    """Add ``weight``: rows / (classes * rows of the class), from one tiny aggregate."""
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for label, n in counts.items():
        weight = F.when(F.col("label") == label, total / (len(counts) * n)).otherwise(weight)
    return train.withColumn("weight", weight)


def fit_model(key: str, model_type: str, train: DataFrame, params: ModelSettings = ModelSettings()
              ) -> PipelineModel | NeighbourModel:
    """Fit one model on rows with the feature columns and ``label``."""
    check_key(key, model_type)
    statistics = scaling_statistics(train, FEATURES)
    if key == "knn":
        return NeighbourModel(model_type, train, statistics, params.neighbours)

    n = train.count()
    kernel = key in ("svm", "svr")
    stages = scaling_stages(statistics, "scaled" if kernel else "features")
    if kernel:
        varying = _varying(train)
        stages.append(FourierFeatures(size=params.fourier_features, gamma=1.0 / max(varying, 1),
                                      seed=params.seed))
    if key in ("logistic", "svm") or (key == "random_forest" and model_type == "direction"):
        train = _balanced(train)
    stages.append(_estimator(key, model_type, train, n, params))
    return Pipeline(stages=stages).fit(train)


def _varying(train: DataFrame) -> int:
    """How many feature columns are not constant."""
    row = train.agg(*[(F.min(c) < F.max(c)).cast("int").alias(c) for c in FEATURES]).first()
    return sum(v or 0 for v in row)


def _estimator(key: str, model_type: str, train: DataFrame, n: int, p: ModelSettings):
    """The estimator whose objective equals the per-sample-sum form with the given penalty.

    Spark averages the loss over rows and, for linear regression, works on the label divided by its
    deviation, hence the conversions of the penalties.
    """
    if key == "logistic":
        return LogisticRegression(
            regParam=1.0 / (p.logistic_c * n), elasticNetParam=0.0, standardization=False,
            maxIter=p.logistic_iterations, tol=1e-9, weightCol="weight")
    if key == "svm":
        return LinearSVC(regParam=1.0 / n, standardization=False, maxIter=100, tol=1e-4,
                         weightCol="weight")
    if key == "ridge":
        deviation = train.agg(F.stddev_pop("label")).first()[0] or 1.0
        return LinearRegression(
            solver="normal", elasticNetParam=0.0, standardization=False,
            regParam=p.ridge_alpha * deviation / n)
    if key == "lasso":
        return LinearRegression(
            elasticNetParam=1.0, standardization=False, regParam=p.lasso_alpha,
            maxIter=p.lasso_iterations, tol=1e-10)
    if key == "svr":
        return LinearRegression(loss="huber", standardization=False, regParam=1.0 / n, maxIter=200)

    direction = model_type == "direction"
    if key == "random_forest":
        kind = RandomForestClassifier if direction else RandomForestRegressor
        weight = {"weightCol": "weight"} if direction else {}
        return kind(numTrees=p.trees, maxDepth=p.forest_depth, seed=p.seed,
                    featureSubsetStrategy="sqrt" if direction else "all", **weight)
    kind = GBTClassifier if direction else GBTRegressor
    return kind(maxIter=p.rounds, maxDepth=p.boosting_depth, stepSize=p.learning_rate,
                seed=p.seed, checkpointInterval=10)


class NeighbourModel:
    """k nearest neighbours as a model: it keeps its scaled training rows as a table."""

    def __init__(self, model_type: str, train: DataFrame,
                 statistics: dict[str, tuple[float, float]], k: int):
        self.model_type, self.train, self.statistics, self.k = model_type, train, statistics, k

    def _scaled(self, rows: DataFrame, *extra: str) -> DataFrame:
        return rows.select(*settings.META_COLUMNS, *extra, *[
            ((F.col(c) - m) / s).alias(c) for c, (m, s) in self.statistics.items()])

    def transform(self, rows: DataFrame) -> DataFrame:
        near = knn.nearest_neighbours(self._scaled(self.train, "label"), self._scaled(rows),
                                      list(self.statistics), self.k)
        decide = knn.knn_classify if self.model_type == "direction" else knn.knn_regress
        answer = decide(near).withColumnRenamed("predicted", "prediction")
        return rows.join(answer, list(settings.META_COLUMNS), "left")

    def save(self, path: str) -> None:
        """Training rows and scaling statistics as two tables."""
        self.train.write.mode("overwrite").parquet(f"{path}/train")
        rows = [(self.model_type, self.k, c, m, s) for c, (m, s) in self.statistics.items()]
        self.train.sparkSession.createDataFrame(
            rows, "model_type string, k int, feature string, mean double, scale double"
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")

    @classmethod
    def load(cls, spark, path: str) -> NeighbourModel:
        rows = spark.read.parquet(f"{path}/statistics").collect()     # one row per feature
        order = {c: i for i, c in enumerate(FEATURES)}
        rows.sort(key=lambda r: order.get(r["feature"], len(order)))
        return cls(rows[0]["model_type"], spark.read.parquet(f"{path}/train"),
                   {r["feature"]: (r["mean"], r["scale"]) for r in rows}, rows[0]["k"])


def save_model(model: PipelineModel | NeighbourModel, path: str) -> None:
    if isinstance(model, NeighbourModel):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def load_model(spark, path: str, key: str) -> PipelineModel | NeighbourModel:
    return NeighbourModel.load(spark, path) if key == "knn" else PipelineModel.load(path)


def coefficients(model: PipelineModel | NeighbourModel) -> list[float] | None:
    """Coefficients of a linear model, None for every other kind."""
    if isinstance(model, NeighbourModel):
        return None
    values = getattr(model.stages[-1], "coefficients", None)
    return None if values is None else [float(v) for v in values]
