"""Training the grid of models and scoring them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas, settings
from tidemark.operators import models
from tidemark.operators.fusion import complete_schema
from tidemark.operators.models import ModelSettings
from tidemark.operators.split import chronological_split, direction_label
from tidemark.runtime import materialize

KEY = list(settings.META_COLUMNS)
REGISTRY_SCHEMA = "name string, model_type string, horizon int, key string, path string"


@dataclass
class TrainedModel:
    name: str
    model_type: str
    horizon: int
    key: str
    model: object
    path: str | None = None

    @property
    def target(self) -> str:
        return f"ret_{self.horizon}d"


def grid(horizons: Iterable[int], direction: Iterable[str], magnitude: Iterable[str]
         ) -> list[tuple[int, str, str]]:
    """All (horizon, type, key) of a run; an unknown key fails before anything is fitted."""
    specs = [(h, kind, key) for h in horizons
             for kind, keys in (("direction", direction), ("magnitude", magnitude))
             for key in keys]
    for _, kind, key in specs:
        models.check_key(key, kind)
    return specs


def training_rows(train: DataFrame, horizon: int, model_type: str) -> DataFrame:
    """Rows with a target, and the label of the model type."""
    target = F.col(f"ret_{horizon}d")
    label = direction_label(target).cast("double") if model_type == "direction" else target
    return train.where(target.isNotNull()).select(
        *KEY, *settings.FEATURE_COLUMNS, label.alias("label"))


def train_all(matrix: DataFrame, horizons: Iterable[int] = settings.TARGET_HORIZONS,
              direction: Iterable[str] = settings.DIRECTION_MODELS,
              magnitude: Iterable[str] = settings.MAGNITUDE_MODELS,
              ratio: float = settings.TRAIN_RATIO, params: ModelSettings = ModelSettings(),
              output: str | None = None, parallel: int = 4
              ) -> tuple[list[TrainedModel], DataFrame]:
    """Split by time, fit every model of the grid, save them under ``output`` and return them with
    the test rows.

    The cleaned training and test rows are stored once and shared by all fits.  Up to ``parallel``
    fits run side by side; each is a sequence of distributed Spark jobs.  A target that the matrix
    lacks, or one with too few training rows, is skipped.
    """
    specs = [s for s in grid(horizons, direction, magnitude) if f"ret_{s[0]}d" in matrix.columns]
    train, test = (materialize(complete_schema(part), label)
                   for part, label in zip(chronological_split(matrix, ratio), ("train", "test")))
    targets = sorted({f"ret_{h}d" for h, _, _ in specs})
    if not targets:
        return [], test
    sizes = train.agg(*[F.count(t).alias(t) for t in targets]).first()
    specs = [s for s in specs if sizes[f"ret_{s[0]}d"] >= settings.MIN_TRAIN_ROWS]
    kept = {(h, kind): training_rows(train, h, kind) for h, kind, _ in specs}

    def fit(spec: tuple[int, str, str]) -> TrainedModel:
        horizon, kind, key = spec
        name = f"{kind}_{horizon}d_{key}"
        model = models.fit_model(key, kind, kept[(horizon, kind)], params)
        path = f"{output}/{name}" if output else None
        if path:
            models.save_model(model, path)
        return TrainedModel(name, kind, horizon, key, model, path)

    spark = matrix.sparkSession
    pool = ThreadPool(max(1, min(parallel, len(specs) or 1)))
    try:
        trained = pool.map(inheritable_thread_target(spark)(fit), specs, chunksize=1)
    finally:
        pool.close()
    if output:
        registry = [(m.name, m.model_type, m.horizon, m.key, m.path) for m in trained]
        spark.createDataFrame(registry, REGISTRY_SCHEMA).coalesce(1).write.mode(
            "overwrite").parquet(f"{output}/models")
    return trained, test


def load_all(spark: SparkSession, output: str) -> list[TrainedModel]:
    """The saved models of an earlier run, in name order."""
    rows = spark.read.parquet(f"{output}/models").orderBy("name").collect()    # one row per model
    return [TrainedModel(r["name"], r["model_type"], r["horizon"], r["key"],
                         models.load_model(spark, r["path"], r["key"]), r["path"]) for r in rows]


def score(model: TrainedModel, test: DataFrame) -> DataFrame:
    """Predictions of one model in the long form; rows without the target are left out."""
    rows = test.where(F.col(model.target).isNotNull())
    return model.model.transform(rows).select(
        F.lit(model.name).alias("model"), F.lit(model.model_type).alias("model_type"),
        F.lit(model.horizon).alias("horizon"), *KEY, F.col(model.target).alias("actual"),
        F.col("prediction").cast("double").alias("predicted"))


def score_all(trained: list[TrainedModel], test: DataFrame) -> DataFrame:
    """Predictions of all models, computed once and stored; none for an empty grid."""
    if not trained:
        return test.sparkSession.createDataFrame([], schemas.PREDICTIONS)
    parts = [score(m, test) for m in trained]
    return materialize(reduce(DataFrame.unionByName, parts), "predictions")
