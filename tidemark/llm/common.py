"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.runtime import ship_by_value

ship_by_value(__name__)

# Text bytes a Python worker turns into objects at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, for caches kept between tasks.

    Functions shipped by value get new module globals in every task, so those cannot hold a cache.
    """
    name = "tidemark_worker_store"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def release_caches() -> None:
    """Drop what operators before have cached in this worker, as it is kept with the worker and
    would stand beside the memory of a stage that needs much of its own."""
    worker_store().clear()


class PieceCache:
    """Values of pre-tokens, computed once each and for many at a time.

    It starts anew when it holds more than ``pieces`` entries or ``chars`` characters.
    """

    def __init__(self, compute: Callable[[list[str]], list], pieces: int = 300_000,
                 chars: int = 4_000_000) -> None:
        self.compute, self.most_pieces, self.most_chars = compute, pieces, chars
        self.values: dict[str, Any] = {}
        self.chars = 0

    def of(self, pieces: list[str]) -> list:
        if len(self.values) > self.most_pieces or self.chars > self.most_chars:
            self.values, self.chars = {}, 0
        new = list(set(pieces).difference(self.values))
        if new:
            self.values.update(zip(new, self.compute(new)))
            self.chars += sum(map(len, new))
        return list(map(self.values.__getitem__, pieces))


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch into zero-copy slices of about ``SLICE_BYTES`` of text each."""
    start, size = 0, 0
    lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and size + (n or 0) > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column as Python strings, null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def map_texts(df: DataFrame, column: str, outputs: str,
              fn: Callable[[list[str]], dict[str, pa.Array]]) -> DataFrame:
    """``df`` with the columns that ``fn`` derives from the texts of ``column``, one value each.

    ``outputs`` is a DDL list of the new columns.  One that ``df`` already has is replaced.
    """
    spark = df.sparkSession
    new = spark.createDataFrame([], outputs).schema
    names = {f.name.lower() for f in new}
    kept = [f for f in df.schema if f.name.lower() not in names or f.name == column]
    clash = column.lower() in names
    schema = type(df.schema)([f for f in kept if not (clash and f.name == column)] + list(new))
    carried = [f.name for f in schema if f.name not in new.names]

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, column):
                made = fn(texts_of(part, column))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in carried] + [made[f] for f in new.names],
                    names=carried + list(new.names))

    return df.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def nested(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as one struct ``row`` beside computed columns, so that no input column's name
    can clash with a working column.  ``select("row.*")`` gives the rows back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                     *[c.alias(n) for n, c in columns.items()])


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under working names that no operator's columns have, and the names by column."""
    names = {c: f"column {i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def brought_back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(f"`{working}`").alias(c) for c, working in names.items()])
