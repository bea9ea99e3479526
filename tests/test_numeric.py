"""Numeric and ordered operators against brute force, in their large-data forms."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.numeric import correlation_p_value
from tidemark.operators.ordering import average_rank, exact_medians, running_products


def _p_by_integration(r, nu):
    """Two-sided p-value by integrating (1 - s^2)^((nu - 2) / 2) over the angle."""
    t = np.linspace(0, math.pi / 2, 2_000_001)
    f = np.cos(t) ** (nu - 1)
    mass = np.concatenate([[0], np.cumsum((f[1:] + f[:-1]) / 2)])
    return 1 - np.interp(math.asin(abs(r)), t, mass) / mass[-1]


@pytest.mark.parametrize("n", [3, 4, 5, 6, 9, 48, 49, 1999, 2002, 2003, 5000, 100_000, 1_000_000])
def test_p_value(spark, n):
    rs = [0.0, 0.5 / math.sqrt(n), -2.0 / math.sqrt(n + 2), 0.9 / math.sqrt(math.sqrt(n))]
    got = [row[0] for row in spark.createDataFrame([(r, n) for r in rs], "r double, n int").select(
        correlation_p_value(F.col("r"), F.col("n"))).collect()]
    assert got == pytest.approx([_p_by_integration(r, n - 2) for r in rs], abs=1e-6)


def test_p_value_edges(spark):
    rows = spark.createDataFrame([(1.0, 10), (-1.0, 5), (0.5, 2), (None, 10)], "r double, n int")
    got = [r[0] for r in rows.select(correlation_p_value(F.col("r"), F.col("n"))).collect()]
    assert got == [0.0, 0.0, None, None]


def test_average_rank(spark):
    rng = np.random.default_rng(3)
    # a third of the rows share one value
    rows = [(m, i, 0.5 if rng.random() < 0.34 else float(rng.integers(0, 200)) / 100)
            for m in ("a", "b") for i in range(800)]
    df = spark.createDataFrame(rows, "model string, i int, x double")
    got = {(r["model"], r["i"]): r["rank"]
           for r in average_rank(df, ["model"], "x", "rank").collect()}
    assert len(got) == len(rows)
    for m in ("a", "b"):
        xs = np.array([x for k, _, x in rows if k == m])
        for k, i, x in rows:
            if k == m:
                assert got[(m, i)] == (xs < x).sum() + ((xs == x).sum() + 1) / 2


def test_running_products(spark):
    rng = np.random.default_rng(4)
    rows = [(m, int(d), f"t{i:04d}", float(1 + rng.normal() / 50))
            for m in ("a", "b") for i, d in enumerate(rng.integers(0, 5, 600))]
    df = spark.createDataFrame(rows, "model string, day int, ticker string, f double")
    got = running_products(df, ["model"], ["day", "ticker"], {"p": "f"}, "at")
    for m in ("a", "b"):
        mine = got.where(F.col("model") == m).orderBy("day", "ticker").collect()
        want = np.cumprod([f for k, d, t, f in sorted(rows) if k == m])
        assert [r["at"] for r in mine] == list(range(600))
        assert [r["p"] for r in mine] == pytest.approx(list(want), rel=1e-12)


@settings(max_examples=12, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.sampled_from([0.0, 1.0, -1.0]),
                          st.floats(-1e6, 1e6)), min_size=30, max_size=200))
def test_medians_by_narrowing(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    present = [v for v in values if v is not None]
    want = float(np.median(present)) if present else None
    for limit in (5, 10_000):
        got = exact_medians(df, ["x"], limit)["x"]
        assert got == (want if want is None else pytest.approx(want, rel=1e-12, abs=1e-12))


def test_medians_of_many_columns(spark):
    df = spark.range(10_001).select(
        (F.col("id") * 1.0).alias("a"), F.when(F.col("id") % 3 != 0, F.sin("id")).alias("b"),
        F.lit(None).cast("double").alias("c"), F.when(F.col("id") < 9000, 7.0)
        .otherwise(F.col("id") * 1.0).alias("d"))
    pdf = df.toPandas()
    got = exact_medians(df, ["a", "b", "c", "d"], limit=50)
    for c in ("a", "b", "d"):
        assert got[c] == pytest.approx(pdf[c].astype(float).median(), rel=1e-12)
    assert got["c"] is None
