"""Every registered query against its SQL, on the smallest data set (rich in nulls)."""

import uuid

import pytest
from conftest import SMALL

import __spark_entry__ as entry
from tidemark.operators import models
from tidemark.plans import evaluate, report, train
from tidemark.runtime import shared_folder
from verification import catalog, oracles
from verification.compare import compare, connect
from verification.views import Views

QUERIES, ORACLES = catalog.build(), oracles.build()
ROWS_ONLY = {"train_grid", "optional_models", "coefficient_ranking", "model_evaluation",
             "evaluation_report"}


# Fits all eleven models at their full size; ``verification.compare.run`` checks it.
SLOW = {"model_persistence"}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_without_sql_is_listed():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.fixture(scope="module")
def views(spark):
    """One set of views for all queries, so that the matrix is built once."""
    return Views(spark, SMALL)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_matches_sql(views, con, name):
    assert compare(con, catalog.QUERIES[name](views), ORACLES[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_saved_models_predict_the_same(spark, views):
    path = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    small = models.ModelSettings(trees=3, rounds=2, fourier_features=8)
    trained, test = train.train_all(views.imputed, (1,), oracles.PERSISTED["direction"],
                                    oracles.PERSISTED["magnitude"], params=small, output=path)
    key = ["model", "ticker", "event_date", "predicted"]
    before = train.score_all(trained, test).select(*key)
    after = train.score_all(train.load_all(spark, path), test).select(*key)
    assert before.count() > 0 and before.exceptAll(after).count() == 0


def test_an_empty_grid_has_no_predictions_and_a_report(spark, views):
    trained, test = train.train_all(views.imputed, (), (), ())
    scored = train.score_all(trained, test)
    assert scored.collect() == []
    lines = [r["line"] for r in report.report_lines(evaluate.evaluate_all(scored)).collect()]
    assert any("nothing to compare" in x for x in lines)
