"""Every registered query against its SQL, over the whole tables."""

import oracle
import pytest
from conftest import SMALL

from gridlens.catalog.oracles import ORACLES
from gridlens.catalog.queries import QUERIES

TRAINED = {"isolation_forest", "detector_train_metrics", "random_forest", "gradient_boosting", "cross_validate",
           "feature_importance", "learned_forecaster", "learned_forecast", "vote_metrics", "score_readings", "fit_or_load", "stream_scores"}


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SMALL)


def test_every_query_but_trained_models_has_sql():
    assert set(QUERIES) - set(ORACLES) == TRAINED
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    found = QUERIES[name](spark, SMALL).toArrow()
    assert oracle.difference(found, con.execute(ORACLES[name]).to_arrow_table()) is None


def test_entry(spark):
    found = oracle.load_entry().entry(spark)
    assert found.columns == ["device_id", "samples", "energy_kwh", "cost", "peak_power", "peak_power_time", "load_status"]
    assert found.count() > 0
