"""Tables whose windows are all attacks, or all normal: cuts without a negative or a positive are those of the SQL."""

from __future__ import annotations

import duckdb
import pytest
from oracle import differences, duck

import tidewatch.plans.all  # noqa: F401
from tidewatch.plans import registry


@pytest.fixture(scope="module", params=["value + 150", "least(value, 50)"], ids=["attacks", "normal"])
def one_class(request, tmp_path_factory, small) -> str:
    """The small views, each of them an attack or none."""
    home = tmp_path_factory.mktemp("one_class")
    duckdb.connect().execute(f"COPY (SELECT * REPLACE ({request.param} AS value) FROM read_parquet('{small}/events.parquet') WHERE event_type = 'view') TO '{home}/events.parquet' (FORMAT parquet)")
    return str(home)


def test_cuts_of_one_class(spark, one_class):
    assert differences(registry.QUERIES["single_feature_cuts"](spark, one_class), duck(one_class), registry.SQL["single_feature_cuts"]) == ""
