"""A table whose every hour has an attack: nothing normal to learn from, and every query still gives what its SQL gives."""

from __future__ import annotations

import duckdb
import pytest
from oracle import differences, duck

import tidewatch.plans.all  # noqa: F401
from tidewatch.plans import registry


@pytest.fixture(scope="module")
def attacked(tmp_path_factory, small) -> str:
    """The small events, and a reading of 150 in the middle of every hour, which is an attack."""
    home = tmp_path_factory.mktemp("attacked")
    more = "SELECT 1000000000 + row_number() OVER (ORDER BY h) AS event_id, h + INTERVAL 30 MINUTE AS ts, 1 AS user_id, 'view' AS event_type, 150.0::DOUBLE AS value, props FROM (SELECT date_trunc('hour', ts) AS h, min(props) AS props FROM e GROUP BY 1)"
    duckdb.connect().execute(f"COPY (WITH e AS (SELECT event_id, ts, user_id, event_type, value, props FROM read_parquet('{small}/events.parquet')) SELECT * FROM e UNION ALL BY NAME {more}) TO '{home}/events.parquet' (FORMAT parquet)")
    return str(home)


#: Queries that have SQL.
EQUAL = (
    "alert_sentences",
    "category_flag_rates",
    "consecutive_alerts",
    "cohorts",
    "confusion",
    "explanations",
    "identity_check",
    "kolmogorov_smirnov",
    "pressure_proxy",
    "regression_bar",
    "rederived_flags",
    "regression_by_category",
    "residual_cohorts",
    "regression_delta",
    "cadence_tightening",
    "code_divergence",
    "discords",
    "flood_detection",
    "mapped_baselines",
    "nearest_normal",
    "nearest_reference",
    "wasserstein_to_normal",
)


@pytest.mark.parametrize("name", EQUAL)
def test_equals_its_sql_without_a_normal_window(spark, attacked, name):
    assert differences(registry.QUERIES[name](spark, attacked), duck(attacked), registry.SQL[name]) == ""


#: Fitted queries, with what a row says where nothing could be fitted.
FITTED = {
    "bidirectional_forest": {"tn": 0, "fp": 0, "fn": 0, "tp": 0},
    "detector": {"if_score": None, "forest": None, "flagged": None},
    "family_probe": {"recall": None, "threshold": None, "clears_null": False},
    "family_verdict": {"dominant_family": None, "verdict": "NO-GO-CEILING"},
    "forest_scores": {"if_score": None},
    "leave_one_run_out": {},
    "model_fingerprints": {},
    "mann_whitney_p": {"p": 1.0},
    "probability_rule": {"fired": None, "reasons": ""},
    "payload_augmented": {"label": 1},
}


@pytest.mark.parametrize("name", FITTED)
def test_fits_of_nothing_say_so(spark, attacked, name):
    rows = registry.QUERIES[name](spark, attacked).collect()
    assert all(r[c] == v for r in rows for c, v in FITTED[name].items())
    assert bool(rows) == (name != "leave_one_run_out")
