from __future__ import annotations

import pytest
from oracle import differences, duck

from tidewatch.plans import registry
import tidewatch.plans.all  # noqa: F401

CHECKED = sorted(registry.SQL)
OTHERS = sorted(set(registry.QUERIES) - set(registry.SQL))


@pytest.fixture(scope="module")
def con(medium):
    return duck(medium)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, medium, con, name):
    assert differences(registry.QUERIES[name](spark, medium), con, registry.SQL[name]) == ""


#: Fitted models and their draws, which SQL has no words for; tests/test_learned.py and tests/test_fitted.py check them.
FITTED = {
    "detector", "random_forest", "boosted_trees", "model_ensemble", "smote", "smote_borderline", "adasyn", "smote_forest", "per_type_models", "forest_scores", "bidirectional_forest", "model_fingerprints", "warped_neighbours",
    "feature_importances", "multiclass_forest", "mann_whitney_p", "family_probe", "family_verdict", "leave_one_run_out", "run_dependence", "probability_rule", "payload_augmented", "boosted_classes", "fold_models", "fold_model_summary", "forest_grid",
}


def test_only_fitted_models_lack_sql():
    assert set(OTHERS) == FITTED
