"""Queries of fitted models on the tables, against counts and plain versions of what they must agree with."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from tidewatch.operators import similarity
from tidewatch.plans import registry, residual_plans
from tidewatch.plans.detector import blocked, frames
from tidewatch.plans.series_plans import labelled
from tidewatch.operators import splits, windows
import tidewatch.plans.all  # noqa: F401

from test_learned import plain_warp


def rows(spark, folder, name):
    return registry.QUERIES[name](spark, folder).collect()


@pytest.fixture(scope="module")
def blocks(spark, medium):
    return {r["bucket"]: r for r in blocked(spark, medium).collect()}


@pytest.fixture(scope="module")
def cohort(spark, medium):
    return residual_plans.probed(spark, medium).cache()


def test_forest_scores_every_window(spark, medium, blocks):
    got = rows(spark, medium, "forest_scores")
    assert {r["bucket"]: (r["block"], r["label"]) for r in got} == {k: (b["block"], b["is_attack"]) for k, b in blocks.items()} and all(0 < r["if_score"] < 1 for r in got)


def test_bidirectional_forest_counts_its_cohort(spark, medium):
    own = splits.contiguous(windows.feature_windows(frames(spark, medium).drop("bucket"), registry.HOUR)).where("block = 'test'").select("categories").collect()
    got = rows(spark, medium, "bidirectional_forest")[0]
    assert got["tp"] + got["fn"] == sum(5 in r["categories"] for r in own) and got["fp"] + got["tn"] == sum(r["categories"] == [0] for r in own)


def test_several_classes(spark, medium, blocks):
    from tidewatch.sources.frames import CATEGORIES

    got = {r["bucket"]: r for r in rows(spark, medium, "multiclass_forest")}
    assert set(got) == {k for k, b in blocks.items() if b["block"] == "test"}
    for k, r in got.items():
        assert r["category"] == CATEGORIES[min((c for c in blocks[k]["categories"] if c), default=0)] and r["predicted"] in CATEGORIES.values()


def test_boosted_classes(spark, medium, blocks):
    got = {r["bucket"]: r for r in rows(spark, medium, "boosted_classes")}
    assert set(got) == {k for k, b in blocks.items() if b["block"] == "test"}
    seen = {min((c for c in b["categories"] if c), default=0) for b in blocks.values() if b["block"] == "train"}
    assert all(r["category"] == min((c for c in blocks[k]["categories"] if c), default=0) and r["predicted"] in seen for k, r in got.items())


@pytest.mark.parametrize("name", ["smote", "smote_borderline", "adasyn"])
def test_oversampled_classes_are_even(spark, medium, blocks, name):
    got = {(r["label"], r["synthetic"]): r["n"] for r in rows(spark, medium, name)}
    n = Counter(b["is_attack"] for b in blocks.values() if b["block"] == "train")
    assert got[1, False] == n[1] and got[0, False] == n[0] and got[1, True] == n[0] - n[1]


def test_warped_neighbours_equal_a_plain_search(spark, medium):
    series = labelled(spark, medium)
    known = similarity.library(similarity.subsequences(series, 15, keep="normal"))
    assert 0 < len(known) <= 300
    got = {r["bucket"]: r["distance"] for r in rows(spark, medium, "warped_neighbours")}
    subs = {}
    for r in similarity.subsequences(series, 15).collect():
        subs.setdefault(r["bucket"], []).append(r["values"])
    assert set(got) == set(subs)
    for bucket in sorted(subs)[::240]:
        assert got[bucket] == pytest.approx(max(min(plain_warp(q, k) for k in known.tolist()) for q in subs[bucket]))


def test_probe_counts_and_null(spark, medium, cohort):
    n = Counter((r["block"], r["label"]) for r in cohort.collect())
    got = {r["family"]: r for r in rows(spark, medium, "family_probe")}
    assert set(got) == {"F1", "F2", "F3", "combined"}
    for r in got.values():
        assert r["n_train"] == n["train", 0] + n["train", 1] and r["n_train_positive"] == n["train", 1] and r["n_test_positive"] == n["test", 1]
        assert r["clears_null"] == (r["low"] > r["null_p95"]) and r["achieved_fpr"] <= 0.003 and r["low"] <= r["high"]
    verdict = rows(spark, medium, "family_verdict")[0]
    assert (verdict["verdict"] == "NO-GO-CEILING") == (not verdict["proceed_first"] and not verdict["proceed_second"])


def test_held_out_runs_are_the_cohorts(spark, medium, cohort):
    own = sorted(r["bucket"] for r in cohort.collect() if r["label"] == 1 and r["block"] in ("train", "validation"))
    runs = [r for r in np.split(own, np.flatnonzero(np.diff(own) != 1) + 1) if len(r) >= 3]
    got = rows(spark, medium, "leave_one_run_out")
    assert {(r["first"], r["last"], r["n"]) for r in got} == {(int(r[0]), int(r[-1]), len(r)) for r in runs}
    assert all(abs(r["recall"] * r["n"] - round(r["recall"] * r["n"])) < 1e-9 and r["achieved_fpr"] <= 0.003 for r in got)
    summary = rows(spark, medium, "run_dependence")[0]
    recalls = [r["recall"] for r in got]
    assert summary["n_runs"] == len(got) and summary["mean_recall"] == pytest.approx(np.mean(recalls)) and summary["run_dependent"] == (np.std(recalls) > 0.25)


def test_rule_covers_the_test_block(spark, medium, blocks):
    got = rows(spark, medium, "probability_rule")
    assert {r["bucket"] for r in got} == {k for k, b in blocks.items() if b["block"] == "test"} and all(r["fired"] == (r["reasons"] != "") for r in got)


def test_folds_are_scored_alike(spark, medium):
    got = rows(spark, medium, "fold_models")
    total = {(r["fold"], r["features"]): r["tn"] + r["fp"] + r["fn"] + r["tp"] for r in got}
    assert {f for f, _ in total} == {1, 2, 3, 4, 5} and all(total[f, "X"] == total[f, "Y"] > 0 for f in range(1, 6))
    for r in rows(spark, medium, "fold_model_summary"):
        own = [x["recall"] for x in got if x["features"] == r["features"]]
        assert r["recall_mean"] == pytest.approx(np.mean(own)) and r["recall_std"] == pytest.approx(np.std(own))


def test_grid_counts_the_validation_block(spark, medium, blocks):
    got = rows(spark, medium, "forest_grid")
    n = Counter(b["is_attack"] for b in blocks.values() if b["block"] == "validation")
    assert {(r["depth"], r["leaf"]) for r in got} == {(d, leaf) for d in (None, 10, 20) for leaf in (1, 2, 5)}
    assert all(r["tp"] + r["fn"] == n[1] and r["fp"] + r["tn"] == n[0] for r in got)
