"""Models, probes and oversampling against plain Python."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewatch.operators import boosting, evaluate, models, probes, similarity
from tidewatch.operators.boosting import BoostedTrees
from tidewatch.plans import registry
import tidewatch.plans.all  # noqa: F401

X = ["x", "y"]


def table(n: int = 240, seed: int = 1):
    pick = np.random.default_rng(seed)
    points = pick.normal(size=(n, 2))
    return [(i, int(a + b > 1.2), float(a), float(b)) for i, (a, b) in enumerate(points)]


def test_boosted_trees_learn_and_round_trip():
    pick = np.random.default_rng(0)
    x = pick.normal(size=(1200, 5))
    x[::50, 3] = np.nan
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 1)).astype(int)
    model = BoostedTrees().fit(x[:900], y[:900])
    p = model.probability(x[900:])
    assert ((p > 0.5) == y[900:]).mean() > 0.85 and model.importances()[:3].sum() > 0.8
    again = BoostedTrees.loaded(model.plain())
    assert (again.probability(x) == model.probability(x)).all() and again.fingerprint() == model.fingerprint() == BoostedTrees().fit(x[:900], y[:900]).fingerprint()


def test_one_tree_equals_a_plain_split():
    """One round of depth 1 on all rows and features is the best cut by gain, missing values on the better side, its leaves the damped means."""
    pick = np.random.default_rng(3)
    x, y = pick.integers(0, 9, (90, 2)).astype(float), pick.integers(0, 2, 90)
    x[:25, 0] = np.nan
    y[:20] = 1
    model = BoostedTrees(rounds=1, depth=1, step=1.0, rows=1.1, columns=1.0).fit(x, y)
    g, h = 0.5 - y, np.full(90, 0.25)
    sides = [(m, f, c) for f in range(2) for c in range(1, 9) for m in (np.where(np.isnan(x[:, f]), True, x[:, f] < c), np.where(np.isnan(x[:, f]), False, x[:, f] < c))]
    sides.append((np.isnan(x[:, 0]), 0, None))
    best = max((g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1), i) for i, (m, _, _) in enumerate(sides) if h[m].sum() >= 1 and h[~m].sum() >= 1)
    left = sides[best[1]][0]
    want = np.where(left, *(-g[m].sum() / (h[m].sum() + 1) for m in (left, ~left)))
    assert model.probability(x) == pytest.approx(1 / (1 + np.exp(-want)))


FIVE = list("abcde")


@pytest.fixture(scope="module")
def frame(spark):
    """(DataFrame, features, labels, hashed keys) of the same rows, some values missing."""
    from tidewatch.functions.draws import number

    pick = np.random.default_rng(0)
    x = np.round(pick.normal(size=(1500, 5)), 2)
    x[::17, 3] = np.nan
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 1)).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(len(x))], "k int, label int, a double, b double, c double, d double, e double")
    keys = np.array([r[0] for r in spark.range(len(x)).coalesce(1).select(number(0, F.col("id").cast("int"))).collect()])
    return df.repartition(3), x, y, keys


def same_trees(a, b) -> bool:
    return all(np.array_equal(u, v) for u, v in zip(a.edges, b.edges)) and (a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.missing == b.missing).all() and np.allclose(a.leaf, b.leaf, atol=1e-12)


@pytest.mark.parametrize("rows", [1 << 16, 200])
def test_training_in_spark_equals_training_in_memory(frame, monkeypatch, rows):
    df, x, y, keys = frame
    monkeypatch.setattr(boosting, "ROWS", rows)
    model = boosting.train(df, FIVE, "k", [BoostedTrees(rounds=8)], "label")[0]
    assert same_trees(model, BoostedTrees(rounds=8).fit(x, y, keys)) and ((model.probability(x) > 0.5) == y).mean() > 0.8


def test_joint_classes_equal_training_in_memory(frame):
    df, x, _, keys = frame
    classes = (x[:, 0] > 0.3).astype(int) + (x[:, 1] > 0)
    place = (F.col("a") > 0.3).cast("int") + (F.col("b") > 0).cast("int")
    model = boosting.train(df, FIVE, "k", [BoostedTrees(rounds=7, classes=3)], place)[0]
    assert same_trees(model, BoostedTrees(rounds=7, classes=3).fit(x, classes, keys)) and (model.probabilities(x).argmax(0) == classes).mean() > 0.97
    got = models.predicted_class(df, model, ["p", "q", "r"], FIVE).select("k", "predicted").collect()
    assert all(r["predicted"] == "pqr"[c] for r, c in zip(sorted(got), model.probabilities(x).argmax(0)))
    assert model.probabilities(x).sum(0) == pytest.approx(np.ones(len(x)))


def test_models_side_by_side_equal_models_alone(frame, monkeypatch):
    """Permuted labels, rows left out, rows seen alone, features shut: each member as if it were trained by itself."""
    df, x, y, keys = frame
    monkeypatch.setattr(boosting, "GROUP", 3)
    n, tag = 12, np.arange(len(x)) % 4
    allowed = [None if i % 3 else [0, 1, 2] for i in range(n)]
    both = boosting.train(df, FIVE, "k", [BoostedTrees(rounds=7, allowed=a) for a in allowed], "label", labels=F.array(F.col("label"), 1 - F.col("label")), label_of=[i % 2 for i in range(n)], tag=F.col("k") % 4, without=[i % 4 for i in range(n)])
    whole = BoostedTrees(rounds=1).fit(x, y, keys).edges
    for i in range(n):
        on = tag != i % 4
        alone = BoostedTrees(rounds=7, allowed=allowed[i])
        monkeypatch.setattr(alone, "begin", lambda edges, m=alone: BoostedTrees.begin(m, whole))
        alone.fit(x[on], (y if i % 2 == 0 else 1 - y)[on], keys[on])
        assert same_trees(both[i], alone), i
    seen = boosting.train(df, FIVE, "k", [BoostedTrees(rounds=5) for _ in range(4)], "label", tag=F.col("k") % 4, only=[0, 1, 2, 3])
    assert all(same_trees(seen[i], BoostedTrees(rounds=5).fit(x[tag == i], y[tag == i], keys[tag == i])) for i in range(4))


def test_training_without_rows_is_an_error(frame):
    with pytest.raises(ValueError):
        boosting.train(frame[0].where("label > 5"), FIVE, "k", [BoostedTrees(rounds=2)], "label")
    with pytest.raises(ValueError):
        boosting.train(frame[0], FIVE, "k", [BoostedTrees(rounds=2), BoostedTrees(rounds=3)], "label")


def test_probability_rule_saved_and_loaded(spark, tmp_path):
    rows = spark.createDataFrame(table(), "k int, label int, x double, y double")
    model = models.fit_boosted(rows, X, "label", "k", rounds=30)
    path = f"file://{tmp_path}/rule.json"
    models.ProbabilityRule(model, 0.5, X).save(spark, path)
    rule = models.ProbabilityRule.load(spark, path)
    more = rows.unionByName(spark.createDataFrame([(999, 0, None, None)], "k int, label int, x double, y double"))
    hits = {r["k"]: r["float_provenance"] for r in rule.apply(more).collect()}
    p = dict(zip((r[0] for r in table()), model.probability(np.array([r[2:] for r in table()])), strict=True))
    assert not hits[999]["fired"] and all(hits[k]["fired"] == (v > 0.5) for k, v in p.items()) and any(h["fired"] for h in hits.values())
    assert all((h["reasons"] == []) != h["fired"] for h in hits.values())
    with pytest.raises(Exception):
        models.ProbabilityRule(model, 0.5, X).save(spark, path)  # written once


@pytest.mark.parametrize("block", [13, 4000])
def test_neighbours_are_exact(spark, block):
    rows = table()
    df = spark.createDataFrame(rows, "k int, label int, x double, y double")
    rare = [r for r in rows if r[1] == 1]
    got = {r["key"]: [n["key"] for n in r["near"]] for r in models.neighbours(df.where("label = 1"), df, "k", X, 4, extra=("label",), block=block).collect()}
    for r in rare:
        far = sorted(((r[2] - o[2]) ** 2 + (r[3] - o[3]) ** 2, o[0]) for o in rows if o[0] != r[0])
        assert got[r[0]] == [k for _, k in far[:4]]


def test_neighbours_need_few_distances(spark):
    """Clusters and a dense spot: the same neighbours as a plain search, with under a tenth of its distances."""
    pick = np.random.default_rng(8)
    points = np.concatenate((pick.normal(size=(1500, 2)) + 8 * pick.integers(0, 4, (1500, 2)), np.round(pick.normal(size=(500, 2)) / 50, 2)))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "k int, x double, y double")
    got = {r["key"]: r for r in models.neighbours(df, df, "k", X, 5, block=300).collect()}
    for i in range(0, 2000, 7):
        far = ((points - points[i]) ** 2).sum(1)
        far[i] = np.inf
        assert [n["key"] for n in got[i]["near"]] == np.lexsort((np.arange(2000), far))[:5].tolist()
    assert len(got) == 2000 and sum(r["seen"] for r in got.values()) < 0.1 * 2000 * 2000
    assert models.neighbours(df, df.limit(0), "k", X, 5).collect() == [] and len(models.neighbours(df.limit(3), df.limit(3), "k", X, 5).first()["near"]) == 2


@pytest.mark.parametrize("method", ["smote", "borderline", "adasyn", lambda data, *_: data.where("label = 1 and x > 1").select(F.col("k").alias("key"), F.lit(2.0).alias("weight"))])
def test_oversampling_evens_classes(spark, method):
    rows = table()
    df = spark.createDataFrame(rows, "k int, label int, x double, y double")
    out = models.oversample(df, X, "label", "k", method=method, block=50).collect()
    count = {c: sum(r["label"] == c for r in out) for c in (0, 1)}
    assert count[0] == count[1] and len([r for r in out if r["k"] is not None]) == len(rows)
    seeds = [r for r in rows if r[1] == 1]
    for r in [r for r in out if r["k"] is None]:  # on a line between a seed and one of its five nearest of the class
        assert any(abs(math.dist(a[2:], (r["x"], r["y"])) + math.dist(b[2:], (r["x"], r["y"])) - math.dist(a[2:], b[2:])) < 1e-9 for a in seeds for b in seeds)
    assert models.oversample(df.where("label = 0"), X, "label", "k").count() == df.where("label = 0").count()


def test_probe_tells_signal_from_noise(spark):
    pick = np.random.default_rng(2)
    rows = []
    for block, first in (("train", 0), ("validation", 1000), ("test", 2000)):
        for run in range(60):
            attack = run % 3 == 0
            rows += [(first + run * 6 + j, block, int(attack), float(attack * 3 + pick.normal()), float(pick.normal())) for j in range(4)]
    df = spark.createDataFrame(rows, "bucket long, block string, label int, good double, noise double")
    got = {r["family"]: r for r in probes.family_probe(df, {"F2": ["good"], "F3": ["noise"], "combined": ["good", "noise"]}, max_fpr=0.05, bootstraps=50, permutations=8, rounds=20).collect()}
    assert got["F2"]["clears_null"] and got["combined"]["clears_null"] and not got["F3"]["clears_null"] and got["F2"]["test_recall"] > 0.7
    assert got["combined"]["top_feature"] == "good" and 0 <= got["F2"]["low"] <= got["F2"]["recall"] <= got["F2"]["high"] <= 1
    verdict = probes.family_verdict(spark.createDataFrame(list(got.values())), {"good": "F2", "noise": "F3"}).first()
    assert verdict["verdict"] == "PROCEED-0030" and verdict["dominant_family"] == "F2"
    runs = probes.held_out_runs(df, ["good"], max_fpr=0.05, rounds=20)
    assert runs.count() == 40 and runs.where("n = 4").count() == 40
    summary = probes.run_summary(runs).first()
    assert summary["n_runs"] == 40 and summary["mean_recall"] == pytest.approx(np.mean([r["recall"] for r in runs.collect()]))


def test_probe_parts(spark):
    rows = spark.createDataFrame([(k,) for k in (20, 3, 4, 8, 6, 7)], "k long")
    found = {}
    for r in probes.events(rows, "k").collect():
        found.setdefault(r["event"], set()).add(r["k"])
    assert sorted(map(sorted, found.values())) == [[3, 4], [6, 7, 8], [20]]
    scored = spark.createDataFrame([("a", 0, s) for s in (0.1, 0.9, 0.5, 0.4)] + [("a", 1, s) for s in (0.6, 0.2)] + [("b", 0, 0.1), ("b", 0, 0.9)], "m string, label int, score double")
    cuts = evaluate.fit_threshold(scored.where("label = 0"), "score", 0.5, ("m",))
    assert {tuple(r) for r in cuts.collect()} == {("a", 0.5, 0.25), ("b", 0.9, 0.0)}
    assert {tuple(r) for r in probes.recalls(scored, cuts, "label", ("m",)).collect()} == {("a", 0.5, 0.25), ("b", 0.0, 0.0)}


def test_runs_are_those_of_all_rows(spark):
    """Seven runs of ten among 600 windows, whatever else there is; short ones and guards don't join or count."""
    rows = [(i, 1 if 0 <= i % 80 - 40 < 10 and i < 560 else 0, "train" if i < 400 else "validation") for i in range(600)] + [(700, 1, "validation"), (702, 1, "test"), (703, 1, "test"), (704, 1, "test")]
    df = spark.createDataFrame(rows, "bucket long, label int, block string").repartition(5)
    got = sorted(tuple(r) for r in probes.attack_runs(df).select("first", "last", "n").collect())
    assert got == [(80 * i + 40, 80 * i + 49, 10) for i in range(7)]
    assert probes.attack_runs(df, least_positive=62).count() == 0


def test_trees_draw_from_all_rows(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(20_000)], "k int, x double")
    got = models.drawn_rows(df, "k", 20_000, 50, 256, 1).groupBy("tree").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
    assert len(got) == 50 and all(256 <= r["n"] < 500 and r["low"] < 1500 and r["high"] > 18_500 for r in got)
    forest = models.fit_forest(df, ["x"], "k", trees=20)
    assert forest.size == 256 and len(forest.roots) == 20 and forest.fingerprint() == models.fit_forest(df.repartition(7), ["x"], "k", trees=20).fingerprint()
    assert forest.score(np.array([[-9000.0], [10_000.0]]))[0] > forest.score(np.array([[-9000.0], [10_000.0]]))[1]
    few = models.fit_forest(df.limit(30), ["x"], "k", trees=5)
    assert few.size == 30
    with pytest.raises(ValueError):
        models.fit_forest(df.limit(0), ["x"], "k")


def test_permuted_labels_are_the_same_labels(spark):
    df = spark.createDataFrame([(i * 3, i % 2) for i in range(40)], "event long, label int")
    got = {}
    for r in evaluate.permute(df, 6, 1).collect():
        got.setdefault(r["replicate"], {})[r["event"]] = r["label"]
    assert len(got) == 6 and all(set(v) == {i * 3 for i in range(40)} and sum(v.values()) == 20 for v in got.values()) and len({tuple(sorted(v.items())) for v in got.values()}) == 6


def test_forest_grid(spark):
    df = spark.createDataFrame(table(120), "k int, label int, x double, y double")
    got = models.forest_grid(df, df, X, "label", depths=(None, 2), leaves=(1, 5), trees=5).collect()
    assert {(r["depth"], r["leaf"]) for r in got} == {(None, 1), (None, 5), (2, 1), (2, 5)}
    assert all(r["tp"] + r["fn"] + r["fp"] + r["tn"] == 120 for r in got)


def plain_warp(a, b) -> float:
    far = [[math.inf] * (len(b) + 1) for _ in range(len(a) + 1)]
    far[0][0] = 0.0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            far[i][j] = abs(x - y) + min(far[i - 1][j], far[i][j - 1], far[i - 1][j - 1])
    return far[-1][-1]


def test_warped_distance_equals_a_plain_table():
    pick = np.random.default_rng(4)
    known = pick.normal(size=(6, 8))
    for q in pick.normal(size=(5, 8)):
        assert similarity.warped(q, known).tolist() == pytest.approx([plain_warp(q, k) for k in known])


def test_cascade_finds_the_same_with_few_warps():
    pick = np.random.default_rng(5)
    known, x = np.cumsum(pick.normal(size=(80, 10)), 1), np.cumsum(pick.normal(size=(300, 10)), 1)
    full = np.stack([similarity.warped(q, known) for q in x])
    assert (similarity.lower_bounds(x, known) <= full + 1e-9).all()
    got, warps = similarity.nearest_warped(x, known, rows=64)
    assert got == pytest.approx(full.min(1)) and warps < 0.25 * full.size
    assert similarity.nearest_warped(np.zeros((2, 1)), np.ones((1, 1)))[0].tolist() == [1.0, 1.0]


def test_two_sided_p(spark, small):
    got = {r["feature"]: r["p"] for r in registry.QUERIES["mann_whitney_p"](spark, small).collect()}
    z = {r["feature"]: r["z"] for r in registry.QUERIES["mann_whitney"](spark, small).collect()}
    assert all(got[f] == pytest.approx(math.erfc(z[f] / math.sqrt(2)), abs=1e-3) for f in got)


def test_isolation_forest_scores_outliers_higher():
    pick = np.random.default_rng(6)
    forest = models.IsolationForest(trees=100).fit(pick.normal(size=(500, 3)))
    scores = forest.score(np.concatenate((pick.normal(size=(200, 3)), np.full((3, 3), 9.0))))
    assert scores[200:].min() > scores[:200].max() and ((scores > 0) & (scores < 1)).all()
    path, one = models.average_path(np.array([1, 2, 256])), 2 * (math.log(255) + np.euler_gamma) - 2 * 255 / 256
    assert path.tolist() == pytest.approx([0, 1, one])


def test_detector_parts_agree(spark, small):
    """Flags are the union of rules and forest, and every mechanism is the one its flags say."""
    rows = registry.QUERIES["detector"](spark, small).collect()
    assert rows
    for r in rows:
        rule = r["protocol"] or r["pressure"] or r["rate"]
        assert r["flagged"] == (rule or r["forest"]) and (r["mechanism"] is None) == (not r["flagged"]) and (r["reasons"] == "") == (not rule) and 0 < r["if_score"] < 1
        assert r["mechanism"] in (None, "Rule + IF", "Rule", "IF") and ((r["mechanism"] == "Rule + IF") == (rule and r["forest"]))


PROBABILITIES = ["random_forest", "boosted_trees", "model_ensemble", "smote_forest", "per_type_models", "payload_augmented"]


@pytest.mark.parametrize("name", PROBABILITIES)
def test_probabilities_cover_the_test_block(spark, small, name):
    rows = registry.QUERIES[name](spark, small).collect()
    want = {r["bucket"]: r["is_attack"] for r in registry_blocks(spark, small) if r["block"] == "test"}
    assert {r["bucket"]: r["label"] for r in rows} == want and all(0 <= r["probability"] <= 1 for r in rows)


def registry_blocks(spark, small):
    from tidewatch.plans.detector import blocked

    return blocked(spark, small).select("bucket", "block", "is_attack").collect()


def test_fingerprints_are_stable(spark, small):
    a, b = ([tuple(r) for r in registry.QUERIES["model_fingerprints"](spark, small).orderBy("model").collect()] for _ in range(2))
    assert a == b and len({f for _, f in a}) == 2


def test_importances_are_shares_in_order(spark, small):
    rows = registry.QUERIES["feature_importances"](spark, small).collect()
    values = sorted((r["importance"] for r in rows), reverse=True)
    assert sum(values) == pytest.approx(1) and min(values) >= 0 and len(rows) == 8
