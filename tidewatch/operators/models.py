"""Models: the isolation forest, tree ensembles of the machine-learning library, and oversampling of rare classes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import number, share
from ..sources.scratch import written
from . import boosting, ordered
from .boosting import BoostedTrees

#: Rows to which others are compared first in a search for neighbours, at most.
PIVOTS = 1024


def average_path(n):
    """Expected path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Random isolation trees as flat arrays; the score is 2 ** (-mean path / expected path), larger for outliers.

    Trees split a feature that varies at a uniform place, to a depth of log2 of the sample; a leaf adds the expected path of
    its rows.
    """

    def __init__(self, trees: int = 300, sample: int = 256, seed: int = 42):
        self.trees, self.sample, self.seed = trees, sample, seed

    def fit(self, x: np.ndarray) -> IsolationForest:
        """Trees of draws from rows in memory."""
        if not len(x):
            raise ValueError("no rows to fit a forest on")
        pick = np.random.default_rng(self.seed)
        size = min(self.sample, len(x))
        return self.joined([isolated(x[pick.choice(len(x), size, replace=False)], self.seed, t) for t in range(self.trees)], size)

    def joined(self, trees: list[tuple], size: int) -> IsolationForest:
        """A forest of the trees of :func:`isolated`, of ``size`` rows each."""
        starts = np.cumsum([0, *[len(t[0]) for t in trees]])[:-1]
        self.size, self.roots = size, starts
        self.feature, self.cut, self.path = (np.concatenate([np.asarray(t[i]) for t in trees]) for i in (0, 1, 3))
        self.left = np.concatenate([np.where(np.asarray(t[2]) >= 0, np.asarray(t[2]) + at, -1) for t, at in zip(trees, starts, strict=True)])
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            active = every
            while len(active):
                active = active[self.feature[node[active]] >= 0]
                at = node[active]
                node[active] = self.left[at] + (x[active, self.feature[at]] >= self.cut[at])
            total += self.path[node]
        return 2.0 ** (-total / len(self.roots) / max(float(average_path(self.size)), 1e-12))

    def fingerprint(self) -> str:
        """A hash of all parameters and trees."""
        raw = b"".join(np.ascontiguousarray(a).tobytes() for a in (self.feature, self.cut, self.left, self.path, self.roots))
        return hashlib.sha256(f"{self.trees},{self.sample},{self.seed}".encode() + raw).hexdigest()


def isolated(rows: np.ndarray, seed: int, tree: int) -> tuple[list, list, list, list]:
    """(feature, cut, left child, path) of the nodes of a random tree of ``rows``; feature -1 is a leaf, right is left + 1."""
    pick = np.random.default_rng((seed, tree))
    deep = int(np.ceil(np.log2(max(len(rows), 2))))
    feature, cut, left, path = [-1], [0.0], [-1], [0.0]
    todo = [(rows, 0, 0)]
    while todo:
        own, depth, node = todo.pop()
        low, high = (own.min(0), own.max(0)) if len(own) > 1 else (np.zeros(1), np.zeros(1))
        varied = np.flatnonzero(high > low)
        if depth >= deep or not len(varied):
            path[node] = depth + float(average_path(len(own)))
            continue
        f = int(pick.choice(varied))
        at = float(pick.uniform(low[f], high[f]))
        feature[node], cut[node], left[node] = f, at, len(feature)
        below = own[:, f] < at
        for part in (own[below], own[~below]):
            todo.append((part, depth + 1, len(feature)))
            feature.append(-1), cut.append(0.0), left.append(-1), path.append(0.0)
    return feature, cut, left, path


def drawn_rows(rows: DataFrame, key: str, n: int, trees: int, sample: int, seed: int, spare: float = 6.0) -> DataFrame:
    """``rows`` that each tree may draw (columns ``tree`` and ``draw``): about ``sample`` and some spare of all, by hash.

    A row's hash falls into the slot of one tree or of none, and as many hashes are taken as it takes slots for all trees: on
    many rows that is one, so the rows that are told apart grow with the draws, not with rows times trees.
    """
    share_ = min(1.0, (sample + spare * sample**0.5 + 16) / max(1, n))
    slots = int(1 / share_)
    turns = -(-trees // slots)
    turn = F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))
    out = rows.withColumn("__turn", turn).withColumn("draw", share(seed, "__turn", key))
    slot = F.floor(F.col("draw") / share_).cast("int")
    return out.withColumn("tree", F.col("__turn") * slots + slot).where((slot < slots) & (F.col("tree") < trees)).drop("__turn")


def fit_forest(normal: DataFrame, features: list[str], key: str, *, trees: int = 300, sample: int = 256, seed: int = 42, needed: bool = True) -> IsolationForest | None:
    """A forest of normal rows: every tree draws ``sample`` of all of them by hash of seed and key, and is built in a task.

    The driver gets the trees, of at most 2 * ``sample`` nodes each.  Without a row it is an error, or no forest unless ``needed``.
    """
    rows = written(normal.select(F.col(key).alias("key"), F.array(*[F.col(f).cast("double") for f in features]).alias("x")), "normal")
    n = rows.count()
    if not n and not needed:
        return None
    if not n:
        raise ValueError("no rows to fit a forest on")
    size, spare, built = min(sample, n), 6.0, {}

    def build(pdf):
        import pandas as pd

        x = np.stack(pdf["x"].to_numpy()).astype(float)
        order = np.lexsort((*x.T[::-1], pdf["draw"].to_numpy()))[:size]
        nodes = isolated(x[order], seed, int(pdf["tree"].iloc[0])) if len(order) == size else ([], [], [], [])
        return pd.DataFrame([[pdf["tree"].iloc[0], *nodes]], columns=["tree", "feature", "cut", "left", "path"])

    while len(built) < trees:  # a tree whose spare did not do, one in some 10**8, makes for another turn with more
        found = drawn_rows(rows, "key", n, trees, sample, seed, spare).groupBy("tree").applyInPandas(lambda pdf: build(pdf), "tree int, feature array<int>, cut array<double>, left array<int>, path array<double>")
        built |= {r["tree"]: tuple(r)[1:] for r in found.collect() if r["feature"] and r["tree"] not in built}
        spare *= 4
    return IsolationForest(trees, sample, seed).joined([built[t] for t in range(trees)], size)


def forest_scores(rows: DataFrame, forest: IsolationForest | None, features: list[str], out: str = "if_score") -> DataFrame:
    """``rows`` with the forest's score; null without a forest."""
    if forest is None:
        return rows.withColumn(out, F.lit(None).cast("double"))
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def rate(x):
        import pandas as pd

        return pd.Series(shared.value.score(np.stack(x.to_numpy()).astype(float)) if len(x) else [], dtype=float)

    return rows.withColumn(out, rate(F.array(*[F.col(f).cast("double") for f in features])))


def assembled(rows: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(rows)


def balanced_weights(rows: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weights that give both classes the same total."""
    n = rows.agg(F.count("*").alias("__n"), F.sum(label).alias("__p"))
    w = F.when(F.col(label) == 1, F.col("__n") / (2 * F.greatest(F.col("__p"), F.lit(1)))).otherwise(F.col("__n") / (2 * F.greatest(F.col("__n") - F.col("__p"), F.lit(1))))
    return rows.crossJoin(F.broadcast(n)).withColumn(out, w).drop("__n", "__p")


def forest_grid(rows: DataFrame, checked: DataFrame, features: list[str], label: str, *, depths=(None, 10, 20), leaves=(1, 2, 5), trees: int = 300, seed: int = 42) -> DataFrame:
    """(depth, leaf, tp, fp, fn, tn, ...) of forests fitted on ``rows`` for every depth (None: the deepest there is) and least leaf, on ``checked``."""
    from .evaluate import confusion

    out = None
    for depth in depths:
        for leaf in leaves:
            model = random_forest(rows, features, label, trees=trees, depth=depth or 30, leaf=leaf, seed=seed)
            one = confusion(probability(checked, model, features), F.col(label) == 1, F.col("probability") >= 0.5)
            one = one.withColumns({"depth": F.lit(depth).cast("int"), "leaf": F.lit(leaf)})
            out = one if out is None else out.unionByName(one)
    return out


def random_forest(rows: DataFrame, features: list[str], label: str, *, trees: int = 300, depth: int = 30, leaf: int = 1, balanced: bool = True, seed: int = 42):
    """A fitted random forest classifier."""
    from pyspark.ml.classification import RandomForestClassifier

    data = assembled(balanced_weights(rows, label) if balanced else rows.withColumn("weight", F.lit(1.0)), features)
    return RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, maxDepth=min(depth, 30), minInstancesPerNode=leaf, seed=seed).fit(data)


def multiclass_forest(rows: DataFrame, features: list[str], label: str, *, trees: int = 100, depth: int = 10, seed: int = 42):
    """A fitted random forest over numbered classes."""
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=min(depth, 30), seed=seed).fit(assembled(rows, features))


def boosted(rows: DataFrame, features: list[str], label: str, *, rounds: int = 150, depth: int = 4, step: float = 0.1, balanced: bool = True, seed: int = 42):
    """Fitted gradient-boosted trees."""
    from pyspark.ml.classification import GBTClassifier

    data = assembled(balanced_weights(rows, label) if balanced else rows.withColumn("weight", F.lit(1.0)), features)
    return GBTClassifier(labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed).fit(data)


def probability(rows: DataFrame, model, features: list[str], out: str = "probability") -> DataFrame:
    """``rows`` with the model's probability of class 1."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(assembled(rows, features, "__features").withColumnRenamed("__features", "features"))
    keep = [c for c in rows.columns if c != out]
    return scored.select(*keep, vector_to_array("probability")[1].alias(out) if out != "probability" else vector_to_array("probability")[1].alias("probability"))


def model_fingerprint(model) -> str:
    """A hash of a tree ensemble's parameters and trees."""
    params = ",".join(f"{p.name}={v}" for p, v in sorted(model.extractParamMap().items(), key=lambda x: x[0].name) if p.name not in ("featuresCol",))
    return hashlib.sha256((params + model.toDebugString.split("\n", 1)[1]).encode()).hexdigest()


def fit_boosted(rows: DataFrame, features: list[str], label: str, key: str, **settings) -> BoostedTrees:
    """Boosted trees trained in Spark on all labelled rows."""
    return boosting.train(rows, features, key, [BoostedTrees(**settings)], label)[0]


def boosted_probability(rows: DataFrame, model: BoostedTrees, features: list[str], out: str = "probability") -> DataFrame:
    """``rows`` with the model's probability of class 1; null where all features are null (nothing is known of the row)."""
    return boosting.scores(rows, [model], features, out).withColumn(out, F.get(out, F.lit(0)))


def fit_classes(rows: DataFrame, features: list[str], label: str, key: str, classes: list, **settings) -> BoostedTrees:
    """Boosted trees of all ``classes`` under a joint softmax, trained in Spark on all rows of these classes."""
    place = F.coalesce(*[F.when(F.col(label) == c, F.lit(i)) for i, c in enumerate(classes)])
    return boosting.train(rows, features, key, [BoostedTrees(classes=max(2, len(classes)), **settings)], place)[0]


def predicted_class(rows: DataFrame, model: BoostedTrees, classes: list, features: list[str], out: str = "predicted") -> DataFrame:
    """``rows`` with the class of the largest probability, the first of those as large; null without features."""
    p = boosting.class_probabilities(rows, model, features, "__p")
    place = F.array_position("__p", F.array_max("__p")).cast("int")
    return p.withColumn(out, F.get(F.array(*[F.lit(c) for c in classes]), place - 1)).drop("__p")


class ProbabilityRule:
    """A rule on a fitted model's probability: fires above the threshold, never on rows without features."""

    def __init__(self, model: BoostedTrees, threshold: float, features: list[str]):
        self.model, self.threshold, self.features = model, float(threshold), list(features)

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the rule once, in an envelope with its checksum."""
        from ..sources.sinks import write_once

        write_once(spark, {"model": self.model.plain(), "threshold": self.threshold, "features": self.features, "fingerprint": self.model.fingerprint()}, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ProbabilityRule:
        """A saved rule; an error if the file or the trees aren't those that were saved."""
        from ..sources.sinks import read_envelope

        got = read_envelope(spark, path)
        model = BoostedTrees.loaded(got["model"])
        if model.fingerprint() != got["fingerprint"]:
            raise ValueError("model differs from its fingerprint")
        return cls(model, got["threshold"], got["features"])

    def apply(self, rows: DataFrame, out: str = "float_provenance") -> DataFrame:
        """``rows`` with the hit, a struct<fired, reasons>."""
        scored = boosted_probability(rows, self.model, self.features, "__probability")
        return scored.withColumn(out, probability_rule(F.col("__probability"), self.threshold)).drop("__probability")


def probability_rule(probability_: Column, threshold: float) -> Column:
    """A hit where the probability exceeds the threshold."""
    fired = F.coalesce(probability_ > threshold, F.lit(False))
    from .rules import significant

    text = F.concat(F.lit("cmri_float_provenance_score="), significant(probability_), F.lit(">"), significant(F.lit(float(threshold))))
    return F.struct(fired.alias("fired"), F.when(fired, F.array(text)).otherwise(F.array().cast("array<string>")).alias("reasons"))


def per_type_maximum(scores: dict[str, Column]) -> Column:
    """The largest probability of the types that are active (name of the activity column to probability); 0 if none is."""
    parts = [F.when(F.col(active) > 0, p).otherwise(0.0) for active, p in scores.items()]
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def _far(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots."""
    return np.sqrt(((x[:, None, :] - pivots[None]) ** 2).sum(2))


def _meet(k: int, extra: tuple[str, ...]):
    """(key, far, other, x, ..., seen): the k nearest of a part of a cell to each of some rows, within the row's reach.

    Rows of a cell are ordered by their distance to its pivot: those whose distance differs by more than the reach from the
    row's own are farther away than the reach, and no distance to them is computed.
    """

    def run(own, other):
        import pandas as pd

        columns = ["key", "far", "other", "x", *extra, "seen"]
        if not len(own) or not len(other):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
        other = other.sort_values(["far", "key"], kind="stable").reset_index(drop=True)
        points, far, names = np.stack(other["x"].to_numpy()).astype(float), other["far"].to_numpy(), other["key"].to_numpy()
        rank = np.empty(len(names), np.int64)
        rank[np.argsort(names, kind="stable")] = np.arange(len(names))
        ids, squared, places, seen = [], [], [], []
        for key, x, at, reach in zip(own["key"].to_numpy(), own["x"], own["far"].to_numpy(), own["reach"].to_numpy(), strict=True):
            slack = reach + 1e-9 * (1 + abs(at) + (reach if np.isfinite(reach) else 0))
            a, b = np.searchsorted(far, at - slack, "left"), np.searchsorted(far, at + slack, "right")
            d = ((points[a:b] - np.asarray(x, float)) ** 2).sum(1)
            near = np.lexsort((rank[a:b], d))
            near = near[names[a:b][near] != key][:k]
            ids.append(np.full(len(near), key))
            squared.append(d[near])
            places.append(near + a)
            seen.append(np.where(np.arange(len(near)) == 0, b - a, 0))
        at = np.concatenate(places)
        taken = other.iloc[at]
        return pd.DataFrame({"key": np.concatenate(ids), "far": np.concatenate(squared), "other": taken["key"].to_numpy(), "x": taken["x"].to_numpy(), **{c: taken[c].to_numpy() for c in extra}, "seen": np.concatenate(seen)}, columns=columns)

    return run


def neighbours(rows: DataFrame, others: DataFrame, key: str, features: list[str], k: int, *, extra: tuple[str, ...] = (), block: int = 4_000, pivots: int = PIVOTS) -> DataFrame:
    """(key, near, seen) for every one of ``rows``: its k nearest of ``others`` but itself, by squared distance, ties by key.

    ``near`` is array<struct<far, key, x, ...>>, nearest first, with the ``extra`` columns; ``seen`` counts the distances that
    were computed to find them, those to pivots aside.  The result is exact: ``others`` lie in cells around pivots, about the
    root of their number and ``pivots`` at most, drawn by hash; a row first meets the cell of its nearest pivot, and then,
    with the k-th distance found there as its reach, only cells that its reach touches (the triangle inequality).  Cells and
    the rows that meet them are cut into parts of about ``block``, so no task holds more, whatever the density.
    """
    kind = rows.schema[key].dataType.simpleString()
    near = F.struct("far", F.col("other").alias("key"), "x", *extra)
    more = "".join(f", {c} {others.schema[c].dataType.simpleString()}" for c in extra)
    schema = f"key {kind}, far double, other {kind}, x array<double>{more}, seen long"
    x = F.array(*[F.col(f).cast("double") for f in features])
    right = written(others.select(F.col(key).alias("key"), x.alias("x"), *extra), "others")
    n = right.count()
    most = max(1, min(pivots, int(np.ceil(n**0.5))))
    known = np.array([r["x"] for r in right.orderBy(number(17, "key"), "key").limit(most).collect()], float).reshape(-1, len(features))
    if not n:
        return rows.sparkSession.createDataFrame([], schema).groupBy("key").agg(F.collect_list(near).alias("near"), F.sum("seen").alias("seen"))
    known = np.unique(known, axis=0)
    shared = rows.sparkSession.sparkContext.broadcast(known)  # at most ``pivots`` rows

    @F.pandas_udf("cell int, far double")
    def placed(points):
        import pandas as pd

        far = [_far(np.stack(points.to_numpy()[i : i + 1024]).astype(float), shared.value) for i in range(0, len(points), 1024)]
        far = np.concatenate(far) if far else np.zeros((0, 1))
        cell = far.argmin(1)
        return pd.DataFrame({"cell": cell.astype(np.int32), "far": far[np.arange(len(far)), cell]})

    right = written(right.withColumn("p", placed("x")).select("key", "x", *extra, "p.cell", "p.far"), "cells")
    cells = {r["cell"]: r for r in right.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()}  # as many as pivots
    low, high = (np.array([cells[c][name] if c in cells else bad for c in range(len(known))]) for name, bad in (("low", np.inf), ("high", -np.inf)))
    parts = {c: -(-r["n"] // block) for c, r in cells.items()}
    of = lambda table, cell: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), cell), F.lit(1))
    right = right.withColumn("part", F.pmod(F.xxhash64("key"), of(parts, F.col("cell"))).cast("int"))
    left = written(rows.select(F.col(key).alias("key"), x.alias("x")).withColumn("p", placed("x")).select("key", "x", "p.cell", "p.far"), "rows")

    def met(asked: DataFrame) -> DataFrame:
        """What rows (key, x, cell, far, reach) find in the cell they ask."""
        many = {r["cell"]: -(-r["count"] // block) for r in asked.groupBy("cell").count().collect()}  # as many as pivots
        if not many:
            return rows.sparkSession.createDataFrame([], schema)
        a = asked.withColumn("turn", F.pmod(F.xxhash64("key", F.lit(3)), of(many, F.col("cell"))).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), of(parts, F.col("cell")) - 1)))
        b = right.withColumn("turn", F.explode(F.sequence(F.lit(0), of(many, F.col("cell")) - 1)))
        run = _meet(k, extra)
        return a.groupBy("cell", "part", "turn").cogroup(b.groupBy("cell", "part", "turn")).applyInPandas(lambda own, other: run(own, other), schema)

    @F.pandas_udf("array<struct<cell:int,far:double>>")
    def touched(points, home, reach):
        import pandas as pd

        out = []
        for p, h, r in zip(points, home, reach, strict=True):
            far = _far(np.asarray(p, float)[None], shared.value)[0]
            slack = r + 1e-9 * (1 + far)
            out.append([{"cell": int(c), "far": float(far[c])} for c in np.flatnonzero((far - high <= slack) & (low - far <= slack)) if c != h])
        return pd.Series(out)

    first = written(met(left.withColumn("reach", F.lit(float("inf")))), "near")
    reach = first.groupBy("key").agg(F.sort_array(F.collect_list("far")).alias("f")).select("key", F.when(F.size("f") >= k, F.sqrt(F.get("f", F.lit(k - 1)))).alias("reach"))
    asked = left.join(reach, "key", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    asked = asked.withColumn("c", F.explode(touched("x", "cell", "reach"))).select("key", "x", "c.cell", "c.far", "reach")
    found = first.unionByName(met(written(asked, "asked")))
    return found.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(near)), 1, k).alias("near"), F.sum("seen").alias("seen"))


def smote_seeds(data: DataFrame, features: list[str], label: str, key: str, k: int, m: int) -> DataFrame:
    """(key, weight): every row of class 1, alike."""
    return data.where(F.col(label) == 1).select(F.col(key).alias("key"), F.lit(1.0).alias("weight"))


def borderline_seeds(data: DataFrame, features: list[str], label: str, key: str, k: int, m: int) -> DataFrame:
    """(key, weight): rows of class 1 of whose m nearest rows half or more, but not all, are of the other class."""
    near = neighbours(data.where(F.col(label) == 1), data, key, features, m, extra=(label,))
    share = _other_share(label)
    return near.select("key", ((share >= 0.5) & (share < 1)).cast("double").alias("weight"))


def adasyn_seeds(data: DataFrame, features: list[str], label: str, key: str, k: int, m: int) -> DataFrame:
    """(key, weight): rows of class 1 by the share of the other class among their k nearest rows."""
    near = neighbours(data.where(F.col(label) == 1), data, key, features, k, extra=(label,))
    return near.select("key", _other_share(label).alias("weight"))


def _other_share(label: str) -> Column:
    return F.size(F.filter("near", lambda x: x[label] != 1)) / F.size("near")


#: Ways to weigh seeds, by name; a caller may pass one of its own.
SAMPLERS = {"smote": smote_seeds, "borderline": borderline_seeds, "adasyn": adasyn_seeds}


def oversample(rows: DataFrame, features: list[str], label: str, key: str, *, method: str | Callable[..., DataFrame] = "smote", k: int = 5, m: int = 10, seed: int = 42, block: int = 4_000) -> DataFrame:
    """``rows`` (key, label, features) and synthetic rows of class 1 until both classes are even; synthetic keys are null.

    A synthetic row lies at a random place between a seed of class 1 and one of its k nearest of the class.  ``method`` weighs
    the seeds, one of :data:`SAMPLERS` or a function of (data, features, label, key, k, m) that gives (key, weight).  Seeds get
    their share of the rows by running sums of weights, so just as many are made as are missing; draws are hashes of the
    seed, the seed's key and the row's number.  All rows of both classes are searched.  Where nothing is missing, a class has
    fewer than two rows or all weights are 0, nothing is added.
    """
    weigh = SAMPLERS[method] if isinstance(method, str) else method
    data = written(rows.select(key, label, *features), "rows")
    sizes = {r[0]: r[1] for r in data.groupBy(label).count().limit(3).collect()}  # two classes
    need = sizes.get(0, 0) - sizes.get(1, 0)
    if need <= 0 or sizes.get(1, 0) < 2:
        return data
    rare = data.where(F.col(label) == 1)
    near = neighbours(rare, rare, key, features, k, block=block)
    seeds = weigh(data, features, label, key, k, m).where("weight > 0").join(near, "key").join(rare.select(F.col(key).alias("key"), F.array(*[F.col(f).cast("double") for f in features]).alias("own")), "key")
    seeds = written(ordered.numbered(seeds, "key", out="__at"), "seeds")
    total = seeds.agg(F.sum("weight")).first()[0]
    if not total:
        return data
    placed = ordered.running_sum(seeds, "__at", F.col("weight"), "__upto")
    count = lambda c: F.floor(c / total * need + 0.5)
    placed = placed.withColumn("__n", (count(F.col("__upto")) - count(F.col("__upto") - F.col("weight"))).cast("int")).where("__n > 0")
    made = placed.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    partner = F.get("near", F.floor(share(seed, 1, "key", "__i") * F.size("near")).cast("int"))["x"]
    mixed = F.zip_with("own", partner, lambda a, b: a + (b - a) * share(seed, 2, F.col("key"), F.col("__i")))
    made = made.withColumn("__v", mixed).select(F.lit(None).cast(data.schema[key].dataType).alias(key), F.lit(1).cast(data.schema[label].dataType).alias(label), *[F.get("__v", F.lit(i)).cast(data.schema[f].dataType).alias(f) for i, f in enumerate(features)])
    return data.unionByName(made)
