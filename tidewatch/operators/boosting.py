"""Gradient-boosted trees with second-order splits over binned features, trained by Spark on all rows.

A level of a tree is one job: tasks sum gradients and curvatures of their rows into histograms by node, feature and bin, and
the histograms, whose size depends on the model alone, merge in a reduction tree on their way to the driver, which picks the
splits.  Rows stay where they are, in blocks of one byte a feature that carry their margins.  Many models (permuted labels,
folds, rows held out) train side by side in the same jobs.
"""

from __future__ import annotations

import copy
import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import number

#: Accuracy of the approximate quantiles that cut features into bins.
ACCURACY = 100_000
#: Rows of a block.
ROWS = 1 << 16
#: Cells of the histograms of models that train side by side, at most.
CELLS = 8_000_000
#: Models of a group that is a task, at least where there are so many.
GROUP = 8
#: Rounds after which blocks take new trees into their margins.
KEEP = 6
_U = np.uint64


def uniform(key: np.ndarray, seed: int, part: int) -> np.ndarray:
    """Numbers from 0 to 1, 1 excluded, from keys (60-bit whole numbers), a seed and a part: the same in every task and run."""
    with np.errstate(over="ignore"):
        x = key.astype(_U) + _U(0x9E3779B97F4A7C15) * _U((seed * 1_000_003 + part) % (1 << 62) + 1)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return (x >> _U(11)).astype(float) / float(1 << 53)


class BoostedTrees:
    """Trees of fixed depth for one or more classes: a node splits where the gain of its halves' gradients is largest.

    Two classes have one logistic margin; more have one margin each under a joint softmax, a tree for each in every round.
    Missing values go to the side where the gain is larger.  Rows and features of a round are drawn with the seed, a row's draw
    by a hash of its key.  ``allowed`` are the places of the features that may be split (all by default).
    """

    def __init__(self, rounds: int = 150, depth: int = 4, step: float = 0.1, rows: float = 0.8, columns: float = 0.8, shrink: float = 1.0, least: float = 1.0, bins: int = 64, seed: int = 0, classes: int = 2, allowed: list[int] | None = None):
        if not 2 <= bins <= 250 or classes < 2 or depth < 1:
            raise ValueError("2 to 250 bins, at least two classes and one level")
        self.settings = {"rounds": rounds, "depth": depth, "step": step, "rows": rows, "columns": columns, "shrink": shrink, "least": least, "bins": bins, "seed": seed, "classes": classes, "allowed": allowed}
        self.__dict__.update(self.settings)
        #: Trees of a round, and the first tree that is held.
        self.outputs, self.offset = 1 if classes == 2 else classes, 0

    def begin(self, edges: list[np.ndarray]) -> BoostedTrees:
        """An empty model over features cut at ``edges``."""
        self.edges, self.width, inner, trees = edges, len(edges), (1 << self.depth) - 1, self.rounds * self.outputs
        self.feature, self.cut, self.missing = np.full((trees, inner), -1), np.zeros((trees, inner), int), np.zeros((trees, inner), bool)
        self.leaf, self.gains = np.zeros((trees, inner + 1)), np.zeros(len(edges))
        return self

    def part(self, first: int, last: int) -> BoostedTrees:
        """The model with the trees from ``first`` to before ``last`` alone, without edges, and gains that start anew."""
        out = copy.copy(self)
        out.offset, out.edges, out.gains = first, None, np.zeros(self.width)
        for name in ("feature", "cut", "missing", "leaf"):
            setattr(out, name, getattr(self, name)[first - self.offset : last - self.offset])
        return out

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Rows by features: 0 for a missing value, else 1 and the number of edges up to it."""
        x = np.asarray(x, float)
        if not len(x):
            return np.zeros((0, len(self.edges)), np.uint8)
        return np.stack([np.where(np.isnan(c), 0, 1 + np.searchsorted(e, c, "right")) for e, c in zip(self.edges, x.T, strict=True)], 1).astype(np.uint8)

    def opened(self, tree: int) -> np.ndarray:
        """Features that a tree may split, by the seed."""
        own = np.arange(self.width) if self.allowed is None else np.asarray(self.allowed)
        order = np.argsort(uniform(own, self.seed, 2 * tree + 1), kind="stable")
        out = np.zeros(self.width, bool)
        out[own[order[: max(1, round(self.columns * len(own)))]]] = True
        return out

    def drawn(self, key: np.ndarray, turn: int) -> np.ndarray:
        """Whether rows take part in a round."""
        return uniform(key, self.seed, 2 * turn) < self.rows

    def reached(self, codes: np.ndarray, tree: int, levels: int | None = None) -> np.ndarray:
        """The node of each row after some levels of a tree."""
        tree -= self.offset
        node, every = np.zeros(len(codes), int), np.arange(len(codes))
        for level in range(self.depth if levels is None else levels):
            own = (1 << level) - 1 + node
            f = self.feature[tree, own]
            code = codes[every, np.maximum(f, 0)]
            node = 2 * node + ((f >= 0) & np.where(code == 0, self.missing[tree, own], code >= self.cut[tree, own]))
        return node

    def advance(self, margin: np.ndarray, codes: np.ndarray, first: int, last: int) -> np.ndarray:
        """``margin`` (outputs by rows) with the trees from ``first`` to before ``last``."""
        for tree in range(first, last):
            margin[tree % self.outputs] += self.leaf[tree - self.offset][self.reached(codes, tree)]
        return margin

    def gradients(self, margin: np.ndarray, y: np.ndarray, output: int) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivatives of the loss by one margin at labels 0, 1, ..."""
        if self.outputs == 1:
            p = 1 / (1 + np.exp(-margin[0]))
            return p - (y == 1), p * (1 - p)
        p = np.exp(margin - margin.max(0))
        p = p[output] / p.sum(0)
        return p - (y == output), p * (1 - p)

    def histogram(self, codes: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, level: int) -> np.ndarray:
        """(2, nodes, features, codes): sums of g and h."""
        many, width, slots = 1 << level, self.width, self.bins + 2
        spot = (node[:, None] * (width * slots) + np.arange(width) * slots + codes).ravel()
        return np.stack([np.bincount(spot, np.repeat(v, width), many * width * slots).reshape(many, width, slots) for v in (g, h)])

    def split(self, tree: int, level: int, sums: np.ndarray) -> None:
        """Enters the best splits of a level's nodes, after the last level the leaves; ties go to the first feature and the
        lowest cut, with missing values left."""
        gs, hs = sums
        many, width, slots = gs.shape
        part = lambda a, b: a * a / (b + self.shrink)
        gt, ht = gs.sum(2, keepdims=True), hs.sum(2, keepdims=True)
        gain, left = np.zeros((many, width, slots, 2)), np.zeros((2, many, width, slots, 2))
        for side in (0, 1):  # missing values left, or right
            g, h = gs[:, :, 1:].cumsum(2), hs[:, :, 1:].cumsum(2)
            if side == 0:
                g, h = g + gs[:, :, :1], h + hs[:, :, :1]
            own = part(g, h) + part(gt - g, ht - h) - part(gt, ht)
            own[(h < self.least) | (ht - h < self.least)] = 0
            # a cut at code c sends the codes below it left
            gain[:, :, 2:, side], left[0, :, :, 2:, side], left[1, :, :, 2:, side] = own[:, :, :-1], g[:, :, :-1], h[:, :, :-1]
        gain[..., 1][gain[..., 1] <= gain[..., 0] + 1e-12] = 0
        gain[:, ~self.opened(tree)] = 0
        flat, rows = gain.reshape(many, -1), np.arange(many)
        best = flat.argmax(1)
        size = flat[rows, best]
        split = size > 1e-9
        f, c, side = best // (slots * 2), best // 2 % slots, best % 2
        base, tree = slice(many - 1, 2 * many - 1), tree - self.offset
        self.feature[tree, base], self.cut[tree, base], self.missing[tree, base] = np.where(split, f, -1), np.where(split, c, 0), split & (side == 1)
        np.add.at(self.gains, f[split], size[split])
        if level == self.depth - 1:
            total = np.stack((gt[:, 0, 0], ht[:, 0, 0]))
            low = np.where(split, left[:, rows, f, c, side], total)
            ends = np.stack((low, total - low), 2).reshape(2, -1)
            self.leaf[tree] = -self.step * ends[0] / (ends[1] + self.shrink)

    def take(self, tree: int, found: tuple) -> None:
        """Enters what :meth:`split` found elsewhere: a tree's nodes and leaves, and the gains."""
        self.feature[tree], self.cut[tree], self.missing[tree], self.leaf[tree] = found[:4]
        self.gains += found[4]

    def probabilities(self, x: np.ndarray, codes: np.ndarray | None = None) -> np.ndarray:
        """Classes by rows."""
        codes = self.codes(x) if codes is None else codes
        m = self.advance(np.zeros((self.outputs, len(codes))), codes, 0, len(self.leaf))
        if self.outputs == 1:
            p = 1 / (1 + np.exp(-m[0]))
            return np.stack((1 - p, p))
        e = np.exp(m - m.max(0))
        return e / e.sum(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of class 1."""
        return self.probabilities(x)[1]

    def fit(self, x: np.ndarray, y: np.ndarray, key: np.ndarray | None = None) -> BoostedTrees:
        """The same trees of rows in memory, which tests hold the training in Spark against."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        if not len(x):
            raise ValueError("no rows to fit trees on")
        key = np.arange(len(x)) if key is None else key
        at = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.begin([np.unique(np.quantile(c[np.isfinite(c)], at, method="inverted_cdf")) if np.isfinite(c).any() else np.zeros(0) for c in x.T])
        codes, margin = self.codes(x), np.zeros((self.outputs, len(x)))
        for r in range(self.rounds):
            taken = self.drawn(key, r)
            for tree in range(r * self.outputs, (r + 1) * self.outputs):
                g, h = (v * taken for v in self.gradients(margin, y, tree % self.outputs))
                for level in range(self.depth):
                    self.split(tree, level, self.histogram(codes, self.reached(codes, tree, level), g, h, level))
            margin = self.advance(margin, codes, r * self.outputs, (r + 1) * self.outputs)
        return self

    def importances(self) -> np.ndarray:
        """Each feature's share of all gains."""
        return self.gains / self.gains.sum() if self.gains.sum() else self.gains

    def plain(self) -> dict:
        """Settings and trees as plain values, the inverse of :meth:`loaded`."""
        return {"settings": self.settings, "edges": [e.tolist() for e in self.edges], **{k: getattr(self, k).tolist() for k in ("feature", "cut", "missing", "leaf", "gains")}}

    @classmethod
    def loaded(cls, value: dict) -> BoostedTrees:
        out = cls(**value["settings"])
        out.edges = [np.array(e, float) for e in value["edges"]]
        for k in ("feature", "cut", "missing", "leaf", "gains"):
            setattr(out, k, np.array(value[k]))
        out.width = len(out.edges)
        return out

    def fingerprint(self) -> str:
        """A hash of all settings and trees."""
        return hashlib.sha256(json.dumps(self.plain(), sort_keys=True).encode()).hexdigest()


# ---- training in Spark


def edges_of(rows: DataFrame, features: list[str], bins: int, group: Column, accuracy: int = ACCURACY) -> dict[int, list[np.ndarray]]:
    """Each group's cuts of each feature, at approximate quantiles of all finite values."""
    at = F.array(*[F.lit(float(q)) for q in np.linspace(0, 1, bins + 1)[1:-1]])
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    got = rows.groupBy(group.alias("g")).agg(*[F.percentile_approx(finite(F.col(f)), at, accuracy).alias(f"q{i}") for i, f in enumerate(features)]).collect()  # a row for each group of models
    return {r["g"]: [np.unique(np.array(r[f"q{i}"], float)) if r[f"q{i}"] else np.zeros(0) for i in range(len(features))] for r in got}


def _coded_task(edges: dict[int, list[np.ndarray]], bins: int, width: int):
    """Blocks of a partition's rows: codes, keys, labels and tags as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = {g: BoostedTrees(bins=bins).begin(e) for g, e in edges.items()}
        held: list[tuple[np.ndarray, ...]] = []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(v).tobytes()], pa.binary()) for v in zip(*held, strict=True)], names=["codes", "key", "labels", "tag"])

        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), width)
            labels = batch["labels"].flatten().to_numpy(zero_copy_only=False).astype(np.int16).reshape(len(batch), -1)
            group, codes = batch["grp"].to_numpy(), np.zeros(x.shape, np.uint8)
            for g in np.unique(group).tolist():
                codes[group == g] = coders[g].codes(x[group == g])
            held.append((codes, batch["key"].to_numpy(), labels, batch["tag"].to_numpy()))
            if sum(len(h[1]) for h in held) >= ROWS:
                yield block()
                held = []
        if held:
            yield block()

    return run


def train(rows: DataFrame, features: list[str], key: str, models: list[BoostedTrees], label: str | Column, *, labels: Column | None = None, label_of: list[int] | None = None, tag: Column | None = None, without: list[int] | None = None, only: list[int] | None = None) -> list[BoostedTrees]:
    """``models``, whose settings differ in seed and allowed features alone, trained side by side on all labelled ``rows``.

    Rows whose ``label`` is null are left out; labels are 0, 1, ...  ``labels`` may be an array of labels, of which model i takes
    the one at ``label_of[i]``.  ``tag`` is a whole number; model i leaves out rows with the tag ``without[i]``, or sees those with
    ``only[i]`` alone, and then its bins are those of these rows.  A level of a round is one job for all models, its result of
    the histograms' size.
    """
    from ..sources.scratch import written

    first, width, many = models[0], len(features), len(models)
    same = lambda m: {k: v for k, v in m.settings.items() if k not in ("seed", "allowed")}
    if any(same(m) != same(first) for m in models):
        raise ValueError("models that train side by side have equal settings")
    one = F.col(label) if isinstance(label, str) else label
    plain = [F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]
    own = rows.where(one.isNotNull()).select(*plain, number(first.seed, key).alias("key"), (F.array(one) if labels is None else labels).cast("array<int>").alias("labels"), (F.lit(0) if tag is None else tag).cast("long").alias("tag"))
    own = written(own.withColumn("grp", F.col("tag") if only else F.lit(0).cast("long")), "labelled")
    edges = edges_of(own, [f"f{i}" for i in range(width)], first.bins, F.col("grp"))
    if not edges:
        raise ValueError("no rows to fit trees on")
    x = F.array(*[F.coalesce(f"f{i}", F.lit(float("nan"))) for i in range(width)]).alias("x")
    coded = written(own.select(x, F.coalesce("key", F.lit(0)).alias("key"), "labels", F.coalesce("tag", F.lit(-1)).alias("tag"), "grp").mapInArrow(_coded_task(edges, first.bins, width), "codes binary, key binary, labels binary, tag binary"), "blocks")
    for i, m in enumerate(models):
        m.begin(edges.get(only[i] if only else 0, [np.zeros(0)] * width))
    views = [(label_of[i] if label_of else 0, without[i] if without else None, only[i] if only else None) for i in range(many)]
    step = max(1, CELLS // ((1 << first.depth - 1) * width * (first.bins + 2) * 2 * first.outputs))
    for at in range(0, many, step):
        _train(coded, width, models[at : at + step], views[at : at + step])
    return models


def _started(row, width: int, many: int, outputs: int) -> tuple:
    codes, key, labels, tag = (np.frombuffer(bytes(v), kind) for v, kind in zip(row, (np.uint8, np.int64, np.int16, np.int64), strict=True))
    return codes.reshape(-1, width), key, labels.reshape(len(key), -1), tag, np.zeros((many, outputs, len(key)))


def _train(coded: DataFrame, width: int, models: list[BoostedTrees], views: list[tuple]) -> None:
    """Trains models in the same jobs.  Many models are dealt to groups, and each group gets the blocks, so that few rows don't
    make one task; the histograms of a group meet in a task that picks its splits."""
    first, outputs, rows = models[0], models[0].outputs, coded.rdd
    blocks, many = rows.getNumPartitions(), -(-len(models) // GROUP)
    many = min(many, rows.context.defaultParallelism)
    groups = [list(range(g, len(models), many)) for g in range(many)]
    if many == 1:
        state: RDD = rows.map(lambda row: (0, *_started(row, width, len(models), outputs)))
    else:
        dealt = rows.flatMap(lambda row: [(g * blocks + zlib.crc32(bytes(row[1])) % blocks, tuple(row)) for g in range(many)])
        state = dealt.partitionBy(many * blocks, lambda k: k).map(lambda kv: (kv[0] // blocks, *_started(kv[1], width, len(groups[kv[0] // blocks]), outputs)))
    state = state.persist(StorageLevel.MEMORY_AND_DISK)
    old, done = None, 0
    for r in range(first.rounds):
        if r - done == KEEP:
            # a lost block is made again from its file by these few narrow steps
            old, state, done = state, state.map(_advancer([m.part(done * outputs, r * outputs) for m in models], groups, done * outputs, r * outputs)).persist(StorageLevel.MEMORY_AND_DISK), r
        for level in range(first.depth):
            parts = [m.part(done * outputs, (r + 1) * outputs) for m in models]
            sums = state.map(_summer(parts, views, groups, r, level, done))
            if many == 1:
                found = [(0, sums.values().treeReduce(np.add) if blocks > 16 else sums.values().reduce(np.add))]  # fewer need no tree
                found = [_split(parts, groups, r, level, x) for x in found]
            else:
                sums = sums.reduceByKey(np.add, many) if blocks > 1 else sums
                found = sums.map(lambda x, parts=parts, r=r, level=level: _split(parts, groups, r, level, x)).collect()
            for g, trees in found:
                for i, own in zip(groups[g], trees, strict=True):
                    for o, tree in enumerate(own):
                        models[i].take(r * outputs + o, tree)
        if old is not None:
            old.unpersist()
            old = None
    state.unpersist()


def _advancer(parts: list[BoostedTrees], groups: list[list[int]], first: int, last: int):
    """Takes trees into the margins of a block."""
    return lambda b: (*b[:5], np.stack([parts[i].advance(b[5][j].copy(), b[1], first, last) for j, i in enumerate(groups[b[0]])]))


def _summer(parts: list[BoostedTrees], views: list[tuple], groups: list[list[int]], r: int, level: int, done: int):
    """(group, histograms) of a block: by models, outputs, 2, nodes, features, codes."""

    def run(block: tuple) -> tuple[int, np.ndarray]:
        g, codes, key, labels, tag, margins = block
        out = []
        for j, i in enumerate(groups[g]):
            m, (at, without, only) = parts[i], views[i]
            sees = labels[:, at] >= 0
            if without is not None:
                sees &= tag != without
            if only is not None:
                sees &= tag == only
            on = np.flatnonzero(sees & m.drawn(key, r))
            own, y = codes[on], labels[on, at]
            margin = m.advance(margins[j][:, on], own, done * m.outputs, r * m.outputs)
            for o in range(m.outputs):
                d1, d2 = m.gradients(margin, y, o)
                out.append(m.histogram(own, m.reached(own, r * m.outputs + o, level), d1, d2, level))
        return g, np.stack(out).reshape(len(groups[g]), -1, *out[0].shape)

    return run


def _split(parts: list[BoostedTrees], groups: list[list[int]], r: int, level: int, found: tuple[int, np.ndarray]) -> tuple[int, list]:
    """(group, what each of its models' trees of the round are now)."""
    g, sums = found
    out = []
    for i, own in zip(groups[g], sums, strict=True):
        m, trees = parts[i], []
        for o in range(m.outputs):
            m.gains = np.zeros(m.width)
            tree = r * m.outputs + o
            m.split(tree, level, own[o])
            at = tree - m.offset
            trees.append((m.feature[at], m.cut[at], m.missing[at], m.leaf[at], m.gains))
        out.append(trees)
    return g, out


def rated(rows: DataFrame, features: list[str], out: str, rate, known: bool = True) -> DataFrame:
    """``rows`` with the array of doubles that ``rate`` gives for a matrix of features (arrays by rows).

    If ``known``, it is null where all features are null, when nothing is known of the row.
    """

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        found = rate(x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), len(features)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(found)), pa.array(found.T.ravel().astype(float)))

    some = F.coalesce(*[F.col(f).cast("double") for f in features]).isNotNull() if known else F.lit(True)
    return rows.withColumn(out, F.when(some, run(F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features]))))


def scores(rows: DataFrame, models: list[BoostedTrees], features: list[str], out: str, known: bool = True) -> DataFrame:
    """``rows`` with an array of the probability of class 1 by each model."""
    shared = rows.sparkSession.sparkContext.broadcast(models)  # trees alone, whatever the rows
    return rated(rows, features, out, lambda x: np.stack([m.probability(x) for m in shared.value]), known)


def class_probabilities(rows: DataFrame, model: BoostedTrees, features: list[str], out: str) -> DataFrame:
    """``rows`` with an array of the probability of each class."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return rated(rows, features, out, lambda x: shared.value.probabilities(x))
