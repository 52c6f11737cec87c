"""Probes of feature families on residual attacks: refits under resampled events, permuted labels and held-out runs.

All labelled rows take part.  Runs of consecutive windows are found first, over whole blocks; the models of a probe train side
by side (:mod:`boosting`), and thresholds, recalls and resamplings are counted in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import boosting, evaluate, ordered, windows
from .boosting import BoostedTrees

#: Share of normal rows that a threshold may flag, resamplings, permutations, and least sizes of a probe. Fixed values.
MAX_FPR = 0.003
BOOTSTRAPS, PERMUTATIONS = 200, 50
LEAST_ROWS, LEAST_RUN, LEAST_POSITIVE = 10, 3, 5
RUN_SPREAD = 0.25
#: Models of held-out runs that train side by side.
MODELS = 48


def residual(windows: DataFrame, category: int, missed: Column, defined: Column, out: str = "label") -> DataFrame:
    """``windows`` with a label: 1 for those of a category alone (Normal beside it) that are missed, 0 for pure Normal, null for others.

    Only defined windows have a label; ``missed`` null counts as not missed.
    """
    from .windows import pure, pure_normal

    positive = pure("categories", category) & F.coalesce(missed, F.lit(False))
    return windows.withColumn(out, F.when(defined & positive, 1).when(defined & pure_normal("categories"), 0))


def events(rows: DataFrame, key: str, out: str = "event") -> DataFrame:
    """``rows`` with the number of their run of consecutive ``key``, whole numbers without repeats."""
    places = ordered.numbered(rows.select(F.col(key).alias("value")), "value", out="at")
    found = windows.runs(places, "at", 1, "value").select(F.col("value").alias(key), F.col("run").alias(out))
    return rows.join(found, key)


def recalls(scored: DataFrame, cuts: DataFrame, label: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, recall, fpr) of scores above each key's threshold; 0 without positives or normal rows."""
    hit = scored.join(cuts, list(keys)).withColumn("__hit", (F.col("score") > F.col("threshold")).cast("double"))
    part = lambda value: F.coalesce(F.avg(F.when(F.col(label) == value, F.col("__hit"))), F.lit(0.0))
    return hit.groupBy(*keys).agg(part(1).alias("recall"), part(0).alias("fpr"))


def _each(rows: DataFrame, models: list[BoostedTrees], features: list[str], keep: list[str], least: int = 0) -> DataFrame:
    """(keep, model, score): a row for each row and model; ``least`` is the number of the first model.  A row without any
    feature scores as one whose features are all missing."""
    found = boosting.scores(rows, models, features, "__p", known=False)
    return found.select(*keep, F.posexplode("__p").alias("model", "score")).withColumn("model", F.col("model") + least)


def family_probe(rows: DataFrame, families: dict[str, list[str]], *, key: str = "bucket", label: str = "label", block: str = "block", max_fpr: float = MAX_FPR, bootstraps: int = BOOTSTRAPS, permutations: int = PERMUTATIONS, seeds: tuple[int, int] = (42, 7), **settings) -> DataFrame:
    """One row for each family of features: how a model of the training block does, and whether that is more than chance.

    The threshold comes from validation normal rows; validation recall has an interval over resampled events, and a null of
    models refitted to labels permuted among training events.  A family clears the null if the interval's lower end exceeds
    the null's 95th percentile.  The test block is scored once.  Every labelled row counts in its block.  Families without
    enough rows have no figures.
    """
    spark, named = rows.sparkSession, list(families)
    every = list(dict.fromkeys(f for fs in families.values() for f in fs))
    own = written(rows.where(F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(block).alias("block"), *[F.col(f).cast("double").alias(f) for f in every]), "cohort")
    n = {(r["block"], r["label"]): r["count"] for r in own.groupBy("block", "label").count().collect()}  # three blocks, two labels
    size = lambda b: n.get((b, 0), 0) + n.get((b, 1), 0)
    counts = (size("train"), n.get(("train", 1), 0), n.get(("validation", 1), 0), n.get(("test", 1), 0))
    plain = "family string, n_train long, n_train_positive long, n_validation_positive long, n_test_positive long"
    kinds = ", recall double, threshold double, achieved_fpr double, low double, high double, test_recall double, test_fpr double, top_feature string, null_p95 double"
    if size("train") < LEAST_ROWS or not n.get(("train", 1)) or not n.get(("train", 0)) or not n.get(("validation", 0)):
        null = 0.0 if size("train") and permutations else None
        out = spark.createDataFrame([(f, *counts, *[None] * 8, null) for f in named], plain + kinds)
        return out.withColumn("clears_null", F.lit(False))

    # the training labels of every replicate, as arrays: the real ones first
    train = written(events(own.where("block = 'train'"), "key"), "train")
    marks = train.groupBy("event").agg((F.avg("label") > 0.5).cast("int").alias("label"))
    dealt = evaluate.permute(marks, permutations, seeds[1]).groupBy("event").agg(F.transform(F.array_sort(F.collect_list(F.struct("replicate", "label"))), lambda x: x["label"]).alias("dealt"))
    train = train.join(dealt, "event").withColumn("labels", F.concat(F.array(F.col("label").cast("int")), "dealt"))
    copies = permutations + 1
    models = [BoostedTrees(**settings, allowed=[every.index(f) for f in families[name]]) for name in named for _ in range(copies)]
    boosting.train(train, every, "key", models, "label", labels=F.col("labels"), label_of=[i % copies for i in range(len(models))])
    real = models[::copies]

    of = lambda c: (F.floor(F.col("model") / copies).cast("int").alias("family"), (F.col("model") % copies).cast("int").alias("replicate"), *c)
    checked = written(events(own.where("block = 'validation'"), "key"), "checked")
    scored = written(_each(checked, models, every, ["event", "label"]).select(*of(("event", "label", "score"))), "scored")
    cuts = written(evaluate.fit_threshold(scored.where("label = 0"), "score", max_fpr, ("family", "replicate")), "cuts")
    found = written(recalls(scored, cuts, "label", ("family", "replicate")), "recalls")

    # whole events are drawn; their sums stand for their rows
    hits = scored.where("replicate = 0").join(cuts.where("replicate = 0").select("family", "threshold"), "family").where("label = 1")
    sums = hits.groupBy("family", "event").agg(F.count("*").alias("p"), F.count_if(F.col("score") > F.col("threshold")).alias("hit"))
    draws = evaluate.bootstrap(checked.select("event").distinct(), bootstraps, seeds[0]).groupBy("replicate", "event").agg(F.count("*").alias("times"))
    resampled = draws.join(sums, "event").groupBy("family", "replicate").agg((F.sum(F.col("times") * F.col("hit")) / F.sum(F.col("times") * F.col("p"))).alias("recall"))
    grid = spark.range(bootstraps).select(F.col("id").cast("int").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(len(named) - 1))).alias("family"))
    resampled = grid.join(resampled, ["family", "replicate"], "left").na.fill(0.0, ["recall"])  # a draw without a positive has recall 0
    ends = evaluate.interval(resampled, "recall", keys=("family",)).select("family", "low", "high")

    tested = _each(own.where("block = 'test'"), real, every, ["label"]).withColumnRenamed("model", "family")
    final = recalls(tested, cuts.where("replicate = 0").select("family", "threshold"), "label", ("family",)).select("family", F.col("recall").alias("test_recall"), F.col("fpr").alias("test_fpr"))
    null = found.where("replicate > 0").groupBy("family").agg(F.percentile("recall", F.lit(0.95)).alias("null_p95"))
    tops = spark.createDataFrame([(i, name, *counts, every[int(m.importances().argmax())]) for i, (name, m) in enumerate(zip(named, real, strict=True))], "number int, " + plain + ", top_feature string")
    first = found.where("replicate = 0").join(cuts.where("replicate = 0").drop("replicate"), "family").select(F.col("family").alias("number"), "recall", "threshold", "achieved_fpr")
    out = tops.join(first, "number")
    for more in (ends, final, null):
        out = out.join(more.withColumnRenamed("family", "number"), "number", "left")
    out = out.na.fill(0.0, ["test_recall", "test_fpr"]).drop("number")
    return out.withColumn("clears_null", F.coalesce(F.col("low") > F.col("null_p95"), F.lit(False)))


def attack_runs(rows: DataFrame, *, key: str = "bucket", label: str = "label", block: str = "block", least_run: int = LEAST_RUN, least_positive: int = LEAST_POSITIVE) -> DataFrame:
    """(run, first, last, n): runs of consecutive positive windows of training and validation, over all of them.

    Runs shorter than ``least_run``, and those that leave fewer than ``least_positive`` positives, have no row.
    """
    on = rows.where((F.col(label) == 1) & F.col(block).isin("train", "validation")).select(F.col(key).cast("long").alias("key"))
    found = events(on, "key", "run").groupBy("run").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("n"))
    total = on.agg(F.count("*").alias("__all"))
    return found.crossJoin(F.broadcast(total)).where((F.col("n") >= least_run) & (F.col("__all") - F.col("n") >= least_positive)).drop("__all")


def held_out_runs(rows: DataFrame, features: list[str], *, key: str = "bucket", label: str = "label", block: str = "block", max_fpr: float = MAX_FPR, least_run: int = LEAST_RUN, least_positive: int = LEAST_POSITIVE, **settings) -> DataFrame:
    """One row for each of :func:`attack_runs`: its recall by a model refitted to all other labelled rows of the two blocks.

    There is a model for each run, so the work grows with runs times rows; the models of a few dozen runs train side by side.
    """
    spark = rows.sparkSession
    own = rows.where(F.col(label).isNotNull() & F.col(block).isin("train", "validation")).select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), F.col(block).alias("block"), *[F.col(f).cast("double").alias(f) for f in features])
    own = written(own, "cohort")
    runs = written(attack_runs(own, key="key", least_run=least_run, least_positive=least_positive), "runs")
    kept = runs.orderBy("first").collect()  # a model is made for each
    if not kept or own.where("label = 0").limit(LEAST_ROWS).count() < LEAST_ROWS:
        return spark.createDataFrame([], "first long, last long, n long, recall double, achieved_fpr double")
    # a positive row's run: the last that begins before it, if it has not ended
    marked = ordered.numbered(own.select("key", "label", "block", *features, F.lit(None).cast("long").alias("run"), F.lit(None).cast("long").alias("last")).unionByName(runs.select(F.col("first").alias("key"), F.lit(-1).alias("label"), F.lit(None).cast("string").alias("block"), *[F.lit(None).cast("double").alias(f) for f in features], "run", "last")), "key", "label", out="at")
    marked = _within(marked)
    numbers = F.create_map(*[F.lit(v) for i, r in enumerate(kept) for v in (r["run"], i)])
    data = written(marked.where("label >= 0").withColumn("model", F.when(F.col("label") == 1, F.element_at(numbers, F.col("of")))), "marked")
    out = None
    for at in range(0, len(kept), MODELS):
        part = range(at, min(at + MODELS, len(kept)))
        models = boosting.train(data, features, "key", [BoostedTrees(**settings) for _ in part], "label", tag=F.coalesce("model", F.lit(-1)), without=list(part))
        cuts = evaluate.fit_threshold(_each(data.where("label = 0"), models, features, [], at), "score", max_fpr, ("model",))
        mine = _each(data.where(F.col("model").between(part[0], part[-1])).withColumnRenamed("model", "__own"), models, features, ["__own"], at).where("model = __own")
        one = mine.join(cuts, "model").groupBy("model").agg(F.avg((F.col("score") > F.col("threshold")).cast("double")).alias("recall"), F.first("achieved_fpr").alias("achieved_fpr"))
        out = written(one if out is None else out.unionByName(one), "held")
    found = runs.withColumn("model", F.element_at(numbers, F.col("run")))
    return found.join(out, "model").select("first", "last", "n", "recall", "achieved_fpr")


def _within(marked: DataFrame) -> DataFrame:
    """``marked`` with ``of``: the run of the last row up to this one that begins a run, if its last key is not before this one's."""
    rows = ordered.carried(marked.withColumn("one", F.lit(1)), ["one"], "at", F.when(F.col("run").isNotNull(), F.struct("run", "last")), "begun")
    return rows.withColumn("of", F.when(F.col("begun.last") >= F.col("key"), F.col("begun.run"))).drop("one", "begun", "run", "last", "at")


def run_summary(runs: DataFrame, spread: float = RUN_SPREAD) -> DataFrame:
    """Over held-out runs: number, mean, spread and range of recall, and whether it depends on the run (null for fewer than two)."""
    std = F.stddev_pop("recall")
    return runs.agg(F.count("*").alias("n_runs"), F.avg("recall").alias("mean_recall"), std.alias("std_recall"), F.min("recall").alias("min_recall"), F.max("recall").alias("max_recall"), F.when(F.count("*") >= 2, std > spread).alias("run_dependent"))


def family_verdict(probe: DataFrame, family_of: dict[str, str], names: tuple[str, str, str] = ("F2", "F3", "combined")) -> DataFrame:
    """One row: which detectors to build on, from the families that clear their null and the family of the combined model's top feature.

    Every feature is taken from responses seen so far and from no label, so the audit of causes is clean by construction.
    """
    a, b, both = names
    clears = {n: F.coalesce(F.bool_or(F.when(F.col("family") == n, F.col("clears_null"))), F.lit(False)) for n in names}
    top = F.max(F.when(F.col("family") == both, F.element_at(F.create_map(*[F.lit(x) for kv in family_of.items() for x in kv]), F.col("top_feature"))))
    got = probe.agg(clears[a].alias("__a"), clears[b].alias("__b"), clears[both].alias("__c"), top.alias("dominant_family"))
    first, second = (F.col(f"__{x}") | (F.col("__c") & F.coalesce(F.col("dominant_family") == n, F.lit(False))) for x, n in (("a", a), ("b", b)))
    # fixed values
    verdict = F.when(first & second, "PROCEED-BOTH").when(first, "PROCEED-0030").when(second, "PROCEED-0031").otherwise("NO-GO-CEILING")
    return got.select("dominant_family", first.alias("proceed_first"), second.alias("proceed_second"), verdict.alias("verdict"))
