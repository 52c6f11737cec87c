"""Evaluation of flags and scores: confusion, thresholds, resampling and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import number
from . import ordered

#: The published sweep: 0.10, 0.15, ... 0.90. Fixed values.
THRESHOLDS = tuple(i / 100 for i in range(10, 91, 5))


def _rates(df: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    df = df.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "fpr": share(fp, fp + tn)})
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def confusion(rows: DataFrame, label: Column, flag: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """tn, fp, fn, tp and precision, recall, false positive rate and F1, each 0 where it is undefined."""
    label, flag = F.coalesce(label, F.lit(False)), F.coalesce(flag, F.lit(False))
    got = rows.groupBy(*keys).agg(F.count_if(~label & ~flag).alias("tn"), F.count_if(~label & flag).alias("fp"), F.count_if(label & ~flag).alias("fn"), F.count_if(label & flag).alias("tp"))
    return _rates(got)


def flag_rates(rows: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """Rows and flagged rows of each key, for each flag."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), *[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags])


def cohort_table(rows: DataFrame, categories: dict[int, str], flags: list[str]) -> DataFrame:
    """Rows and flagged rows of each category and cohort: windows that contain it, hold it alone (with Normal), or are dominated by it."""
    from .windows import containing, dominant, pure

    member = []
    for c in categories:
        is_pure = (F.size("categories") == 1) & (F.col("categories")[0] == 0) if c == 0 else pure("categories", c)
        for name, test in (("containing", containing("categories", c)), ("pure", is_pure), ("dominant", dominant("categories") == c)):
            member.append(F.when(test, F.struct(F.lit(c).alias("category"), F.lit(name).alias("cohort"))))
    every = rows.withColumn("__m", F.explode(F.filter(F.array(*member), lambda m: m.isNotNull())))
    return every.groupBy("__m.category", "__m.cohort").agg(F.count("*").alias("n"), *[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags])


def regression(rows: DataFrame, label: Column, old: Column, new: Column) -> DataFrame:
    """What a new flag adds to an old one: alarms gained and lost, true and false, and gained true ones for each false one."""
    got = rows.agg(F.count_if(label & new & ~old).alias("tp_gained"), F.count_if(~label & new & ~old).alias("fp_gained"), F.count_if(label & ~new & old).alias("tp_lost"), F.count_if(~label & ~new & old).alias("fp_lost"))
    return got.withColumn("gain_ratio", F.try_divide(F.col("tp_gained").cast("double"), F.col("fp_gained").cast("double")))


def regression_by(rows: DataFrame, key: str, old: Column, new: Column) -> DataFrame:
    """For each category the rows that an old and a new flag mark, and the difference."""
    got = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(old).alias("old_flagged"), F.count_if(new).alias("new_flagged"))
    return got.withColumn("delta", F.col("new_flagged") - F.col("old_flagged"))


def regression_bar(rows: DataFrame, label: Column, old: Column, new: Column, bar: float) -> DataFrame:
    """One row: the false positive rates of an old and a new flag, what the new one adds, and whether it stays within ``bar``."""
    got = rows.where(~label).agg(F.avg(old.cast("int")).alias("fpr_old"), F.avg(new.cast("int")).alias("fpr_new"), (F.count_if(new) - F.count_if(old)).alias("new_fp"))
    return got.withColumn("within_bar", F.col("fpr_new") <= bar)


def infeasible(share_percent: Column, n: Column, majority: float = 50.0) -> Column:
    """The stopping rule: a category without data, or with the majority of it not scorable, is likely infeasible. Fixed values."""
    return F.when(n == 0, "INFEASIBLE (no data)").when(100.0 - share_percent >= majority, "LIKELY INFEASIBLE").otherwise("not flagged by this rule")


def size_gate(effects: DataFrame, least_d: float = 0.5, least_n: int = 30) -> DataFrame:
    """``effects`` (d, n_true) with whether they clear the gate on window sizes. Fixed values."""
    return effects.withColumn("clears_gate", (F.abs("d") >= least_d) & (F.col("n_true") >= least_n))


def reproduced(found: DataFrame, saved: DataFrame, keys: list[str], value: str = "d", tolerance: float = 0.01) -> DataFrame:
    """Saved effects against found ones: ``off`` and whether it is within the tolerance; a missing one is not."""
    other = saved.select(*keys, F.col(value).alias("saved"))
    off = F.abs(F.col(value) - F.col("saved"))
    return other.join(found.select(*keys, value), keys, "left").withColumn("off", off).withColumn("within", F.coalesce(off <= tolerance, F.lit(False)))


def rederived(saved: DataFrame, term: DataFrame, key: str, flag: str, new: str, out: str = "combined") -> DataFrame:
    """Saved flags with a new deterministic term, null where that cannot tell: ``out`` is either; an error where a saved row has no term."""
    rows = saved.join(term.select(key, F.col(new).alias("__new"), F.lit(True).alias("__found")), key, "left")
    checked = F.when(F.col("__found").isNull(), F.raise_error(F.concat(F.lit("no term for "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.col("__new"))
    return rows.withColumn(new, checked).withColumn(out, F.col(flag) | F.col(new)).drop("__new", "__found")


def sweep(scores: DataFrame, label: str = "label", score: str = "score", thresholds=THRESHOLDS) -> DataFrame:
    """Confusion at each threshold, scores from it on flagged: rows are counted once by the number of thresholds they reach."""
    cuts = F.array(*[F.lit(float(t)) for t in thresholds])
    reach = scores.groupBy(F.size(F.filter(cuts, lambda t: F.col(score) >= t)).alias("__k")).agg(F.count_if(F.col(label) == 1).alias("__p"), F.count_if(F.col(label) != 1).alias("__q"))
    each = F.explode(F.transform(cuts, lambda t, i: F.struct(t.alias("threshold"), (i + 1).alias("at"))))
    rows = reach.withColumn("__t", each).groupBy("__t.threshold").agg(
        F.sum(F.when(F.col("__k") >= F.col("__t.at"), F.col("__p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("__k") >= F.col("__t.at"), F.col("__q")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("__k") < F.col("__t.at"), F.col("__p")).otherwise(0)).alias("fn"), F.sum(F.when(F.col("__k") < F.col("__t.at"), F.col("__q")).otherwise(0)).alias("tn"),
    )
    return _rates(rows)


def fit_threshold(normal: DataFrame, score: str, max_fpr: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(threshold, achieved_fpr) of each key: the floor(max_fpr n)-th largest normal score, to be exceeded; just above the largest if that is none.

    Distinct scores are counted first; the ordered pass has one row for each.
    """
    counts = normal.groupBy(*keys, score).agg(F.count("*").alias("__n"))
    n = normal.groupBy(*keys).agg(F.count("*").alias("__all"), F.max(score).alias("__most"))
    upto = ordered.cumulated(counts, list(keys), score, {"__upto": F.col("__n")}, descending=True)
    rows = (upto.join(n, list(keys)) if keys else upto.crossJoin(F.broadcast(n))).withColumn("__k", F.floor(F.lit(max_fpr) * F.col("__all")))
    got = rows.groupBy(*keys).agg(F.max("__k").alias("k"), F.max("__most").alias("most"), F.max("__all").alias("n"), F.max(F.when(F.col("__upto") >= F.col("__k"), F.col(score))).alias("kth"), F.max_by(F.col("__upto") - F.col("__n"), F.when(F.col("__upto") >= F.col("__k"), F.col(score))).alias("above"))
    none = F.col("k") <= 0
    return got.select(*keys, F.when(none, F.col("most") + 1e-9).otherwise(F.col("kth")).alias("threshold"), F.when(none, 0.0).otherwise(F.col("above") / F.col("n")).alias("achieved_fpr"))


def best_cuts(rows: DataFrame, label: str, max_fpr: float, keys: tuple[str, ...] = ("feature",), value: str = "value") -> DataFrame:
    """The best single cut of each feature, on either side: largest recall with a false positive rate of at most ``max_fpr``.

    Every value is a candidate; cumulative counts over distinct values give all cuts in one pass.  Without a negative no cut has a
    rate, so a feature has no row; without a positive the recall is null.
    """
    counts = rows.groupBy(*keys, value).agg(F.count_if(F.col(label) == 1).alias("__p"), F.count_if(F.col(label) != 1).alias("__q"))
    n = counts.groupBy(*keys).agg(F.sum("__p").alias("__all_p"), F.sum("__q").alias("__all_q"))
    out = None
    for side, down in (("above", True), ("below", False)):
        upto = ordered.cumulated(counts, list(keys), value, {"__tp": F.col("__p"), "__fp": F.col("__q")}, descending=down).join(n, list(keys))
        cut = upto.select(*keys, F.lit(side).alias("side"), F.col(value).alias("cut"), F.try_divide("__tp", "__all_p").alias("recall"), F.try_divide("__fp", "__all_q").alias("fpr"))
        out = cut if out is None else out.unionByName(cut)
    best = F.struct(F.col("recall"), -F.col("fpr"), F.col("side") == "above", F.when(F.col("side") == "above", F.col("cut")).otherwise(-F.col("cut")))
    return out.where(F.col("fpr") <= max_fpr).groupBy(*keys).agg(F.max_by("side", best).alias("side"), F.max_by("cut", best).alias("cut"), F.max_by("recall", best).alias("recall"), F.max_by("fpr", best).alias("fpr"))


def bootstrap(events: DataFrame, replicates: int, seed: int, event: str = "event") -> DataFrame:
    """Whole events drawn with replacement: (replicate, event) as often as drawn, as many draws as events.

    A draw is a hash of the seed, the replicate and its number, reduced to an event's place; events are placed by value.
    """
    from .ordered import indexed

    placed = indexed(events.select(event).distinct(), event, event, out="__at")
    n = placed.agg(F.count("*").alias("__n"))
    draws = placed.select(F.col("__at").alias("draw")).crossJoin(F.broadcast(n)).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    draws = draws.withColumn("__at", F.pmod(number(seed, "replicate", "draw"), F.col("__n")) + 1)
    return draws.join(placed, "__at").select("replicate", "draw", event)


def permute(events: DataFrame, replicates: int, seed: int, event: str = "event", label: str = "label") -> DataFrame:
    """Labels of whole events dealt anew among them: (replicate, event, label), a permutation in each replicate.

    The events of a replicate are ordered by a hash, cut into ranges of the hash, so a range is a task and not a replicate:
    the label at a place of the events' own order goes to the event at that place of the hashes' order.
    """
    own = ordered.numbered(events.select(event, label), event, out="__at")
    n = max(1, own.count())
    slices = max(1, -(-n // ordered.BLOCK))
    rows = own.select(event, "__at", label).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("__draw", number(seed, "replicate", event))
    rows = rows.withColumn("__slice", F.floor(F.col("__draw") / float(1 << 60) * slices))
    before = Window.partitionBy("replicate").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    offsets = rows.groupBy("replicate", "__slice").agg(F.count("*").alias("__n")).select("replicate", "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("replicate", "__slice").orderBy("__draw", event))
    dealt = rows.withColumn("__place", place).join(offsets, ["replicate", "__slice"]).select("replicate", (F.col("__place") + F.col("__before")).alias("__at"), F.col(label).alias("dealt"))
    return rows.select("replicate", "__at", event).join(dealt, ["replicate", "__at"]).select("replicate", event, F.col("dealt").alias(label))


def interval(values: DataFrame, value: str, low: float = 0.025, high: float = 0.975, keys: tuple[str, ...] = ()) -> DataFrame:
    return values.groupBy(*keys).agg(F.percentile(value, F.lit(low)).alias("low"), F.percentile(value, F.lit(high)).alias("high"), F.avg(value).alias("mean"))


def fold_summary(metrics: DataFrame, names: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean, population variance and deviation of each metric over folds."""
    out = []
    for m in names:
        out += [F.avg(m).alias(f"{m}_mean"), F.var_pop(m).alias(f"{m}_var"), F.stddev_pop(m).alias(f"{m}_std")]
    return metrics.groupBy(*keys).agg(*out)


def verdict(new_recall: Column, new_fpr: Column, precision: Column) -> Column:
    """The gate of a new rule: recall of missed attacks, normal windows newly flagged, combined precision. Fixed values."""
    return F.when((new_recall >= 0.25) & (new_fpr <= 0.003) & (precision >= 0.97), "STRONG").when((new_recall >= 0.10) & (new_fpr <= 0.003) & (precision >= 0.97), "ACCEPTABLE").otherwise("WEAK / HYPOTHESIS NOT SUPPORTED")


def pick(points: DataFrame, *order: Column) -> DataFrame:
    """The first row of a selection with tie-breaks: a report of one row."""
    return points.orderBy(*order).limit(1)
