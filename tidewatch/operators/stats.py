"""Statistics over labelled windows: effect sizes, ranks, tests, audits and profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import ordered

#: Effect grades: below each bound. Fixed values.
GRADES = ((0.2, "negligible"), (0.5, "small"), (0.8, "medium"))


def z_fit(rows: DataFrame, features: list[str]) -> DataFrame:
    """One row: for each feature its mean ``mu_`` and population deviation ``sd_``, 1 where that is 0."""
    return rows.agg(*z_columns(features))


def z_columns(features: list[str]) -> list[Column]:
    """The aggregates of :func:`z_fit`, to be taken with others in one pass."""
    std = lambda c: F.stddev_pop(c)
    return [F.avg(c).alias(f"mu_{c}") for c in features] + [F.when(std(c) > 0, std(c)).otherwise(1.0).alias(f"sd_{c}") for c in features]


def z_scores(rows: DataFrame, fitted: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` with ``z_`` columns."""
    out = rows.crossJoin(F.broadcast(fitted)).withColumns({f"z_{c}": (F.col(c) - F.col(f"mu_{c}")) / F.col(f"sd_{c}") for c in features})
    return out.drop(*fitted.columns)


def long_form(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, feature, value) of every feature."""
    return rows.unpivot(keys, features, "feature", "value")


def grade(d: Column) -> Column:
    out = F
    for bound, name in GRADES:
        out = out.when(F.abs(d) < bound, name)
    return out.otherwise("large")


def cohens_d(rows: DataFrame, group: str, value: str = "value", keys: tuple[str, ...] = ("feature",), *, sample: bool = False) -> DataFrame:
    """Effect size of ``group`` (true against false) for each key: pooled population variances, or pooled sample variances weighted by
    degrees of freedom; 0 where nothing varies."""
    on, off = (F.when(F.col(group) == g, F.col(value)) for g in (True, False))
    n, m = F.count(on), F.count(off)
    if sample:
        var = ((n - 1) * F.var_samp(on) + (m - 1) * F.var_samp(off)) / (n + m - 2)
    else:
        var = (F.var_pop(on) + F.var_pop(off)) / 2
    got = rows.groupBy(*keys).agg(n.alias("n_true"), m.alias("n_false"), (F.avg(on) - F.avg(off)).alias("difference"), F.sqrt(var).alias("pooled"))
    d = F.when(F.col("pooled") > 0, F.col("difference") / F.col("pooled")).otherwise(0.0)
    return got.withColumn("d", d).withColumn("grade", grade(F.col("d")))


def counted_ranks(rows: DataFrame, value: str, keys: list[str], **counts: Column) -> DataFrame:
    """A row for each key and distinct value: ``counts`` of its rows, and ``rank``, the mean of the ranks that they share, from 1."""
    got = rows.groupBy(*keys, value).agg(F.count("*").alias("__n"), *[F.count_if(c).alias(n) for n, c in counts.items()])
    got = ordered.cumulated(got, keys, value, {"__upto": F.col("__n")})
    return got.withColumn("rank", F.col("__upto") - (F.col("__n") - 1) / 2).drop("__upto", "__n")


def average_ranks(rows: DataFrame, value: str, keys: list[str], out: str = "rank") -> DataFrame:
    """``rows`` with ranks from 1, equal values sharing the mean of their ranks.

    Ranks are found among counts of distinct values; ``rows`` should be written, so that both uses see the same values.
    """
    ranks = counted_ranks(rows, value, keys).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(value).alias("__value"), F.col("rank").alias(out))
    same = F.col(value).eqNullSafe(F.col("__value"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(ranks, same).drop("__value", *[f"__k{i}" for i in range(len(keys))])


def correlations(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, pearson, spearman) of each pair of columns; null where one is constant."""
    parts = [rows.select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    long = written(long, "pairs")
    ranked = average_ranks(written(average_ranks(long, "x", ["a", "b"], "rx"), "ranks"), "y", ["a", "b"], "ry")
    varied = lambda c: F.stddev_pop(c) > 0
    return ranked.groupBy("a", "b").agg(F.when(varied("x") & varied("y"), F.corr("x", "y")).alias("pearson"), F.when(varied("rx") & varied("ry"), F.corr("rx", "ry")).alias("spearman"))


def mann_whitney(rows: DataFrame, group: str, value: str = "value", keys: tuple[str, ...] = ("feature",)) -> DataFrame:
    """U of the true group and its two-sided p by the tie-corrected normal approximation with continuity correction."""
    ranked = counted_ranks(rows, value, list(keys), __a=F.col(group), __b=~F.col(group))
    got = ranked.groupBy(*keys).agg(F.sum("__a").alias("n"), F.sum("__b").alias("m"), F.sum(F.col("__a") * F.col("rank")).alias("ranks"))
    ties = rows.groupBy(*keys, value).agg(F.count("*").cast("double").alias("t")).groupBy(*keys).agg(F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    got = got.join(ties, list(keys)).withColumn("u", F.col("ranks") - n * (n + 1) / 2)
    spread = F.sqrt(n * m / 12 * ((n + m + 1) - F.coalesce(F.try_divide(F.col("ties"), (n + m) * (n + m - 1)), F.lit(0.0))))
    z = F.try_divide(F.greatest(F.lit(0.0), F.abs(F.col("u") - n * m / 2) - 0.5), spread)
    return got.select(*keys, "n", "m", "u", F.when(spread > 0, z).alias("z"), F.when(spread > 0, _two_sided(z)).otherwise(1.0).alias("p"))


def _two_sided(z: Column) -> Column:
    @F.pandas_udf("double")
    def tail(x):
        return x.map(lambda v: math.erfc(v / math.sqrt(2.0)))

    return tail(z)


def kolmogorov_smirnov(rows: DataFrame, group: str, value: str = "value", keys: tuple[str, ...] = ("feature",)) -> DataFrame:
    """The largest distance of the two groups' distribution functions; null where a group is empty."""
    counts = rows.groupBy(*keys, value).agg(F.count_if(F.col(group)).alias("__a"), F.count_if(~F.col(group)).alias("__b"))
    placed = ordered.cumulated(counts, list(keys), value, {"__upto_a": F.col("__a"), "__upto_b": F.col("__b")})
    n = counts.groupBy(*keys).agg(F.sum("__a").alias("__all_a"), F.sum("__b").alias("__all_b"))
    placed = placed.join(n, list(keys)) if keys else placed.crossJoin(F.broadcast(n))  # one row
    far = F.abs(F.try_divide(F.col("__upto_a"), F.col("__all_a")) - F.try_divide(F.col("__upto_b"), F.col("__all_b")))
    return placed.groupBy(*keys).agg(F.max(far).alias("ks"))


def summary(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Number, mean, population deviation, least, quartiles, 95th and 99th percentile, largest."""
    q = lambda p: F.percentile(value, F.lit(p))
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"), q(0.95).alias("q95"), q(0.99).alias("q99"), F.max(value).alias("most"))


def byte_audit(bytes_: DataFrame, key: str = "at", value: str = "value", shown: int = 20) -> DataFrame:
    """For each place: number, distinct values, least, largest, entropy in bits, constancy, and the first distinct values."""
    counts = bytes_.groupBy(key, value).agg(F.count("*").alias("__n"))
    total = counts.withColumn("__p", F.col("__n") / F.sum("__n").over(Window.partitionBy(key)))
    return total.groupBy(key).agg(
        F.sum("__n").alias("n"), F.count("*").alias("distinct"), F.min(value).alias("least"), F.max(value).alias("most"), F.abs(F.sum(-F.col("__p") * F.log2("__p"))).alias("entropy"), (F.count("*") == 1).alias("constant"),
        F.array_join(F.slice(F.sort_array(F.collect_set(value)), 1, shown).cast("array<string>"), ",").alias("first_values"),
    )


def float_audit(rows: DataFrame, key: str, value: str) -> DataFrame:
    """For each place: readings, NaNs, infinities, and mean and sample deviation of the finite ones."""
    odd = F.isnan(value)
    endless = F.abs(F.col(value)) == float("inf")
    finite = F.when(~odd & ~endless, F.col(value))
    return rows.groupBy(key).agg(F.count(value).alias("n"), F.count_if(odd).alias("n_nan"), F.count_if(~odd & endless).alias("n_inf"), F.count_distinct(finite).alias("distinct"), F.min(finite).alias("least"), F.max(finite).alias("most"), F.avg(finite).alias("mean"), F.stddev_samp(finite).alias("std"))


def profile(rows: DataFrame, ts: str, texts: list[str], index: str = "record_index") -> DataFrame:
    """One row: rows, nulls and distinct values of each column, first and last time, disorder, repeated rows and times."""
    from . import ordered

    back = ordered.with_frame(rows, index, 1, {"__before": F.lag(ts).over(ordered.over(index))})
    whole = F.md5(F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in texts]))
    n = F.count("*")
    return back.agg(
        n.alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in texts], *[F.count_distinct(c).alias(f"distinct_{c}") for c in texts], F.min(ts).alias("first"), F.max(ts).alias("last"),
        F.count_if(F.col(ts) < F.col("__before")).alias("backward"), F.count_if(F.col(ts) == F.col("__before")).alias("standing"), (n - F.count_distinct(whole)).alias("repeated_rows"), (n - F.count_distinct(ts)).alias("repeated_times"),
    )


def crosstab(rows: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of ``column``'s values by ``row``, with row totals and a last row of totals (null key)."""
    counts = [F.count_if(F.col(column).eqNullSafe(F.lit(v))).alias(f"n_{v}") for v in values]
    return rows.rollup(row).agg(*counts, F.count("*").alias("total"), F.grouping(row).alias("is_total"))


def value_counts(rows: DataFrame, column: str, most: int = 60) -> DataFrame:
    """The most frequent values, ties by value: a report of at most ``most`` rows."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(most)


def register_audit(bytes_: DataFrame, row: str, at: str = "at", value: str = "value") -> DataFrame:
    """For each pair of neighbouring bytes from an even place, as a big-endian word: number, distinct words, least, largest, constancy."""
    pair = F.floor(F.col(at) / 2).cast("int")
    words = bytes_.groupBy(row, pair.alias("register")).agg(F.sum(F.when(F.col(at) % 2 == 0, F.col(value) * 256).otherwise(F.col(value))).alias("word"), F.count("*").alias("k")).where("k = 2")
    return words.groupBy("register").agg(F.count("*").alias("n"), F.count_distinct("word").alias("distinct"), F.min("word").alias("least"), F.max("word").alias("most"), (F.count_distinct("word") == 1).alias("constant"))


def lengths_by(rows: DataFrame, key: str, length: str = "frame_len") -> DataFrame:
    """Rows and mean length of each direction."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(length).alias("mean_length"))


def separation(rows: DataFrame, group: str, value: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """Presence and range of a value in two groups: numbers, quartiles, values in common, and whether a cut parts them perfectly."""
    on, off = F.when(F.col(group), F.col(value)), F.when(~F.col(group), F.col(value))
    q = lambda c, p: F.percentile(c, F.lit(p))
    got = rows.groupBy(*keys).agg(
        F.count_if(F.col(group)).alias("rows_true"), F.count_if(~F.col(group)).alias("rows_false"), F.count(on).alias("n_true"), F.count(off).alias("n_false"), F.min(on).alias("least_true"), q(on, 0.25).alias("q25_true"), q(on, 0.5).alias("median_true"), q(on, 0.75).alias("q75_true"), F.max(on).alias("most_true"),
        F.min(off).alias("least_false"), q(off, 0.25).alias("q25_false"), q(off, 0.5).alias("median_false"), q(off, 0.75).alias("q75_false"), F.max(off).alias("most_false"), F.count_distinct(on).alias("distinct_true"), F.count_distinct(off).alias("distinct_false"),
    )
    both = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_if(F.col(group)).alias("a"), F.count_if(~F.col(group)).alias("b"))
    common = both.groupBy(*keys).agg(F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("values_in_common"))
    got = got.join(common, list(keys), "left") if keys else got.crossJoin(F.broadcast(common))  # one row
    parted = (F.col("least_true") > F.col("most_false")) | (F.col("most_true") < F.col("least_false"))
    return got.withColumn("separated", F.coalesce(parted, F.lit(False)))


def payload_gate(found: DataFrame) -> DataFrame:
    """Whether a value may serve a detector: present in both groups, more than one value among normal rows, and no perfect cut,
    which speaks of an artefact; with the reasons against."""
    reasons = F.array_compact(F.array(F.when(F.col("n_true") == 0, "absent from attacks"), F.when(F.col("n_false") == 0, "absent from normal rows"), F.when(F.col("distinct_false") <= 1, "constant among normal rows"), F.when(F.col("separated"), "separates perfectly")))
    return found.withColumn("reasons", reasons).withColumn("passes", F.size(reasons) == 0)


def support_gate(support: DataFrame, least_windows: int, least_attacks: int) -> DataFrame:
    """``support`` (normal_windows, attack_windows) with the reasons against a type, none if it may be used."""
    reasons = F.array_compact(F.array(F.when(F.col("normal_windows") < least_windows, "too few normal windows"), F.when(F.col("attack_windows") < least_attacks, "too few attack windows")))
    return support.withColumn("reasons", reasons).withColumn("supported", F.size(reasons) == 0)


def typed_support(frames: DataFrame, windows: DataFrame, attack: int) -> DataFrame:
    """For each code and block: normal frames, normal windows and windows with an attack; also over all codes (null code)."""
    rows = frames.select("bucket", "function_code").join(windows.select("bucket", "block", "categories"), "bucket")
    from .windows import containing, pure_normal

    normal = pure_normal("categories")
    return rows.rollup("block", "function_code").agg(F.count_if(normal).alias("normal_frames"), F.count_distinct(F.when(normal, F.col("bucket"))).alias("normal_windows"), F.count_distinct(F.when(containing("categories", attack), F.col("bucket"))).alias("attack_windows")).where("block is not null")


def cooccurrence(windows: DataFrame, category: int) -> DataFrame:
    """Windows with a category by what else they hold: the other categories but Normal, joined by a plus sign, or 'pure'."""
    from .windows import containing

    others = F.array_join(F.transform(F.array_sort(F.filter("categories", lambda c: ~c.isin(0, category))), lambda c: c.cast("string")), "+")
    rows = windows.where(containing("categories", category)).withColumn("other", F.when(others == "", "pure").otherwise(others))
    return rows.groupBy("other").agg(F.count("*").alias("n_windows"), F.avg("packet_count").alias("mean_packets"))


def roc_auc(scores: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the receiver operating curve, from average ranks."""
    on = F.col(label) == 1
    ranked = counted_ranks(scores, score, [], __a=on, __b=~on)
    got = ranked.agg(F.sum("__a").alias("n"), F.sum("__b").alias("m"), F.sum(F.col("__a") * F.col("rank")).alias("ranks"))
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    return got.select(((F.col("ranks") - n * (n + 1) / 2) / (n * m)).alias("roc_auc"), "n", "m")


def average_precision(scores: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the precision-recall curve: the sum over thresholds of precision times the gain in recall."""
    counts = scores.groupBy(score).agg(F.sum(label).alias("__p"), F.count("*").alias("__n"))
    total = counts.agg(F.sum("__p").alias("__all"))
    placed = ordered.cumulated(counts, [], score, {"__tp": F.col("__p"), "__at": F.col("__n")}, descending=True)
    rows = placed.crossJoin(F.broadcast(total))  # one row
    return rows.agg(F.sum(F.col("__tp") / F.col("__at") * F.col("__p") / F.col("__all")).alias("average_precision"))
