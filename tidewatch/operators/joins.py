"""Joins of frame logs and event points: verified positional merge, nearest and range matches, predecessors, identity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered


def aligned(left: DataFrame, right: DataFrame, checks: list[str], key: str = "record_index") -> DataFrame:
    """Rows merged by position, with ``r_`` before the right side's columns; an error where a row is alone or a check differs."""
    other = right.select(F.col(key), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != key], F.lit(True).alias("__right"))
    rows = left.withColumn("__left", F.lit(True)).join(other, key, "full")
    sound = F.col("__left").isNotNull() & F.col("__right").isNotNull()
    for c in checks:
        sound = sound & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    return rows.withColumn("__ok", F.assert_true(sound, F.concat(F.lit("rows differ at "), F.col(key).cast("string")))).where(F.col("__ok").isNull()).drop("__ok", "__left", "__right")


def alignment_report(left: DataFrame, right: DataFrame, checks: list[str], key: str = "record_index") -> DataFrame:
    """One row: merged pairs, rows alone on either side, and for each check the pairs that differ."""
    other = right.select(F.col(key), *[F.col(c).alias(f"r_{c}") for c in checks], F.lit(1).alias("__r"))
    rows = left.select(key, *checks, F.lit(1).alias("__l")).join(other, key, "full")
    both = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    return rows.agg(F.count_if(both).alias("pairs"), F.count_if(F.col("__r").isNull()).alias("left_only"), F.count_if(F.col("__l").isNull()).alias("right_only"), *[F.count_if(both & ~F.col(c).eqNullSafe(F.col(f"r_{c}"))).alias(f"differs_{c}") for c in checks])


def nearest(rows: DataFrame, candidates: DataFrame, key: str, slice_: int = 10_000) -> DataFrame:
    """Each row's candidate with the closest key, the later one of two as close: ``match``, null if there is no candidate.

    Keys are whole numbers.  Both sides are dealt to slices of the key; each slice also gets the last candidate before and the
    first after it, so that one window over a slice sees every neighbour.
    """
    at = lambda c: F.floor(c / slice_)
    cand = candidates.select(F.col(key).alias("key")).distinct().withColumn("slice", at(F.col("key")))
    edges = cand.groupBy("slice").agg(F.min("key").alias("least"), F.max("key").alias("most"))
    every = rows.select(at(F.col(key)).alias("slice")).distinct().join(edges, "slice", "full")
    back, on = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("slice").rowsBetween(1, Window.unboundedFollowing)  # one row for each slice
    around = every.select("slice", F.last("most", ignorenulls=True).over(back).alias("before"), F.first("least", ignorenulls=True).over(on).alias("after"))
    marked = rows.withColumns({"slice": at(F.col(key)), "key": F.col(key), "__row": F.lit(True)}).unionByName(cand.withColumn("__row", F.lit(False)), allowMissingColumns=True)
    order = Window.partitionBy("slice").orderBy("key", F.col("__row").cast("int"))
    own = F.when(~F.col("__row"), F.col("key"))
    marked = marked.withColumns({"__low": F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "__high": F.first(own, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))}).where("__row")
    marked = marked.join(around, "slice", "left").withColumns({"__low": F.coalesce("__low", "before"), "__high": F.coalesce("__high", "after")})
    low, high, k = F.col("__low"), F.col("__high"), F.col("key")
    match = F.when(low.isNull() | (high - k <= k - low), high).otherwise(low)
    return marked.withColumn("match", F.coalesce(match, low)).drop("slice", "key", "__row", "__low", "__high", "before", "after")


def range_counts(points: DataFrame, samples: DataFrame, ranges: dict[str, tuple[Column, Column]], slice_us: int, *, ts: str = "ts_us", point_key: str = "point_id") -> DataFrame:
    """``points`` with, for each name, the number of samples at times from the first to the second bound, both included.

    Bounds are whole microseconds, so an open end is a bound one less or more.  A range holds the samples up to its end less those
    before it, so bounds and samples are laid in one order and samples are summed over its blocks: work and memory grow with
    points and samples, however many samples a range holds, and ``slice_us`` is of no account.
    """
    ends = [(a - 1, b) for a, b in ranges.values()]
    values = F.array_distinct(F.array_compact(F.array(*[x.cast("long") for pair in ends for x in pair])))
    bounds = points.select(point_key, F.posexplode(values).alias("__at", "__ts"))
    # a sample comes before the bounds of its time; samples of one time are one row
    counted = samples.where(F.col(ts).isNotNull()).groupBy(F.col(ts).cast("long").alias("__ts")).agg(F.count("*").alias("__n")).withColumn("__bound", F.lit(0))
    rows = counted.unionByName(bounds.withColumns({"__n": F.lit(0).cast("long"), "__bound": F.lit(1)}), allowMissingColumns=True)
    rows = ordered.running_sum(ordered.numbered(rows, "__ts", "__bound", point_key, out="__place"), "__place", F.col("__n"), "__upto")
    got = rows.where("__bound = 1").groupBy(point_key).agg(*[F.max(F.when(F.col("__at") == i, F.col("__upto"))).alias(f"__upto_{i}") for i in range(2 * len(ends))])
    upto = F.array(*[F.col(f"__upto_{i}") for i in range(2 * len(ends))])
    at = lambda x: F.get(upto, (F.array_position(values, x.cast("long")) - 1).cast("int"))
    counts = {n: F.greatest(F.coalesce(at(b) - at(a), F.lit(0)), F.lit(0)) for n, (a, b) in zip(ranges, ends, strict=True)}
    return points.join(got, point_key, "left").withColumns(counts).drop(*got.columns[1:])


def neighbour_gaps(points: DataFrame, ts: str = "ts_us") -> DataFrame:
    """``points`` with seconds to the nearest other time and to the next later one; null where there is none.  Equal times share both."""
    times = ordered.indexed(points.select(ts).distinct(), ts, ts, out="position")
    w = ordered.over("position")
    # the frame looks one row ahead: order backwards is a frame back, so gaps before are found first and shifted
    gaps = ordered.with_frame(times, "position", 1, {"before": (F.col(ts) - F.lag(ts).over(w)) / 1e6})
    later = gaps.select((F.col("position") - 1).alias("position"), F.col("before").alias("next_gap"))
    gaps = gaps.join(later, "position", "left").select(ts, F.least("before", "next_gap").alias("nearest_gap"), "next_gap")
    return points.join(gaps, ts)


def predecessor(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``prev_`` columns of the row whose key is one less; null where there is none, gaps included."""
    before = rows.select((F.col(key) + 1).alias(key), *[F.col(c).alias(f"prev_{c}") for c in columns])
    return rows.join(before, key, "left")


def identical(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each key of either side: ``same`` if both have it and all columns agree, nulls included."""
    other = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in columns], F.lit(1).alias("__r"))
    rows = left.select(*keys, *columns, F.lit(1).alias("__l")).join(other, keys, "full")
    same = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    return rows.select(*keys, same.alias("same"))


def dominated(curve: DataFrame, other: DataFrame, gain: str = "recall", cost: str = "fpr") -> DataFrame:
    """Points of a threshold curve with the number of points of another that are at least as good in both and better in one."""
    o = other.select(F.col(gain).alias("__g"), F.col(cost).alias("__c"))
    better = (F.col("__g") >= F.col(gain)) & (F.col("__c") <= F.col(cost)) & ((F.col("__g") > F.col(gain)) | (F.col("__c") < F.col(cost)))
    rows = curve.join(F.broadcast(o), better, "left")  # a curve has a point for each threshold of a fixed grid
    return rows.groupBy(*curve.columns).agg(F.count("__g").alias("dominated_by"))
