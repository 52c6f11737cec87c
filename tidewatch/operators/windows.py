"""Time windows over frames: tumbling feature windows, native widths, sessions, and what windows hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered

#: Feature names in the order that ranks ties. Fixed values.
FEATURES = (
    "packet_count", "packets_per_sec", "bytes_per_sec", "mean_frame_len", "iat_mean", "iat_std", "iat_min", "iat_max", "frac_func_valid",
    "frac_func_read", "frac_func_write", "rare_func_rate", "distinct_frame_ratio", "repeat_frame_rate", "payload_entropy_mean", "payload_entropy_std",
)
#: Those of the forest: two are constant or the inverse of another on normal traffic.
FOREST_FEATURES = tuple(f for f in FEATURES if f not in ("frac_func_valid", "rare_func_rate"))


def bucket(ts: str | Column, width_us: int) -> Column:
    """Number of the window of ``width_us`` microseconds that holds a time."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ((ts - F.pmod(ts, F.lit(width_us))) / width_us).cast("long")


def feature_windows(frames: DataFrame, width_us: int = 5_000_000, *, least: int = 2, valid=(3, 16), more: tuple[Column, ...] = ()) -> DataFrame:
    """One row for each window of at least ``least`` frames: 16 features, and the sets of categories, codes and addresses.

    Gaps are within the window; the deviation of a single gap is 0.  All moments are of the whole population.  ``more`` are
    further aggregates of the same pass, such as :func:`readings`.
    """
    order = Window.partitionBy("bucket").orderBy("ts_us", "record_index")
    rows = frames.withColumn("bucket", bucket("ts_us", width_us)).withColumns({"gap": F.col("ts_us") - F.lag("ts_us").over(order), "again": (F.col("payload") == F.lag("payload").over(order)).cast("int")})
    n, seconds = F.count("*"), width_us / 1e6
    share = lambda c: F.sum(c.cast("int")) / n
    out = rows.groupBy("bucket").agg(
        n.cast("double").alias("packet_count"), (n / seconds).alias("packets_per_sec"), (F.sum("frame_len") / seconds).alias("bytes_per_sec"), F.avg("frame_len").alias("mean_frame_len"),
        (F.avg("gap") / 1e6).alias("iat_mean"), (F.coalesce(F.stddev_pop("gap"), F.lit(0.0)) / 1e6).alias("iat_std"), (F.min("gap") / 1e6).alias("iat_min"), (F.max("gap") / 1e6).alias("iat_max"),
        share(F.col("function_code").isin(*valid)).alias("frac_func_valid"), share(F.col("function_code") == 3).alias("frac_func_read"), share(F.col("function_code") == 16).alias("frac_func_write"), share(~F.col("function_code").isin(*valid)).alias("rare_func_rate"),
        (F.count_distinct("payload") / n).alias("distinct_frame_ratio"), F.when(n > 1, F.coalesce(F.sum("again"), F.lit(0)) / (n - 1)).otherwise(1.0).alias("repeat_frame_rate"),
        F.avg("entropy").alias("payload_entropy_mean"), F.coalesce(F.stddev_pop("entropy"), F.lit(0.0)).alias("payload_entropy_std"),
        F.sort_array(F.collect_set("category")).alias("categories"), F.sort_array(F.collect_set("function_code")).alias("func_codes"), F.sort_array(F.collect_set("address")).alias("addresses"), *more,
    ).where(F.col("packet_count") >= least)
    return out.withColumn("is_attack", F.exists("categories", lambda c: c != 0).cast("int"))


def until(frames: DataFrame, last: int, width_us: int) -> DataFrame:
    """Frames up to the window ``last``, itself included: a range of times, which a scan of sorted files can prune."""
    return frames.where(F.col("ts_us") < (last + 1) * width_us)


def dominant(categories: str | Column) -> Column:
    """The smallest category but Normal; 0 for pure Normal."""
    return F.coalesce(F.array_min(F.filter(categories, lambda c: c != 0)), F.lit(0))


def pure_normal(categories: str) -> Column:
    return (F.size(categories) == 1) & (F.col(categories)[0] == 0)


def containing(categories: str, category: int | Column) -> Column:
    return F.array_contains(F.col(categories), category)


def pure(categories: str, category: int) -> Column:
    """Holds the category and else at most Normal."""
    return containing(categories, category) & F.forall(categories, lambda c: c.isin(0, category))


def exactly(categories: str, category: int) -> Column:
    return (F.size(categories) == 1) & (F.col(categories)[0] == category)


def readings() -> tuple[Column, ...]:
    """The aggregates of :func:`pressure_range`, to be taken with others in one pass; null where a window has no reading."""
    return F.min("pressure").alias("p_min"), F.max("pressure").alias("p_max")


def pressure_range(frames: DataFrame, width_us: int) -> DataFrame:
    """(bucket, p_min, p_max, p_count) of windows with a reading."""
    return frames.where(F.col("pressure").isNotNull()).groupBy(bucket("ts_us", width_us).alias("bucket")).agg(F.min("pressure").alias("p_min"), F.max("pressure").alias("p_max"), F.count("*").alias("p_count"))


def pressure_features(frames: DataFrame, buckets: DataFrame, baseline: DataFrame, width_us: int) -> DataFrame:
    """For each of ``buckets`` and each code of ``baseline`` (function_code, mean): last, mean, least, largest reading, largest and
    last deviation from the mean, and last change; a window without a reading has the baseline and no deviation."""
    rows = frames.where(F.col("pressure").isNotNull()).withColumn("bucket", bucket("ts_us", width_us))
    order = Window.partitionBy("bucket", "function_code").orderBy("ts_us", "record_index")
    rows = rows.withColumn("change", F.col("pressure") - F.lag("pressure").over(order)).join(baseline, "function_code")
    at = F.struct("ts_us", "record_index")
    got = rows.groupBy("bucket", "function_code").agg(
        F.max_by("pressure", at).alias("last"), F.avg("pressure").alias("mean_"), F.min("pressure").alias("least"), F.max("pressure").alias("most"),
        F.max(F.abs(F.col("pressure") - F.col("mean"))).alias("deviation_max"), F.max_by("change", at).alias("change_last"),
    )
    every = buckets.select("bucket").crossJoin(baseline)  # a few codes for each window
    out = every.join(got, ["bucket", "function_code"], "left")
    value = lambda c: F.coalesce(F.col(c), F.col("mean"))
    return out.select("bucket", "function_code", value("last").alias("last"), value("mean_").alias("average"), value("least").alias("least"), value("most").alias("most"), F.coalesce("deviation_max", F.lit(0.0)).alias("deviation_max"), F.abs(value("last") - F.col("mean")).alias("deviation_last"), F.coalesce("change_last", F.lit(0.0)).alias("change_last"), F.col("last").isNotNull().cast("int").alias("available"))


def native_windows(frames: DataFrame, blocks: DataFrame, width_us: int, times: int) -> DataFrame:
    """Windows ``times`` as wide that lie in one block with all of their narrow windows: spread, range, largest step, slope and
    shift of the mean from the window before; null where there are fewer than two readings."""
    wide = F.floor(F.col("bucket") / times)
    kept = blocks.where("block in ('train', 'validation', 'test')").groupBy(wide.alias("wide"), "block").agg(F.count_distinct("bucket").alias("n")).where(F.col("n") == times).drop("n")
    rows = frames.where(F.col("pressure").isNotNull()).withColumn("bucket", bucket("ts_us", width_us)).withColumn("wide", wide)
    order = Window.partitionBy("wide").orderBy("ts_us", "record_index")
    rows = rows.withColumns({"step": F.abs(F.col("pressure") - F.lag("pressure").over(order)), "t": (F.col("ts_us") - F.col("wide") * (width_us * times)) / 1e6})
    two = F.count("*") >= 2
    got = rows.groupBy("wide").agg(
        F.count("*").alias("n"), F.avg("pressure").alias("mean"), F.when(two, F.stddev_pop("pressure")).alias("std"), F.when(two, F.max("pressure") - F.min("pressure")).alias("range"), F.max("step").alias("step_max"),
        F.when(two, F.coalesce(F.abs(F.regr_slope("pressure", "t")), F.lit(0.0))).alias("slope"),
    )
    before = got.select((F.col("wide") + 1).alias("wide"), F.col("mean").alias("mean_before"))
    return kept.join(got, "wide").join(before, "wide", "left").withColumn("mean_shift", F.when(F.col("n") >= 2, F.abs(F.col("mean") - F.col("mean_before")))).drop("mean_before")


def sessions(points: DataFrame, gap_us: int | float, index: str = "position") -> DataFrame:
    """``points`` (indexed from 1 by time) with ``session``: a new one starts where the gap before exceeds ``gap_us``."""
    rows = ordered.with_frame(points, index, 1, {"__new": (F.col("ts_us") - F.lag("ts_us").over(ordered.over(index)) > gap_us).cast("int")})
    return ordered.running_sum(rows, index, F.coalesce("__new", F.lit(0)), "session").drop("__new")


def runs(rows: DataFrame, index: str = "position", step: int = 1, key: str = "value") -> DataFrame:
    """``rows`` with ``run``: runs of ``key`` whose neighbours differ by at most ``step``, in index order."""
    marked = ordered.with_frame(rows, index, 1, {"__new": (F.col(key) - F.lag(key).over(ordered.over(index)) > step).cast("int")})
    return ordered.running_sum(marked, index, F.coalesce("__new", F.lit(0)), "run").drop("__new")


def means(rows: DataFrame, value: Column, out: str = "mean") -> DataFrame:
    """The mean of a caller's expression in each bucket."""
    return rows.groupBy("bucket").agg(F.avg(value).alias(out))


def code_divergence(frames: DataFrame, normal: DataFrame) -> DataFrame:
    """For each bucket the L1 distance and the Jensen-Shannon divergence (bits) of its function codes from those of normal buckets;
    without a normal bucket their shares are all 0."""
    counts = frames.groupBy("bucket", "function_code").agg(F.count("*").alias("n"))
    shares = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("bucket")))
    known = counts.join(normal.select("bucket"), "bucket", "left_semi").groupBy("function_code").agg(F.sum("n").alias("m"))
    total = known.agg(F.sum("m").alias("t"))
    q = known.crossJoin(F.broadcast(total)).select("function_code", (F.col("m") / F.col("t")).alias("q"))  # a row for each code
    # codes that a bucket lacks add q to the distance and q / 2 bits to the divergence: their sum is 1 less the shared codes' q
    both = shares.join(F.broadcast(q), "function_code", "left").withColumn("q", F.coalesce("q", F.lit(0.0))).crossJoin(F.broadcast(total))
    mid = (F.col("p") + F.col("q")) / 2
    part = F.col("p") * F.log2(F.col("p") / mid) + F.when(F.col("q") > 0, F.col("q") * F.log2(F.col("q") / mid)).otherwise(0.0)
    rest = F.when(F.max("t").isNotNull(), 1 - F.sum("q")).otherwise(0.0)
    return both.groupBy("bucket").agg((F.sum(F.abs(F.col("p") - F.col("q"))) + rest).alias("l1"), ((F.sum(part) + rest) / 2).alias("js"))
