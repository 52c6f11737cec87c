"""Splits that keep time order, with guards between the blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import indexed


def positions(windows: DataFrame, key: str = "bucket") -> DataFrame:
    """``windows`` with ``position`` from 0 in key order, and ``n``, their number."""
    n = windows.agg(F.count("*").alias("n"))
    return indexed(windows, key, key, out="position").withColumn("position", F.col("position") - 1).crossJoin(F.broadcast(n))


def contiguous(windows: DataFrame, key: str = "bucket", train: float = 0.6, validation: float = 0.2, guard: int = 1) -> DataFrame:
    """``windows`` with ``block``: train, validation and test shares in order, ``guard`` windows on either side of a cut in none."""
    rows = positions(windows, key)
    a, b = (F.col("n") * train).cast("long"), (F.col("n") * (train + validation)).cast("long")
    at = F.col("position")
    block = F.when(at < a - guard, "train").when((at >= a + guard) & (at < b - guard), "validation").when(at >= b + guard, "test").otherwise("guard")
    return rows.withColumn("block", block).drop("n")


def by_manifest(windows: DataFrame, split: DataFrame, key: str = "bucket", guard: int = 2) -> DataFrame:
    """``windows`` with the blocks of a manifest (bucket, block); test are the windows after its last, less the first ``guard``."""
    last = split.where("block in ('train', 'validation')").agg(F.max("bucket").alias("__last"))
    rows = windows.join(split.withColumnRenamed("bucket", key), key, "left").crossJoin(F.broadcast(last))
    after = indexed(rows.where(F.col(key) > F.col("__last")), key, key, out="__at").select(key, "__at")
    rows = rows.join(after, key, "left").withColumn("block", F.coalesce(F.when(F.col("__at") > guard, "test"), "block", F.lit("guard")))
    return rows.drop("__last", "__at")


def by_time(rows: DataFrame, ts: str = "ts_us", share: float = 0.75, guard_us: int = 1_000_000) -> DataFrame:
    """``rows`` with ``block``: train before and test after the row at the share's place, ``guard_us`` away from it at least."""
    placed = positions(rows, ts) if ts == "bucket" else indexed(rows, ts, ts, out="position").withColumn("position", F.col("position") - 1)
    n = rows.agg((F.count("*") * share).cast("long").alias("__cut"))
    cut = placed.join(F.broadcast(n), F.col("position") == F.col("__cut")).agg(F.max(ts).alias("__ts"))
    out = placed.crossJoin(F.broadcast(cut))
    block = F.when(F.col(ts) < F.col("__ts") - guard_us, "train").when(F.col(ts) > F.col("__ts") + guard_us, "test").otherwise("guard")
    return out.withColumn("block", block).drop("__ts", "position")


def forward_segments(windows: DataFrame, positive: str, segments: int = 6, key: str = "bucket") -> DataFrame:
    """``windows`` with ``segment`` from 0, cut so that each has about as many rows with ``positive`` = 1."""
    rows = positions(windows, key)
    total = rows.agg(F.sum(positive).alias("__total"))
    from .ordered import running_sum

    rows = running_sum(rows.withColumn("__at", F.col("position") + 1), "__at", F.col(positive), "__seen").crossJoin(F.broadcast(total))
    before = F.col("__seen") - F.col(positive)
    segment = F.least(F.lit(segments - 1), F.floor(before * segments / F.greatest(F.col("__total"), F.lit(1))))
    return rows.withColumn("segment", segment.cast("int")).drop("__at", "__seen", "__total", "n")


def forward_folds(segmented: DataFrame, segments: int = 6, guard: int = 1) -> DataFrame:
    """One row for each fold and window in it: fold f learns on segments before f and is tested on f; windows within ``guard`` of
    the cut are left out."""
    edges = segmented.groupBy("segment").agg(F.min("position").alias("first"), F.max("position").alias("last"))
    folds = edges.where("segment > 0").select(F.col("segment").alias("fold"), F.col("first").alias("cut"), F.col("last").alias("end"))
    rows = segmented.crossJoin(F.broadcast(folds)).where(F.col("position") <= F.col("end"))
    role = F.when(F.col("position") < F.col("cut") - guard, "train").when(F.col("position") >= F.col("cut") + guard, "validation")
    return rows.withColumn("role", role).where("role is not null").drop("cut", "end")
