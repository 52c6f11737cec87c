"""Shapes of readings: libraries of normal subsequences, warped and plain nearest neighbours, and synthetic floods."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import number
from ..sources.scratch import written
from . import ordered

#: Subsequences in a library of warped neighbours at most.
LIBRARY = 300
#: Subsequences in a block of the search through all shapes.
SHAPES = 1024


def subsequences(series: DataFrame, length: int = 15, gap_us: int | None = None, keep: str | None = None) -> DataFrame:
    """(position, bucket, values): every run of ``length`` consecutive readings, by its last one, whose neighbours are at most
    ``gap_us`` apart and which all have ``keep``."""
    w, back = ordered.over("position", -(length - 1), 0), length - 1
    order = ordered.over("position")
    far = F.lit(False) if gap_us is None else F.col("ts_us") - F.lag("ts_us").over(order) > gap_us
    rows = ordered.with_frame(series, "position", back, {"__far": F.coalesce(far, F.lit(False)).cast("int")})
    kept = F.lit(1) if keep is None else F.col(keep).cast("int")
    rows = ordered.with_frame(rows, "position", back, {"values": F.collect_list("pressure").over(w), "__kept": F.min(kept).over(w), "__breaks": F.sum("__far").over(ordered.over("position", -(length - 2), 0))})
    return rows.where((F.size("values") == length) & (F.col("__kept") == 1) & (F.col("__breaks") == 0)).select("position", "bucket", "values")


def distinct_shapes(subs: DataFrame, digits: int = 4) -> DataFrame:
    """One subsequence for each tuple of rounded values: the first."""
    return subs.groupBy(F.transform("values", lambda v: F.round(v, digits)).alias("shape")).agg(F.min_by("values", "position").alias("values"), F.min("position").alias("position")).drop("shape")


def library(subs: DataFrame, most: int = LIBRARY, seed: int = 42) -> np.ndarray:
    """At most ``most`` distinct shapes, those whose places hash lowest."""
    rows = distinct_shapes(subs).orderBy(number(seed, "position"), "position").limit(most).select("values").collect()
    return np.array([r[0] for r in rows], float)


def normalised(x: np.ndarray) -> np.ndarray:
    """Rows with mean 0 and population deviation 1; nearly constant ones only centred."""
    sd = x.std(axis=-1, keepdims=True)
    return (x - x.mean(axis=-1, keepdims=True)) / np.where(sd < 1e-9, 1.0, sd)


def warped(query: np.ndarray, library_: np.ndarray) -> np.ndarray:
    """Dynamic time warping distance (absolute differences, no band) of a query to every library row."""
    n, m = len(query), library_.shape[1]
    last = np.full((len(library_), m + 1), np.inf)
    last[:, 0] = 0.0
    for i in range(n):
        now = np.full_like(last, np.inf)
        cost = np.abs(library_ - query[i])
        for j in range(1, m + 1):
            now[:, j] = cost[:, j - 1] + np.minimum(np.minimum(last[:, j], now[:, j - 1]), last[:, j - 1])
        last = now
    return last[:, m]


def lower_bounds(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """What the warped distance of every row of ``x`` to every library row is at least.

    The ends of two shapes always meet, and every value meets one within the other shape's range.
    """
    ends = np.abs(x[:, None, 0] - known[None, :, 0]) + (np.abs(x[:, None, -1] - known[None, :, -1]) if min(x.shape[1], known.shape[1]) > 1 else 0)
    beyond = lambda a, low, high: np.maximum(a - high[..., None], 0) + np.maximum(low[..., None] - a, 0)
    mine = beyond(x[:, None, :], known.min(1)[None], known.max(1)[None]).sum(2)
    theirs = beyond(known[None], x.min(1)[:, None], x.max(1)[:, None]).sum(2)
    return np.maximum(ends, np.maximum(mine, theirs))


def _warped_pairs(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, int]:
    """(warped distances of rows to rows, infinite where they reach ``limit``; pairs that were warped to the end)."""
    out, on = np.full(len(a), np.inf), np.arange(len(a))
    last = np.full((len(a), b.shape[1] + 1), np.inf)
    last[:, 0] = 0.0
    for i in range(a.shape[1]):
        now = np.full_like(last, np.inf)
        cost = np.abs(b[on] - a[on, i, None])
        for j in range(1, b.shape[1] + 1):
            now[:, j] = cost[:, j - 1] + np.minimum(np.minimum(last[:, j], now[:, j - 1]), last[:, j - 1])
        keep = now.min(1) < limit[on]  # a path passes every row, so a row's least only grows
        on, last = on[keep], now[keep]
        if not len(on):
            return out, 0
    out[on] = last[:, -1]
    return out, len(on)


def nearest_warped(x: np.ndarray, known: np.ndarray, rows: int = 256) -> tuple[np.ndarray, int]:
    """(each row's warped distance to its nearest library row, pairs that were warped to the end).

    All rows meet their candidates in turns, those with the least bound first; a row is done when the next bound is no less
    than what it has found, and a pair is left as soon as it cannot be nearer.
    """
    out, full = np.full(len(x), np.inf), 0
    for at in range(0, len(x), rows):
        own = x[at : at + rows]
        bound = lower_bounds(own, known)
        order = np.argsort(bound, 1, kind="stable")
        best, on = np.full(len(own), np.inf), np.arange(len(own))
        for turn in range(len(known)):
            on = on[bound[on, order[on, turn]] < best[on]]
            if not len(on):
                break
            far, ended = _warped_pairs(own[on], known[order[on, turn]], best[on])
            best[on] = np.minimum(best[on], far)
            full += ended
        out[at : at + rows] = best
    return out, full


def nearest_shape(subs: DataFrame, library_: np.ndarray) -> DataFrame:
    """(bucket, distance): the largest warped distance of a bucket's subsequences to their nearest library row."""
    shared = subs.sparkSession.sparkContext.broadcast(library_)

    @F.pandas_udf("double")
    def far(values):
        import pandas as pd

        x = np.stack(values.to_numpy()).astype(float) if len(values) else np.zeros((0, 1))
        return pd.Series(nearest_warped(x, shared.value)[0] if len(x) else [], dtype=float)

    return subs.withColumn("distance", far("values")).groupBy("bucket").agg(F.max("distance").alias("distance"))


def _packed(subs: DataFrame, rows: int) -> DataFrame:
    """(buckets, shapes): up to ``rows`` normalised subsequences in a row, as bytes of their numbers."""

    def pack(batches):
        for batch in batches:
            for part in (batch.slice(at, rows) for at in range(0, batch.num_rows, rows)):
                x = normalised(part.column("values").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1))
                buckets = part.column("bucket").to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"buckets": [buckets.tobytes()], "shapes": [x.tobytes()]})

    return subs.select("bucket", "values").mapInArrow(pack, "buckets binary, shapes binary")


def nearest_normalised(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distance of every row of ``a`` to its nearest row of ``b``: the product finds the row, the difference the distance."""
    at = ((b * b).sum(1) - 2 * (a @ b.T)).argmin(1)
    return ((a - b[at]) ** 2).sum(1)


def discords(subs: DataFrame, known: DataFrame, rows: int = SHAPES) -> DataFrame:
    """(bucket, distance): the largest Euclidean distance of a bucket's normalised subsequences to the nearest of all ``known`` ones.

    Every subsequence meets every known shape, so the work grows with their product.  Blocks of ``rows`` meet blocks of as many:
    a task holds two blocks and the table of their products, whatever the sizes of the sides.
    """
    spark = subs.sparkSession
    own = written(_packed(subs, rows).withColumn("block", F.monotonically_increasing_id()), "queries")
    shapes = written(_packed(known, rows).select(F.col("shapes").alias("known")), "library")

    def meet(batches):
        def out():
            n = len(best)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(n)), pa.array(buckets), pa.array(best)], ["block", "at", "bucket", "far"])

        block = best = buckets = None
        for batch in batches:
            for i in range(batch.num_rows):
                one = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if one["block"] != block:
                    if best is not None:
                        yield out()
                    block, buckets = one["block"], np.frombuffer(one["buckets"], np.int64)
                    x, best = np.frombuffer(one["shapes"]).reshape(len(buckets), -1), np.full(len(buckets), np.inf)
                k = np.frombuffer(one["known"]).reshape(-1, x.shape[1])
                best = np.minimum(best, nearest_normalised(x, k))
        if best is not None:
            yield out()

    # a block of subsequences is work for a task: more parts than cores, so that none waits long for the last
    pairs = own.repartition(4 * spark.sparkContext.defaultParallelism).crossJoin(shapes)
    found = pairs.mapInArrow(meet, "block long, at long, bucket long, far double")
    least = found.groupBy("block", "at").agg(F.first("bucket").alias("bucket"), F.min("far").alias("far"))
    return least.groupBy("bucket").agg(F.sqrt(F.max("far")).alias("distance"))


def flood(frames: DataFrame, times: float, profile: str, width_us: int) -> DataFrame:
    """Frames of each bucket at ``times`` the rate, evenly spaced over it.

    Profile A gives every synthetic frame an identity of its own, profile B repeats the bucket's frames in turn; a target of
    times n frames rounds half to even; once the rate, the frames stay as they are.
    """
    from pyspark.sql import Window

    if profile not in ("A", "B"):
        raise ValueError("profile is A or B")
    order = Window.partitionBy("bucket").orderBy("ts_us", "record_index")
    rows = frames.withColumns({"__at": F.row_number().over(order) - 1, "__n": F.count("*").over(Window.partitionBy("bucket"))})
    if times == 1:
        return rows.drop("__at", "__n")
    target = F.rint(F.col("__n") * times).cast("long")
    at, n = F.col("__at").cast("long"), F.col("__n")
    # a row has only its own places, every n-th from its own on
    rows = rows.withColumn("__i", F.explode(F.when(at < target, F.sequence(at, target - 1, n))))
    ts = (F.col("bucket") * width_us + F.floor(F.col("__i") * F.lit(float(width_us)) / target)).cast("long")
    out = rows.withColumns({"ts_us": ts, "record_index": F.col("__i")})
    if profile == "A":
        out = out.withColumn("payload", F.concat_ws("#", "payload", F.col("__i").cast("string")))
    return out.drop("__at", "__n", "__i")
