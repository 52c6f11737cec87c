"""Streaming twins: tumbling and session windows with watermarks, running cumulative sums, and consecutive alert removal."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import windows
from ..operators.ordered import indexed
from ..sources.frames import instant
from ..sources.scratch import scratch

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files: int = 1) -> DataFrame:
    """The event table as a stream of files."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    single = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile()
    reader = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files)
    raw = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(f"{folder}/{name}")
    return raw.withColumn("ts", instant("ts"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events, their types and values by tumbling window; events later than the watermark are left out."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most")).select(F.unix_micros("window.start").alias("start_us"), "n", "total", "most")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", width, step)
    return events.withWatermark("ts", late).groupBy(w).agg(F.count("*").alias("n")).select(F.unix_micros("window.start").alias("start_us"), "n")


def session_counts(events: DataFrame, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: a gap that equals the limit still joins."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w, key).agg(F.count("*").alias("n"), F.max("ts").alias("last")).select(key, F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n")


def _stateful(rows: DataFrame, keys: list[str], step, output: str, kept: str, expire_s: float | None) -> DataFrame:
    """``rows`` (keys, at in microseconds, ...) through ``step(state or None, rows of a key in order) -> (state, rows)``.

    With ``expire_s`` a key's state goes when the watermark is so far beyond its last event; its next event starts anew.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(name: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        own = pd.concat(list(batches))
        kept_, out = step(state.get if state.exists else None, own)
        state.update(kept_)
        if expire_s is not None:
            state.setTimeoutTimestamp(max(int(own["at"].max() // 1000 + expire_s * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({**dict(zip(keys, ([v] * len(out) for v in name), strict=True)), **{c: out[c].to_numpy() for c in out.columns}})

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInPandasWithState(run, f"{kinds}, {output}", kept, "update", GroupStateTimeout.NoTimeout if expire_s is None else GroupStateTimeout.EventTimeTimeout)


def cusum(events: DataFrame, key: str, expected_s: float, scale_s: float, allowance: float = 0.5, *, late: str | None = None, expire_s: float | None = None) -> DataFrame:
    """The cumulative sum of scaled late gaps of each key after each batch: (key, n, state).

    State is (last time, sum, events); rows of a batch are taken in time order, an event that is not later than the last leaves
    the sum as it is.  With ``late`` and ``expire_s`` the state of keys without events for so long goes.
    """

    def step(state, own):
        import pandas as pd

        last, total, n = state or (None, 0.0, 0)
        for at in sorted(own["at"].tolist()):
            if last is not None and at > last:
                total = max(0.0, total + max(0.0, (at - last) / 1e6 - expected_s) / scale_s - allowance)
            last, n = at, n + 1
        return (last, total, n), pd.DataFrame({"n": [n], "state": [total]})

    rows = (events if late is None else events.withWatermark("ts", late)).select(key, "ts", F.unix_micros("ts").alias("at"))
    return _stateful(rows, [key], step, "n long, state double", "last long, total double, n long", expire_s)


def deduplicated(alerts: DataFrame, key: str, index: str = "position", fired: str = "fired", *, late: str = "0 seconds", expire_s: float | None = None) -> DataFrame:
    """The streaming twin of :func:`consecutive` for rows (key, ts, index, fired): (key, index, length, severity) of every run
    that a batch begins or lengthens, by its first index.

    State is the open run (first, length, last).  A row that is not after the last one of its key is late, or a repeat, and
    left out.  With ``expire_s`` the run of a key without alerts for so long goes, and the next alert starts another.
    """

    def step(state, own):
        import pandas as pd

        first, length, last = state or (None, 0, None)
        runs = {}
        for at in sorted(own["index"].tolist()):
            if last is not None and at <= last:
                continue
            first, length = (first, length + 1) if last is not None and at == last + 1 else (at, 1)
            last = at
            runs[first] = length
        severity = [3 if n >= 5 else 2 if n >= 2 else 1 for n in runs.values()]
        out = pd.DataFrame({index: pd.Series(list(runs), dtype="int64"), "length": pd.Series(list(runs.values()), dtype="int64"), "severity": pd.Series(severity, dtype="int32")})
        return (first, length, last), out

    rows = alerts.withWatermark("ts", late).where(fired).select(key, "ts", F.unix_micros("ts").alias("at"), F.col(index).cast("long").alias("index"))
    return _stateful(rows, [key], step, f"{index} long, length long, severity int", "first long, length long, last long", expire_s)


def drained(stream: DataFrame, kind: str, mode: str = "append", checkpoint: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over all that is there, into files in the shared folder, its checkpoint beside them or where told.

    Every batch is a table of its own, written anew if the batch is run again.  The result is what the last batch says of each
    of ``keys`` (``update``), the last batch whole (``complete``), or all batches (``append``).
    """
    spark = stream.sparkSession
    path = scratch(spark, kind)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batches/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batches")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):  # nothing came
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).option("basePath", f"{path}/batches").parquet(f"{path}/batches")
    if mode == "append":
        return rows.drop("batch")
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("__last"))
        return rows.join(F.broadcast(last), F.col("batch") == F.col("__last")).drop("batch", "__last")  # one row
    others = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("__x")).select(*keys, "__x.*")


def replayed(events: DataFrame, ts: str, slice_s: int, speed: float, kind: str = "replay", **source) -> DataFrame:
    """A stream that replays a table's time slices in order, one file a batch.

    Files have the order of their slices in their times; with a processing-time trigger of :func:`pace` seconds the stream runs ``speed`` times as fast as
    the events did.
    """
    spark = events.sparkSession
    path = scratch(spark, kind)
    # one job writes all slices, a file each
    events.withColumn("slice", F.floor(F.unix_micros(ts) / (slice_s * 1_000_000))).repartition("slice").write.partitionBy("slice").parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = sorted((int(f.getPath().getName().removeprefix("slice=")), f.getPath()) for f in fs.listStatus(place) if f.isDirectory())
    for i, (_, folder) in enumerate(folders):  # a stream takes files by their time
        for f in fs.listStatus(folder):
            fs.setTimes(f.getPath(), 1_000_000_000_000 + 1000 * i, -1)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def pace(slice_s: int, speed: float) -> float:
    """Seconds between batches for a replay at ``speed``."""
    if speed <= 0:
        raise ValueError("speed must be positive")
    return slice_s / speed


def consecutive(alerts: DataFrame, index: str = "position", fired: str = "fired") -> DataFrame:
    """Alerts without those that follow one directly, with the length of the run and a severity of 1 to 3 by it."""
    hits = alerts.where(fired).withColumn("value", F.col(index))
    placed = indexed(hits, "value", "value", out="__at")
    runs = windows.runs(placed, "__at", 1, "value").groupBy("run").agg(F.min("value").alias(index), F.count("*").alias("length"))
    return runs.withColumn("severity", F.when(F.col("length") >= 5, 3).when(F.col("length") >= 2, 2).otherwise(1)).drop("run")


__all__ = ["EVENTS", "consecutive", "cusum", "deduplicated", "drained", "event_stream", "pace", "replayed", "session_counts", "sliding", "tumbling"]
