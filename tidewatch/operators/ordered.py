"""Global order without a global sort in one task.

Rows are cut into ranges that Spark samples, and get a dense index from their range's offset and their place in it; row frames
of bounded length work on blocks of consecutive indices, each with a halo of the rows just before it; running totals, least
totals and last values compose over blocks, within keys too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Consecutive rows framed by one task.
BLOCK = 100_000
#: Bits of a row's place in its range; those above are the range's number.
_PLACE = 33


def indexed(df: DataFrame, ts: str, tie: str, *, out: str = "record_index") -> DataFrame:
    """``df`` with ``out``: 1, 2, ... in the order of (ts, tie); rows without a ``ts`` have no place and are left out."""
    return numbered(df.where(F.col(ts).isNotNull()), *dict.fromkeys((ts, tie)), out=out)


def numbered(df: DataFrame, *order: str | Column, out: str = "place", slices: int | None = None) -> DataFrame:
    """``df`` with ``out``: 1, 2, ... in the order of any columns, ties in no order.

    Ranges are cut where Spark's sample of the rows says, as many as the session's shuffle partitions (``slices`` overrides), so
    a day, or one time if ties differ, that holds most rows is many ranges.  The sorted ranges are written: numbers and offsets
    are of the same ranges, whatever is lost and computed again.
    """
    ranges = df.repartitionByRange(slices, *order) if slices else df.repartitionByRange(*order)
    # a row's id is its range and its place there
    rows = written(ranges.sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "sorted")
    rows = rows.withColumn("__slice", F.shiftright("__id", _PLACE))
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = rows.groupBy("__slice").agg(F.count("*").alias("__n")).select("__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return rows.join(offsets, "__slice").withColumn(out, F.col("__id").bitwiseAND(F.lit((1 << _PLACE) - 1)) + 1 + F.col("__before")).drop("__id", "__slice", "__before")


def framed(df: DataFrame, index: str, back: int, *, block: int = BLOCK) -> DataFrame:
    """``df`` dealt to blocks (column ``block``) of consecutive ``index``, each with its ``back`` predecessors, marked ``halo``.

    A window over ``partitionBy("block").orderBy(index)`` then sees every frame of up to ``back`` preceding rows whole on the
    rows that are no halo.
    """
    if back >= block:
        raise ValueError("a frame must be shorter than a block")
    own = F.floor((F.col(index) - 1) / block)
    late = (F.col(index) - 1) % block >= block - back
    copies = F.array(F.struct(own.alias("block"), F.lit(False).alias("halo")))
    copies = F.when(late, F.concat(copies, F.array(F.struct((own + 1).alias("block"), F.lit(True).alias("halo"))))).otherwise(copies)
    return df.withColumn("__copy", F.explode(copies)).select("*", "__copy.block", "__copy.halo").drop("__copy")


def over(index: str, start: int | None = None, end: int | None = None):
    """The window of a framed DataFrame; rows from ``start`` to ``end`` relative to the current one."""
    window = Window.partitionBy("block").orderBy(index)
    return window if start is None else window.rowsBetween(start, end)


def with_frame(df: DataFrame, index: str, back: int, columns: dict[str, Column], *, block: int = BLOCK) -> DataFrame:
    """``df`` with window columns over frames of at most ``back`` preceding rows."""
    return framed(df, index, back, block=block).withColumns(columns).where(~F.col("halo")).drop("block", "halo")


def running_sum(df: DataFrame, index: str, value: Column, out: str, *, block: int = BLOCK) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to the current one in index order."""
    rows = df.withColumns({"__block": F.floor((F.col(index) - 1) / block), "__value": value})
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    totals = rows.groupBy("__block").agg(F.sum("__value").alias("__total")).select("__block", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.sum("__value").over(inside)).join(totals, "__block").withColumn(out, F.coalesce(F.col(out), F.lit(0)) + F.col("__before")).drop("__block", "__value", "__before")


def carried(df: DataFrame, keys: list[str], index: str, value: Column, out: str, *, strict: bool = False, block: int = BLOCK) -> DataFrame:
    """``df`` with the last ``value`` that is not null among a key's rows up to the current one, or before it if ``strict``.

    A key's rows are dealt to blocks of the index; every block also gets the last value of the blocks before, so a key with
    most of the rows is not one task.
    """
    rows = df.withColumns({"__block": F.floor((F.col(index) - 1) / block), "__value": value})
    ends = rows.groupBy(*keys, "__block").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(index))).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    ends = ends.withColumn("__end", F.last("__end", ignorenulls=True).over(before))
    inside = Window.partitionBy(*keys, "__block").orderBy(index).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    rows = rows.withColumn("__last", F.last("__value", ignorenulls=True).over(inside)).join(ends, [*keys, "__block"])
    return rows.withColumn(out, F.coalesce("__last", "__end")).drop("__block", "__value", "__last", "__end")


def accumulated(df: DataFrame, keys: list[str], index: str, value: Column, total: str, least: str, *, block: int = BLOCK) -> DataFrame:
    """``df`` with a key's sum of ``value`` up to the current row (nulls count 0), and the least such sum so far.

    Sums and least sums of blocks of the index compose, so a key with most of the rows is not one task.
    """
    rows = df.withColumns({"__acc_block": F.floor((F.col(index) - 1) / block), "__acc_value": F.coalesce(value, F.lit(0.0))})
    inside = Window.partitionBy(*keys, "__acc_block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__acc_sum", F.sum("__acc_value").over(inside)).withColumn("__acc_least", F.min("__acc_sum").over(inside))
    ends = rows.groupBy(*keys, "__acc_block").agg(F.max_by("__acc_sum", index).alias("__acc_total"), F.min("__acc_sum").alias("__acc_low"))
    before = Window.partitionBy(*keys).orderBy("__acc_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    ends = ends.withColumn("__acc_before", F.coalesce(F.sum("__acc_total").over(before), F.lit(0.0)))
    ends = ends.withColumn("__acc_lowest", F.min(F.col("__acc_before") + F.col("__acc_low")).over(before))
    rows = rows.join(ends.select(*keys, "__acc_block", "__acc_before", "__acc_lowest"), [*keys, "__acc_block"])
    rows = rows.withColumns({total: F.col("__acc_before") + F.col("__acc_sum"), least: F.least(F.col("__acc_before") + F.col("__acc_least"), "__acc_lowest")})
    return rows.drop("__acc_block", "__acc_value", "__acc_sum", "__acc_least", "__acc_before", "__acc_lowest")


def cumulated(counts: DataFrame, keys: list[str], value: str, sums: dict[str, Column], *, descending: bool = False, block: int = BLOCK) -> DataFrame:
    """``counts`` (a row for each key and distinct ``value``) with sums over a key's values up to the current one, itself included.

    Rows are numbered by key and value and summed in blocks of so many, to which the key's totals of the blocks before are
    added: a task has at most ``block`` rows, however many values a key has.  Null and NaN values come as Spark orders them.
    """
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_first()
    rows = numbered(counts.withColumns({f"__v_{n}": c for n, c in sums.items()}), *keys, order, out="__place").withColumn("__slice", F.floor((F.col("__place") - 1) / block))
    inside = Window.partitionBy(*keys, "__slice").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    rows = rows.withColumns({n: F.sum(f"__v_{n}").over(inside) for n in sums})
    ends = rows.groupBy(*keys, "__slice").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    ends = ends.select(*keys, "__slice", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums])
    rows = rows.join(ends, [*keys, "__slice"]).withColumns({n: F.col(n) + F.col(f"__b_{n}") for n in sums})
    return rows.drop("__place", "__slice", *[f"__{x}_{n}" for x in ("v", "b") for n in sums])


def assert_monotonic(df: DataFrame, index: str, ts: str, *, block: int = BLOCK) -> DataFrame:
    """``df``; an error when a row's time is before that of the row before it in index order."""
    back = F.lag(ts).over(over(index))
    sound = back.isNull() | (F.col(ts) >= back)
    rows = with_frame(df, index, 1, {"__ok": sound}, block=block)
    checked = F.assert_true(F.col("__ok"), F.concat(F.lit("time runs backward at "), F.col(index).cast("string")))
    return rows.withColumn("__ok", checked).where(F.col("__ok").isNull()).drop("__ok")
