"""Sharding by Karmarkar-Karp differencing.

Every indivisible group starts as a partial partition of its own: its bytes in one part, nothing in the others.  The two
partial partitions with the largest spread are combined again and again, the largest part of one with the smallest of
the other, until one is left.  Groups are dealt to blocks of bounded size by a hash; a block's differencing leaves one
partial partition, and the blocks' partitions are differenced in turn, level by level, so no task or driver ever holds
more than :data:`BLOCK` of them.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Partial partitions differenced in one task, on average.
BLOCK = 10_000
#: Partial partitions differenced on the driver at most.
TOP = 2_000
#: Rows numbered in one task, on average.
RUN = 50_000


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combines partial partitions (rows of ``parts``; columns are their parts' sizes).

    Returns the sums of the final parts and, for every row, the final part that each of its columns went to.
    """
    n, k = parts.shape
    order0 = np.argsort(-parts, axis=1, kind="stable")
    nodes = [row[o] for row, o in zip(parts, order0, strict=True)]
    heap = [(float(v[-1] - v[0]), i) for i, v in enumerate(nodes)]
    heapq.heapify(heap)
    made = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = nodes[a] + nodes[b][::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        made.append((a, b, order))
        nodes[a] = nodes[b] = None
        nodes.append(total)
        heapq.heappush(heap, (float(total[-1] - total[0]), len(nodes) - 1))
    place: dict[int, np.ndarray] = {len(nodes) - 1: np.arange(k)}
    for i in range(len(made) - 1, -1, -1):
        a, b, order = made[i]
        own = place.pop(n + i)
        left, right = np.empty(k, np.int64), np.empty(k, np.int64)
        left[order] = own
        right[k - 1 - order] = own
        place[a], place[b] = left, right
    turns = np.empty((n, k), np.int64)
    for i in range(n):
        turns[i, order0[i]] = place[i]
    return nodes[-1], turns


def _level(parts: DataFrame, blocks: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """One round: (block, key, turn) of the partial partitions, and (key, sums) of the blocks."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("key")  # ties go by key, whatever order the rows come in
        sums = np.zeros((len(pdf), shards), np.int64)
        for i, x in enumerate(pdf["sums"]):
            sums[i, : len(x)] = x
        total, turns = difference(sums)
        width = [len(x) for x in pdf["sums"]]
        block = int(pdf["block"].iloc[0])
        rows = pd.DataFrame({"block": block, "key": pdf["key"], "turn": [t[:w].tolist() for t, w in zip(turns, width, strict=True)], "sums": None})
        return pd.concat([rows, pd.DataFrame({"block": [block], "key": [None], "turn": [None], "sums": [total.tolist()]})])

    dealt = parts.withColumn("block", F.pmod(F.xxhash64("key", F.lit(blocks)), F.lit(blocks)).cast("long"))
    done = written(dealt.groupBy("block").applyInPandas(run, "block long, key long, turn array<int>, sums array<long>"), "kk")
    return done.where("sums is null").drop("sums"), done.where("sums is not null").select(F.col("block").alias("key"), "sums")


def assign(groups: DataFrame, shards: int, *, block: int = BLOCK, top: int = TOP) -> DataFrame:
    """(key, shard) for ``groups`` of distinct ``key`` (long) and ``weight`` (long), weights of shards as even as differencing gets them."""
    spark = groups.sparkSession
    parts = groups.select("key", F.array("weight").alias("sums"))
    count, levels = groups.count(), []
    while True:
        blocks = max(1, -(-count // block))
        turned, parts = _level(parts, blocks, shards)
        levels.append(turned)
        count = blocks
        if count <= top:
            break
    left = parts.orderBy("key").collect()
    if not left:
        return groups.select("key", F.lit(0).alias("shard"))
    _, turns = difference(np.array([r["sums"] for r in left], np.int64))
    final = spark.createDataFrame([(r["key"], t.tolist()) for r, t in zip(left, turns, strict=True)], "block long, final array<int>")
    final, small = F.broadcast(final), True  # at most TOP rows of `shards` numbers
    for turned in reversed(levels):
        placed = turned.join(final, "block").select(F.col("key"), F.transform("turn", lambda t: F.get("final", t)).alias("final"))
        final = placed.withColumnRenamed("key", "block")
    return final.select(F.col("block").alias("key"), F.get("final", F.lit(0)).alias("shard"))


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", *, overhead: int = 16, block: int = BLOCK, top: int = TOP, run: int = RUN) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard and slot, by bytes, equal texts together.

    A row's size is its text's UTF-8 bytes (null: none) plus ``overhead``; null and empty texts are one group.  Groups are
    told apart by a 64-bit hash of the text, and two that share it merely stay together.  Slots count every shard's rows
    from 0 without gaps, ordered within runs by id (nulls first) and checksum; repeated rows get slots of their own.
    An empty table gives an empty result.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"))
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("weight")), "groups")
    homes = assign(groups, shards, block=block, top=top)
    # copies of one text are a hot key of the left side, which adaptive execution splits
    runs = max(16, -(-docs.count() // (shards * run)))
    placed = written(rows.join(homes, "key").withColumn("run", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(runs)).cast("int")).drop("key"), "placed")
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "run").agg(F.count("*").alias("n")).select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy("shard", "run").orderBy("id", "text_crc32")) - 1
    return placed.withColumn("slot", number).join(offsets, ["shard", "run"]).select("id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("slot") + F.col("offset")).alias("slot"))
