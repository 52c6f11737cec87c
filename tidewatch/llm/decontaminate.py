"""Benchmark decontamination by spaced seeds.

A seed's mask looks at a few of the tokens in a span and ignores the others, so a hit survives substitutions at the ignored
places.  Every mask is hashed at every token position of the test items and of the training texts.  Spark joins the hashes,
after a sieve of fixed size has dropped nearly all of the corpus's that no item has; where hashes meet, item and text are
laid side by side at that offset and the overlap around the hit is verified token by token, substitutions allowed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .store import small_batches, written

#: Places that each mask looks at.  With these every overlap of 10 to 18 tokens with at most a fifth of them substituted has a
#: hit, wherever the substitutions are; found by greedy search.  All span ten tokens or more, so a stock phrase of fewer words
#: makes none of its places in the corpus meet its places in the benchmark.
MASKS = ((0, 1, 3, 8, 9), (0, 5, 6, 7, 9), (0, 2, 3, 4, 9), (0, 1, 2, 8, 9), (0, 2, 3, 4, 10))
#: Tokens of an overlap at least; shorter items must overlap whole.
LEAST = 10
#: Share of equal tokens in an overlap at least.
SIMILAR = 0.8
#: Bits of the largest sieve: 32 MB are broadcast at most, whatever the benchmark's size.
SIEVE = 28
#: Texts that one task verifies, on average.
EACH = 500


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, token hashes, each row's first token): runs of letters and digits, in lower case."""
    lowered = pc.utf8_lower(column)
    for row, off, data in words.chunks(lowered):
        _, _, h, first = words.runs(data, off, words.NOT_ALNUM, words.LOWER)
        yield row, len(off) - 1, h, first


def seeds(hashes: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """The mask's hash at every position where it fits."""
    n = len(hashes) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, number + 1, np.uint64)
    for at in mask:
        total *= np.uint64(0xD6E8FEB86659FD93)
        total += hashes[at : at + n]
    return words.mix(total)


def masks_of(n: int, least: int = LEAST, similar: float = SIMILAR, masks=MASKS) -> tuple[tuple[int, ...], ...]:
    """The masks for an item of ``n`` tokens; for one shorter than an overlap a run that some substitutions must leave whole."""
    if n >= least:
        return masks
    wrong = int(n * (1 - similar) + 1e-9)
    return (tuple(range(math.ceil((n - wrong) / (wrong + 1)))),) if n else ()


def overlap(own: np.ndarray, h: np.ndarray, shift: int, least: int = LEAST, similar: float = SIMILAR) -> tuple[int, int, int] | None:
    """(start, end, equal tokens) in the item ``own`` of the longest sound overlap with ``h`` at this offset, if long enough.

    An overlap begins and ends with equal tokens and has at least the ``similar`` share of them.
    """
    a, b = max(0, -shift), min(len(own), len(h) - shift)
    same = own[a:b] == h[a + shift : b + shift]
    need = min(least, len(own))
    at = np.flatnonzero(same)
    if not len(at) or len(at) < similar * need - 1e-9:
        return None
    # of equal tokens i <= j the span is sound where balance[j + 1] >= balance[i]
    balance = np.concatenate(([0.0], np.cumsum(np.where(same, 1.0 - similar, -similar))))
    low = np.minimum.accumulate(balance[at])
    start = at[np.searchsorted(-low, -balance[at + 1] - 1e-9)]
    best = int(np.argmax(at - start))
    x, y = int(start[best]), int(at[best]) + 1
    return (a + x, a + y, int(same[x:y].sum())) if y - x >= need else None


def _item_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, item, tokens): an item's token hashes as one binary."""
    for batch in words.grouped(batches, words.CHUNK):
        for at, n, h, first in tokens(batch.column(2)):
            own = [h[first[i] : first[i + 1]].tobytes() for i in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(own, pa.binary())], names=["row", "item", "tokens"])


def _seed_task(least: int, similar: float, masks):
    """(hash, row, place) of every seed of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: list = list(masks)
        for batch in words.grouped(batches, words.CHUNK):
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = np.frombuffer(raw.as_py(), np.uint64)
                for mask in masks_of(len(h), least, similar, masks):
                    found = seeds(h, mask, every.index(mask) if mask in every else len(every) + len(mask))
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), row, np.int64)), pa.array(np.arange(len(found), dtype=np.int32))], names=["hash", "row", "place"])

    return run


def _bits(hashes: DataFrame, name: str, bits: int) -> np.ndarray:
    """A sieve of ``hashes``: which numbers their highest ``bits`` make."""
    top = F.shiftrightunsigned(F.col(name), 64 - bits)
    marks = hashes.groupBy(F.shiftright(top, 6).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({name}, {64 - bits}) & 63 as int))")).alias("bits"))
    got = marks.toArrow()  # at most 2 ** (bits - 6) rows
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return np.unpackbits(out.view(np.uint8), bitorder="little") if bits <= 24 else out


def _kept(sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the sieve lets pass."""
    if sieve.dtype == np.uint8:
        return sieve[(h >> np.uint64(64 - int(np.log2(len(sieve))))).astype(np.int64)] != 0
    top = h >> np.uint64(58 - int(np.log2(len(sieve))))
    return (sieve[(top >> np.uint64(6)).astype(np.int64)] >> (top & np.uint64(63))) & np.uint64(1) != 0


def _hit_task(shared, every: list):
    """(hash, key, place) of the corpus's seeds that pass the sieve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.grouped(batches, words.CHUNK):
            keys = batch.column(0).to_numpy()
            for row, _, h, first in tokens(batch.column(1)):
                for number, mask in every:
                    found = seeds(h, mask, number)
                    at = np.flatnonzero(_kept(shared.value, found))
                    text = np.searchsorted(first, at, "right") - 1
                    whole = at + mask[-1] < first[text + 1]
                    at, text = at[whole], text[whole]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(found[at].view(np.int64)), pa.array(keys[row + text]), pa.array((at - first[text]).astype(np.int32))], names=["hash", "key", "place"])

    return run


def _verify_task(least: int, similar: float, id_type: pa.DataType, item_type: pa.DataType):
    out = pa.schema([("id", id_type), ("item", item_type), *[(c, pa.int64()) for c in ("start", "end", "item_start", "item_end", "equal", "item_tokens")]])

    def run(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        words.release()
        at: dict[int, list[int]] = {}
        for i, key in enumerate(pairs["key"].to_pylist()):
            at.setdefault(key, []).append(i)
        shifts, items = pairs["shift"].to_numpy(), pairs["item"]
        rows, who, what = [], [], []
        texts = texts.combine_chunks()
        for row, n, h, first in tokens(texts["text"]):
            for i in range(n):
                found = {}
                for j in at.get(texts["key"][row + i].as_py(), ()):
                    own, shift = np.frombuffer(pairs["tokens"][j].as_py(), np.uint64), int(shifts[j])
                    got = overlap(own, h[first[i] : first[i + 1]], shift, least, similar)
                    if got:
                        found[pairs["row"][j].as_py(), got[0] + shift, got[1] + shift, *got, len(own)] = j
                for key, j in sorted(found.items()):
                    rows.append(key[1:])
                    who.append(row + i)
                    what.append(j)
        table = np.array(rows, np.int64).reshape(-1, 6)
        columns = [texts["id"].take(pa.array(who, pa.int64())), items.take(pa.array(what, pa.int64())), *[pa.array(table[:, i]) for i in range(6)]]
        words.trim()
        return pa.table(columns, schema=out)

    return run


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, least: int = LEAST, similar: float = SIMILAR, masks=MASKS, sieve: int = SIEVE, each: int = EACH) -> DataFrame:
    """(id, item, start, end, item_start, item_end, equal, item_tokens) of every verified overlap, in tokens from 0.

    An overlap has at least ``least`` tokens, or the whole item where that is shorter, and at least the ``similar`` share of
    them equal place by place; it begins and ends with equal tokens.  With the default figures every such overlap of 10 to 18
    tokens is found, and every short item; longer ones all but surely.  Null and empty texts and items overlap nothing;
    repeated items and repeated rows are found each, and two overlaps of a text with an item at different offsets are two
    rows.  Only sieves of at most ``2 ** sieve`` bits are broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_type, item_type = (pa.schema(t.select(c).limit(0).toArrow().schema)[0].type for t, c in ((docs, id_col), (benchmark, item_col)))
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    known = benchmark.where(F.col(item_text_col).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    items = written(known.mapInArrow(_item_task, f"row long, item {kinds[1]}, tokens binary"), "items")
    planted = written(items.select("row", "tokens").mapInArrow(_seed_task(least, similar, masks), "hash long, row long, place int"), "seeds")
    size = planted.count()
    rows = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # masks of short items only where there are such
    lengths = {r[0] for r in items.select((F.octet_length("tokens") / 8).cast("int")).where(F.octet_length("tokens") < 8 * least).distinct().collect()}
    short = {m for n in lengths for m in masks_of(n, least, similar, masks)}
    every = [*enumerate(masks), *[(len(masks) + len(m), m) for m in sorted(short) if m not in masks]]
    bits = min(sieve, max(20, int(size).bit_length() + 14))
    shared = spark.sparkContext.broadcast(_bits(planted, "hash", bits))
    hits = rows.select("key", "text").mapInArrow(_hit_task(shared, every), "hash long, key long, place int")
    pairs = hits.join(planted.withColumnRenamed("place", "item_place"), "hash").select("key", "row", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    pairs = written(pairs, "pairs")
    texts = pairs.agg(F.approx_count_distinct("key")).first()[0]
    chosen = spark.sparkContext.broadcast(_bits(pairs, "key", min(sieve, max(20, int(texts).bit_length() + 10))))

    @F.arrow_udf("boolean")
    def wanted(keys: pa.Array) -> pa.Array:
        return pa.array(_kept(chosen.value, keys.to_numpy(zero_copy_only=False).view(np.uint64)))

    part = F.pmod(F.col("key"), F.lit(max(64, -(-texts // each)))).cast("int").alias("part")
    left = rows.where(wanted(F.col("key"))).select(part, "key", "id", "text")
    right = pairs.join(items, "row").select(part, "key", "row", "shift", "item", "tokens")
    schema = f"id {kinds[0]}, item {kinds[1]}, start long, end long, item_start long, item_end long, equal long, item_tokens long"
    return left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(_verify_task(least, similar, id_type, item_type), schema)


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that have a verified overlap, found by id and text; rows with a null text stay."""
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    marked = docs.withColumn("__key", key)
    bad = find(marked, benchmark, "__key", text_col, **options).select(F.col("id").alias("__bad")).distinct()
    return marked.join(bad, F.col("__key") == F.col("__bad"), "left_anti").drop("__key")
