"""Vector code compression: a small codebook for each part of the vectors, trained in whole numbers.

Vectors become blocks of whole numbers, one row of a NumPy matrix for each dimension.  A round assigns every part of a block
to its nearest entry, distances accumulated dimension by dimension; sums and counts of each entry's parts are tensors that
``treeAggregate`` merges through a reduction tree, so the driver gets one pair of tensors a round, of the codebooks' size.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block, at most.
BLOCK = 8192
#: Numbers below this are squared and summed in 64 bits; larger ones as Python's whole numbers.
_NARROW = 1 << 25
_LONG = (1 << 63) - 1


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite numbers, exact whatever their size."""
    with np.errstate(over="ignore"):
        found = np.floor(np.asarray(x, np.float64) * scale)
    if not found.size or np.abs(found).max() < _NARROW:
        return found.astype(np.int64)
    return np.array([math.floor(float(v) * scale) if abs(v) < 1e300 else int(v) * scale for v in x.ravel()], object).reshape(x.shape)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Dimensions by vectors."""
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1).T


def assigned(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parts by vectors) nearest entries of a block (dimensions by vectors), and their squared distances; ties to the first."""
    parts, entries, width = books.shape
    n = block.shape[1]
    kind = object if object in (block.dtype, books.dtype) else np.int64
    nearest, least = np.zeros((parts, n), np.int64), np.zeros((parts, n), kind)
    for p in range(parts):
        far = np.zeros((n, entries), kind)
        for d in range(width):
            step = block[p * width + d].astype(kind)[:, None] - books[p, :, d][None]
            far += step * step
        nearest[p] = far.argmin(1) if n else 0
        least[p] = far[np.arange(n), nearest[p]]
    return nearest, least


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a + b, as Python's whole numbers where 64 bits might not do."""
    if a.dtype != object and b.dtype != object and max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0))) >= 1 << 61:
        a = a.astype(object)
    return a + b


def summed(total: tuple, block: np.ndarray, books: np.ndarray) -> tuple:
    """``total`` (sums, counts) with a block's parts added to their entries."""
    parts, entries, width = books.shape
    nearest, _ = assigned(block, books)
    sums, counts = np.zeros((parts, entries, width), block.dtype if block.dtype == object else np.int64), np.zeros((parts, entries), np.int64)
    for p in range(parts):
        np.add.at(sums[p], nearest[p], block[p * width : (p + 1) * width].T)
        np.add.at(counts[p], nearest[p], 1)
    return merged(total, (sums, counts))


def merged(a: tuple, b: tuple) -> tuple:
    return _added(a[0], b[0]), a[1] + b[1]


def moved(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entries at the floor of their parts' means; those without parts stay."""
    used = counts > 0
    means = sums // np.maximum(counts, 1)[:, :, None]
    if means.dtype == object and max((abs(v) for v in means.ravel()), default=0) < _NARROW:
        means = means.astype(np.int64)
    return np.where(used[:, :, None], means, books)


def _block_task(scale: int):
    """Blocks (dimensions by vectors) of whole numbers in as few bytes as they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                block = whole(_matrix(batch["vector"].slice(at, BLOCK)), scale)
                if block.dtype != object:
                    block = block.astype(np.min_scalar_type(-int(np.abs(block).max(initial=1)) - 1))
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(np.ascontiguousarray(block), 5)], pa.binary())], names=["block"])

    return run


def _loaded(row) -> np.ndarray:
    block = pickle.loads(bytes(row[0]))
    return block if block.dtype == object else block.astype(np.int64)


def sound(vector: Column) -> Column:
    """Whether a vector is there and has no null, infinite or undefined component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def train(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, depth: int = 2) -> np.ndarray:
    """Codebooks (parts, entries, width) of ``vectors`` (id, vector), all sound and of one length, a multiple of ``parts``.

    The first entries are the parts of the vectors with the smallest ids (nulls last, ties by the vector); fewer vectors than
    ``entries`` make as many entries.
    """
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    books = np.stack([whole(np.array(r["vector"], float), scale).reshape(parts, -1) for r in first], 1) if first else np.zeros((parts, 0, 0), np.int64)
    if not first:
        return books
    spark = vectors.sparkSession
    blocks = written(vectors.select("vector").mapInArrow(_block_task(scale), "block binary"), "blocks").rdd.map(_loaded)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)  # of the codebooks' fixed size
        none = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        sums, counts = blocks.treeAggregate(none, lambda total, block: summed(total, block, shared.value), merged, depth)  # noqa: B023
        books = moved(books, sums, counts)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _code_task(books: np.ndarray, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest, least = assigned(whole(_matrix(batch["vector"]), scale), books)
            errors = [int(e) if e <= _LONG else None for e in least.sum(0).tolist()]
            codes = [bytes(c).hex() for c in nearest.T.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])

    return run


def compress(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) for every row with a sound vector.

    Rows whose vector is null or holds null, infinite or undefined components are dropped; vectors of different lengths, or
    of a length that ``parts`` doesn't divide, are an error.  ``code`` has two hex digits for each part, ``error`` the squared
    distances summed over parts, ``label_error`` the errors of equal labels, nulls together.  All arithmetic is exact; an
    error too large for a long is null, and so is the sum of its label.  Repeated ids are rows like others; an empty table
    has no rows.  Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits")
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label")).where(sound(F.col("vector")))
    short, long = rows.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if short != long or (short or 0) % parts:
        raise ValueError(f"vectors of {short} to {long} components can't be cut into {parts} equal parts")
    books = train(rows.select("id", "vector"), parts=parts, entries=entries, rounds=rounds, scale=scale)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    coded = written(rows.mapInArrow(_code_task(books, scale), f"id {kinds['id']}, label {kinds['label']}, code string, error long"), "codes")
    whole_ = F.count("error") == F.count("*")
    # a table of one row a label: Spark broadcasts it where it is small, and splits a hot label's rows where it is not
    sums = written(coded.groupBy(F.col("label").alias("of")).agg(F.when(whole_, F.try_sum("error")).alias("label_error")), "labels")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
