"""Packed exchanges that tell every bucket of texts which of its hashes others have too.

Texts are dealt to buckets by a hash of their content, so every pass over a bucket sees the same rows.  A bucket sends its
distinct hashes once, truncated to a few bits more than it takes to number them all, ascending, as differences of as few
bytes as the largest needs; a row is (block of the hash space, bucket, packed hashes) and nothing else.  A block answers
each bucket with those of its hashes that are in more than one place.  Truncation can only add to the answer, so what
follows looks at whole hashes of few rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words

SENT = "block int, bucket int, data binary"
TOLD = "bucket int, data binary"
#: Hashes that a bucket holds and that a block's task sorts, on average and at least.
EACH = 2_000_000
#: Hashes of a row, on average and at least: buckets and blocks grow with the root of the input to keep it.
ROW = 64
#: Bytes of text for each hash, about.
_BYTES = 6
#: Low bits that say how many texts of a bucket have a hash, and what each number stands for: one, few, some, many.
_TIMES = 2
_CLASSES = np.array([1, 2, 8, 64])
#: Bits of a truncated hash beyond those that number all: one in so many powers of two is taken for another.
_SPARE = 8


class Layout(NamedTuple):
    buckets: int
    #: Bits of the block number, and of a truncated hash.
    bits: int
    space: int


def layout(size: int, each: int = EACH) -> Layout:
    """How to deal ``size`` bytes of text."""
    n = max(1.0, size / _BYTES)
    each = max(each, (ROW * n) ** 0.5)
    bits = max(6, int(np.ceil(np.log2(n / each))))
    return Layout(max(64, int(-(-n // each))), bits, min(56, max(bits + 8, int(np.ceil(np.log2(n))) + _SPARE)))


def bucket(columns: list[Column], plan: Layout) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit(17)), F.lit(plan.buckets)).cast("int")


def packed(values: np.ndarray) -> bytes:
    """Ascending 64-bit words as differences."""
    steps = np.diff(values, prepend=values[:1])
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return values[:1].tobytes() + bytes([width]) + steps[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if len(data) < 9:
        return np.zeros(0, np.uint64)
    width = data[8]
    n = (len(data) - 9) // width
    steps = np.zeros((n + 1, 8), np.uint8)
    steps[1:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(n, width)
    steps[0] = np.frombuffer(data, np.uint8, 8)
    return np.cumsum(steps.reshape(-1).view(np.uint64), dtype=np.uint64)


def runs(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal entries."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def slices(values: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal entries."""
    start = runs(values)
    return list(zip(start.tolist(), np.append(start, len(values))[1:].tolist(), strict=True)) if len(start) else []


def truncated(hashes: np.ndarray, plan: Layout) -> np.ndarray:
    return hashes >> np.uint64(64 - plan.space)


def sent(bucket: int, short: np.ndarray, times: np.ndarray, plan: Layout) -> pa.Table:
    """Rows of :data:`SENT` for ascending distinct truncated hashes and the numbers of texts that have them."""
    values = (short << np.uint64(_TIMES)) | (np.searchsorted(_CLASSES, times, "right") - 1).astype(np.uint64)
    number = short >> np.uint64(plan.space - plan.bits)
    cut = slices(number)
    data = [packed(values[a:b]) for a, b in cut]
    return pa.table({"block": pa.array([int(number[a]) for a, _ in cut], pa.int32()), "bucket": pa.array([bucket] * len(cut), pa.int32()), "data": pa.array(data, pa.binary())})


def common(table: pa.Table) -> pa.Table:
    """(bucket, data): of each bucket's hashes in a block those in more than one text, with how common they are: 4 log2."""
    parts = [unpacked(x.as_py()) for x in table["data"]]
    which = np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in parts])
    values = np.concatenate(parts)
    del parts
    order = np.argsort(values)
    values, which = values[order], which[order]
    del order
    short = values >> np.uint64(_TIMES)
    start = runs(short)
    total = np.add.reduceat(_CLASSES[(values & np.uint64((1 << _TIMES) - 1)).astype(np.int64)], start)
    size = np.diff(np.append(start, len(short)))
    shared = np.repeat(total > 1, size)
    rank = np.repeat(np.minimum(255, np.ceil(4 * np.log2(total))).astype(np.uint64), size)[shared]
    found, which = (short[shared] << np.uint64(8)) | rank, which[shared]
    order = np.argsort(which, kind="stable")
    found, which = found[order], which[order]
    cut, buckets = slices(which), table["bucket"].to_pylist()
    data = [packed(found[a:b]) for a, b in cut]
    words.trim()
    return pa.table({"bucket": pa.array([buckets[which[a]] for a, _ in cut], pa.int32()), "data": pa.array(data, pa.binary())})


def answered(data: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(truncated hashes, how common they are), ascending, of all answers to a bucket."""
    parts = [unpacked(x.as_py()) for x in data if x.is_valid]
    values = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    return values >> np.uint64(8), (values & np.uint64(255)).astype(np.uint8)


def located(answers: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Places of truncated hashes among the answers; -1 for those that are not there."""
    if not len(answers):
        return np.full(len(short), -1)
    at = np.minimum(np.searchsorted(answers, short), len(answers) - 1)
    at[answers[at] != short] = -1
    return at


def binary(cuts: np.ndarray, data: bytes, each: int) -> pa.Array:
    """A binary array of consecutive slices of ``data``: ``cuts`` counts entries of ``each`` bytes and ends with their number."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * each).astype(np.int32).tobytes()), pa.py_buffer(data)])


def column(table: pa.Table, name: str) -> pa.Array:
    """A text column of a bucket in one piece, nulls empty."""
    found = table[name].combine_chunks()
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    return pc.fill_null(found, "")
