"""Vectorised word hashing over Arrow string columns.

A column's UTF-8 bytes are cut into runs by a byte table.  A run's hash takes its bytes eight at a time through a chain of
bijections of 64-bit words (a digest, where a run is very long), so words of up to eight bytes of one length never share a
hash and longer ones only by chance.  Two seeds give independent hashes.  Work goes in chunks of about :data:`CHUNK` bytes,
so temporary arrays stay small whatever the batch holds; a text is never cut.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Where the chains of the two hash functions begin.
SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Steps of eight bytes after which a run is digested by itself.
STEPS = 64

#: Bytes that part words: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything but ASCII letters and digits and the bytes of other scripts.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 0x20

def trim() -> None:
    """Gives freed memory back to the system: workers live on and other tasks need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: What tasks keep for later tasks of their kind in the same worker; a task of another kind lets it go.
kept: dict = {}


def release() -> None:
    if kept:
        kept.clear()
        trim()


def grouped(batches: Iterator[pa.RecordBatch], limit: int, *, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches joined to about ``limit`` bytes; memory is given back at the end, and before, unless told to ``keep``, what others keep."""
    if not keep:
        release()
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    trim()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, text offsets from 0, bytes) of runs of whole texts; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    rows = len(column)
    if not rows:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + rows + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < rows:
        to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
        to = min(max(to, at + 1), rows)
        yield at, off[at : to + 1] - off[at], raw[off[at] : off[to]]
        at = to


def runs(data: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE, fold: np.ndarray = SAME) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the runs between separators, and each text's first run (one more entry than texts)."""
    start, end, first = places(data, off, separators)
    return start, end, hashes(data, start, end, fold), first


def places(data: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of the runs between separators, and each text's first run (one more entry than texts)."""
    inside = ~separators[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = off[1:] > off[:-1]
    first, last = off[:-1][full], off[1:][full] - 1
    begins[first] = inside[first]
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, off)


#: The low bytes of a word of eight, by their number.
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray = SAME, seed: int = 0) -> np.ndarray:
    """Hashes of the byte ranges, every byte replaced by its ``fold``; a hash doesn't depend on where its range lies."""
    n = len(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data if fold is SAME else fold[data]
    eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    length = end - start
    out = mix((eight[start] & _LOW[np.minimum(length, 8)]) ^ (length.astype(np.uint64) * _STEP + SEEDS[seed]))
    rows = np.flatnonzero(length > 8)
    for step in range(1, STEPS):
        if not len(rows):
            return out
        left = length[rows] - 8 * step
        out[rows] = mix(out[rows] ^ (eight[start[rows] + 8 * step] & _LOW[np.minimum(left, 8)]))
        rows = rows[left > 8]
    for i in rows.tolist():
        own = hashlib.blake2b(padded[start[i] : end[i]], digest_size=8, salt=SEEDS[seed].tobytes())
        out[i] = np.frombuffer(own.digest(), np.uint64)[0]
    return out


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    """The step to the powers 0 to n - 1 in 64 bits, or its inverse."""
    step = np.uint64(pow(int(_STEP), -1, 1 << 64)) if inverse else _STEP
    steps = np.full(n, step)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hashes of all runs of ``k`` consecutive entries, polynomials in 64-bit arithmetic, spread by a bijection.

    The polynomial of the entries so far is taken at the step's inverse, so every window is a difference of two of its values
    times a power: a step from a window to the next one costs the same whatever ``k`` is.  The entries are spread words, not
    bytes, and the step is odd, so two windows that differ in one entry never agree and others by chance.
    """
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    upto = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _powers(len(hashes), inverse=True), out=upto[1:])
    return mix((upto[k:] - upto[:-k]) * _powers(n + k - 1)[k - 1 :])


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the windows of ``k`` words that lie in one text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found = rolling(hashes, k)
    whole = text[: len(found)] == text[k - 1 :] if len(found) else np.zeros(0, bool)
    return text[: len(found)][whole], found[whole]
