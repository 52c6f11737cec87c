"""Removal of word windows that an earlier document has too.

Every window of ``k`` consecutive words gets a Rabin-Karp hash.  Buckets of documents exchange truncated hashes (see
:mod:`blocks`) and learn which of their windows may repeat.  Those few are hashed with a second seed as well: where both
hashes, 96 bits, agree, all documents but the one of the smallest id are told the places.  A document's repeated windows
merge into maximal intervals of words, which go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, words
from .store import small_batches

WINDOW = 13
_LAST = (1 << 63) - 1
_ENTRY = np.dtype([("one", "<u8"), ("two", "<u4"), ("id", "<i8"), ("row", "<u4"), ("word", "<u4")])
_PLACE = np.dtype([("row", "<u4"), ("word", "<u4")])
_SENT = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])
_TOLD = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_OUT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", _SPANS), ("kept", pa.string())])


def _ordered(table: pa.Table) -> pa.Table:
    """A bucket's rows in the same order in every pass."""
    return table.take(pc.sort_indices(table, sort_keys=[("key", "ascending"), ("text", "ascending")]))


def _sieve_task(k: int, plan: blocks.Layout):
    """Sends a bucket's truncated hashes, and whether more than one of its documents has them."""

    def run(table: pa.Table) -> pa.Table:
        words.release()
        _, rank = np.unique(table["key"].to_numpy(), return_inverse=True)
        found, own = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for row, off, data in words.chunks(blocks.column(table, "text")):
            _, _, h, first = words.runs(data, off)
            t, w = words.windows(h, first, k)
            found.append(blocks.truncated(w, plan))
            own.append(rank[t + row].astype(np.int32))
        found, own = np.concatenate(found), np.concatenate(own)
        order = np.argsort(found)
        found, own = found[order], own[order]
        start = blocks.runs(found)
        several = np.minimum.reduceat(own, start) < np.maximum.reduceat(own, start) if len(start) else np.zeros(0, bool)
        out = blocks.sent(table["bucket"][0].as_py(), found[start], 1 + several, plan)
        words.trim()
        return out

    return run


def _window_task(k: int, plan: blocks.Layout):
    """Entries of the windows that may repeat, of a bucket's first document with each; later ones are told at once.

    Told rows go along as blocks beyond the hash space.
    """

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        words.release()
        if not len(table) or not len(answers):
            return _SENT.empty_table()
        bucket = table["bucket"][0].as_py()
        table = _ordered(table)
        keys = table["key"].to_numpy()
        known, _ = blocks.answered(answers["data"])
        parts = [np.zeros(0, _ENTRY)]
        for row, off, data in words.chunks(blocks.column(table, "text")):
            start, end, first = words.places(data, off)
            t, w = words.windows(words.hashes(data, start, end), first, k)
            hit = np.flatnonzero(blocks.located(known, blocks.truncated(w, plan)) >= 0)
            if not len(hit):
                continue
            part = np.zeros(len(hit), _ENTRY)
            part["one"] = w[hit]
            part["two"] = words.windows(words.hashes(data, start, end, seed=1), first, k)[1][hit] >> np.uint64(32)
            part["row"] = t[hit] + row
            part["id"] = keys[part["row"]]
            part["word"] = hit - np.searchsorted(t, t[hit])
            parts.append(part)
        found = np.concatenate(parts)
        del parts, table
        order = np.lexsort((found["id"], found["two"], found["one"]))
        late = np.zeros(len(found), bool)
        late[order] = _late(found[order])
        local, found = found[late], found[~late]
        number = (found["one"] >> np.uint64(64 - plan.bits)).astype(np.int32)
        order = np.argsort(number, kind="stable")
        found, number = found[order], number[order]
        rows = [(int(number[a]), _columns(found[a:b])) for a, b in blocks.slices(number)]
        if len(local):
            rows.append(((1 << plan.bits) + bucket % (1 << plan.bits), _places(local)))
        words.trim()
        return pa.table([pa.array([x for x, _ in rows], pa.int32()), pa.array([bucket] * len(rows), pa.int32()), pa.array([x for _, x in rows], pa.binary())], schema=_SENT)

    return run


def _late(found: np.ndarray) -> np.ndarray:
    """Of entries by hashes and id, those with a larger id than the first of their hashes."""
    if not len(found):
        return np.zeros(0, bool)
    start = np.flatnonzero(np.concatenate(([True], (found["one"][1:] != found["one"][:-1]) | (found["two"][1:] != found["two"][:-1]))))
    return found["id"] > np.repeat(found["id"][start], np.diff(np.append(start, len(found))))


def _columns(found: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(found[c]).tobytes() for c in _ENTRY.names)


def _entries(data: bytes) -> np.ndarray:
    out, at = np.zeros(len(data) // _ENTRY.itemsize, _ENTRY), 0
    for c in _ENTRY.names:
        out[c] = np.frombuffer(data, _ENTRY[c], len(out), at)
        at += len(out) * _ENTRY[c].itemsize
    return out


def _places(found: np.ndarray) -> bytes:
    out = np.zeros(len(found), _PLACE)
    out["row"], out["word"] = found["row"], found["word"]
    return out.tobytes()


def _owner_task(plan: blocks.Layout):
    """(bucket, places) of the windows that a document of a smaller id has too."""

    def run(table: pa.Table) -> pa.Table:
        if table["block"][0].as_py() >= 1 << plan.bits:
            return table.select(["bucket", "data"])
        parts = [_entries(x.as_py()) for x in table["data"]]
        bucket = np.repeat(table["bucket"].to_numpy(), [len(x) for x in parts])
        found = np.concatenate(parts)
        del parts
        order = np.lexsort((found["id"], found["two"], found["one"]))
        late = order[_late(found[order])]
        late = late[np.argsort(bucket[late], kind="stable")]
        cut = blocks.slices(bucket[late])
        out = pa.table([pa.array([int(bucket[late[a]]) for a, _ in cut], pa.int32()), pa.array([_places(found[late[a:b]]) for a, b in cut], pa.binary())], schema=_TOLD)
        words.trim()
        return out

    return run


def _cut_task(k: int):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        words.release()
        table = _ordered(table)
        places = np.concatenate([np.zeros(0, _PLACE), *[np.frombuffer(x.as_py(), _PLACE) for x in told["data"]]])
        places = places[np.argsort(places["row"], kind="stable")]
        first = np.searchsorted(places["row"], np.arange(len(table) + 1))
        n_words, removed, spans, kept = [], [], [], []
        for i, text in enumerate(table["text"]):
            own = text.as_py().encode().split()
            n_words.append(len(own))
            hit = places["word"][first[i] : first[i + 1]]
            if not len(hit):
                removed.append(0)
                spans.append([])
                kept.append(b" ".join(own).decode())
                continue
            cover = np.bincount(hit, minlength=len(own) + 1) - np.bincount(hit + k, minlength=len(own) + 1)
            gone = np.cumsum(cover[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
            removed.append(int(gone.sum()))
            kept.append(b" ".join([w for w, g in zip(own, gone.tolist(), strict=True) if not g]).decode())
        out = pa.table([table["key"], pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.string())], schema=_OUT)
        words.trim()
        return out

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = WINDOW, each: int = blocks.EACH) -> DataFrame:
    """(id, n_words, n_removed, spans, kept) for every row: words covered by a window that a smaller id has too are removed.

    Words lie between 0x20 and 0x09-0x0D; ``spans`` are maximal [start, end) word intervals of the input, ``kept`` the other
    words joined by one space.  Null and empty texts have no words; texts shorter than a window lose none.  Ids are whole
    numbers; rows that share one are one document and don't repeat each other; a null id is larger than all others.  Windows
    count as equal by 96 bits of two independent hashes: among 10**13 windows two different ones agree with a probability
    under 10**-3.  The texts are exchanged once, for three passes.  Other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    key, text = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    plan = blocks.layout(size, each)
    rows = docs.select(blocks.bucket([key, text], plan).alias("bucket"), key.alias("key"), text.alias("text"))
    sieved = rows.groupBy("bucket").applyInArrow(_sieve_task(k, plan), blocks.SENT)
    answers = sieved.groupBy("block").applyInArrow(blocks.common, blocks.TOLD)
    found = rows.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_window_task(k, plan), blocks.SENT)
    told = found.groupBy("block").applyInArrow(_owner_task(plan), blocks.TOLD)
    out = rows.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(_cut_task(k), "id long, n_words long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept string")
    return out.withColumn("id", F.when(F.col("id") != _LAST, F.col("id")).cast(kind))
