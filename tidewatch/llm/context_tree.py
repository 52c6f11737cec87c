"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A text is modelled as its lower-cased words, a blank after each, and an end.  A byte is eight binary choices; each of the 255
places in that decision tree has a context tree of its own, whose nodes are the last 0, 1, ... ``depth`` bytes.  A node has the
Krichevsky-Trofimov probability of the choices made there in training; its weighted probability is half that plus half the
product of its children's.  The share of a node's own estimate in its weighted probability is how much it counts in a
prediction, the rest goes down to the child of the context.  A context that training never met leaves the rest to the
deepest node that it did.

Buckets of texts send their distinct runs of ``depth + 1`` bytes, packed, with counts, to blocks of runs that share the last
bytes of context.  Nodes of long contexts are built in blocks, nodes of short ones level by level in Spark, and the log
probabilities of a bucket's runs come back to its texts.  Words are counted by the same exchange.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .blocks import packed, runs, unpacked
from .store import small_batches, written

#: Bytes of context.
DEPTH = 5
#: Bytes of text in a bucket, at least where there are so many, and the least number of buckets; blocks are as many.
EACH, BUCKETS = 16_000_000, 24
#: Bytes of text for each row of a bucket and a block: buckets grow with the root of the input, so that rows keep their size.
ROW = 1_000
#: Bytes that are cut into runs at once.
CHUNK = 1 << 21
#: Runs that a task holds before it counts them.
HELD = 1 << 24
#: Bytes of context that runs share at most less than ``depth``: with the next one, 2**24 runs share the others at most.
OWN = 2
_HALF = math.log(0.5)
#: The end of a text, in bytes and among words.
END = b"\n"
_SENT = "block int, bucket int, grams binary, n binary, words binary, m binary"


def tokens(text: str | None) -> list[bytes]:
    """Words between 0x20 and 0x09-0x0D with A-Z in lower case, and the end."""
    return [*(text or "").encode().lower().split(), END]


def sequence(found: list[bytes], depth: int) -> bytes:
    """The modelled bytes after ``depth`` bytes of context."""
    return END * depth + b" ".join(found)


def _chunks(sequences: Iterator[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(runs of depth + 1 bytes as numbers, the text of each part, the number of runs of each part); a long text has several parts."""
    held, owner, size = [], [], 0

    def cut():
        data = np.frombuffer(b"".join(held), np.uint8).astype(np.uint64)
        length = np.array([len(x) for x in held])
        found = np.zeros(len(data) - depth, np.uint64)
        for j in range(depth + 1):
            found = (found << np.uint64(8)) | data[j : j + len(found)]
        context = np.zeros(len(data), bool)
        start = np.cumsum(length) - length
        for j in range(depth):
            context[start + j] = True
        return found[~context[depth:]].view(np.int64), np.array(owner), length - depth

    for i, text in enumerate(sequences):
        for at in range(0, len(text) - depth, CHUNK):
            held.append(text[at : at + CHUNK + depth])
            owner.append(i)
            size += len(held[-1])
            if size >= CHUNK:
                yield cut()
                held, owner, size = [], [], 0
    if held:
        yield cut()


def _distinct(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct runs, their numbers in texts to learn from) of numbers whose lowest bit says whether to learn."""
    keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    found = keys >> 1
    start = runs(found)
    return found[start], np.add.reduceat(keys & 1, start) if len(start) else start


def _merged(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct runs and the sums of their numbers."""
    order = np.argsort(grams)
    grams = grams[order]
    start = runs(grams)
    return grams[start], np.add.reduceat(n[order], start) if len(start) else start


def _narrow(n: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes as the largest needs."""
    kind = np.min_scalar_type(int(n.max(initial=0)))
    return bytes([kind.itemsize]) + n.astype(kind).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _dealt(grams: np.ndarray, stem: int, many: int) -> list[np.ndarray]:
    """Places of ascending runs by the block of their last ``stem`` bytes of context."""
    ending = (grams >> 8) & ((1 << 8 * stem) - 1)
    block = (words.mix(ending.view(np.uint64)) % np.uint64(many)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    return np.split(order, np.searchsorted(block[order], np.arange(1, many)))


def _vocabulary(found: set, many: int) -> list[list[bytes]]:
    """The words of each block."""
    out: list[list[bytes]] = [[] for _ in range(many)]
    for word in found:
        out[zlib.crc32(word) % many].append(word)
    return out


def _count_task(depth: int, stem: int, many: int):
    """For each block a row of the distinct runs and words of a bucket, with their numbers in texts to learn from."""

    def run(table: pa.Table) -> pa.Table:
        words.release()
        n: Counter = Counter()
        others: set = set()
        train = np.array(table["train"].to_pylist(), bool)

        def sequences() -> Iterator[bytes]:
            for learn, text in zip(train.tolist(), table["text"], strict=True):
                found = tokens(text.as_py())
                n.update(found) if learn else others.update(found)
                yield sequence(found, depth)

        parts, size = [], 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for found, owner, length in _chunks(sequences(), depth):
            parts.append((found << 1) | np.repeat(train[owner], length))
            size += len(found)
            if size >= HELD:
                held.append(_distinct(parts))
                parts, size = [], 0
        held.append(_distinct(parts))
        del parts
        grams, count = _merged(np.concatenate([g for g, _ in held]), np.concatenate([c for _, c in held])) if len(held) > 1 else held[0]
        cut = _dealt(grams, stem, many)
        vocabulary = _vocabulary(others.union(n), many)
        out = pa.table({
            "block": pa.array(np.arange(many, dtype=np.int32)), "bucket": pa.array(np.full(many, table["bucket"][0].as_py(), np.int32)),
            "grams": pa.array([packed(grams[x].view(np.uint64)) for x in cut], pa.binary()), "n": pa.array([_narrow(count[x]) for x in cut], pa.binary()),
            "words": pa.array([b" ".join(own) for own in vocabulary], pa.binary()), "m": pa.array([_narrow(np.fromiter(map(n.__getitem__, own), np.int64, len(own))) for own in vocabulary], pa.binary()),
        })
        words.trim()
        return out

    return run


def _split(data: bytes) -> list[bytes]:
    """The words of a row; the end, a word of its own, is white space for others."""
    return data.split(b" ") if data else []


def _word_task(table: pa.Table) -> pa.Table:
    """(bucket, keys, data, total, kinds): a bucket's words in a block, the corpus' numbers of them, and on one row the block's sums."""
    words.release()
    every: Counter = Counter()
    for own, m in zip(table["words"], table["m"], strict=True):
        for word, number in zip(_split(own.as_py()), _wide(m.as_py()).tolist(), strict=True):
            every[word] += number
    data = [_narrow(np.fromiter(map(every.__getitem__, found), np.int64, len(found))) for found in (_split(own.as_py()) for own in table["words"])]
    first = np.arange(len(table)) == 0
    out = pa.table({"bucket": table["bucket"], "keys": table["words"], "data": pa.array(data, pa.binary()), "total": np.where(first, sum(every.values()), 0), "kinds": np.where(first, sum(v > 0 for v in every.values()), 0)})
    del every
    words.trim()
    return out


def _unpacked(data: bytes) -> np.ndarray:
    return unpacked(data).view(np.int64)


def _gathered(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The runs of each row, all distinct ones, and their numbers."""
    rows = [_unpacked(x.as_py()) for x in table["grams"]]
    n = [_wide(x.as_py()) for x in table["n"]]
    grams, count = _merged(np.concatenate(rows), np.concatenate(n)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return rows, grams, count


def log_gamma(z, log):
    """ln Gamma(z) for z > 0 by Stirling's series eight steps up, good to 1e-13; ``log`` makes it fit arrays and columns."""
    product, up = z, z + 8
    for i in range(1, 8):
        product = product * (z + i)
    tail = 1 / (up * up)
    series = (1 / 12 - tail * (1 / 360 - tail * (1 / 1260 - tail / 1680))) / up
    return (up - 0.5) * log(up) - up + 0.5 * math.log(2 * math.pi) + series - log(product)


def estimate(a, b, log):
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones: Gamma(a + 1/2) Gamma(b + 1/2) / (pi Gamma(a + b + 1))."""
    return log_gamma(a + 0.5, log) + log_gamma(b + 0.5, log) - math.log(math.pi) - log_gamma(a + b + 1.0, log)


class Level(NamedTuple):
    """The nodes of one depth and one bit of the byte: ascending keys (context, bits before), zeros, ones, ln estimate, ln weighted."""

    key: np.ndarray
    a: np.ndarray
    b: np.ndarray
    own: np.ndarray
    weighted: np.ndarray


def tree(grams: np.ndarray, n: np.ndarray, depth: int, stem: int) -> dict[tuple[int, int], Level]:
    """Nodes by (depth, bit) from ``depth`` down to ``stem``, of ascending distinct runs that hold whole contexts of ``stem`` bytes."""
    out: dict[tuple[int, int], Level] = {}
    code, count = grams, n
    for d in range(depth, stem - 1, -1):
        if d < depth:
            code, count = _merged(code & ((1 << 8 * (d + 1)) - 1), count)
        for k in range(8):
            key = code >> (8 - k)
            start = runs(key)
            one = (code >> (7 - k)) & 1
            b = np.add.reduceat(count * one, start) if len(start) else np.zeros(0, np.int64)
            a = (np.add.reduceat(count, start) if len(start) else b) - b
            own = estimate(a.astype(float), b.astype(float), np.log)
            weighted = own
            if d < depth:
                child = out[d + 1, k]
                place = np.searchsorted(key[start], child.key & ((1 << (8 * d + k)) - 1))
                weighted = np.logaddexp(_HALF + own, _HALF + np.bincount(place, child.weighted, len(start)))
            out[d, k] = Level(key[start], a, b, own, weighted)
    return out


def node_id(key: np.ndarray, k: int) -> np.ndarray:
    """A number for a node among those of all bits of its depth: context, then a one and the bits before."""
    return ((key >> k) << 8) | (1 << k) | (key & ((1 << k) - 1))


def _stem_task(depth: int, stem: int):
    """(block, node, a, b, weighted) of the nodes of ``stem`` bytes."""

    def run(table: pa.Table) -> pa.Table:
        words.release()
        _, grams, n = _gathered(table)
        built = [(k, level) for (d, k), level in tree(grams, n, depth, stem).items() if d == stem]
        block = np.full(sum(len(x.key) for _, x in built), table["block"][0].as_py(), np.int32)
        out = pa.table({"block": block, "node": np.concatenate([node_id(x.key, k) for k, x in built]), "a": np.concatenate([x.a for _, x in built]), "b": np.concatenate([x.b for _, x in built]), "weighted": np.concatenate([x.weighted for _, x in built])})
        words.trim()
        return out

    return run


def _went(level: Level, total, rest, last, leaf: bool):
    """What goes on from nodes to their children: the prediction of a one so far, the share that is left, and the prediction if a child was never met."""
    estimate_ = (level.b + 0.5) / (level.a + level.b + 1.0)
    last = np.where(level.a + level.b > 0, total + rest * estimate_, last)
    share = 1.0 if leaf else np.exp(_HALF + level.own - level.weighted)
    return total + rest * share * estimate_, rest * (1 - share), last


def _predict_task(depth: int, stem: int):
    """(bucket, keys, data): a bucket's runs in a block, and for each log10 of the probability of the last byte after the others."""

    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        words.release()
        rows, grams, n = _gathered(table)
        built = tree(grams, n, depth, stem)
        node = above["node"].to_numpy()
        order = np.argsort(node)
        node, state = node[order], [above[c].to_numpy()[order] for c in ("total", "rest", "last")]
        value = np.zeros(len(grams))
        for k in range(8):
            total = rest = last = keys = None
            for d in range(stem, depth + 1):
                level = built[d, k]
                if d == stem:
                    place = np.searchsorted(node, node_id(level.key, k))
                    total, rest, last = (x[place] for x in state)
                else:
                    place = np.searchsorted(keys, level.key & ((1 << (8 * (d - 1) + k)) - 1))
                    total, rest, last = total[place], rest[place], last[place]
                keys = level.key
                total, rest, last = _went(level, total, rest, last, d == depth)
            p = last[np.searchsorted(keys, grams >> (8 - k))]
            value += np.log10(np.where((grams >> (7 - k)) & 1 == 1, p, 1 - p))
        data = [value[np.searchsorted(grams, own)].tobytes() for own in rows]
        out = pa.table({"bucket": table["bucket"], "keys": table["grams"], "data": pa.array(data, pa.binary())})
        del built, rows
        words.trim()
        return out

    return run


def _plus(x: Column, y: Column) -> Column:
    """ln(e**x + e**y)"""
    return F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y)))


def _parents(children: DataFrame, d: int) -> DataFrame:
    """The nodes of ``d`` bytes from those of ``d + 1``."""
    up = children.groupBy(F.col("node").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("node")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("weighted").alias("inner"))
    return up.withColumn("own", estimate(F.col("a").cast("double"), F.col("b").cast("double"), F.ln)).select("node", "a", "b", "own", _plus(_HALF + F.col("own"), _HALF + F.col("inner")).alias("weighted"))


def _states(bottom: DataFrame, stem: int) -> DataFrame:
    """(block, node, total, rest, last): what reaches each node of ``stem`` bytes from those above; ``bottom`` has these nodes."""
    levels = {stem: bottom}
    for d in range(stem - 1, -1, -1):
        levels[d] = written(_parents(levels[d + 1], d), f"level{d}")
    state = levels[0].select("node", F.lit(0.0).alias("total"), F.lit(1.0).alias("rest"), F.lit(0.5).alias("last"))
    for d in range(stem):
        met, guess, share = F.col("a") + F.col("b") > 0, (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1.0), F.exp(_HALF + F.col("own") - F.col("weighted"))
        on = levels[d].join(state, "node").select(F.col("node").alias("up"), (F.col("total") + F.col("rest") * share * guess).alias("total"), (F.col("rest") * (1 - share)).alias("rest"), F.when(met, F.col("total") + F.col("rest") * guess).otherwise(F.col("last")).alias("last"))
        below = levels[d + 1].select(*["block"] * (d + 1 == stem), "node", F.col("node").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("up"))
        state = below.join(on, "up").drop("up")
    return state


def _score_task(depth: int):
    """Scores of a bucket's texts from what blocks say of its runs and words; the words' score lacks the corpus' size."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        words.release()
        grams, values, known = [], [], {}
        for keys, data, isword in zip(told["keys"], told["data"], told["words"].to_pylist(), strict=True):
            if isword:
                known.update(zip(_split(keys.as_py()), _wide(data.as_py()).tolist(), strict=True))
            else:
                grams.append(_unpacked(keys.as_py()))
                values.append(np.frombuffer(data.as_py()))
        place, value = pd.Index(np.concatenate(grams)), np.concatenate(values)
        del grams, values
        rows = len(table)
        n_tokens, n_known, n_bytes, base, score = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows)

        def sequences() -> Iterator[bytes]:
            for i, text in enumerate(table["text"]):
                own = tokens(text.as_py())
                c = np.fromiter(map(known.__getitem__, own), float, len(own))
                n_tokens[i], n_known[i], base[i] = len(c), (c > 0).sum(), np.log10(c + 1).sum()
                whole = sequence(own, depth)
                n_bytes[i] = len(whole) - depth
                yield whole

        for chunk, owner, length in _chunks(sequences(), depth):
            each = value[place.get_indexer(chunk)]
            np.add.at(score, owner, np.add.reduceat(each, np.cumsum(length) - length))
        out = pa.table({"id": table["id"], "n_tokens": n_tokens, "n_known": n_known, "n_bytes": n_bytes, "counted": base, "score": score})
        del place, value, known
        words.trim()
        return out

    return run


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", *, depth: int = DEPTH, each: int = EACH) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, n_bytes, base_score, score, bits_per_byte) for every row.

    The model learns from all rows where ``train`` is true (null: false) and scores all.  ``score`` is its log10 probability of
    the text, ``bits_per_byte`` the code length that follows; ``base_score`` is the sum over tokens of log10((c + 1) / (N + V +
    1)) with the counts of single tokens.  A null or empty text is its end alone, one token.  Without rows to learn from every
    choice of a bit is even.  Repeated ids and rows are texts like others; long texts are cut into runs part by part.  At most
    six bytes of context.  Other columns are not read.
    """
    if not 1 <= depth <= 6:
        raise ValueError("a run of bytes must fit a long")
    small_batches(docs.sparkSession)
    stem = max(1, depth - OWN)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    many = max(BUCKETS, int(size / max(each, (ROW * size) ** 0.5)) + 1)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(train, F.lit(False)).alias("train"), F.pmod(F.xxhash64(F.col(id_col), text, F.lit(11)), F.lit(many)).cast("int").alias("bucket"))
    sent = written(rows.groupBy("bucket").applyInArrow(_count_task(depth, stem, many), _SENT), "sent")
    counted = written(sent.select("block", "bucket", "words", "m").groupBy("block").applyInArrow(_word_task, "bucket int, keys binary, data binary, total long, kinds long"), "words")
    total, kinds = counted.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()

    grams = sent.select("block", "bucket", "grams", "n").groupBy("block")
    bottom = written(grams.applyInArrow(_stem_task(depth, stem), "block int, node long, a long, b long, weighted double"), "stem")
    values = grams.cogroup(_states(bottom, stem).groupBy("block")).applyInArrow(_predict_task(depth, stem), "bucket int, keys binary, data binary")

    told = values.withColumn("words", F.lit(False)).unionByName(counted.select("bucket", "keys", "data", F.lit(True).alias("words")))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.select("bucket", "id", "text").groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(_score_task(depth), f"id {kind}, n_tokens long, n_known long, n_bytes long, counted double, score double")
    base = F.col("counted") - F.col("n_tokens") * math.log10(total + kinds + 1)
    bits = -F.col("score") * math.log2(10) / F.col("n_bytes")
    return out.select("id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "n_bytes", base.alias("base_score"), "score", bits.alias("bits_per_byte"))
