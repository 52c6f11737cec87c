"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates.

Words are runs of letters or digits and runs of other marks; each has its lower-cased form and its shape (capitals,
digits, the mark itself).  Unigrams and bigrams of forms, uni- to trigrams of shapes and whether a word repeats the one
before it are hashed into a table of fixed
size.  A document's vector is its n-gram counts over the root of their number; the score is the sigmoid of a sparse dot
product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .language import held_out
from .store import small_batches

BITS = 20
#: Most labelled rows that a fit reads, and most bytes of their texts: the documented bounds of the sample.
FIT_ROWS = 8000
FIT_BYTES = 48 << 20
#: Bytes of texts that are scored at once.
BATCH = 4 << 20
EPOCHS = 3
_SEEDS = tuple(np.uint64(x) for x in (0x1D8E4E27C47D124F, 0x2545F4914F6CDD1D, 0x94D049BB133111EB, 0xA24BAED4963EE407, 0x9FB21C651E98DF25))
_SHAPE = np.zeros(256, np.uint8)
_SHAPE[0x30:0x3A] = 1
_SHAPE[0x41:0x5B] = 2
_SHAPE[0x61:0x7B] = 3
_SHAPE[0x80:] = 3


def _parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text in parts of about :data:`words.CHUNK` bytes that end with a separator; the last part has the rest."""
    at = 0
    while at < len(data):
        to = at + words.CHUNK
        while to < len(data):  # to the next separator
            found = np.flatnonzero(words.SPACE[data[to : to + words.CHUNK]])
            if len(found):
                to += int(found[0]) + 1
                break
            to += words.CHUNK
        yield data[at:to]
        at = to


def _runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(form, shape) of the runs of letters or digits and of other marks, in order, and each text's first."""
    one = words.runs(data, off, words.NOT_ALNUM, words.LOWER)
    two = words.runs(data, off, ~np.isin(np.arange(256), np.flatnonzero(words.NOT_ALNUM & ~words.SPACE)))
    start = np.concatenate((one[0], two[0]))
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.concatenate((one[1], two[1]))[order]
    form = np.concatenate((one[2], two[2]))[order]
    head, tail = _SHAPE[data[start]], _SHAPE[data[end - 1]]
    mark = words.NOT_ALNUM[data[start]] & ~words.SPACE[data[start]]
    shape = words.mix(np.where(mark, form, (head.astype(np.uint64) * np.uint64(4) + tail) + np.uint64(1)))
    return form, shape, np.searchsorted(start, off)


def _grams(form: np.ndarray, shape: np.ndarray, first: np.ndarray, known: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, table index) of the n-grams that end after the first ``known`` runs."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    again = np.concatenate(([False] * min(1, len(form)), form[1:] == form[:-1]))
    texts, found = [text[known:]] * 2, [words.mix(form ^ _SEEDS[0])[known:], np.where(again, _SEEDS[4], _SEEDS[3])[known:]]
    for source, k, seed in ((form, 2, _SEEDS[1]), (shape, 1, _SEEDS[2]), (shape, 2, _SEEDS[3]), (shape, 3, _SEEDS[4])):
        skip = max(0, known - k + 1)
        t, h = words.windows(source, first, k)
        texts.append(t[skip:])
        found.append(words.mix(h ^ seed)[skip:])
    return np.concatenate(texts), (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)


def features(column: pa.Array, bits: int = BITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, text number, table index) of every n-gram, chunk by chunk; a long text comes in several parts."""
    for row, off, data in words.chunks(column):
        if len(data) <= 2 * words.CHUNK:
            form, shape, first = _runs(data, off)
            yield row, len(off) - 1, *_grams(form, shape, first, 0, bits)
            continue
        for i in range(len(off) - 1):
            last = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            for part in _parts(data[off[i] : off[i + 1]]):
                form, shape, _ = _runs(part, np.array([0, len(part)]))
                form, shape = np.concatenate((last[0], form)), np.concatenate((last[1], shape))
                yield row + i, 1, *_grams(form, shape, np.array([0, len(form)]), len(last[0]), bits)
                last = form[-2:], shape[-2:]


class Model:
    """Weights of the hash table (a fixed number, whatever the corpus) and a bias."""

    def __init__(self, bits: int = BITS, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.3, l2: float = 1.0):
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.weights = np.zeros((1 << bits) + 1, np.float32)

    def fit(self, column: pa.Array, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Model:
        """One FTRL-proximal step for each row, in a fixed shuffled order, ``epochs`` times over."""
        rows = vectors(column, self.bits)
        z, n2 = np.zeros(len(self.weights)), np.zeros(len(self.weights))
        pick = np.random.default_rng(seed)

        def weight(i: np.ndarray) -> np.ndarray:
            zi = z[i]
            w = (np.sign(zi) * self.l1 - zi) / ((self.beta + np.sqrt(n2[i])) / self.alpha + self.l2)
            w[np.abs(zi) <= self.l1] = 0
            return w

        for _ in range(epochs):
            for r in pick.permutation(len(rows)):
                i, x = rows[r]
                w = weight(i)
                p = 1 / (1 + np.exp(-np.clip(float(w @ x), -35, 35)))
                g = (p - labels[r]) * x
                sigma = (np.sqrt(n2[i] + g * g) - np.sqrt(n2[i])) / self.alpha
                z[i] += g - sigma * w
                n2[i] += g * g
        self.weights = weight(np.arange(len(z))).astype(np.float32)
        return self

    def scores(self, column: pa.Array) -> np.ndarray:
        out, total = np.zeros(len(column)), np.zeros(len(column))
        for row, n, text, index in features(column, self.bits):
            total[row : row + n] += np.bincount(text, minlength=n)
            out[row : row + n] += np.bincount(text, self.weights[index], n)
        return 1 / (1 + np.exp(-np.clip(out / np.sqrt(np.maximum(1, total)) + self.weights[-1], -35, 35)))


def vectors(column: pa.Array, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(table indices, values) of every text, and the bias's 1."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for row, n, text, index in features(column, bits):
        order = np.argsort(text, kind="stable")
        cuts = np.searchsorted(text[order], np.arange(n + 1))
        index = index[order]
        for i in range(n):
            own, counts = np.unique(index[cuts[i] : cuts[i + 1]], return_counts=True)
            if row + i in held:  # another part of a long text
                own, place = np.unique(np.concatenate((held[row + i][0], own)), return_inverse=True)
                counts = np.bincount(place, np.concatenate((held[row + i][1], counts))).astype(np.int64)
            held[row + i] = own.astype(np.int32), counts
    none = np.zeros(0, np.int32), np.zeros(0, np.int64)
    return [(np.append(own, 1 << bits).astype(np.int32), np.append(counts / np.sqrt(max(1, counts.sum())), 1.0).astype(np.float32)) for own, counts in (held.get(i, none) for i in range(len(column)))]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, bits: int = BITS, epochs: int = EPOCHS) -> Model:
    """Trains on labelled rows whose ids hash lowest: at most ``fit_rows`` rows with at most ``fit_bytes`` of text.

    The driver holds no more than these; an id whose rows would pass the bounds is left out.  Null ids and null labels teach
    nothing; of repeated labels for an id the mean counts, rounded up from a half.  Without rows the model scores 0.5
    everywhere; with labels of one class alone it learns that class.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("__label"))
    lowest = [F.xxhash64("__id", F.lit(5)), F.col("__id")]
    chosen = {r["__id"]: r["__label"] for r in marks.orderBy(*lowest).limit(fit_rows).collect()}
    if not chosen:
        return Model(bits)
    spark, kind = docs.sparkSession, marks.schema["__id"].dataType

    def rows(ids: list) -> DataFrame:
        known = spark.createDataFrame([(x,) for x in ids], f"__id {kind.simpleString()}")
        return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(known), "__id")

    # at most fit_rows ids, so as many groups
    sizes = rows(list(chosen)).groupBy("__id").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("__text"), F.lit(0))).alias("bytes")).orderBy(*lowest).collect()
    taken, n, size = [], 0, 0
    for r in sizes:
        if n + r["n"] <= fit_rows and size + r["bytes"] <= fit_bytes:
            taken, n, size = [*taken, r["__id"]], n + r["n"], size + r["bytes"]
    got = rows(taken).toArrow().sort_by([("__id", "ascending"), ("__text", "ascending")])
    return Model(bits).fit(got["__text"].combine_chunks(), np.array([chosen[x] for x in got["__id"].to_pylist()], float), epochs)


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about :data:`BATCH` bytes."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH, "right")))
        yield at, to
        at = to


def score(docs: DataFrame, model: Model, text_col: str = "text", *, score_out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1; null and empty texts get the bias's score.  A column of that name is replaced.

    The broadcast model is a table of fixed size.  Texts are scored a few MB at a time and a long one in parts, so memory
    doesn't grow with the texts.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def rate(texts: pa.Array) -> pa.Array:
        words.release()
        return pa.array(np.concatenate([np.zeros(0), *[shared.value.scores(texts.slice(a, b - a)) for a, b in _pieces(texts)]]))

    return docs.drop(score_out).withColumn(score_out, rate(F.col(text_col)))


__all__ = ["Model", "features", "fit", "held_out", "score", "vectors"]
