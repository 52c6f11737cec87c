"""Language identification by rank-order n-gram profiles.

A profile is a language's :data:`RANKS` most frequent letter 1- to 3-grams, best first.  A document's own most frequent
n-grams are compared with each profile by the out-of-place distance: the sum, over the document's n-grams, of how far
each stands from its place in the profile, or the full profile length where the profile lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .store import small_batches

RANKS = 400
#: Labelled rows of each language that a fit reads on average, the documented bound of the sample; rows are taken by a hash of their id.
FIT_ROWS = 4000
UNKNOWN = "und"
#: Characters of a text that are counted at once.
LONG = 1 << 20
#: Stands for a blank in an n-gram's number: no character has it, so n-grams of different lengths differ.
_BLANK = 0x110000
_state: dict = {}


def _letters() -> np.ndarray:
    if "letters" not in _state:
        _state["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _state["letters"]


def grams(text: str) -> np.ndarray:
    """All 1- to 3-grams of the lower-cased words, as integers; a word is padded by one blank on each side."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(_letters()[points], points, 0)
    points = np.concatenate(([0], points, [0]))
    keep = points != 0
    keep[1:] |= points[:-1] != 0
    keep[0] = True
    points = points[keep]
    if not points.any():
        return np.zeros(0, np.int64)
    if points[-1] != 0:
        points = np.append(points, 0)
    p = np.where(points == 0, _BLANK, points)
    two = (p[:-1] << 21) | p[1:]
    three = ((p[:-2] << 42) | (p[1:-1] << 21) | p[2:])[points[1:-1] != 0]
    return np.concatenate((points[points != 0], two, three))


def ranked(counts: np.ndarray, values: np.ndarray, most: int) -> np.ndarray:
    """The most frequent of ascending ``values``, ties by value."""
    order = np.sort(((np.int64(1) << 31) - counts << np.int64(31)) + np.arange(len(values)))[:most]
    return values[order & ((1 << 31) - 1)]


def counted(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = np.sort(found)
    at = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else np.zeros(0, np.int64)
    return found[at], np.diff(np.append(at, len(found)))


def tallied(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct n-grams and their counts; a long text is cut between words and its parts are summed."""
    if len(text) <= LONG:
        return counted(grams(text))
    parts, at = [], 0
    while at < len(text):
        to = min(at + LONG, len(text))
        while to < len(text) and text[to].isalpha():
            to += 1
        parts.append(counted(grams(text[at:to])))
        at = to
    values, inverse = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    return values, np.bincount(inverse, np.concatenate([c for _, c in parts]), len(values)).astype(np.int64)


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language; kept sums go out when they grow large, and at the end."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            values, inverse = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
            sums = np.bincount(inverse, np.concatenate([c for _, c in parts])).astype(np.int64)
            yield pa.record_batch({"lang": pa.array([lang] * len(values), pa.string()), "gram": values, "n": sums})
        held.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
            part = tallied(text.as_py())
            held.setdefault(lang, []).append(part)
            size += len(part[0])
            if size > 1_000_000:
                yield from flush()
                size = 0
    yield from flush()


class Profiles:
    """Rank tables of all languages: for each n-gram, the languages that rank it and its places there.

    They take 16 bytes for each n-gram of a profile at most, so some 6 KB for each language, whatever the corpus.
    """

    def __init__(self, ordered: dict[str, list[int]], ranks: int = RANKS):
        self.langs = sorted(ordered)
        self.ranks = ranks
        every = np.concatenate([np.zeros(0, np.int64), *[np.asarray(ordered[x], np.int64) for x in self.langs]])
        sizes = [len(ordered[x]) for x in self.langs]
        order = np.argsort(every, kind="stable")
        self.lang = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        self.place = np.concatenate([np.zeros(0, np.int32), *[np.arange(n, dtype=np.int32) for n in sizes]])[order]
        self.grams, self.first = np.unique(every[order], return_index=True)
        self.last = np.append(self.first[1:], len(every))

    def distances(self, top: np.ndarray) -> np.ndarray:
        """Out-of-place distance of ranked n-grams to every language; an n-gram that a profile lacks is its full length off."""
        far = np.full(len(self.langs), self.ranks * len(top), np.int64)
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        mine = np.flatnonzero(self.grams[at] == top)
        first, size = self.first[at[mine]], (self.last - self.first)[at[mine]]
        rows = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())  # the n-grams' own rows, one after the other
        near = self.ranks - np.abs(self.place[rows] - np.repeat(mine, size))
        return far - np.bincount(self.lang[rows], near, len(far)).astype(np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Nearest language, and its distance's margin over the second (over the largest possible where it is alone)."""
        values, counts = tallied(text or "")
        if not len(values) or not self.langs:
            return UNKNOWN, 0.0
        top = ranked(counts, values, self.ranks)
        far = self.distances(top)
        best = int(far.argmin())
        second = int(np.delete(far, best).min()) if len(far) > 1 else self.ranks * len(top)
        return self.langs[best], 1.0 - far[best] / second if second else 0.0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, fit_rows: int = FIT_ROWS, ranks: int = RANKS) -> Profiles:
    """Profiles of all languages, from the rows with a text and a language.

    Of a language with more than ``fit_rows`` rows a sample of about that many is read, chosen by a hash of the id; null
    ids count as one id.  The driver gets a row for each language and ``ranks`` for its profile.  Empty input gives no profiles, and then every prediction is ``und``.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Profiles({}, ranks)
    place = F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(7)), 11) / float(1 << 53)
    large = {lang: fit_rows / n for lang, n in sizes.items() if n > fit_rows}
    kept = F.lit(1.0)
    if large:
        shares = docs.sparkSession.createDataFrame(list(large.items()), "lang string, share double")  # a row for each such language
        rows, kept = rows.join(F.broadcast(shares), "lang", "left"), F.coalesce("share", F.lit(1.0))
    sample = rows.where(place <= kept).select("lang", "text")
    sums = sample.mapInArrow(_count_task, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ordered: dict[str, list[int]] = {}
    for r in sums.withColumn("place", F.row_number().over(best)).where(F.col("place") <= ranks).orderBy("lang", "place").collect():
        ordered.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ordered, ranks)


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text", *, lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and a score from 0 to 1; null texts and texts without a letter are ``und``, 0.

    Columns of those names in the input are replaced.  Whole texts are read, whatever their length.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.arrow_udf("lang string, score double")
    def guess(texts: pa.Array) -> pa.Array:
        words.release()
        found = [shared.value.predict(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["lang", "score"])

    # not to be evaluated again for a filter on what it predicts
    out = docs.drop(lang_out, score_out).withColumn("__guess", guess.asNondeterministic()(F.col(text_col)))
    return out.withColumns({lang_out: F.col("__guess.lang"), score_out: F.col("__guess.score")}).drop("__guess")


def lettered(text: F.Column) -> F.Column:
    """Whether a text has a letter; those without have no language."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a row is kept from learning: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
