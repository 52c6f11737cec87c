"""How the sources of a language differ in their terms: exact divergences from histograms of joint counts.

A pair's divergence is a sum over all kept terms, but it depends on a term only through its two counts.  So tasks tally, for
every two sources of a language, how many terms have the same two counts; cells where one source or both lack the term
follow from the sources' own histograms and the number of kept terms.  The divergence is then evaluated once for each
distinct cell and weighed by the cell's number of terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .store import small_batches, written

#: Documents of a language that a kept term is in, at least.
LEAST = 10
#: Terms reported for a group.
TERMS = 10
#: Distinct counts that a task holds before it sends them.
HELD = 250_000
#: Cells of terms by sources that are tallied at once.
CELLS = 4_000_000
_UNIT = 1_000_000_000
#: Bytes of terms, A-Z in lower case, all others blank.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, with A-Z in lower case, in UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences of a term in a group and the documents that have it."""
    words.release()
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        held.clear()
        words.trim()

    size = 0
    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"], strict=True):
            own = Counter(terms(text.as_py()))
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            n.update(own)
            docs.update(own.keys())
            size += len(n)
            if size > HELD:
                yield from flush()
                size = 0
    yield from flush()


def kept_terms(groups: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, cells): the terms in at least ``least`` documents of a language; cells are array<struct<source, n>>.

    ``groups`` has lang, source and text without nulls.
    """
    counts = groups.mapInArrow(_count_task, "lang string, source string, term string, n long, docs long")
    # dealt by language and term once, for the sums of sources and of languages
    sums = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return found.where(F.col("docs") >= least).select("lang", "term", "cells")


def tallied(counts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, x, y, m) of a matrix of terms by sources: m terms have x > 0 in source i and y > 0 in source j > i."""
    values, codes = np.unique(counts, return_inverse=True)
    codes = codes.reshape(counts.shape)
    some, many = counts > 0, len(values)
    for i in range(counts.shape[1] - 1):
        rows = np.flatnonzero(some[:, i])
        row, j = np.nonzero(some[rows, i + 1 :])
        row = rows[row]
        cell, m = np.unique((j * many + codes[row, i]) * many + codes[row, j + i + 1], return_counts=True)
        yield np.full(len(m), i), cell // (many * many) + i + 1, values[cell // many % many], values[cell % many], m


def _tally_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, x, y, m): tallies of two sources' counts, both above 0, a before b."""
    for batch in words.grouped(batches, 32 << 20):
        lang, cells = batch["lang"], batch["cells"]
        size, inner = cells.value_lengths().to_numpy(), cells.flatten()
        owner = np.repeat(np.arange(len(batch)), size)
        names, source = np.unique(inner.field("source").to_numpy(zero_copy_only=False).astype(str), return_inverse=True) if len(inner) else (np.zeros(0, str), np.zeros(0, np.int64))
        n = inner.field("n").to_numpy()
        codes = lang.dictionary_encode()
        of = codes.indices.to_numpy()
        for k, label in enumerate(codes.dictionary.to_pylist()):
            own = np.flatnonzero(of == k)
            mine = np.flatnonzero(of[owner] == k)
            here, local = np.unique(source[mine], return_inverse=True)
            row = np.searchsorted(own, owner[mine])
            step = max(1, CELLS // max(1, len(here)))
            for at in range(0, len(own), step):
                a, b = np.searchsorted(row, (at, at + step))
                table = np.zeros((min(step, len(own) - at), len(here)), np.int64)
                table[row[a:b] - at, local[a:b]] = n[mine[a:b]]
                for i, j, x, y, m in tallied(table):
                    yield pa.RecordBatch.from_arrays([pa.array([label] * len(m), pa.string()), pa.array(names[here[i]].tolist(), pa.string()), pa.array(names[here[j]].tolist(), pa.string()), pa.array(x), pa.array(y), pa.array(m.astype(np.int64))], names=["lang", "a", "b", "x", "y", "m"])


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (n + 2) / (total + 2 * kept)), in decimals: no count overflows."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", F.lit(_UNIT).cast("decimal(10,0)") * wide(n + 2), wide(total + 2 * kept)).cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)); shares are at most 10**9 + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _cells(pairs: DataFrame, kept: DataFrame, sums: DataFrame) -> DataFrame:
    """(lang, a, b, x, y, m): for every pair of sources how many kept terms have the counts x and y, zeros included."""
    cell = lambda x, y, m: F.struct(F.lit(x).cast("long").alias("x") if isinstance(x, int) else x.alias("x"), F.lit(y).cast("long").alias("y") if isinstance(y, int) else y.alias("y"), m.alias("m"))
    x, y, m = F.col("x"), F.col("y"), F.col("m")
    joint = kept.mapInArrow(_tally_task, "lang string, a string, b string, x long, y long, m long").groupBy("lang", "a", "b", "x", "y").agg(F.sum("m").alias("m"))
    own = sums.groupBy("lang", "source", F.col("n").alias("x")).agg(F.count("*").alias("m"))
    left = pairs.join(own.withColumnRenamed("source", "a"), ["lang", "a"]).select("lang", "a", "b", F.explode(F.array(cell(x, 0, m), cell(0, 0, -m))).alias("c"))
    right = pairs.join(own.withColumnRenamed("source", "b"), ["lang", "b"]).select("lang", "a", "b", F.explode(F.array(cell(0, x, m), cell(0, 0, -m))).alias("c"))
    # terms in both stand in both histograms: they leave the cells of one and come back to the empty one
    both = joint.select("lang", "a", "b", F.explode(F.array(cell(x, y, m), cell(x, 0, -m), cell(0, y, -m), cell(0, 0, m))).alias("c"))
    all_ = pairs.select("lang", "a", "b", cell(0, 0, F.col("kept")).alias("c"))
    every = all_.unionByName(left).unionByName(right).unionByName(both)
    return every.groupBy("lang", "a", "b", F.col("c.x").alias("x"), F.col("c.y").alias("y")).agg(F.sum("c.m").alias("m")).where("m > 0")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", *, least: int = LEAST, most: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of a language and a source.

    Part ``pair`` has a row for each other source of the language, its divergence from it summed over the language's kept
    terms; part ``term`` the ``most`` terms that stand out most against the whole language.  Null languages, sources and
    texts are empty; a group without terms has pairs all the same, and a language without kept terms pairs of value 0.
    Repeated rows count as often as they are there; rows need no id.  All arithmetic is in whole numbers.  A language's
    pairs grow with the square of its sources, as the result does.  Other columns are not read.
    """
    small_batches(docs.sparkSession)
    own = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    rows = docs.select(own(lang_col, "lang"), own(source_col, "source"), own(text_col, "text"))
    kept = written(kept_terms(rows, least), "terms")
    sums = kept.select("lang", "term", F.aggregate("cells", F.lit(0).cast("long"), lambda t, c: t + c["n"]).alias("every"), F.explode("cells").alias("c")).select("lang", "term", "every", "c.source", "c.n")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = sums.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["kept", "total"])
    groups = written(groups, "groups")
    wholes = groups.groupBy("lang").agg(F.sum("total").alias("whole"))

    # two rows of a language's sources make the pairs that the result lists
    a, b = groups.withColumnRenamed("source", "a"), groups.select("lang", F.col("source").alias("b"), F.col("total").alias("other"))
    pairs = written(a.join(b, "lang").where("a < b"), "pairs")
    cells = _cells(pairs, kept, sums).join(pairs, ["lang", "a", "b"])
    value = gap(share(F.col("x"), F.col("total"), F.col("kept")), share(F.col("y"), F.col("other"), F.col("kept"))) * F.col("m")
    found = cells.groupBy("lang", "a", "b").agg(F.sum(value).alias("value"))
    found = pairs.select("lang", "a", "b").join(found, ["lang", "a", "b"], "left").na.fill(0, ["value"])
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = found.select("lang", ways.alias("w"), "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value").withColumn("rank", F.row_number().over(order))

    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("every"), F.col("whole"), F.col("kept"))
    odd = sums.join(groups, ["lang", "source"]).join(wholes, "lang").select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    odd = odd.select("lang", "source", F.lit("term").alias("part"), "item", gap(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return pair.unionByName(odd)
