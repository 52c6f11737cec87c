"""Vector codes and the divergence audit against plain whole-number versions."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from tidewatch.llm import divergence, vector_codes

INF, NAN = float("inf"), float("nan")


def plain_codes(rows, parts, entries=16, rounds=6):
    """{place: (code, error)} and the digest, of (id, vector) rows in order of their ids."""
    kept = [(i, v) for i, (_, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = {i: [math.floor(4096 * Fraction(x)) for x in v] for i, v in kept}
    order = sorted(ints, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    width = len(kept[0][1]) // parts
    cut = lambda i, p: ints[i][p * width : (p + 1) * width]
    books = [[cut(i, p) for i in order[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for i in ints:
                own[near(cut(i, p), books[p])[1]].append(cut(i, p))
            books[p] = [[sum(x) // len(own[e]) for x in zip(*own[e])] if e in own else c for e, c in enumerate(books[p])]
    out = {}
    for i in ints:
        found = [near(cut(i, p), books[p]) for p in range(parts)]
        out[i] = "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)
    return out, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e290])
def test_codes_equal_plain_arithmetic(spark, scale):
    pick = np.random.default_rng(4)
    rows = [(i, [float(x) * (scale if i % 7 == 0 else 1) for x in np.round(pick.normal(size=8), 2)]) for i in range(60)]
    rows += [(70, None), (71, [1.0, None, *[0.0] * 6]), (72, [NAN, *[0.0] * 7]), (73, [INF, *[0.0] * 7]), (None, [0.5] * 8), (5, rows[5][1]), (5, [0.25] * 8)]
    labels = [None if i % 5 == 0 else i % 3 for i in range(len(rows))]
    df = spark.createDataFrame([(k, v, lab, "x", "y") for (k, v), lab in zip(rows, labels)], "vec_id long, embedding array<double>, label int, code string, block string")
    got = vector_codes.compress(df.repartition(3), parts=4).collect()
    want, digest = plain_codes(rows, 4)
    long = lambda e: e if e < 1 << 63 else None
    assert Counter((r["id"], r["label"], r["code"], r["error"]) for r in got) == Counter((rows[i][0], labels[i], c, long(e)) for i, (c, e) in want.items())
    assert {r["codebooks_sha256"] for r in got} == {digest}
    for r in got:
        total = sum(e for i, (_, e) in want.items() if labels[i] == r["label"])
        assert r["label_error"] == long(total)


def test_tables_without_vectors_or_of_several_lengths(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([(1, None, 2)], kind)).collect() == []
    few = vector_codes.compress(spark.createDataFrame([(1, [0.5] * 8, None), (2, [0.25] * 8, None)], kind)).collect()
    assert {r["code"] for r in few} == {"00" * 8, "01" * 8} and all(r["label_error"] == 0 for r in few)
    for rows in ([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], [(1, [1.0] * 9, 1)]):
        with pytest.raises(ValueError):
            vector_codes.compress(spark.createDataFrame(rows, kind))


def test_sums_widen_before_they_overflow():
    big = np.full((1, 1, 1), 1 << 61)
    assert vector_codes.merged((big, np.ones((1, 1), np.int64)), (big, np.ones((1, 1), np.int64)))[0].item() == 1 << 62
    assert vector_codes.whole(np.array([-0.0001, 0.9999, 1e300])).tolist() == [-1, 4095, int(1e300) * 4096]


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_audit(rows, least, most):
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        groups.add((lang, source))
        found = TERM.findall(lower(text))
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = set()
    share = lambda c, total, v: 1 + 10**9 * (c + 2) // (total + 2 * v)
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = {g: sum(counts[g][t] for t in kept) for g in groups if g[0] == lang}
        p = {(g, t): share(counts[g][t], total[g], len(kept)) for g in total for t in kept}
        gap = lambda x, y: (x - y) ** 2 // (x + y)
        pairs = [(sum(gap(p[(lang, source), t], p[g, t]) for t in kept), g[1]) for g in total if g[1] != source]
        whole = {t: sum(counts[g][t] for g in total) for t in kept}
        q = {t: share(whole[t], sum(whole.values()), len(kept)) for t in kept}
        terms = [(gap(p[(lang, source), t], q[t]), t) for t in kept if counts[lang, source][t] and p[(lang, source), t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[: most if part == "term" else None]
            out |= {(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("least,most", [(1, 3), (3, 10), (50, 10)])
def test_audit_equals_a_plain_count(spark, least, most):
    pick = np.random.default_rng(7)
    vocabulary = ["the", "The", "cat", "Über", "über", "naïve", "x1y", "日本", "a-b", "q"]
    rows = [(["de", "en", None][i % 3], ["s1", "s2", "s3", None][pick.integers(4)], " ".join(pick.choice(vocabulary, pick.integers(0, 30)))) for i in range(120)]
    rows += [("en", "empty", None), ("en", "blank", "12 34 !"), ("fr", "alone", "the the"), ("en", "s1", "cat " * 5000), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "lang string, source string, text string, term int, cells string").repartition(5)
    got = {tuple(r) for r in divergence.audit(df, least=least, most=most).collect()}
    assert got == plain_audit(rows, least, most)


def test_audit_of_nothing_and_of_one_source(spark):
    kind = "lang string, source string, text string"
    assert divergence.audit(spark.createDataFrame([], kind)).collect() == []
    assert divergence.audit(spark.createDataFrame([("a", "b", "c c")], kind)).collect() == []
    got = divergence.audit(spark.createDataFrame([("a", "b", "c"), ("a", None, None)], kind)).collect()
    assert {(r["source"], r["part"], r["item"], r["value"]) for r in got} == {("b", "pair", "", 0), ("", "pair", "b", 0)}


def test_counts_beyond_a_double_stay_exact(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([((1 << 60) + 1, (1 << 60) + 5, 3)], "n long, total long, kept long").select(divergence.share(F.col("n"), F.col("total"), F.col("kept"))).first()
    assert row[0] == 1 + 10**9 * ((1 << 60) + 3) // ((1 << 60) + 11)


def test_tallies_count_every_pair_of_counts():
    table = np.random.default_rng(1).integers(0, 4, (300, 5))
    got = {(int(i[k]), int(j[k]), int(x[k]), int(y[k])): int(m[k]) for i, j, x, y, m in divergence.tallied(table) for k in range(len(m))}
    want = Counter((i, j, int(r[i]), int(r[j])) for r in table for i in range(5) for j in range(i + 1, 5) if r[i] and r[j])
    assert got == want
