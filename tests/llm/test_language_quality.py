from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from brute import held_out
from tidewatch.llm import language, quality, queries, words


def test_language_on_held_out_rows(spark, medium):
    got = queries.op10_language(spark, medium).join(spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000 and all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    test = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in test) >= 0.97 * len(test)


def test_language_learns_nothing_from_held_out_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    a = language.fit(docs.where(~language.held_out()))
    b = language.fit(docs.withColumn("lang", F.when(language.held_out(), "xx").otherwise(F.col("lang"))).where(~language.held_out()))
    assert a.langs == b.langs and (a.grams == b.grams).all() and (a.place == b.place).all()


def test_language_equals_brute_force(spark, medium):
    """Profiles, out-of-place distances and scores against plain counting, with rows of all lengths."""
    table = spark.read.parquet(f"{medium}/documents.parquet")
    rows = [r.asDict() for r in table.select("doc_id", "text", "lang").collect()]
    known = [r for r in rows if not held_out(r["doc_id"]) and r["text"] is not None and r["lang"] is not None]
    profiles = {}
    for lang in sorted({r["lang"] for r in known}):
        counts = Counter(g for r in known if r["lang"] == lang for g in brute.grams(r["text"]))
        profiles[lang] = brute.ranked(counts, language.RANKS)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op10_language(spark, medium).collect()}
    for r in rows[:400]:
        lang, score = brute.language(r["text"], profiles, language.RANKS)
        assert got[r["doc_id"]][0] == lang and got[r["doc_id"]][1] == pytest.approx(score)


def test_language_learns_all_languages(spark):
    """More languages than any table of a fixed size, each of one text of its own letters, and some that share letters."""
    own = lambda i: f"{chr(0x4E00 + i)}{chr(0x4E00 + i + 1)} {chr(0x4E00 + i)}"
    docs = spark.createDataFrame([(i, own(2 * i), f"l{i}") for i in range(1500)] + [(9, "the cat", "en")] * 3, "doc_id long, text string, lang string")
    profiles = language.fit(docs, fit_rows=2)
    assert len(profiles.langs) >= 1500
    got = language.predict(docs.where("lang <> 'en'"), profiles)
    assert got.where("lang_pred <> lang").count() == 0
    plain = {lang: [] for lang in profiles.langs}
    for lang, at in zip(profiles.lang, range(len(profiles.lang)), strict=True):
        plain[profiles.langs[lang]].append((int(profiles.place[at]), int(profiles.grams[np.searchsorted(profiles.first, at, "right") - 1])))
    top = language.ranked(*language.tallied(own(6) + " cat")[::-1], profiles.ranks)
    for lang, far in zip(profiles.langs, profiles.distances(top), strict=True):
        place = {g: p for p, g in plain[lang]}
        assert far == sum(abs(place[g] - i) if g in place else profiles.ranks for i, g in enumerate(top.tolist()))


def test_language_edges(spark):
    kind = "doc_id long, text string, lang string, lang_pred string"
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", "?"), (2, "le chat et le chien", "fr", "?"), (3, None, "en", "?"), (4, "", None, "?"), (5, "12 34 --", "en", "?"), (None, "the dog", None, "?"), (1, "the cat", "en", "?"), (6, "x" * 200_000, None, "?")], kind)
    out = language.predict(docs, language.fit(docs))
    got = [(r["doc_id"], r["lang_pred"]) for r in out.collect()]
    assert len(got) == 8 and {(3, "und"), (4, "und"), (5, "und"), (1, "en"), (2, "fr"), (None, "en")} <= set(got)
    empty = docs.where("false")
    assert language.predict(empty, language.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, language.fit(empty)).collect()} == {"und"}


def test_quality_on_held_out_rows(spark, medium):
    got = queries.op7_quality(spark, medium)
    rows = got.join(spark.read.parquet(f"{medium}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert got.count() == 1000 and auc >= 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_fit_equals_plain_ftrl(spark):
    """Weights against a plain follow-the-regularised-leader over dictionaries, rows in the same order."""
    pick = random.Random(4)
    texts = [" ".join(pick.choice(["good", "fine", "bad", "BUY", "now!!", "12"]) for _ in range(pick.randrange(1, 30))) for _ in range(80)]
    labels = np.array([float("BUY" not in t) for t in texts])
    model = quality.Model(12).fit(pa.array(texts), labels, epochs=2)
    rows = [dict(zip(i.tolist(), x.tolist(), strict=True)) for i, x in quality.vectors(pa.array(texts), 12)]
    z, n = Counter(), Counter()

    def weight(i: int) -> float:
        if abs(z[i]) <= model.l1:
            return 0.0
        return (math.copysign(model.l1, z[i]) - z[i]) / ((model.beta + math.sqrt(n[i])) / model.alpha + model.l2)

    order = np.random.default_rng(11)
    for _ in range(2):
        for r in order.permutation(len(rows)):
            w = {i: weight(i) for i in rows[r]}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in rows[r].items())))
            for i, x in rows[r].items():
                g = (p - labels[r]) * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / model.alpha * w[i]
                n[i] += g * g
    assert model.weights == pytest.approx([weight(i) for i in range(len(model.weights))], abs=1e-5) and (model.weights != 0).sum() > 20


def test_vectors_count_every_gram():
    """Counts of n-grams are those of a plain count, and a text in parts has those of the whole."""
    texts = ["One two two, THREE!! 4x", "", "a b " * 700 + "é-ü"]
    for text, (index, value) in zip(texts, quality.vectors(pa.array(texts), 16), strict=True):
        own = brute.quality_grams(text)
        assert len(index) - 1 <= len(own) and value[:-1] @ value[:-1] * sum(own.values()) >= sum(v * v for v in own.values()) - 1e-3
        assert (value[:-1] * math.sqrt(max(1, sum(own.values())))).sum() == pytest.approx(sum(own.values()))
    long = " ".join(random.Random(1).choices(["alpha", "beta,", "Gamma", "7", "--"], k=1_200_000))
    parts = Counter()
    for _, _, _, index in quality.features(pa.array([long])):
        parts.update(index.tolist())
    form, shape, first = quality._runs(np.frombuffer(long.encode(), np.uint8), np.array([0, len(long)]))
    whole = quality._grams(form, shape, first, 0, quality.BITS)[1]
    assert len(long) > 2 * words.CHUNK and parts == Counter(whole.tolist())


def test_fit_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, "word " * (10 if i else 100_000)) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    model = quality.fit(docs, labels, fit_bytes=2_000)
    assert model.weights.any() and (model.weights == quality.fit(docs.where("doc_id > 0"), labels.where("doc_id > 0"), fit_bytes=2_000).weights).all()
    one = quality.fit(docs.where("doc_id > 0"), labels.withColumn("quality", F.lit(1)))
    assert all(r["score"] > 0.5 for r in quality.score(docs, one).collect())


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "a fine text", 0.5), (2, None, 0.5), (3, "", 0.5), (4, "BUY!! NOW!!", 0.5), (4, "BUY!! NOW!!", 0.5), (None, "z" * 300_000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 0), (4, None), (None, 1), (9, 1)], "doc_id long, quality int")
    scored = quality.score(docs, quality.fit(docs, labels))
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert scored.count() == 6 and all(0 <= s <= 1 for s in got.values()) and got[2] == got[3] and got[1] > got[4]
    none = quality.fit(docs.where("false"), labels.where("false"))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.where("false"), none).count() == 0
