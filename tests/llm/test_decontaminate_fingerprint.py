from __future__ import annotations

import hashlib
import itertools
import random

import brute
import pytest
from pyspark.sql import functions as F
from tidewatch.llm import decontaminate, fingerprint, queries

PICK = random.Random(8)
VOCABULARY = [f"w{i}x" for i in range(3000)]


def prose(n: int) -> list[str]:
    return [PICK.choice(VOCABULARY) for _ in range(n)]


def test_substitutions_are_tolerated_and_clean_texts_left_alone(spark):
    items = [prose(PICK.randrange(15, 60)) for _ in range(30)]
    docs, bad = [], set()
    for i in range(120):
        own = prose(80)
        if i % 3 == 0:
            passage = list(PICK.choice(items))
            for at in range(3, len(passage), 7):
                passage[at] = "other"
            own[40:40] = [w.upper() + "," for w in passage]
            bad.add(i)
        docs.append((i, " ".join(own), 1))
    docs += [(1000, None, 1), (1001, "", 1), (None, " ".join(items[0]), 1), (1002, "z " * 100_000 + " ".join(items[1]), 1), (1002, "z", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item int")
    bench = spark.createDataFrame([(k, " ".join(w), 1) for k, w in enumerate(items)] + [(99, None, 1), (98, "", 1), (97, "two words", 1)], "item_id long, text string, start int")
    found = decontaminate.find(df, bench).collect()
    assert {r["id"] for r in found} == bad | {None, 1002}
    assert all(r["equal"] >= 0.8 * (r["end"] - r["start"]) and r["end"] - r["start"] == r["item_end"] - r["item_start"] for r in found)
    assert sorted(tuple(r) for r in decontaminate.find(df, bench, sieve=20, each=7).collect() if r["id"] is not None) == sorted(tuple(r) for r in found if r["id"] is not None)
    left = decontaminate.remove(df, bench)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {d[0] for d in docs} - bad - {None}
    assert [r["text"] for r in left.where("doc_id = 1002").collect()] == ["z"]  # rows go by id and text
    assert decontaminate.find(df.where("false"), bench).count() == 0 and decontaminate.find(df, bench.where("false")).count() == 0


@pytest.mark.parametrize("n", range(1, 19))
def test_masks_survive_all_placements(n):
    """An overlap of 10 to 18 tokens with a fifth substituted, and any short item, has a seed wherever the substitutions are."""
    masks = decontaminate.masks_of(n)
    for wrong in itertools.combinations(range(1, n - 1), min(int(n * 0.2 + 1e-9), max(0, n - 2))):
        assert any(all(at + x not in wrong for x in mask) for mask in masks for at in range(n - mask[-1]))


def test_longer_overlaps_survive():
    pick = random.Random(2)
    for n in range(19, 60):
        for _ in range(300):
            wrong = set(pick.sample(range(1, n - 1), int(n * 0.2)))
            assert any(all(at + x not in wrong for x in mask) for mask in decontaminate.MASKS for at in range(n - mask[-1]))


def test_overlaps_equal_brute_force(spark):
    pick = random.Random(3)
    few = [f"t{i}" for i in range(60)]
    items = [[pick.choice(few) for _ in range(n)] for n in (1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 15, 20, 40)] * 2
    docs = []
    for i in range(60):
        passage = list(items[i % len(items)])
        for at in range(1, len(passage) - 1):
            if pick.random() < 0.22:
                passage[at] = pick.choice(few)
        a = pick.randrange(len(passage)) if pick.random() < 0.3 else 0
        docs.append((i, " ".join([pick.choice(few) for _ in range(pick.randrange(25))] + passage[a:] + [pick.choice(few) for _ in range(pick.randrange(25))])))
    docs.append((3, docs[3][1]))
    found = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k % 14, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"))
    got = sorted((r["id"], r["item"], r["start"], r["end"], r["equal"]) for r in found.collect())
    assert got == sorted((i, k % 14, *x) for i, text in docs for k, w in enumerate(items) for x in brute.overlaps(text.split(), w))


def test_all_exact_passages_are_found(spark, medium):
    from pyspark.sql import SparkSession  # noqa: F401

    rows = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{medium}/benchmark.parquet").collect()
    exact = {(d["doc_id"], b["item_id"]) for d in rows for b in items if b["text"] in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op1_decontamination(spark, medium).collect()}
    assert exact and exact <= got


def jaccard(a: str, b: str) -> float:
    def own(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    x, y = own(a), own(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints(spark, medium):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{medium}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in queries.op9_fingerprints(spark, medium).collect()}
    assert len(got) == len(docs)
    wrong, prints = [], {}
    for i, (name, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        k = len(text) // 4
        edited, r = text[: len(text) - k] + after[:k], got[name]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        wrong.append(abs(r["near_edited"] - jaccard(text, edited)))
    assert sum(wrong) / len(wrong) < 0.06


def test_fingerprint_edges(spark):
    docs = [(1, "a b c"), (2, None), (5, ""), (7, "é" * 7), (9, "w " * 60_000), (9, "w " * 60_000), (None, "left out"), (11, "a b c d e f")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n int, own int")
    rows = fingerprint.compare_edits(df).collect()
    assert sorted(r["id"] for r in rows) == [1, 2, 5, 7, 9, 9, 11]
    by = {r["id"]: r for r in rows}
    assert by[2]["near_edited"] == 1.0 and by[2]["near_next"] == 1.0 and by[5]["near_next"] == 0.0
    assert by[11]["edited_sha256"] == hashlib.sha256(("a b c d e f"[:9] + "a ").encode()).hexdigest()
    assert fingerprint.compare_edits(df.where("false")).count() == 0
    assert fingerprint.compare_edits(df.where("doc_id = 1")).first()["near_next"] == 1.0


def test_merged_and_containment(spark):
    words = [f"v{i}" for i in range(2000)]
    df = spark.createDataFrame([(" ".join(words[:1000]), " ".join(words[1000:]), " ".join(words))], "a string, b string, c string")
    for c in "abc":
        df = fingerprint.sketch(df, F.col(c), f"s{c}")
    r = df.select(fingerprint.containment(F.col("sa"), F.col("sc")).alias("inside"), fingerprint.containment(F.col("sc"), F.col("sa")).alias("half"), fingerprint.similarity(fingerprint.merged(F.array("sa", "sb")), F.col("sc")).alias("same")).first()
    assert r["inside"] == 1.0 and 0.3 < r["half"] < 0.7 and r["same"] > 0.95


def test_stock_phrases_make_no_pairs(spark, monkeypatch):
    """Random words around one phrase of eight in every text and item: no overlap, and candidates that don't grow with the product."""
    import random

    pick, found = random.Random(3), {}
    phrase = "which of the following is not true about"
    made = lambda n, length: [(i, " ".join([*(f"w{pick.getrandbits(60):x}" for _ in range(length)), phrase, *(f"w{pick.getrandbits(60):x}" for _ in range(length))])) for i in range(n)]
    keep = decontaminate.written
    monkeypatch.setattr(decontaminate, "written", lambda df, kind: found.setdefault(kind, keep(df, kind)))
    docs, items = spark.createDataFrame(made(150, 30), "doc_id long, text string"), spark.createDataFrame(made(150, 6), "item_id long, text string")
    assert decontaminate.find(docs, items).count() == 0 and found["pairs"].count() < 50
