"""Context-tree weighting against a recursion over plain dictionaries."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewatch.llm import context_tree, queries

SCHEMA = "doc_id long, text string, lang string, id string, bucket string"
TEXTS = ["the cat sat on the mat", "The  cat\tsat", "", None, "a dog, a cat; a hen", "ünïcode ünïcode", "the cat sat on the mat", "x" * 300 + " end", "zq", " \n "]


def brute(rows: list[tuple], depth: int) -> dict:
    """{place: (score, base, n_tokens, n_known)} with the training rows' counts; rows are (train, text)."""
    zeros, ones, counts = Counter(), Counter(), Counter()

    def steps(text):
        data = (text or "").encode().lower().split()
        data = b"\n" * depth + b"".join(w + b" " for w in data) + b"\n"
        for i in range(depth, len(data)):
            for k in range(8):
                yield data[i - depth : i], (k, data[i] >> (8 - k)), data[i] >> (7 - k) & 1

    for train, text in rows:
        if train:
            counts.update([*(text or "").encode().lower().split(), None])
            for context, place, bit in steps(text):
                for d in range(depth + 1):
                    (ones if bit else zeros)[context[depth - d :], place] += 1
    seen = set(zeros) | set(ones)
    children: dict = {}
    for context, place in seen:
        if context:
            children.setdefault((context[1:], place), []).append((context, place))
    own, weighted = {}, {}
    for node in sorted(seen, key=lambda n: -len(n[0])):
        a, b = zeros[node], ones[node]
        own[node] = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
        weighted[node] = own[node] if len(node[0]) == depth else np.logaddexp(math.log(0.5) + own[node], math.log(0.5) + sum(weighted[c] for c in children[node]))

    def predict(context, place, d=0):
        node = (context[depth - d :], place)
        if node not in seen:
            return None
        one = (ones[node] + 0.5) / (ones[node] + zeros[node] + 1)
        if d == depth:
            return one
        share = math.exp(math.log(0.5) + own[node] - weighted[node])
        below = predict(context, place, d + 1)
        return one if below is None else share * one + (1 - share) * below

    total, out = sum(counts.values()), {}
    for i, (_, text) in enumerate(rows):
        score = 0.0
        for context, place, bit in steps(text):
            one = predict(context, place)
            one = 0.5 if one is None else one
            score += math.log10(one if bit else 1 - one)
        found = [*(text or "").encode().lower().split(), None]
        base = sum(math.log10((counts[t] + 1) / (total + len(counts) + 1)) for t in found)
        out[i] = score, base, len(found), sum(counts[t] > 0 for t in found)
    return out


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 6])
def test_scores_equal_a_plain_recursion(spark, depth):
    rows = [(i, t, "de", "clash", "clash") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r for r in context_tree.score(df, F.col("doc_id") % 3 != 1, depth=depth).collect()}
    want = brute([(i % 3 != 1, t) for i, t in enumerate(TEXTS)], depth)
    assert set(got) == set(want)
    for i, (score, base, n, known) in want.items():
        r = got[i]
        assert (r["score"], r["base_score"]) == pytest.approx((score, base), rel=1e-9) and (r["n_tokens"], r["n_known"]) == (n, known)
        assert r["bits_per_byte"] == pytest.approx(-score * math.log2(10) / r["n_bytes"])
    assert got[0]["score"] == got[6]["score"]


def test_probabilities_of_all_next_bytes_sum_to_one(spark):
    """The last byte before the end takes every value of one byte; with the text before it these are all there is."""
    train = [(i, t, True) for i, t in enumerate(["abc abd", "abd", "abcabd ab"] * 5)]
    values = [b for b in range(33, 127) if not 65 <= b <= 90]
    asked = [(100 + b, "abc ab" + chr(b), False) for b in values]
    df = spark.createDataFrame(train + asked, "doc_id long, text string, train boolean")
    got = {r["id"]: r["score"] for r in context_tree.score(df, F.col("train"), depth=3).collect()}
    assert 0 < sum(10 ** got[100 + b] for b in values) < 10 ** max(got[100 + b] for b in values) * len(values)
    assert got[100 + ord("d")] > got[100 + ord("q")]


def test_small_chunks_and_buckets_change_nothing(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(context_tree, "ROW", 1)
    one = {r["id"]: r for r in context_tree.score(df, F.lit(True), each=10).collect()}
    two = {r["id"]: r for r in context_tree.score(df.repartition(3), F.lit(True)).collect()}
    for i in one:
        assert one[i]["score"] == pytest.approx(two[i]["score"], rel=1e-12) and one[i]["train_tokens"] == two[i]["train_tokens"]


def test_long_texts_are_cut_into_the_same_runs(monkeypatch):
    found = [context_tree.sequence(context_tree.tokens(t), 4) for t in TEXTS]
    whole = list(context_tree._chunks(iter(found), 4))
    monkeypatch.setattr(context_tree, "CHUNK", 16)
    parts = list(context_tree._chunks(iter(found), 4))
    assert len(parts) > len(whole) == 1 and (np.concatenate([p[0] for p in parts]) == whole[0][0]).all()
    per = np.zeros(len(TEXTS), int)
    for _, owner, many in parts:
        np.add.at(per, owner, many)
    assert per.tolist() == [len(x) - 4 for x in found]


def test_nothing_to_learn_from_and_nothing_at_all(spark):
    df = spark.createDataFrame([(1, "ab"), (None, None)], "doc_id long, text string")
    got = {r["id"]: r for r in context_tree.score(df, F.lit(None).cast("boolean")).collect()}
    assert got[1]["bits_per_byte"] == pytest.approx(8) and got[None]["n_tokens"] == 1 and got[1]["base_score"] == 0 and got[1]["train_tokens"] == 0
    assert context_tree.score(df.limit(0), F.lit(True)).collect() == []
    with pytest.raises(ValueError):
        context_tree.score(df, F.lit(True), depth=7)


def test_log_gamma():
    z = np.array([0.5, 1, 1.5, 2, 7.5, 100.5, 1e6, 1e12])
    assert context_tree.log_gamma(z, np.log).tolist() == pytest.approx([math.lgamma(v) for v in z], rel=1e-12, abs=1e-11)


def test_the_query_on_held_out_texts(spark, medium):
    rows = queries.QUERIES["op11_context_tree"](spark, medium).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == set(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in rows)
    counts = Counter(t for i, x in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2 for t in [*(x or "").encode().lower().split(), None])
    total = sum(counts.values())
    for r in rows[::17]:
        base = sum(math.log10((counts[t] + 1) / (total + len(counts) + 1)) for t in [*(docs[r["doc_id"]] or "").encode().lower().split(), None])
        assert r["base_score"] == pytest.approx(base) and r["train_tokens"] == total
    # 2.3 MB to learn from: a few hundredths of single words' score, which pays nothing for the letters of an unknown word
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > 1.03 * sum(r["base_score"] for r in held) and all(r["score"] < 0 for r in rows)
    assert 1 < np.average([r["bits_per_byte"] for r in held], weights=[r["n_bytes"] for r in held]) < 2.3
