from __future__ import annotations

import hashlib
import random

import brute
from pyspark.sql import functions as F
from tidewatch.llm import pii, queries


def shown(spans) -> list[tuple]:
    return [(pii.KINDS[s["rank"]], s["start"], s["end"]) for s in spans]


def test_base_spans_equal_brute_force(spark):
    pick = random.Random(5)
    parts = ["a@b.c", "x.y+z@mail.example.com", "@", ".", "_d@e.f", "1.2.3.4", "300.1.1.1", "001.002.003.0004", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "1 2 3", "12345678901234567890", "+1 (017) 555-7713", "+1", "+123456789012345678", "++49 30 1234567", "é", " ", "\n", "word", "-", "%", "9", "+", "(", ")", "日本"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randrange(14))) for _ in range(1500)] + [None, "", "9" * 50_000, "1 " * 30_000, "a." * 40_000 + "@b.c", "+" + "1-" * 30_000, "1." * 30_000, "a@b" + ".c" * 20_000]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, base string, row int")
    for r in pii.annotate(docs).collect():
        assert shown(r["base"]) == brute.base_spans(texts[r["doc_id"]]), texts[r["doc_id"]][:200]
        assert set(shown(r["base"])) <= set(shown(r["spans"]))


def test_contexts_discover_unseen_identifiers(spark):
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "6011000990139424", "4222222222222220000"[:16]]
    seen = [f"Please note my card number {c} today" for c in cards[:4]] * 2
    missed = "Again our card number 4111111111111113 was typed wrongly"  # fails the check digit
    other = "There were about 1234567890123456 such things"
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*seen, missed, other, "my card number none"])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.annotate(docs).collect()}
    at = missed.index("4111")
    assert shown(got[8]["base"]) == [] and shown(got[8]["spans"]) == [("card", at, at + 16)]
    assert shown(got[9]["spans"]) == [] and shown(got[10]["spans"]) == []


def test_contexts_discover_other_forms(spark):
    mails = [f"You can write to {m} for the details" for m in ("ann@site.com", "bob.b@mail.example.org", "c+d@e.net", "dee@f.co.uk")]
    phones = [f"Or call me on {p} after lunch today" for p in ("+1 (017) 555-7713", "+49 30 1234567", "+331234567890", "+44 20 7946 0958")]
    cases = [("email", "So write to {} or wait", "j\u00f6rg@b\u00fccher.de"), ("email", "Mail {} for the details", "anna [at] example [dot] org"), ("email", "So write to {} or wait", "root@localhost"), ("email", "So write to {} or wait", "max at site dot com"), ("phone", "Just call me on {} or wait", "017 555 7799"), ("phone", "Just ring {} after lunch today", "(030) 1234-5678"), ("phone", "Please 2 call me on {} today", "030-1234567")]
    texts = [*mails, *phones, *[form.format(own) for _, form, own in cases], "It took 017 555 7799 steps", "call 5 times", "meet at noon"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.annotate(docs, support=3).collect()}
    for i, (kind, form, own) in enumerate(cases, len(mails) + len(phones)):
        assert shown(got[i]["base"]) == brute.base_spans(texts[i]) == []
        assert shown(got[i]["spans"]) == [(kind, form.index("{"), form.index("{") + len(own))], texts[i]
    assert all(shown(got[i]["spans"]) == [] for i in range(len(texts) - 3, len(texts)))


def test_scores_equal_brute_force(spark):
    """Three turns over a random graph against plain sums, forms without propagation."""
    pick = random.Random(6)
    edges = sorted({(pick.choice(["left", "right", "shape"]) + f"\x01{pick.randrange(8)}", f"i{pick.randrange(25)}") for _ in range(120)})
    known = {(f"i{i}", pick.randrange(3)): 1.0 for i in range(0, 25, 2)}
    df = spark.createDataFrame([(p, i, p.startswith("shape")) for p, i in edges], "pattern string, instance string, shape boolean")
    got = pii.scored(df, spark.createDataFrame([(*k, v, True) for k, v in known.items()], "instance string, rank int, score double, sure boolean")).collect()
    scores = dict(known)
    for _ in range(pii.TURNS):
        trust = {}
        for p in {p for p, _ in edges}:
            own = [i for q, i in edges if q == p]
            for rank in range(3):
                of = known if p.startswith("shape") else scores
                if any((i, rank) in scores for i in own):
                    trust[p, rank] = sum(of.get((i, rank), 0.0) for i in own) / (len(own) + pii.SMOOTH)
        scores = dict(known)
        for i in {i for _, i in edges}:
            for rank in range(3):
                around = [trust[p, rank] for p, j in edges if j == i and not p.startswith("shape") and (p, rank) in trust]
                if around:
                    scores.setdefault((i, rank), sum(around) / len(around))
    assert {(r["pattern"], r["rank"]): round(r["trust"], 9) for r in got} == {k: round(v, 9) for k, v in trust.items()}


def test_hidden_identifiers_are_recovered(spark, medium):
    """Of the tables' own identifiers, one in ten hidden from the seeds, patterns find some and nothing that is none."""
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text")
    base, marks = pii.placed(pii.scanned(docs))
    hidden = F.pmod(F.xxhash64("row"), F.lit(10)) == 3
    found = {(r["row"], r["rank"], r["start"], r["end"]) for r in pii.discovered(base.where(~hidden), marks).collect()}
    want = {(r["row"], r["rank"], r["start"], r["end"]) for r in base.where(hidden).collect()}
    assert len(want) >= 3 and found and found <= want
    # contexts alone, without a form's own pattern
    alone = pii.discovered(base.where(~hidden), marks, bare=False).collect()
    assert all(r["contextual"] for r in alone)
    alone = {(r["row"], r["rank"], r["start"], r["end"]) for r in alone}
    assert alone <= want and len(alone) * 4 >= len(want)


def test_word_classes_are_contexts(spark):
    """No word beside an identifier comes twice, but the classes of the words do; numbers of the same marks elsewhere are left."""
    words = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    pick = random.Random(3)
    pick.shuffle(words)
    mail = lambda i: f"{words[i]}{i}@{words[-1 - i]}.org"
    seen = [f"Ask {words[i]} {mail(i)} {words[50 + i]} there" for i in range(20)]
    new = "They heard quux ann@b\u00fccher.de plugh instead"
    docs = spark.createDataFrame(list(enumerate([*seen, new, "Section quux 1234.5 plugh", "see ann@home, plugh"])), "doc_id long, text string")
    base, marks = pii.placed(pii.scanned(docs))
    got = [(r["rank"], r["start"], r["end"], r["contextual"]) for r in pii.discovered(base, marks, bare=False).collect()]
    at = new.index("ann@")
    assert got == [(0, at, at + len("ann@b\u00fccher.de"), True)]
    rows = {r["doc_id"]: r for r in pii.annotate(docs.withColumn("n_form", F.lit("clash"))).collect()}
    assert [rows[20][c] for c in ("n_contextual", "n_form")] == [1, 0] and [rows[0][c] for c in ("n_contextual", "n_form")] == [0, 0]


def test_redaction(spark):
    text = "é Mail a@b.co or 10.0.0.1, x@1.2.3.4 end"
    docs = pii.annotate(spark.createDataFrame([(1, text), (2, None), (3, "none")], "doc_id long, text string"))
    got = {r["doc_id"]: r["t"] for r in docs.select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {1: "é Mail [EMAIL] or [IP], [EMAIL] end", 2: None, 3: "none"}


def test_query(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op4_pii(spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = brute.base_spans(docs[r["doc_id"]])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.annotate(empty).count() == 0
    twice = spark.createDataFrame([(None, "a@b.c"), (None, "a@b.c"), (1, "a@b.c")], "doc_id long, text string")
    assert [len(r["base"]) for r in pii.annotate(twice).collect()] == [1, 1, 1]
