from __future__ import annotations

import brute
import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from tidewatch.llm import language

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_after_another(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", None, None), (9002, "12 34", None, "s", 5), (9003, "", "de", "s", 0)], docs.schema)
    docs = docs.unionByName(odd)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = [{"doc_id": k, "text": v} for k, v in texts.items()]

    first = pipeline.language_id(spark, docs, small)
    assert first.columns == COLUMNS and {r["doc_id"] for r in first.collect()} == {k for k, v in texts.items() if v and any(c.isalpha() for c in v)}

    second = pipeline.ngram_jaccard(spark, first, small)
    kept = [r["doc_id"] for r in second.collect()]
    found = brute.classes([r for r in rows if r["text"] and any(c.isalpha() for c in r["text"])])
    assert second.columns == COLUMNS and sorted(kept) == sorted(k for k, (_, c) in found.items() if k == c)

    third = pipeline.decontamination(spark, second, small)
    left = {r["doc_id"] for r in third.collect()}
    bench = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    hurt = {k for k in kept if any(b in texts[k] for b in bench)}
    assert third.columns == COLUMNS and hurt <= set(kept) - left and len(left) >= len(kept) - len(hurt) - 2

    fourth = pipeline.personal_data(spark, third, small).collect()
    assert {r["doc_id"] for r in fourth} == left
    for r in fourth:
        assert r["n_chars"] == len(r["text"]) and not brute.base_spans(r["text"])
        assert r["text"] == texts[r["doc_id"]] or brute.base_spans(texts[r["doc_id"]]) or "[" in r["text"]


def test_first_stage_keeps_what_sql_keeps(spark, medium):
    from oracle import duck

    first = pipeline.language_id(spark, spark.read.parquet(f"{medium}/documents.parquet"), medium)
    want = {r[0] for r in duck(medium).execute(r"SELECT doc_id FROM documents WHERE regexp_matches(coalesce(text, ''), '\p{L}')").fetchall()}
    assert {r["doc_id"] for r in first.collect()} == want


def test_first_stage_uses_its_prediction_and_makes_it_once(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stage = pipeline.language_id(spark, docs, small)
    want = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, language.fit(docs)).collect()}
    assert all(r["lang"] == want[r["doc_id"]] for r in stage.collect())
    plan = stage.where("lang = 'en'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_first_stage_keeps_a_table_without_languages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    stage = pipeline.language_id(spark, docs, small)
    lettered = {r["doc_id"] for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"])}
    assert {r["doc_id"] for r in stage.collect()} == lettered and stage.where("lang is not null").count() == 0


def test_repeated_ids_of_different_texts(spark, small):
    bench = spark.read.parquet(f"{small}/benchmark.parquet").first()["text"]
    rows = [(1, f"before it {bench} and after", "en", "s", 1), (1, "quite another text of the same number", "en", "s", 1), (None, f"no number {bench}", "en", "s", 1), (None, "nothing of it", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["text"] for r in pipeline.decontamination(spark, docs, small).collect()) == ["nothing of it", "quite another text of the same number"]


def test_whole_run(spark, small):
    out = pipeline.run(spark, small)
    assert out.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "pii", "best_fit_packing"]
    assert language.UNKNOWN == "und"


def test_empty_documents(spark, small, tmp_path):
    spark.read.parquet(f"{small}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
