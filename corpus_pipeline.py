"""Corpus preparation as a chain of stages; each takes (spark, docs, sf_dir) and returns what the next one reads.

Every stage but the last returns the columns of ``documents``.  A stage that filters keeps every row that it has no reason
to drop; a null text reaches no stage but the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, jaccard, language, packing, pii
from tidewatch.llm.queries import tokenizer_path
from tidewatch.llm.store import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language: null texts and texts without a letter.  ``lang`` becomes the predicted one.

    Where no row has a language to learn from, nothing is predicted and ``lang`` stays as it is.
    """
    own = docs.select(*COLUMNS).where(language.lettered(F.col("text")))
    out = language.predict(own, language.fit(docs))
    lang = F.when(F.col("lang_pred") != language.UNKNOWN, F.col("lang_pred")).otherwise(F.col("lang"))
    return out.select("doc_id", "text", lang.alias("lang"), "source", "n_chars")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near copies the document with the smallest id."""
    found = jaccard.classes(docs)
    kept = found.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("__id")).distinct()
    return docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of the benchmark, substitutions allowed."""
    return decontaminate.remove(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind in brackets; n_chars follows."""
    out = pii.annotate(docs.select(*COLUMNS)).withColumn("text", pii.redacted(F.col("text"), F.col("spans")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document, packed into sequences; one row for each piece."""
    return packing.pack(packing.pieces(docs, tokenizer_path())).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("best_fit_packing", best_fit_packing),
]
#: SQL cannot express rank profiles, pattern scoring or the packing; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
