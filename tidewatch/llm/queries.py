"""The queries of this subpackage, by name; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_tree, decontaminate, divergence, fingerprint, jaccard, language, oracles, packing, pii, quality, sharding, substring, vector_codes, warc


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(parts: int) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by ``parts``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == 2, F.lit(False))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "start", "end", "item_start", "item_end", "equal", "item_tokens", (F.col("equal") / (F.col("end") - F.col("start"))).alias("similarity"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.annotate(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    counts = [F.size(pii.of_kind(F.col("base"), kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(pii.written_spans(F.col("base")), 256).alias("base_sha256"), pii.written_spans(F.col("spans")).alias("spans"), "n_contextual", "n_form")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents"), tokenizer_path())).withColumnRenamed("id", "doc_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels").where(~quality.held_out()))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents"), 40)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.compare_edits(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", fingerprint.encoded(F.col("own")).alias("fingerprint"), fingerprint.encoded(F.col("changed")).alias("edited_fingerprint"), "near_edited", "near_next")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    profiles = language.fit(docs.where(~language.held_out()))
    out = language.predict(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op11_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = context_tree.score(_table(spark, sf_dir, "documents"), ~_held_out(7)).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", _held_out(7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_substring": op2_substring,
    "op3_warc": op3_warc,
    "op4_pii": op4_pii,
    "op5_jaccard": op5_jaccard,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_sharding": op8_sharding,
    "op9_fingerprints": op9_fingerprints,
    "op10_language": op10_language,
    "op11_context_tree": op11_context_tree,
    "op12_vector_codes": op12_vector_codes,
    "op13_divergence": op13_divergence,
}

#: DuckDB SQL of the queries that SQL can express whole.
SQL: dict[str, str] = {"op2_substring": oracles.SUBSTRING, "op3_warc": oracles.WARC, "op5_jaccard": oracles.JACCARD, "op12_vector_codes": oracles.VECTOR_CODES, "op13_divergence": oracles.DIVERGENCE}
