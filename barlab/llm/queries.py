"""The numbered queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from barlab.llm import exact_dedup, fill_middle, line_dedup, maxent_lm, near_dedup, packing, pieces, quality, secrets, sharding, token_counts, toxicity, whitening
from barlab.llm.session import documents


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.remove_boilerplate(documents(spark, sf_dir))
    return clean.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("clean_sha256"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(documents(spark, sf_dir)))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.lm_scores(documents(spark, sf_dir), held_out=F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(documents(spark, sf_dir).select("doc_id", "text"))
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & F.col("kept")).alias("kept"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(documents(spark, sf_dir))
    marked = encoded.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_hash": F.xxhash64("ids")})
    return pieces.decode(marked).select("doc_id", "n_tokens", "ids_hash", F.sha2("text", 256).alias("decoded_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.toxicity(docs, labels, held_out=held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.restore(fill_middle.fill_in_middle(documents(spark, sf_dir).select("doc_id", "text")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return whitening.by_component(whitening.whiten(vectors))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_secret_scans": op3_secret_scans,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_quality_rules": op5_quality_rules,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_sharding": op11_sharding,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op3_secret_scans": secrets.ORACLE,
    "op5_quality_rules": quality.ORACLE,
    "op10_minhash_near_dedup": near_dedup.ORACLE,
    "op11_sharding": sharding.ORACLE,
    "op12_fill_in_middle": fill_middle.ORACLE,
}
