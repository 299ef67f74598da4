"""The queries of this subpackage, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumite.llm.url_filter import url_verdicts

    return url_verdicts(_table(spark, sf_dir, "pages"), URL_RULES)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumite.llm.lm_score import cross_entropy_difference

    good = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    out = cross_entropy_difference(_table(spark, sf_dir, "documents"), good)
    # Six decimals: sums of logarithms differ in the last digits with the order of the words.
    return out.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumite.llm.token_files import token_files

    return token_files(_table(spark, sf_dir, "documents"), _tokenizer(), end_id=2)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumite.llm.quality import quality_verdicts

    out = quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumite.llm.simhash import hex_digits, simhash_components

    out = simhash_components(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumite.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumite.llm.langid import fit, held_out_fold, identify

    docs = _table(spark, sf_dir, "documents")
    models = fit(docs.where(held_out_fold() != 2))
    held = F.coalesce(held_out_fold() == 2, F.lit(False)).alias("held_out")
    return identify(docs, models).select("doc_id", held, "lang_pred", "score", "rejected")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumite.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumite.llm.substring import repeated_spans

    return repeated_spans(_table(spark, sf_dir, "documents")).select("doc_id", "start", "bytes", "chunks", "kept_in")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumite.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), _tokenizer(), end_id=0, capacity=2048)


def queries() -> dict:
    return {f.__name__: f for f in (op1_url_filter, op2_lm_score, op3_token_files, op4_quality_rules, op5_simhash, op6_nearest, op7_language_id, op8_mixing, op9_substring_dedup, op10_best_fit_packing)}


def oracle_sql() -> dict[str, str]:
    """Of the others the fingerprints, digests, tokens and trained models are not SQL; tests hold them against plain Python."""
    from vellumite.llm import oracles

    return {"op1_url_filter": oracles.url_filter(), "op2_lm_score": oracles.lm_score(), "op4_quality_rules": oracles.quality_rules(), "op6_nearest": oracles.nearest()}
