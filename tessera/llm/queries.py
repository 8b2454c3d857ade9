"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, oracles, ppm_language, substring_dedup, suffix_dedup, token_store
from .jaccard_join import jaccard_groups
from .quality_rules import quality_rules
from .source_mix import source_mix
from .topk_kdtree import topk
from .url_filter import url_filter

END_ID = 2
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), size=4, percent=85)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = source_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), weights=[5, 2, 1], cap=3.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    codec = bpe_codec.Codec.from_path(tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe_codec.digests(table(spark, sf_dir, "documents"), codec)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"), window=35)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"), window=50)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = token_store.Tokens.from_path(tokenizer_path("byte_bpe_50k.json"))
    return token_store.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokens, END_ID)


def op10_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_language.held_out_predictions(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_jaccard_join, op2_quality_rules, op3_exact_topk, op4_source_mix, op5_byte_bpe, op6_substring_dedup, op7_suffix_dedup, op8_url_filter, op9_token_store, op10_ppm_language)}


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": oracles.op1(4, 85), "op2_quality_rules": oracles.OP2, "op3_exact_topk": oracles.OP3, "op6_substring_dedup": oracles.op6(35), "op7_suffix_dedup": oracles.op7(50)}
