"""Corpus pipeline: documents through quality rules, near-duplicate and repeat removal, mixing and tokenisation.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs.  All but the last return the columns of docs.  Null and empty texts have no
words and go in the first stage; a text that the third stage empties stays as an empty document, whose
n_chars is 0; repeated
rows count as copies and one stays; an empty table stays empty.  Columns that docs has besides those used
go along unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe_codec, jaccard_join, quality_rules, source_mix, suffix_dedup
from tessera.llm.common import save
from tessera.sources.scratch import tidy

#: Near duplicates share 80 % of their five-word shingles; repeats are of 50 bytes and more.
SHINGLE_WORDS, SIMILAR_PERCENT, REPEAT_BYTES = 5, 80, 50
WEIGHTS, CAP = [5, 2, 1], 3.0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the cascade keep."""
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    return jaccard_join.first_of_groups(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings that an earlier document has; characters cut in part go whole."""
    out = suffix_dedup.remove_repeats(docs, REPEAT_BYTES, as_text=True)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document taken more than once is as many rows."""
    return source_mix.mixed_documents(docs, WEIGHTS, CAP)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    import public_tokenizers

    codec = bpe_codec.Codec.from_path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe_codec.digests(docs, codec)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", repeats),
    ("source_mix", mix),
    ("byte_bpe", tokens),
]

#: The mix's hash and the tokenizer have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
