"""The registered queries of this subpackage, with their fixed parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspan.runtime import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspan.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspan.llm.compact_windows import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"), passage=50, similarity=0.8)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspan.llm.partenum import similar_components

    return similar_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspan.llm.line_edit import duplicate_lines

    return duplicate_lines(table(spark, sf_dir, "documents"), short=True)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspan.llm.pivot_index import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspan.llm.bradley_terry import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspan.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspan.llm.pii_crf import annotate

    return annotate(table(spark, sf_dir, "documents"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspan.llm.prefix_hash import edited

    return edited(table(spark, sf_dir, "documents"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspan.llm.pair_bpe import encode

    return encode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
