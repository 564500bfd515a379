"""Registered queries of the pipeline operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.llm import (
    chat,
    jaccard_join,
    language_id,
    lexical_search,
    nearest,
    packing,
    prefix_trie,
    quality_classifier,
    quality_rules,
    sentencepiece_codec,
    sharding,
    substring_dedup,
    suffix_dedup,
)
from jsonloom.llm.common import table


def tokenizer_file(name: str) -> str:
    """Where the installed package of public tokenizers keeps a vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_codec.digests(docs, tokenizer_file("piece_bpe_32k.model")).withColumnRenamed(
        "id", "doc_id"
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents"))
    return found.withColumn("n_spans", F.size("spans")).drop("spans")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.with_components(table(spark, sf_dir, "documents"), jaccard_join.Join(words=3, percent=90))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"  # a text full of control strings
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    file = tokenizer_file("byte_bpe_50k.json")
    return chat.read_back(*chat.format_tree(rows.unionByName(probe), file), file)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"), prefix_trie.Sharing()).drop("name", "parent")


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_nearest": op8_nearest,
    "op9_chat_tree": op9_chat_tree,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_sharding": op12_sharding,
    "op13_lexical_search": op13_lexical_search,
}
ORACLES: dict[str, str] = {
    "op4_quality_rules": quality_rules.ORACLE,
    "op7_jaccard_join": jaccard_join.ORACLE,
    "op8_nearest": nearest.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
