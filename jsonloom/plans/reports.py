"""Reports over a whole corpus of records and nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jsonloom.functions.paths import node_shape

KINDS = ("object", "array", "string", "number", "boolean", "null")


def parse_quality(records: DataFrame, *keys: Column | str, subtotals: bool = False) -> DataFrame:
    """Record counts per key, with ``rollup`` rows on request."""
    grouped = records.rollup(*keys) if subtotals else records.groupBy(*keys)
    return grouped.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("cell").isNotNull()).alias("success"),
        F.count_if(F.col("cell").isNull()).alias("failed"),
    )


def path_profile(nodes: DataFrame) -> DataFrame:
    """Per path without indexes: how many nodes, of which kinds, how many of them
    came out of strings."""
    return nodes.groupBy(node_shape(F.col("path"), F.col("path_text")).alias("path_shape")).agg(
        F.count("*").alias("nodes"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
        F.count_if("was_stringified").alias("stringified"),
    )


def nesting_histogram(nodes: DataFrame) -> DataFrame:
    """Records by their string layers and structural depth."""
    per_record = nodes.groupBy("doc_id", "source_line").agg(
        F.max(F.size("layers")).alias("string_layers"), F.max("depth").alias("max_depth")
    )
    return per_record.groupBy("string_layers", "max_depth").agg(F.count("*").alias("records"))


def top_paths(matches: DataFrame, k: int) -> DataFrame:
    """The ``k`` path texts with most hits; ties by path text."""
    hits = matches.groupBy("path_text").agg(F.count("*").alias("hits"))
    return hits.orderBy(F.desc("hits"), "path_text").limit(k)


def top_records(matches: DataFrame, k: int) -> DataFrame:
    """The ``k`` records with most hits; ties by record order."""
    hits = matches.groupBy("doc_id", "source_line").agg(F.count("*").alias("hits"))
    return hits.orderBy(F.desc("hits"), "doc_id", "source_line").limit(k)
