"""Labels a node is shown and searched by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jsonloom.functions.shared import shared
from jsonloom.functions.text import js_number, json_quote


@shared
def key_label() -> Column:
    """Last path segment, ``$`` at the root."""
    return F.element_at("path", -1)


@shared
def scalar_label() -> Column:
    """JSON text of a scalar node, except that an infinite number stays a word."""
    return (
        F.when(F.col("kind") == "string", json_quote(F.col("str_value")))
        .when(F.col("kind") == "number", js_number(F.col("num_value")))
        .when(F.col("kind") == "boolean", F.col("bool_value").cast("string"))
        .when(F.col("kind") == "null", "null")
    )


@shared
def value_label() -> Column:
    count = F.col("n_children").cast("string")
    return (
        F.when(F.col("kind") == "object", F.concat(F.lit("{"), count, F.lit("}")))
        .when(F.col("kind") == "array", F.concat(F.lit("["), count, F.lit("]")))
        .otherwise(scalar_label())
    )
