"""Turning expanded strings back into plain strings."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jsonloom.functions.paths import ancestor, dotted
from jsonloom.operators.control import Control, with_chosen, with_hits

#: Paths up to which each row compares its own path with them first.
FEW_PATHS = 20


def strict_layers(layers: Column, was_stringified: Column) -> Column:
    """Depths of the stringified ancestors, without the node itself."""
    return F.slice(layers, F.lit(1), F.size(layers) - was_stringified.cast("int"))


def as_string(nodes: DataFrame, where: Column) -> DataFrame:
    """Rows that satisfy ``where`` as the plain string of their raw text."""
    own_layers = strict_layers(F.col("layers"), F.lit(True))
    own_chain = strict_layers(F.col("stringified_chain"), F.lit(True))
    changed = {
        "kind": F.lit("string"),
        "str_value": F.col("raw_string"),
        "num_value": F.lit(None).cast("double"),
        "bool_value": F.lit(None).cast("boolean"),
        "n_children": F.lit(0),
        "was_stringified": F.lit(False),
        "raw_string": F.lit(None).cast("string"),
        "expandable": F.lit(False),
        "restorable": F.lit(False),
        "layers": own_layers,
        "stringified_chain": own_chain,
    }
    flagged = nodes.withColumn("back", where)
    return flagged.select(
        *[
            F.when(F.col("back"), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else c
            for c in nodes.columns
        ]
    )


def restore_all(nodes: DataFrame) -> DataFrame:
    """Each outermost stringified node becomes its raw string, a leaf.

    Whether a node lies inside another stringified one is known from its own
    row, so this is a filter and a projection.
    """
    was = F.col("was_stringified")
    outer = nodes.where(F.size("layers") - was.cast("int") == 0)
    return as_string(outer, was)


def restore_below(nodes: DataFrame, depth: Column) -> DataFrame:
    """Restore the outermost stringified nodes strictly deeper than ``depth``."""
    inside = F.exists("layers", lambda d: (d > depth) & (d < F.col("depth")))
    return as_string(
        nodes.where(~inside), F.col("was_stringified") & (F.col("depth") > depth)
    )


def restore_paths(nodes: DataFrame, paths: Iterable[list[str]] | DataFrame) -> DataFrame:
    """Restore the stringified nodes at ``paths``, outermost first.

    Paths are compared by their segments joined with dots.  A frame holds such
    joined paths in its first column.
    """
    control = paths if isinstance(paths, DataFrame) else [".".join(p) for p in paths]
    keys = F.transform("layers", lambda d: dotted(ancestor(F.col("path"), d)))
    if not isinstance(control, DataFrame) and len(control) <= FEW_PATHS:
        # a path's ancestors are beginnings of its text: most rows need no look at their keys
        near = reduce(Column.__or__, [dotted(F.col("path")).startswith(p) for p in control], F.lit(False))
        keys = F.when(near, keys).otherwise(F.array().cast("array<string>"))
    was = F.col("was_stringified")
    keyed = nodes.withColumn("keys", keys)
    marked = with_hits(keyed, F.col("keys"), control, "hits")
    overlap = F.arrays_overlap(strict_layers(F.col("keys"), was), F.col("hits"))
    inside = F.when(F.size("hits") > 0, overlap).otherwise(False)
    target = was & F.array_contains("hits", dotted(F.col("path")))
    return as_string(marked.where(~inside), target).drop("keys", "hits")


def restore_records(nodes: DataFrame, records: Control) -> DataFrame:
    """Restore all strings of the chosen records, leave the others expanded.

    A record is a ``(doc_id, record_id)``; see :func:`with_chosen`.
    """
    chosen = with_chosen(nodes, records, "chosen")
    picked = F.col("chosen")
    was = F.col("was_stringified")
    nested = F.size("layers") - was.cast("int") > 0
    return as_string(chosen.where(~(picked & nested)), picked & was).drop("chosen")
