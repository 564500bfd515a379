"""Path texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segment_text(segment: Column) -> Column:
    """One segment below the root: all digits in brackets, the rest after a dot.

    Segments are not quoted, so numeric object keys look like indexes and dots
    inside keys look like separators.
    """
    return F.when(
        segment.rlike(r"^[0-9]+\z"), F.concat(F.lit("["), segment, F.lit("]"))
    ).otherwise(F.concat(F.lit("."), segment))


def path_text(path: Column) -> Column:
    """``$.payload[0]`` of a path array."""
    segments = F.transform(F.slice(path, F.lit(2), F.size(path)), segment_text)
    return F.concat(F.lit("$"), F.array_join(segments, ""))


def shape_text(path: Column) -> Column:
    """Path text with every index written ``[*]``, for profiles over a corpus."""
    segments = F.transform(
        F.slice(path, F.lit(2), F.size(path)),
        lambda s: F.when(s.rlike(r"^[0-9]+\z"), F.lit("[*]")).otherwise(
            F.concat(F.lit("."), s)
        ),
    )
    return F.concat(F.lit("$"), F.array_join(segments, ""))


def node_shape(path: Column, text: Column) -> Column:
    """:func:`shape_text` of a node whose path text is known.

    Where no key has a bracket, brackets of the text are those of indexes.
    """
    plain = ~F.contains(F.array_join(path, ""), F.lit("["))
    return F.when(plain, F.regexp_replace(text, r"\[[0-9]+\]", "[*]")).otherwise(shape_text(path))


def dotted(path: Column) -> Column:
    """Segments joined by dots, the form in which restore paths are compared."""
    return F.array_join(path, ".")


def ancestor(path: Column, depth: Column) -> Column:
    """The prefix of ``path`` that ends ``depth`` levels below its root."""
    return F.slice(path, F.lit(1), depth + 1)
