"""Node rows back to JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jsonloom.functions.cells import mark
from jsonloom.functions.paths import ancestor, path_text
from jsonloom.functions.shared import shared
from jsonloom.functions.text import json_quote
from jsonloom.operators.control import Control
from jsonloom.operators.expand import DEFAULT_MAX_DEPTH, expand_cells
from jsonloom.operators.labels import scalar_label
from jsonloom.operators.restore import restore_below, restore_records, strict_layers

# Sorts after every child position, so a closing bracket follows all descendants.
AFTER_CHILDREN = 2147483647
# Fixed value: JSON.stringify uses at most ten spaces.
MAX_INDENT = 10


@shared
def _scalar_text() -> Column:
    infinite = F.abs(F.col("num_value")) == float("inf")
    return F.when((F.col("kind") == "number") & infinite, "null").otherwise(scalar_label())


@shared
def _key_text() -> Column:
    return json_quote(F.element_at("path", -1))


def _break(level: Column, indent: int) -> Column:
    if indent == 0:
        return F.lit("")
    return F.concat(F.lit("\n"), F.repeat(F.lit(" "), indent * level))


def materialise(
    nodes: DataFrame, indent: int = 0, root_depth: Column | None = None, carry: tuple[str, ...] = ()
) -> DataFrame:
    """``doc_id, record_id, source_line, root, json``: one text per root node, with
    the ``carry`` columns of that node.

    Every node emits its opening text and, with children, a closing bracket;
    sorted by position these concatenate to the JSON.  This is one shuffle on
    the record; what comes together in a row is one record's text, which was one
    row of input.
    """
    indent = max(0, min(indent, MAX_INDENT))
    depth = F.size("ord") if root_depth is None else F.size("ord") - root_depth
    root = F.slice("ord", F.lit(1), F.size("ord") - depth)
    brackets = {"object": ("{", "}"), "array": ("[", "]")}

    def by_kind(pick) -> Column:
        return F.when(F.col("kind") == "object", pick(brackets["object"])).when(
            F.col("kind") == "array", pick(brackets["array"])
        )

    filled = F.col("n_children") > 0
    below = depth > 0
    colon = ": " if indent else ":"
    lead = F.when(
        below,
        F.concat(
            F.when(F.element_at("ord", -1) > 0, ",").otherwise(""),
            _break(depth, indent),
            F.when(F.col("member"), F.concat(_key_text(), F.lit(colon))).otherwise(""),
        ),
    ).otherwise("")
    body = F.coalesce(
        F.when(filled, by_kind(lambda b: F.lit(b[0]))).otherwise(
            by_kind(lambda b: F.lit(b[0] + b[1]))
        ),
        _scalar_text(),
    )
    opening = F.struct(F.col("ord").alias("at"), F.concat(lead, body).alias("text"))
    closing = F.struct(
        F.concat("ord", F.array(F.lit(AFTER_CHILDREN))).alias("at"),
        F.concat(_break(depth, indent), by_kind(lambda b: F.lit(b[1]))).alias("text"),
    )
    parts = F.when(filled, F.array(opening, closing)).otherwise(F.array(opening))
    own = F.when(depth == 0, F.struct(*carry)) if carry else F.lit(None)
    tokens = nodes.select(
        "doc_id",
        "record_id",
        "source_line",
        root.alias("root"),
        own.alias("own"),
        F.explode(parts).alias("token"),
    )
    in_order = F.array_sort(F.collect_list("token"))
    places = F.transform(in_order, lambda t: t["at"])
    repeated = F.raise_error(F.lit("several documents have the same doc_id; see from_column(numbered=True)"))
    joined = F.when(
        F.size(F.array_distinct(places)) == F.size(places),
        F.array_join(F.transform(in_order, lambda t: t["text"]), ""),
    ).otherwise(repeated.cast("string"))
    # An opening and a closing token both carry the root's columns: either will do.
    carried = [F.first("own", ignorenulls=True).alias("own")] if carry else []
    out = tokens.groupBy("doc_id", "record_id", "source_line", "root").agg(joined.alias("json"), *carried)
    return out.select("doc_id", "record_id", "source_line", "root", "json", *(f"own.{c}" for c in carry))


def materialise_records(
    records: DataFrame,
    nodes: DataFrame,
    restored: Control = (),
    indent: int = 0,
) -> DataFrame:
    """``doc_id, record_id, json`` of every record, NULL for failed ones, with
    the strings of ``restored`` records left as strings."""
    texts = materialise(restore_records(nodes, restored), indent)
    failed = records.where(F.col("cell").isNull()).select(
        "doc_id", "record_id", F.lit(None).cast("string").alias("json")
    )
    return texts.select("doc_id", "record_id", "json").unionByName(failed)


def _subtrees(nodes: DataFrame, wanted: str) -> DataFrame:
    """Rows at or under nodes with path text ``wanted``, and the node's depth.

    A row's own path tells whether it lies there, so there is no join.
    """
    path = F.col("path")
    at = F.filter(
        F.sequence(F.lit(0), F.size(path) - 1),
        lambda k: path_text(ancestor(path, k)) == wanted,
    )
    first = F.lit(wanted)
    rows = nodes.where(F.startswith("path_text", first)).withColumn("at", F.get(at, F.lit(0)))
    return rows.where(F.col("at").isNotNull())


def node_values(nodes: DataFrame, wanted: str, indent: int = 2) -> DataFrame:
    """JSON of the *unexpanded* value of the nodes with path text ``wanted``."""
    inner = restore_below(_subtrees(nodes, wanted), F.col("at"))
    return materialise(inner, indent, F.col("at"))


def expand_again(
    nodes: DataFrame,
    wanted: str,
    max_depth: int = DEFAULT_MAX_DEPTH,
    levels: int | None = None,
) -> DataFrame:
    """New nodes of the subtrees at ``wanted``, from the nodes' own values.

    A restored string expands again, a double-encoded one opens one more layer,
    and a container drops its own stringified flag.
    """
    was = F.col("was_stringified")
    scalar = (
        F.when(F.col("kind") == "string", F.concat(F.lit("s"), F.col("str_value")))
        .when(F.col("kind") == "number", F.col("num_value").cast("string"))
        .otherwise(scalar_label())
    )
    # The subtrees' texts and what their roots hold come from one grouped pass.
    inner = restore_below(_subtrees(nodes, wanted), F.col("at"))
    inner = inner.withColumns(
        {"scalar": scalar, "outer_layers": strict_layers(F.col("layers"), was)}
    )
    carry = ("ord", "path", "path_text", "outer_layers", "member", "expandable", "scalar")
    roots = materialise(inner, 0, F.col("at"), carry)
    start = roots.select(
        "doc_id",
        F.col("source_line").alias("line_number"),
        "ord",
        "path",
        "path_text",
        F.col("outer_layers").alias("layers"),
        "member",
        F.when(F.col("expandable"), mark(F.col("json"))).otherwise(F.col("scalar")).alias("cell"),
    )
    return expand_cells(start, max_depth, levels)
