"""The collapsed and expanded row view of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jsonloom.operators.control import Control, with_hits
from jsonloom.operators.labels import key_label, value_label
from jsonloom.operators.restore import restore_records, strict_layers


def visible_nodes(
    nodes: DataFrame, expanded: Control = (), restored: Control = ()
) -> DataFrame:
    """Nodes on view, with ``open_paths``: those of their stringified path texts
    that are in ``expanded``.

    A node shows when all stringified nodes above it are expanded.  Path texts
    count for every record, as one set is shared by all.
    """
    rows = restore_records(nodes, restored)
    was = F.col("was_stringified")
    above = strict_layers(F.col("stringified_chain"), was)
    marked = with_hits(rows, F.col("stringified_chain"), expanded, "open_paths")
    # most nodes have nothing above them to compare
    bare = F.size("stringified_chain") == was.cast("int")
    return marked.where(F.when(bare, True).otherwise(F.size(F.array_except(above, F.col("open_paths"))) == 0))


def visible_rows(
    nodes: DataFrame, expanded: Control = (), restored: Control = ()
) -> DataFrame:
    """Rows as displayed; sort by ``doc_id, source_line, ord`` for their order."""
    shown = visible_nodes(nodes, expanded, restored)
    is_open = ~F.col("was_stringified") | F.array_contains("open_paths", F.col("path_text"))
    return shown.select(
        "doc_id",
        "source_line",
        "ord",
        F.concat("record_id", F.lit(":"), "path_text").alias("id"),
        "record_id",
        "path",
        "path_text",
        "depth",
        key_label().alias("key_label"),
        "kind",
        value_label().alias("value_label"),
        "was_stringified",
        "expandable",
        is_open.alias("expanded"),
    )


def rows_page(rows: DataFrame, first: int, size: int) -> DataFrame:
    """Rows ``first`` (from 0) to ``first + size`` of each record's display, with their ``place``.

    A record's rows meet in one window, which its one row of input bounds; rows beyond the
    page are left out before they are exchanged.
    """
    order = Window.partitionBy("doc_id", "record_id").orderBy("ord")
    numbered = rows.withColumn("place", F.row_number().over(order) - 1)
    return numbered.where((F.col("place") < first + size) & (F.col("place") >= first))


def row_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "record_id").agg(F.count("*").alias("rows"))


def stringified_paths(
    nodes: DataFrame, expanded: Control = (), restored: Control = ()
) -> DataFrame:
    """Distinct ``path_text`` of the stringified nodes on view."""
    shown = visible_nodes(nodes, expanded, restored)
    return shown.where("was_stringified").select("path_text").distinct()


def expand_all(
    nodes: DataFrame,
    expanded: Control = (),
    restored: Control = (),
    fixpoint: bool = False,
) -> DataFrame:
    """The next expanded set; the restored set is empty afterwards.

    One step opens what is on view and so reveals one more layer of strings;
    ``fixpoint`` gives the set after which nothing is left to open.
    """
    if fixpoint:
        return nodes.where("was_stringified").select("path_text").distinct()
    return stringified_paths(nodes, expanded, restored)


def restore_all_set(records: DataFrame) -> DataFrame:
    """Ids of all successful records; the expanded set is empty afterwards."""
    return records.where(F.col("cell").isNotNull()).select("doc_id", "record_id")
