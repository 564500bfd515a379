"""Records to nodes: the level-wise flat-map that unwraps JSON inside strings.

A level turns every *open* row into itself, closed, followed by its children,
open.  Levels are chained projections and ``explode``s over one frame that holds
open and closed rows together, so any number of levels is a single narrow stage:
nothing is shuffled, and no level recomputes those before it.

How many levels there are depends on the data.  Two ways end the chain:

* ``levels=n`` – a lazy plan of ``n`` levels.  A record that needs more raises
  an error while running; nothing is cut off.
* ``levels=None`` – passes of ``PASS_LEVELS`` levels.  Each pass writes its rows
  to the shared folder, split by ``open``; open rows start the next pass.  The
  result reads the closed rows back, as columnar, prunable Parquet.

Where only some paths are wanted, rows also carry their state in the automaton of these
paths (:mod:`jsonloom.operators.wanted`): a child that leads to none of them is dropped
before it becomes a row, so containers beside the way stay shut.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jsonloom.config import scratch_path
from jsonloom.functions.cells import (
    ENTRIES,
    boolean_value,
    is_container,
    kind,
    number_value,
    open_cell,
    string_value,
)
from jsonloom.functions.paths import ancestor, path_text, segment_text
from jsonloom.functions.shared import shared
from jsonloom.operators.wanted import NOWHERE, UNDER, Wanted

# Fixed value: strings deeper than this stay strings.
DEFAULT_MAX_DEPTH = 10
PASS_LEVELS = 6

# A row is open while ``n_children`` is NULL.  Closed containers keep only the
# bracket of their cell.  ``chain`` has the path text of each depth in ``layers``: kept
# along the way, since paths cut out of every node's own cost more than its expansion.
_STATE = ("doc_id", "line_number", "ord", "path", "path_text", "layers", "chain", "member", "cell")


def _opened(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.select(
        *_STATE,
        *[c for c in ("at",) if c in rows.columns],
        F.lit(None).cast("int").alias("n_children"),
        F.lit(None).cast("string").alias("raw_string"),
        *extra,
    )


@shared
def root_value(max_depth: int) -> Column:
    """Containers have been taken apart already when the record was checked."""
    cell = F.col("cell")
    inside = open_cell(cell, F.lit(max_depth >= 0))
    return F.when(is_container(cell), F.struct("cell", "children")).otherwise(inside)


def _roots(records: DataFrame, max_depth: int, only: Wanted | None = None) -> DataFrame:
    rows = records.where(F.col("cell").isNotNull()).select(
        "doc_id",
        "line_number",
        F.array().cast("array<int>").alias("ord"),
        F.array(F.lit("$")).alias("path"),
        F.lit("$").alias("path_text"),
        F.array().cast("array<int>").alias("layers"),
        F.array().cast("array<string>").alias("chain"),
        F.lit(False).alias("member"),
        "cell",
        root_value(max_depth).alias("value"),
        *([F.lit(only.start).alias("at")] if only else []),
    )
    return _opened(rows, "value")


@shared
def _open_value(max_depth: int) -> Column:
    may_unwrap = F.size("path") - 1 <= max_depth
    return F.when(F.col("n_children").isNull(), open_cell(F.col("cell"), may_unwrap))


@shared
def _with_children(view: tuple[str, ...] | None) -> Column:
    self_entry = F.array(F.lit(None).cast("struct<key:string,cell:string>"))
    below = F.col("value.children")
    if view is not None:
        below = F.when(~F.col("cell").startswith("s") | F.col("path_text").isin(*view), below)
    return F.concat(self_entry, F.coalesce(below, F.array().cast(ENTRIES)))


def _wanted_children(only: Wanted) -> Column:
    """As above, entries that lead to a wanted path and their states."""
    none = F.lit(None).cast("string")
    itself = F.array(F.struct(F.lit(0).alias("pos"), none.alias("key"), none.alias("cell"), F.col("at").alias("at")))

    def child(e: Column, i: Column) -> Column:
        segment = F.coalesce(e["key"], i.cast("string"))
        return F.struct(
            (i + 1).alias("pos"), e["key"].alias("key"), e["cell"].alias("cell"), only.after(F.col("at"), segment).alias("at")
        )

    below = F.transform(F.coalesce(F.col("value.children"), F.array().cast(ENTRIES)), child)
    return F.concat(itself, F.filter(below, lambda e: e["at"] != NOWHERE))


@shared
def _spread_columns() -> list[Column]:
    own = F.col("pos") == 0
    unwrapped = F.col("cell").startswith("s") & F.col("value").isNotNull()
    key = F.coalesce(F.col("entry.key"), (F.col("pos") - 1).cast("string"))
    count = F.coalesce("n_children", F.size("value.children"), F.lit(0))
    raw = F.when(unwrapped, string_value(F.col("cell"))).otherwise(F.col("raw_string"))
    return [
        F.col("doc_id"),
        F.col("line_number"),
        F.when(own, F.col("ord")).otherwise(F.concat("ord", F.array(F.col("pos") - 1))).alias("ord"),
        F.when(own, F.col("path")).otherwise(F.concat("path", F.array(key))).alias("path"),
        F.when(own, F.col("path_text"))
        .otherwise(F.concat("path_text", segment_text(key)))
        .alias("path_text"),
        F.when(unwrapped, F.concat("layers", F.array(F.size("path") - 1)))
        .otherwise(F.col("layers"))
        .alias("layers"),
        F.when(unwrapped, F.concat("chain", F.array("path_text"))).otherwise(F.col("chain")).alias("chain"),
        F.when(own, F.col("member")).otherwise(F.col("entry.key").isNotNull()).alias("member"),
        F.when(own, F.coalesce("value.cell", "cell")).otherwise(F.col("entry.cell")).alias("cell"),
        F.when(own, count).alias("n_children"),
        F.when(own, raw).alias("raw_string"),
    ]


def _spread(rows: DataFrame, only: Wanted | None = None, view: tuple[str, ...] | None = None) -> DataFrame:
    """Close the open rows and open their children, those of ``only`` or on ``view`` if given.

    The explode and the new columns share one generated stage.
    ``posexplode_outer`` keeps the optimizer from adding a filter on the array's
    size, which would be pushed below the projection and parse a second time.
    """
    if only:
        spread = rows.select("*", F.explode_outer(_wanted_children(only)).alias("entry")).withColumn("pos", F.col("entry.pos"))
        return spread.select(*_spread_columns(), F.col("entry.at").alias("at"))
    spread = rows.select("*", F.posexplode_outer(_with_children(view)).alias("pos", "entry"))
    return spread.select(*_spread_columns())


def _level(
    rows: DataFrame, max_depth: int, only: Wanted | None = None, view: tuple[str, ...] | None = None
) -> DataFrame:
    return _spread(rows.select("*", _open_value(max_depth).alias("value")), only, view)


def _levels(
    rows: DataFrame, count: int, max_depth: int, only: Wanted | None = None, view: tuple[str, ...] | None = None
) -> DataFrame:
    return reduce(lambda frame, _: _level(frame, max_depth, only, view), range(count), rows)


@shared
def _node_columns() -> list[Column]:
    cell, path = F.col("cell"), F.col("path")
    was = F.col("raw_string").isNotNull()
    return [
        F.col("doc_id"),
        F.concat(F.lit("record-"), F.col("line_number").cast("string")).alias("record_id"),
        F.col("line_number").alias("source_line"),
        F.col("ord"),
        path,
        F.col("path_text"),
        (F.size(path) - 1).alias("depth"),
        kind(cell).alias("kind"),
        string_value(cell).alias("str_value"),
        number_value(cell).alias("num_value"),
        boolean_value(cell).alias("bool_value"),
        F.col("n_children"),
        was.alias("was_stringified"),
        F.col("raw_string"),
        is_container(cell).alias("expandable"),
        was.alias("restorable"),
        F.col("member"),
        F.col("layers"),
        F.col("chain").alias("stringified_chain"),
    ]


def _finish(rows: DataFrame) -> DataFrame:
    """Node columns; those not asked for are pruned by the optimizer."""
    return rows.select(*_node_columns())


def stringified_chain(path: Column, layers: Column) -> Column:
    """Path texts of the stringified nodes from the root down to this one."""
    return F.transform(layers, lambda depth: path_text(ancestor(path, depth)))


def _guard(rows: DataFrame, count: int) -> DataFrame:
    problem = F.concat(
        F.lit(f"record deeper than {count} levels: "),
        F.col("doc_id").cast("string"),
        F.lit(" line "),
        F.col("line_number").cast("string"),
    )
    # Checked by a filter, which no column pruning can remove.
    return rows.where(
        F.when(F.col("n_children").isNull(), F.raise_error(problem).cast("boolean")).otherwise(True)
    )


def _closed(
    rows: DataFrame,
    done: int,
    max_depth: int,
    levels: int | None,
    keep_deep: bool = False,
    scratch: list[str] | None = None,
    only: Wanted | None = None,
    view: tuple[str, ...] | None = None,
) -> DataFrame:
    """All rows closed, given rows to which ``done`` levels were applied."""
    if levels is not None:
        reached = _levels(rows, levels - done, max_depth, only, view)
        return reached if keep_deep else _guard(reached, levels)

    spark = rows.sparkSession
    closed = []
    while True:
        path = scratch_path(spark, "nodes")
        if scratch is not None:
            scratch.append(path)
        reached = _levels(rows, PASS_LEVELS, max_depth, only, view).withColumn(
            "open", F.col("n_children").isNull()
        )
        reached.write.partitionBy("open").parquet(path)
        written = spark.read.schema(reached.schema).parquet(path)
        closed.append(written.where(~F.col("open")).drop("open"))
        rows = written.where(F.col("open")).drop("open")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, closed)


def expand_cells(
    rows: DataFrame, max_depth: int, levels: int | None, scratch: list[str] | None = None
) -> DataFrame:
    """Nodes of the subtrees under cells at given paths (columns ``_STATE`` without ``chain``)."""
    rows = rows.withColumn("chain", stringified_chain(F.col("path"), F.col("layers")))
    return _finish(_closed(_opened(rows), 0, max_depth, levels, scratch=scratch))


def expand(
    records: DataFrame,
    max_depth: int = DEFAULT_MAX_DEPTH,
    levels: int | None = None,
    keep_deep: bool = False,
    scratch: list[str] | None = None,
    only: Iterable[Sequence[str]] | None = None,
    view: Iterable[str] | None = None,
) -> DataFrame:
    """The node table of all successful records.

    ``only`` names wanted paths by their segments below the root, ``*`` for any segment
    (``["items", "*", "note"]``): the nodes there and all below them, and nothing beside
    the way to them is opened.  A path that strings of JSON lie on needs no more.

    ``view`` holds path texts of stringified nodes: what lies in any other such node is left
    out.  These are the nodes that :func:`jsonloom.operators.view.visible_nodes` keeps of all
    with the same set expanded and nothing restored.

    With ``levels`` and ``keep_deep`` a record that needs more levels does not fail the
    job: its unopened nodes stay as they are (:func:`unopened`).  Without ``levels``
    the folders of the passes are added to ``scratch``, for the caller to drop.
    """
    wanted = None if only is None else Wanted(only)
    shown = None if view is None else tuple(dict.fromkeys(view))
    if wanted and shown is not None:
        raise ValueError("either only or view")
    rows = _spread(_roots(records, max_depth, wanted), wanted, shown)
    rows = _closed(rows, 1, max_depth, levels, keep_deep, scratch, wanted, shown)
    return _finish(rows.where(F.col("at") == UNDER) if wanted else rows)


def _on_the_way(path: Column, wanted: str) -> Column:
    """Does a path text end where ``wanted`` does, or before one of its segments?"""
    rest = F.substr(F.lit(wanted), F.length(path) + 1)
    return F.startswith(F.lit(wanted), path) & (rest.startswith(".") | rest.startswith("[") | (rest == ""))


def records_at(records: DataFrame, wanted: str, max_depth: int = DEFAULT_MAX_DEPTH) -> DataFrame:
    """The nodes with path text ``wanted`` as unexpanded rows: ``_STATE`` and ``value``,
    what their cells hold with one string layer taken off.

    One projection per segment, each of which keeps only the children on the way; a text
    may name several nodes, since keys can look like segments.
    """
    rows = _roots(records, max_depth).select(*_STATE, "value")
    there = F.col("path_text") == wanted

    def child(e: Column, i: Column) -> Column:
        key = F.coalesce(e["key"], i.cast("string"))
        return F.struct(
            i.alias("pos"),
            key.alias("key"),
            F.concat(F.col("path_text"), segment_text(key)).alias("text"),
            e["key"].isNotNull().alias("member"),
            e["cell"].alias("cell"),
        )

    children = F.transform(F.coalesce(F.col("value.children"), F.array().cast(ENTRIES)), child)
    itself = F.array(F.lit(None).cast("struct<pos:int,key:string,text:string,member:boolean,cell:string>"))
    kept = F.when(there, itself).otherwise(F.filter(children, lambda e: _on_the_way(e["text"], wanted)))
    stays, was = F.col("entry").isNull(), F.col("cell").startswith("s") & F.col("value").isNotNull()
    # explodes keep what they unfold from being computed again by what follows
    for _ in range(wanted.count(".") + wanted.count("[")):
        rows = rows.where(there | (F.size("value.children") > 0)).select("*", F.explode(kept).alias("entry"))
        rows = rows.select(
            "doc_id",
            "line_number",
            F.when(stays, F.col("ord")).otherwise(F.concat("ord", F.array("entry.pos"))).alias("ord"),
            F.when(stays, F.col("path")).otherwise(F.concat("path", F.array("entry.key"))).alias("path"),
            F.when(stays, F.col("path_text")).otherwise(F.col("entry.text")).alias("path_text"),
            F.when(~stays & was, F.concat("layers", F.array(F.size("path") - 1))).otherwise(F.col("layers")).alias("layers"),
            F.when(~stays & was, F.concat("chain", F.array("path_text"))).otherwise(F.col("chain")).alias("chain"),
            F.when(stays, F.col("member")).otherwise(F.col("entry.member")).alias("member"),
            F.when(stays, F.col("cell")).otherwise(F.col("entry.cell")).alias("cell"),
            F.when(stays, F.col("value")).alias("known"),
        )
        value = F.coalesce("known", open_cell(F.col("cell"), F.size("path") - 1 <= max_depth))
        rows = rows.select(*_STATE, F.explode_outer(F.array(value)).alias("value"))
    return rows.where(there)


def expand_at(
    records: DataFrame, wanted: str, max_depth: int = DEFAULT_MAX_DEPTH, levels: int | None = None, scratch: list[str] | None = None
) -> DataFrame:
    """New nodes of the subtrees at ``wanted``, from the nodes' own values.

    As :func:`jsonloom.operators.materialise.expand_again`, but out of the records: the way
    is opened and the values are expanded where they lie, with no text rebuilt.
    """
    own = F.coalesce("value.cell", "cell")
    again = F.when(own.startswith("s"), open_cell(own, F.size("path") - 1 <= max_depth)).otherwise(F.col("value"))
    rows = records_at(records, wanted, max_depth).withColumn("again", F.explode_outer(F.array(again)))
    rows = rows.withColumn("cell", own).drop("value").withColumnRenamed("again", "value")
    return _finish(_closed(_spread(_opened(rows, "value")), 1, max_depth, levels, scratch=scratch))


def unopened(nodes: DataFrame) -> DataFrame:
    """Nodes that ``keep_deep`` left closed, a quarantine of records that are too deep."""
    return nodes.where(F.col("n_children").isNull())
