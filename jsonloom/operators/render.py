"""Records to JSON text inside their own row, strings opened or left closed.

A record is an array of *parts* in the order of the text: finished pieces, and cells that
are still to be opened, each with the text that leads up to it.  A level rewrites the
array once: an open container gives way to its bracket, its children and the closing
bracket in place, so every bracket stands where it belongs without a sort.  A record stays
one row from its parse to its text and nothing is exchanged.

Levels are counted as in :mod:`jsonloom.operators.expand`: with ``levels=n`` the plan is
lazy and a deeper record raises; without it passes write records that are still open to
the shared folder and go on with those.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jsonloom.config import scratch_path
from jsonloom.functions.cells import (
    ENTRIES,
    boolean_value,
    is_container,
    kind,
    limit_error,
    number_value,
    open_cell,
    printed,
    string_value,
)
from jsonloom.functions.shared import shared
from jsonloom.functions.text import json_quote, let
from jsonloom.operators.control import Control, with_chosen
from jsonloom.operators.expand import DEFAULT_MAX_DEPTH, PASS_LEVELS, records_at, root_value
from jsonloom.operators.records import INVALID, parse_documents

# Fixed value: JSON.stringify uses at most ten spaces.
MAX_INDENT = 10
PART = "struct<text:string,cell:string,depth:int>"
PARTS = f"array<{PART}>"


def _scalar_text(cell: Column) -> Column:
    infinite = F.abs(number_value(cell)) == float("inf")
    return (
        F.when(cell.startswith("s"), json_quote(string_value(cell)))
        .when(infinite, "null")
        .when(kind(cell) == "boolean", boolean_value(cell).cast("string"))
        .otherwise(printed(cell))
    )


def _break(depth: Column, indent: int) -> Column:
    if indent == 0:
        return F.lit("")
    return F.concat(F.lit("\n"), F.repeat(F.lit(" "), indent * depth))


def _done(text: Column) -> Column:
    none = F.lit(None)
    return F.struct(text.alias("text"), none.cast("string").alias("cell"), none.cast("int").alias("depth"))


def _parts(lead: Column, own: Column, children: Column, depth: Column, indent: int) -> Column:
    """What an opened cell turns into: ``own`` is its bracket or scalar cell."""

    def child(entry: Column, i: Column) -> Column:
        colon = F.lit(": " if indent else ":")
        key = F.when(entry["key"].isNotNull(), F.concat(json_quote(entry["key"]), colon)).otherwise("")
        comma = F.when(i > 0, ",").otherwise("")
        return F.struct(
            F.concat(comma, _break(depth + 1, indent), key).alias("text"),
            entry["cell"].alias("cell"),
            (depth + 1).alias("depth"),
        )

    is_object = own.startswith("{")
    opening = F.when(is_object, "{").otherwise("[")
    closing = F.when(is_object, "}").otherwise("]")
    empty = F.when(is_object, "{}").when(own.startswith("["), "[]").otherwise(_scalar_text(own))
    filled = F.concat(
        F.array(_done(F.concat(lead, opening))),
        F.transform(children, child),
        F.array(_done(F.concat(_break(depth, indent), closing))),
    )
    return F.when(F.size(children) > 0, filled).otherwise(F.array(_done(F.concat(lead, empty)))).cast(PARTS)


def _opened(part: Column, unwrap: Column, max_depth: int, indent: int) -> Column:
    cell, depth = part["cell"], part["depth"]

    def spread(value: Column) -> Column:
        own = F.coalesce(value["cell"], cell)
        children = F.coalesce(value["children"], F.array().cast(ENTRIES))
        return _parts(part["text"], own, children, depth, indent)

    opened = let(open_cell(cell, unwrap & (depth <= max_depth)), spread)
    return F.when(cell.isNull(), F.array(part).cast(PARTS)).otherwise(opened)


@shared
def _next_parts(max_depth: int, indent: int) -> Column:
    unwrap = F.col("unwrap")
    return F.array(F.flatten(F.transform("parts", lambda p: _opened(p, unwrap, max_depth, indent))))


def _level(rows: DataFrame, max_depth: int, indent: int) -> DataFrame:
    # An explode of one keeps the levels apart: merged into one expression they would be planned as a whole.
    kept = [c for c in rows.columns if c != "parts"]
    return rows.select(*kept, F.explode_outer(_next_parts(max_depth, indent)).alias("parts"))


def _is_open() -> Column:
    return F.exists("parts", lambda p: p["cell"].isNotNull())


def _texts(
    rows: DataFrame, max_depth: int, indent: int, levels: int | None, scratch: list[str] | None
) -> DataFrame:
    """``rows`` with ``json`` in place of ``parts`` and ``unwrap``."""
    count = PASS_LEVELS if levels is None else levels - 1

    def through(frame: DataFrame) -> DataFrame:
        return reduce(lambda x, _: _level(x, max_depth, indent), range(count), frame)

    if levels is not None:
        problem = F.raise_error(F.lit(f"record deeper than {levels} levels")).cast("boolean")
        closed = through(rows).where(F.when(_is_open(), problem).otherwise(True))
    else:
        spark, done = rows.sparkSession, []
        while True:
            path = scratch_path(spark, "texts")
            if scratch is not None:
                scratch.append(path)
            reached = through(rows).withColumn("open", _is_open())
            reached.write.partitionBy("open").parquet(path)
            written = spark.read.schema(reached.schema).parquet(path)
            done.append(written.where(~F.col("open")).drop("open"))
            rows = written.where(F.col("open")).drop("open")
            if rows.isEmpty():
                break
        closed = reduce(DataFrame.unionByName, done)
    json = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return closed.withColumn("json", json).drop("parts", "unwrap")


@shared
def _root_parts(indent: int) -> Column:
    own = F.coalesce("value.cell", "cell")
    children = F.coalesce("value.children", F.array().cast(ENTRIES))
    return _parts(F.lit(""), own, children, F.lit(0), indent)


def record_texts(
    records: DataFrame,
    restored: Control = (),
    indent: int = 0,
    max_depth: int = DEFAULT_MAX_DEPTH,
    levels: int | None = None,
    scratch: list[str] | None = None,
) -> DataFrame:
    """``doc_id, record_id, source_line, json`` of every successful record.

    All strings that hold JSON are opened, but for the ``restored`` records, which keep
    theirs: a join of records, not of their nodes.  Equal to materialising all nodes of
    :func:`jsonloom.operators.expand.expand`.
    """
    indent = max(0, min(indent, MAX_INDENT))
    good = with_chosen(records.where(F.col("cell").isNotNull()), restored, "chosen")
    value = F.when(F.col("chosen"), root_value(-1)).otherwise(root_value(max_depth))
    rows = good.select(
        "doc_id",
        "record_id",
        F.col("line_number").alias("source_line"),
        (~F.col("chosen")).alias("unwrap"),
        "cell",
        value.alias("value"),
    )
    rows = rows.withColumn("parts", _root_parts(indent)).drop("cell", "value")
    return _texts(rows, max_depth, indent, levels, scratch)


def format_record_texts(
    records: DataFrame,
    indent: int = 2,
    max_depth: int = DEFAULT_MAX_DEPTH,
    levels: int | None = None,
    scratch: list[str] | None = None,
) -> DataFrame:
    """``doc_id, line_number, text`` of every record, each in its own row.

    Failed records print as a comment in JSON Lines and as ``null`` in JSON.
    """
    indent = max(0, min(indent, MAX_INDENT))
    failed = F.array(_done(failure_text(F.col("format"), F.col("line_number"), F.col("error"))))
    parts = F.when(F.col("cell").isNull(), failed).otherwise(_root_parts(indent))
    rows = records.withColumn("value", root_value(max_depth)).select(
        "doc_id", "line_number", F.lit(True).alias("unwrap"), parts.alias("parts")
    )
    return _texts(rows, max_depth, indent, levels, scratch).withColumnRenamed("json", "text")


def failure_text(format_: Column, line_number: Column, error: Column) -> Column:
    """What stands for a failed record."""
    comment = F.concat(F.lit("/* line "), line_number.cast("string"), F.lit(": "), error, F.lit(" */"))
    return F.when(format_ == "jsonl", comment).otherwise("null")


def document_texts(
    docs: DataFrame,
    forced_format: str | None = None,
    indent: int = 2,
    max_depth: int = DEFAULT_MAX_DEPTH,
    levels: int | None = None,
    scratch: list[str] | None = None,
) -> DataFrame:
    """``doc_id, text``: the whole result of each document, from its text to its formatted text in one row.

    A blank document prints as ``null``, in forced JSON Lines as nothing.
    """
    indent = max(0, min(indent, MAX_INDENT))
    blank = "" if forced_format == "jsonl" else "null"

    def record(r: Column, i: Column) -> Column:
        lead = F.when(i > 0, "\n").otherwise("")
        error = F.coalesce(limit_error(r["text"]), F.lit(INVALID))
        failed = F.array(_done(F.concat(lead, failure_text(F.col("format"), r["line_number"], error))))

        def opened(value: Column) -> Column:
            children = F.coalesce(value["children"], F.array().cast(ENTRIES))
            return _parts(lead, F.coalesce(value["cell"], r["cell"]), children, F.lit(0), indent)

        known = F.struct(r["cell"].alias("cell"), r["children"].alias("children"))
        value = F.when(is_container(r["cell"]), known).otherwise(open_cell(r["cell"], F.lit(max_depth >= 0)))
        return F.when(r["cell"].isNull(), failed).otherwise(let(value, opened)).cast(PARTS)

    parts = F.flatten(F.transform("found", record))
    none = F.array(_done(F.lit(blank))).cast(PARTS)
    rows = parse_documents(docs, forced_format).select(
        "doc_id", F.lit(True).alias("unwrap"), F.when(F.size("found") > 0, parts).otherwise(none).alias("parts")
    )
    return _texts(rows, max_depth, indent, levels, scratch).withColumnRenamed("json", "text")


def value_texts(
    records: DataFrame,
    wanted: str,
    indent: int = 2,
    max_depth: int = DEFAULT_MAX_DEPTH,
    levels: int | None = None,
    scratch: list[str] | None = None,
) -> DataFrame:
    """``doc_id, source_line, ord, json``: the unexpanded values of the nodes with path text ``wanted``.

    Only the containers on the way are opened; the nodes' own strings stay closed.
    """
    indent = max(0, min(indent, MAX_INDENT))
    rows = records_at(records, wanted, max_depth).select(
        "doc_id",
        F.col("line_number").alias("source_line"),
        "ord",
        F.lit(False).alias("unwrap"),
        _root_parts(indent).alias("parts"),
    )
    return _texts(rows, max_depth, indent, levels, scratch)


