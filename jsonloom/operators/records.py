"""Documents and lines to records: validity, format, summary, statistics.

A *record* is ``(doc_id, line_number, record_id, format, text, cell, children,
error)``; ``cell`` and ``children`` are the value of
:mod:`jsonloom.functions.cells`, NULL for a failed record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jsonloom.functions.cells import (
    ENTRIES,
    could_be_json,
    kind,
    limit_error,
    parse_text,
    parse_value,
    printed,
    string_value,
)
from jsonloom.functions.shared import shared
from jsonloom.functions.text import js_slice, js_trim, json_trim, let
from jsonloom.sources.documents import split_lines

INVALID = "Invalid JSON"
# The keys a summary shows, in order, and its limits and separator.
SUMMARY_KEYS = ("timestamp", "type", "action", "event", "name", "message")
SUMMARY_UNITS = 48
EXCERPT_UNITS = 72
SEPARATOR = " · "
FAILED_DOCUMENT = "Parse error"

LINE_ENDS = r"\r?\n"
RECORDS = f"array<struct<line_number:bigint,text:string,cell:string,children:{ENTRIES}>>"


# --- formats -----------------------------------------------------------------


@shared
def likely_jsonl(text: str = "text") -> Column:
    """Whether a column's text has at least two non-blank lines, every one valid
    after trimming."""
    lines = F.filter(
        F.transform(F.split(text, LINE_ENDS, -1), js_trim), lambda line: line != ""
    )
    # The look at both ends of all lines spares pretty-printed text the parses.
    return let(
        lines,
        lambda found: F.when(
            (F.size(found) >= 2) & F.forall(found, could_be_json),
            F.forall(found, lambda line: parse_value(line).isNotNull()),
        ).otherwise(False),
    )


def detect_format(text: str = "text") -> Column:
    return F.when(likely_jsonl(text), "jsonl").otherwise("json")


# --- records -----------------------------------------------------------------


@shared
def _text_value() -> Column:
    return parse_text(F.col("text"))


def _record(line_number: Column, text: Column) -> Column:
    return let(
        parse_text(text),
        lambda value: F.struct(
            line_number.cast("bigint").alias("line_number"),
            text.alias("text"),
            value["cell"].alias("cell"),
            value["children"].alias("children"),
        ),
    )


def _numbered_lines(text: Column) -> Column:
    """Non-blank lines as struct(number, line)."""
    lines = F.transform(
        F.split(text, LINE_ENDS, -1),
        lambda line, i: F.struct((i + 1).alias("number"), line.alias("line")),
    )
    return F.filter(lines, lambda e: let(e["line"], js_trim) != "")


@shared
def _strict_lines() -> Column:
    """Records of all lines, or NULL unless there are several and all are valid."""

    def strict(lines: Column) -> Column:
        plausible = (F.size(lines) > 1) & F.forall(
            lines, lambda e: let(json_trim(e["line"]), could_be_json)
        )
        parsed = F.transform(lines, lambda e: _record(e["number"], e["line"]))
        checked = let(
            parsed, lambda rs: F.when(F.forall(rs, lambda r: r["cell"].isNotNull()), rs)
        )
        return F.when(plausible, checked)

    return let(_numbered_lines(F.col("text")), strict)


@shared
def _tolerant_lines() -> Column:
    """Records of all non-blank lines, failed ones with a NULL cell."""
    lines = _numbered_lines(F.coalesce("text", F.lit("")))
    return F.transform(lines, lambda e: _record(e["number"], e["line"]))


@shared
def _blank() -> Column:
    """A null text is blank, too."""
    return F.coalesce(js_trim(F.col("text")), F.lit("")) == ""


@shared
def _whole() -> Column:
    return F.array(_record(F.lit(1), F.col("text")))


def parse_documents(docs: DataFrame, forced_format: str | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``text``, ``format``, ``found``.

    ``found`` is the array of records and lies in the document's own row, so the
    choice between the formats needs neither an aggregate nor a join.
    """
    if forced_format not in (None, "json", "jsonl"):
        raise ValueError(f"unknown format {forced_format!r}")
    blank, none, whole = _blank(), F.array().cast(RECORDS), _whole()

    if forced_format == "json":
        return docs.select(
            "doc_id",
            "text",
            F.lit("json").alias("format"),
            F.when(blank, none).otherwise(whole).alias("found"),
        )
    if forced_format == "jsonl":
        return docs.select(
            "doc_id", "text", F.lit("jsonl").alias("format"), _tolerant_lines().alias("found")
        )

    strict = docs.select("doc_id", "text", _strict_lines().alias("strict"))
    is_lines = F.col("strict").isNotNull()
    return strict.select(
        "doc_id",
        "text",
        F.when(is_lines, "jsonl").otherwise("json").alias("format"),
        F.when(blank, none).when(is_lines, F.col("strict")).otherwise(whole).alias("found"),
    )


def _named(records: DataFrame) -> DataFrame:
    return records.select(
        "doc_id",
        "line_number",
        F.concat(F.lit("record-"), F.col("line_number").cast("string")).alias("record_id"),
        "format",
        "text",
        "cell",
        "children",
        F.when(F.col("cell").isNull(), F.coalesce(limit_error(F.col("text")), F.lit(INVALID))).alias("error"),
    )


def records_of(parsed: DataFrame) -> DataFrame:
    """Records of :func:`parse_documents`' rows."""
    return _named(
        # The outer variant, because the inner one infers a filter on the array
        # that would be pushed below the projection and parse every text twice.
        parsed.select("doc_id", "format", F.explode_outer("found").alias("r"))
        .where(F.col("r.line_number").isNotNull())
        .select("doc_id", "format", "r.line_number", "r.text", "r.cell", "r.children")
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Tolerant JSON Lines: every non-blank line a record, bad lines kept."""
    # As a one-element array the value is computed once, however many filters
    # on it follow.
    found = F.array(_text_value())
    return _named(
        lines.where(~_blank())
        .select("doc_id", "line_number", "text", F.explode_outer(found).alias("r"))
        .select(
            "doc_id", "line_number", F.lit("jsonl").alias("format"), "text", "r.cell", "r.children"
        )
    )


def parse(docs: DataFrame, forced_format: str | None = None, spread: bool = False) -> DataFrame:
    """Records of documents, in automatic or forced format.

    The records of a document stay in the task that read it.  ``spread``
    distributes them evenly by one shuffle, for inputs in which few documents
    hold most of the records.
    """
    if forced_format == "jsonl":
        # Lines leave the row before they are parsed: no array of all of them.
        lines = split_lines(docs)
        return parse_lines(lines.hint("rebalance") if spread else lines)
    records = records_of(parse_documents(docs, forced_format))
    return records.hint("rebalance") if spread else records


# --- projections -------------------------------------------------------------


def primitive_summary(cell: Column, children: Column) -> Column:
    text = js_slice(string_value(cell), EXCERPT_UNITS)
    return (
        F.when(cell == "[", F.concat(
            F.lit("Array("), F.size(children).cast("string"), F.lit(")")
        ))
        .when(cell.startswith("s"), F.when(text == "", '""').otherwise(text))
        .otherwise(printed(cell))
    )


def _is_shown(entry: Column) -> Column:
    return kind(entry["cell"]).isin("number", "boolean") | (
        let(string_value(entry["cell"]), js_trim) != ""
    )


def _object_summary(entries: Column) -> Column:
    """The known keys in their order, else the first primitive field."""
    keys = F.array(*map(F.lit, SUMMARY_KEYS))

    def ranked(units: int):
        return lambda e: F.struct(
            F.array_position(keys, e["key"]).alias("rank"),
            e["key"].alias("key"),
            e["cell"].alias("cell"),
            F.lit(units).alias("units"),
        )

    def shown(e: Column) -> Column:
        text = F.when(
            e["cell"].startswith("s"),
            let(let(string_value(e["cell"]), js_trim), lambda t: js_slice(t, e["units"])),
        ).otherwise(printed(e["cell"]))
        return F.concat(e["key"], F.lit(":"), text)

    def summary(fields: Column) -> Column:
        named = F.filter(fields, lambda e: e["key"].isin(*SUMMARY_KEYS))
        chosen = F.when(
            F.size(named) > 0, F.transform(named, ranked(SUMMARY_UNITS))
        ).otherwise(F.transform(F.slice(fields, 1, 1), ranked(EXCERPT_UNITS)))
        count = F.concat(F.lit("Object("), F.size(entries).cast("string"), F.lit(")"))
        parts = F.transform(F.array_sort(chosen), shown)
        return F.when(F.size(fields) > 0, F.array_join(parts, SEPARATOR)).otherwise(count)

    return let(F.filter(entries, _is_shown), summary)


@shared
def extract_summary() -> Column:
    """One-line summary of a record's unexpanded value."""
    cell, children = F.col("cell"), F.col("children")
    return F.when(cell == "{", _object_summary(children)).otherwise(
        primitive_summary(cell, children)
    )


def summaries(records: DataFrame) -> DataFrame:
    """``records`` with ``summary``; failed lines show an excerpt of their text."""
    failed = F.when(F.col("format") == "json", FAILED_DOCUMENT).otherwise(
        js_slice(F.col("text"), EXCERPT_UNITS)
    )
    return records.withColumn(
        "summary",
        F.when(F.col("cell").isNull(), failed).otherwise(extract_summary()),
    )


def document_stats(docs: DataFrame, forced_format: str | None = None) -> DataFrame:
    """``doc_id, format, total, success, failed`` with zeros for blank and null texts.

    Counted inside each document's row, without a shuffle.
    """
    parsed = parse_documents(docs, forced_format)
    good = F.size(F.filter("found", lambda r: r["cell"].isNotNull()))
    return parsed.select(
        "doc_id",
        "format",
        F.size("found").cast("bigint").alias("total"),
        good.cast("bigint").alias("success"),
        (F.size("found") - good).cast("bigint").alias("failed"),
    )


def record_stats(records: DataFrame) -> DataFrame:
    """Statistics of records from line sources, where documents are not rows."""
    return records.groupBy("doc_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("cell").isNotNull()).alias("success"),
        F.count_if(F.col("cell").isNull()).alias("failed"),
    )


def has_many_records(stats: DataFrame) -> DataFrame:
    """``multi_record``: JSON Lines with more than one record."""
    return stats.withColumn("multi_record", (F.col("format") == "jsonl") & (F.col("total") > 1))


def table_of_contents(records: DataFrame) -> DataFrame:
    """Line number, ok/err and summary of every record."""
    return summaries(records).select(
        "doc_id",
        "line_number",
        F.when(F.col("cell").isNull(), "err").otherwise("ok").alias("state"),
        "summary",
    )


def quarantine(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) records; the bad ones with error and excerpt."""
    good = records.where(F.col("cell").isNotNull())
    bad = summaries(records.where(F.col("cell").isNull())).select(
        "doc_id", "line_number", "record_id", "text", "error", F.col("summary").alias("excerpt")
    )
    return good, bad


def line_formats(lines: DataFrame) -> DataFrame:
    """``doc_id, format`` of line sources: detection as a mergeable aggregate."""
    found = lines.select("doc_id", js_trim(F.col("text")).alias("text")).select(
        "doc_id",
        (F.col("text") != "").alias("counted"),
        _text_value().isNotNull().alias("valid"),
    )
    return found.groupBy("doc_id").agg(
        F.when(
            (F.count_if("counted") >= 2)
            & (F.count_if(F.col("counted") & ~F.col("valid")) == 0),
            "jsonl",
        )
        .otherwise("json")
        .alias("format")
    )


def line_counts(lines: DataFrame) -> DataFrame:
    """``doc_id, lines, bad``: non-blank lines and invalid ones, untrimmed."""
    shown = ~_blank()
    found = lines.select(
        "doc_id", shown.alias("shown"), (shown & _text_value().isNull()).alias("bad")
    )
    return found.groupBy("doc_id").agg(
        F.count_if("shown").alias("lines"), F.count_if("bad").alias("bad")
    )
