"""Pretty-printed results and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jsonloom.config import drop_path, scratch_path
from jsonloom.operators.materialise import materialise

DEFAULT_INDENT = 2


def format_records(records: DataFrame, nodes: DataFrame, indent: int = DEFAULT_INDENT) -> DataFrame:
    """``doc_id, line_number, text`` of every record.

    Failed records print as a comment in JSON Lines and as ``null`` in JSON.
    """
    texts = materialise(nodes, indent).select(
        "doc_id", F.col("source_line").alias("line_number"), F.col("json").alias("text")
    )
    comment = F.concat(
        F.lit("/* line "), F.col("line_number").cast("string"), F.lit(": "), F.col("error"),
        F.lit(" */"),
    )
    failed = records.where(F.col("cell").isNull()).select(
        "doc_id",
        "line_number",
        F.when(F.col("format") == "jsonl", comment).otherwise("null").alias("text"),
    )
    return texts.unionByName(failed)


def format_documents(
    docs: DataFrame,
    records: DataFrame,
    nodes: DataFrame,
    indent: int = DEFAULT_INDENT,
    forced_format: str | None = None,
) -> DataFrame:
    """``doc_id, text``: the whole result of each document as one text.

    A blank document has no records and prints as ``null``, in forced JSON Lines
    as nothing.

    For documents whose text was one row, so that the result fits one as well.
    Results of line sources are written record by record, see
    :func:`write_formatted`.
    """
    lines = format_records(records, nodes, indent)
    in_order = F.array_sort(F.collect_list(F.struct("line_number", "text")))
    whole = lines.groupBy("doc_id").agg(
        F.array_join(F.transform(in_order, lambda r: r["text"]), "\n").alias("text")
    )
    blank = "" if forced_format == "jsonl" else "null"
    return (
        docs.select("doc_id")
        .join(whole, "doc_id", "left")
        .select("doc_id", F.coalesce("text", F.lit(blank)).alias("text"))
    )


def write_formatted(formatted: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write record texts in document and line order, as ordered part files.

    The texts are written once before: the sample that finds the ranges would else make all of them again.
    """
    spark, scratch = formatted.sparkSession, scratch_path(formatted.sparkSession, "formatted")
    formatted.write.parquet(scratch)
    formatted = spark.read.schema(formatted.schema).parquet(scratch)
    if partitions is None:
        ordered = formatted.orderBy("doc_id", "line_number")
    else:
        ordered = formatted.repartitionByRange(
            partitions, "doc_id", "line_number"
        ).sortWithinPartitions("doc_id", "line_number")
    ordered.select("text").write.text(path)
    drop_path(spark, scratch)


def write_split(records: DataFrame, good_path: str, bad_path: str) -> None:
    """Good and bad records to two Parquet tables."""
    from jsonloom.operators.records import quarantine

    good, bad = quarantine(records)
    good.write.parquet(good_path)
    bad.write.parquet(bad_path)
