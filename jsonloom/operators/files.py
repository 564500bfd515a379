"""Files of any size to records, format decided per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.functions.cells import ENTRIES, parse_text
from jsonloom.functions.text import js_trim
from jsonloom.operators.expand import DEFAULT_MAX_DEPTH, expand
from jsonloom.operators.large import expand_large
from jsonloom.operators.records import parse, parse_lines, record_stats
from jsonloom.sources.documents import (
    count_splits,
    read_documents,
    read_lines,
    without_mark,
    without_return,
)

#: Bytes up to which a JSON document is read as one row; a larger one goes by its top-level elements.
ROW_BYTES = 1 << 30
#: Bytes from which on a file of lines is not opened again among the documents.
PRUNED_BYTES = 1 << 24
TOO_LARGE = "JSON document too large for one row; see expand_files"


def _counted(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Splits with their non-blank lines, invalid ones among them, and bytes."""
    line = without_return(F.col("text"))
    shown = js_trim(line) != ""
    bad = shown & parse_text(line)["cell"].isNull()
    # A byte order mark makes the first line of a file invalid only until it is taken off.
    first_is_fine = bad & line.startswith("\ufeff") & parse_text(without_mark(line))["cell"].isNotNull()
    return count_splits(
        spark,
        paths,
        F.count_if(shown).alias("shown"),
        F.count_if(bad).alias("bad"),
        F.min_by(first_is_fine, "row").alias("marked"),
        F.sum(F.octet_length("text") + 1).alias("bytes"),
    )


def parse_files(
    spark: SparkSession, paths: str | list[str], forced_format: str | None = None, row_bytes: int = ROW_BYTES
) -> DataFrame:
    """Records of files, in automatic or forced format.

    In automatic format one pass over the lines, in splits, tells which files hold
    several records and no bad line; those stay lines, however large.  The others are read
    again as whole files, byte for byte.  A document that is too large for one row has no
    record that could hold it: its record is a failed one that says so, while
    :func:`expand_files` expands it like the others.
    """
    if forced_format == "jsonl":
        return parse_lines(read_lines(spark, paths))
    if forced_format == "json":
        sizes = _sizes(spark, paths)
        docs = read_documents(spark, paths, F.col("_metadata.file_size") <= row_bytes)
        return parse(docs, "json").unionByName(_too_large(sizes.where(F.col("bytes") > row_bytes)))

    splits = _counted(spark, paths)
    marked = F.coalesce(F.max((F.col("block") == 0) & F.col("marked")).cast("int"), F.lit(0))
    formats = splits.groupBy("doc_id").agg(
        ((F.sum("shown") > 1) & (F.sum("bad") - marked == 0)).alias("is_jsonl"),
        F.sum("bytes").alias("bytes"),
    )
    lines = read_lines(spark, paths, splits)
    fits = F.col("bytes") <= row_bytes
    records = parse_lines(lines.join(formats.where("is_jsonl").select("doc_id"), "doc_id", "left_semi"))
    whole = formats.where(~F.col("is_jsonl"))
    # Large files of lines are pruned by name, in a list that their size keeps short; a join tells the small ones.
    large = formats.where(F.col("is_jsonl") & (F.col("bytes") > PRUNED_BYTES)).select("doc_id").collect()
    pruned = F.col("_metadata.file_size") <= row_bytes
    if large:
        pruned = pruned & ~F.col("_metadata.file_path").isin([r.doc_id for r in large])
    docs = read_documents(spark, paths, pruned).join(whole.where(fits).select("doc_id"), "doc_id", "left_semi")
    return records.unionByName(parse(docs, "json")).unionByName(_too_large(whole.where(~fits)))


def _sizes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("length").alias("bytes"))


def _too_large(files: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return files.select(
        "doc_id",
        F.lit(1).cast("bigint").alias("line_number"),
        F.lit("record-1").alias("record_id"),
        F.lit("json").alias("format"),
        none.alias("text"),
        none.alias("cell"),
        F.lit(None).cast(ENTRIES).alias("children"),
        F.lit(TOO_LARGE).alias("error"),
    )


def expand_files(
    spark: SparkSession,
    paths: str | list[str],
    forced_format: str | None = None,
    max_depth: int = DEFAULT_MAX_DEPTH,
    levels: int | None = None,
    row_bytes: int = ROW_BYTES,
    scratch: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(nodes, failed)`` of files of any size; failed: ``doc_id, record_id, error``.

    Documents beyond ``row_bytes`` are taken apart over their splits
    (:mod:`jsonloom.operators.large`) and give the nodes that they would give as a row.
    """
    records = parse_files(spark, paths, forced_format, row_bytes)
    nodes = expand(records, max_depth, levels, scratch=scratch)
    failed = records.where("cell is null").select("doc_id", "record_id", "error")
    large = [r.doc_id for r in failed.where(F.col("error") == TOO_LARGE).select("doc_id").collect()]  # names of files
    if not large:
        return nodes, failed
    more, wrong = expand_large(spark, paths, max_depth, levels, scratch, F.col("doc_id").isin(large))
    wrong = wrong.select("doc_id", F.lit("record-1").alias("record_id"), "error")
    return nodes.unionByName(more), failed.where(F.col("error") != TOO_LARGE).unionByName(wrong)


def file_stats(
    spark: SparkSession, paths: str | list[str], forced_format: str | None = None
) -> DataFrame:
    """``doc_id, total, success, failed`` of every file, zeros for blank ones.

    Files of no bytes have no row: Spark's readers pass over them.
    """
    files = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("doc_id"))
    stats = record_stats(parse_files(spark, paths, forced_format))
    return files.join(stats, "doc_id", "left").select(
        "doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "success", "failed"))
    )
