"""Sources of JSON text.

*Documents* are rows ``(doc_id, text)``; *lines* are rows
``(doc_id, line_number, text)`` of JSON Lines files too large to be one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jsonloom.config import scratch_path

BYTE_ORDER_MARK = "\ufeff"


def without_mark(text: Column) -> Column:
    return F.when(text.startswith(BYTE_ORDER_MARK), F.substr(text, F.lit(2))).otherwise(text)


def from_column(
    df: DataFrame, id_cols: str | list[str], text_col: str, numbered: bool = False
) -> DataFrame:
    """Documents from any string column; several id columns become a struct.

    A document is one row, so ids have to be unique.  ``numbered`` makes them so: the
    id becomes a struct of the id columns and a ``row`` number.  Rebuilding JSON from
    nodes of repeated ids raises an error.
    """
    id_cols = [id_cols] if isinstance(id_cols, str) else id_cols
    if numbered:
        doc_id = F.struct(*id_cols, F.monotonically_increasing_id().alias("row"))
    else:
        doc_id = F.col(id_cols[0]) if len(id_cols) == 1 else F.struct(*id_cols)
    return df.select(doc_id.alias("doc_id"), F.col(text_col).alias("text"))


def read_documents(spark: SparkSession, paths: str | list[str], wanted: Column | None = None) -> DataFrame:
    """One document per file, its whole text in one row; ``wanted``, on ``_metadata``, prunes files."""
    files = spark.read.text(paths, wholetext=True)
    files = files if wanted is None else files.where(wanted)
    return files.select(
        F.col("_metadata.file_path").alias("doc_id"),
        without_mark(F.col("value")).alias("text"),
    )


def scan_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``doc_id, block, row, text``: the lines of splits, in order by ``row``."""
    # Only "\n" ends a line: Spark's default would also end it at a lone "\r".
    raw = spark.read.option("lineSep", "\n").text(paths)
    return raw.select(
        F.col("_metadata.file_path").alias("doc_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("text"),
    )


def count_splits(spark: SparkSession, paths: str | list[str], *counts: Column) -> DataFrame:
    """``doc_id, block, first_row, lines`` and more counts of every split, written once.

    Written, they stay the same for every reader.
    """
    splits = (
        scan_lines(spark, paths)
        .groupBy("doc_id", "block")
        .agg(F.min("row").alias("first_row"), F.count("*").alias("lines"), *counts)
    )
    path = scratch_path(spark, "splits")
    splits.write.parquet(path)
    return spark.read.schema(splits.schema).parquet(path)


def read_lines(
    spark: SparkSession, paths: str | list[str], splits: DataFrame | None = None
) -> DataFrame:
    """Lines of splittable text files with their 1-based numbers.

    No file passes through one task.  Inside a split the rows are numbered by
    ``monotonically_increasing_id``; the lines before the split come from a sum
    over the line counts of the file's splits (``splits``, by default counted
    here), a table with one row per split, joined as its size tells Spark.
    A split without its count (the two scans planned differently) raises an
    error rather than losing lines.
    """
    splits = count_splits(spark, paths) if splits is None else splits
    earlier = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(
        "doc_id", "block", "first_row", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before")
    )
    number = F.col("row") - F.col("first_row") + F.col("before") + 1
    checked = F.when(
        F.col("first_row").isNull() | (F.col("row") < F.col("first_row")),
        F.raise_error(F.lit("line numbering: file splits changed between scans")).cast("bigint"),
    ).otherwise(number)
    text = F.when(F.col("line_number") == 1, without_mark(F.col("text"))).otherwise(F.col("text"))
    return (
        scan_lines(spark, paths)
        .join(splits, ["doc_id", "block"], "left")
        .select("doc_id", checked.alias("line_number"), "text")
        .select("doc_id", "line_number", without_return(text).alias("text"))
    )


def without_return(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\z", "")


def split_lines(docs: DataFrame) -> DataFrame:
    """Lines of documents held in a column, blank ones included."""
    return docs.select("doc_id", F.posexplode(F.split("text", r"\r?\n", -1))).select(
        "doc_id",
        (F.col("pos") + 1).cast("bigint").alias("line_number"),
        F.col("col").alias("text"),
    )
