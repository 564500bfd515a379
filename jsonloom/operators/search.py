"""Search over keys, value labels and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import PySparkException

from jsonloom.config import scratch_path
from jsonloom.functions.ranges import find_ranges, segments
from jsonloom.functions.regex import Invalid, Unsupported, to_java
from jsonloom.operators.control import Control
from jsonloom.operators.labels import key_label, value_label

# The characters a literal query escapes.
META_CHARACTERS = ".*+?^${}()|[]\\"
NAMES = ("key", "value", "path")
LINE_BUCKET = 65536


def _any_case(char: str) -> str:
    if char.isascii():
        # Folding beyond ASCII would let the long s match "s".
        return f"[{char.lower()}{char.upper()}]" if char.isalpha() else char
    return f"(?iu:{char})"


def build_pattern(
    spark: SparkSession, query: str, regex: bool = False, case_sensitive: bool = False
) -> str | None:
    """Java pattern of a query; None for an empty query or an invalid regex.

    A valid regex that Java cannot express raises ``functions.regex.Unsupported``.
    """
    if not query:
        return None
    if not regex:
        return "".join(
            "\\" + c if c in META_CHARACTERS else c if case_sensitive else _any_case(c)
            for c in query
        )
    try:
        java = to_java(query)
    except Invalid:
        return None
    pattern = java if case_sensitive else f"(?iu){java}"
    try:
        # Folded on the driver; no job runs.
        spark.range(1).select(F.lit("").rlike(pattern)).collect()
    except PySparkException as refused:
        raise Unsupported(f"Java refuses {pattern!r}") from refused
    return pattern


def search(
    nodes: DataFrame,
    query: str,
    regex: bool = False,
    case_sensitive: bool = False,
    jq: bool = False,
    ordered: bool = False,
    keep_unopened: bool = False,
) -> DataFrame | None:
    """Matching nodes with their ranges; None when there is no pattern.

    All nodes are searched, whether on view or not.  Ranges are computed only for
    rows that matched.  ``jq`` also matches the pattern against the path text.
    ``keep_unopened`` also returns the nodes that were left unopened, marked in a column
    ``unopened``: what is below them has not been searched.
    """
    pattern = build_pattern(nodes.sparkSession, query, regex, case_sensitive)
    if pattern is None:
        return None
    plain = case_sensitive and not regex

    def hit(text: Column) -> Column:
        return F.contains(text, F.lit(query)) if plain else text.rlike(pattern)

    labelled = nodes.select(
        "doc_id",
        "record_id",
        "source_line",
        "ord",
        "path_text",
        "stringified_chain",
        key_label().alias("key_label"),
        value_label().alias("value_label"),
        *([F.col("n_children").isNull().alias("unopened")] if keep_unopened else []),
    )
    key, value, path = F.col("key_label"), F.col("value_label"), F.col("path_text")
    condition = hit(key) | hit(value)
    if jq:
        condition = condition | hit(path)
    if keep_unopened:
        condition = condition | F.col("unopened")
    # One expression over the three labels, so it is built and planned once.
    texts = F.array(key, value, path if jq else F.lit(None).cast("string"))
    ranges = F.transform(texts, lambda text: find_ranges(text, pattern))
    found = labelled.where(condition).withColumn("ranges", ranges)
    matches = found.select(
        "doc_id",
        "record_id",
        "source_line",
        "ord",
        "path_text",
        "key_label",
        "value_label",
        *[F.get("ranges", F.lit(i)).alias(f"{name}_ranges") for i, name in enumerate(NAMES)],
        "stringified_chain",
        *(["unopened"] if keep_unopened else []),
    )
    return matches.orderBy("doc_id", "source_line", "ord") if ordered else matches


def match_counts(matches: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Matches per document; with ``docs`` also a zero for each document without any."""
    counts = matches.groupBy("doc_id").agg(F.count("*").alias("matches"))
    if docs is None:
        return counts
    every = docs.select(F.col("doc_id").alias("_every")).distinct()
    joined = every.join(counts, F.col("_every").eqNullSafe(F.col("doc_id")), "left")
    return joined.select(F.col("_every").alias("doc_id"), F.coalesce("matches", F.lit(0)).alias("matches"))


def kth_match(matches: DataFrame, k: int) -> DataFrame:
    """Each document's match number ``k`` (from 0) in reading order, cyclic.

    Numbering all matches of a document in one window would put them into one
    task.  Counts per block of lines say which block holds the match; only that
    block is numbered.  The matches are written once and serve both.
    """
    path = scratch_path(matches.sparkSession, "matches")
    matches.write.parquet(path)
    matches = matches.sparkSession.read.schema(matches.schema).parquet(path)
    block = F.floor(F.col("source_line") / LINE_BUCKET).alias("block")
    by_line = Window.partitionBy("doc_id").orderBy("block")
    document = Window.partitionBy("doc_id")
    counts = (
        matches.groupBy("doc_id", block)
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(by_line))
        .withColumn("total", F.sum("n").over(document))
    )
    index = F.pmod(F.lit(k), F.col("total"))
    holding = counts.where((F.col("upto") > index) & (F.col("upto") - F.col("n") <= index)).select(
        "doc_id",
        "block",
        "total",
        index.alias("k"),
        (index - F.col("upto") + F.col("n") + 1).alias("place"),
    )
    order = Window.partitionBy("doc_id", "block").orderBy("source_line", "ord")
    return (
        matches.withColumn("block", block)
        .join(holding, ["doc_id", "block"])
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") == F.col("place"))
        .drop("block", "rank", "place")
    )


def paths_to_expand(matches: DataFrame, expanded: Control | None = None) -> DataFrame:
    """Path texts to open so that all matches show, with those open already."""
    chains = matches.select(F.explode("stringified_chain").alias("path_text"))
    if expanded is None:
        return chains.distinct()
    if not isinstance(expanded, DataFrame):
        spark = matches.sparkSession
        expanded = spark.createDataFrame([(p,) for p in expanded], "path_text string")
    return chains.union(expanded.select(expanded.columns[0])).distinct()


def record_matches(matches: DataFrame, record_id: str | None = None) -> DataFrame:
    """Matches keyed by path text: the last one of a record wins."""
    chosen = matches if record_id is None else matches.where(F.col("record_id") == record_id)
    columns = [c for c in matches.columns if c not in ("doc_id", "record_id", "path_text")]
    # Column by column, so that those nobody reads are not made; all of them take the same row.
    return chosen.groupBy("doc_id", "record_id", "path_text").agg(
        *[F.max_by(c, "ord").alias(c) for c in columns]
    )


def highlight(matches: DataFrame, pattern: str) -> DataFrame:
    """``key_segments`` and ``value_segments`` of matches, marked and unmarked.

    A match in the path alone marks the whole key.
    """
    key, value = F.col("key_label"), F.col("value_label")
    whole = F.array(F.struct(key.alias("text"), F.lit(True).alias("marked")))
    plain_key = F.array(F.struct(key.alias("text"), F.lit(False).alias("marked")))
    plain_value = F.array(F.struct(value.alias("text"), F.lit(False).alias("marked")))
    return matches.select(
        "*",
        F.when(F.size("key_ranges") > 0, segments(key, pattern))
        .when(F.size("path_ranges") > 0, whole)
        .otherwise(plain_key)
        .alias("key_segments"),
        F.when(F.size("value_ranges") > 0, segments(value, pattern))
        .otherwise(plain_value)
        .alias("value_segments"),
    )
