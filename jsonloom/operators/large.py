"""One JSON document over many splits: its top-level elements, found in parallel.

A file is read in pieces between commas, in splits as Spark cuts them, and no piece knows
where it stands.  Whether it starts inside a string is the parity of the quotes before it;
given that, its brackets count, and how deep it starts is a sum over the pieces before.
Both are prefix sums: within a split by a window, over the splits by a window on one row
per split, which holds the split's sums for either state that it may begin in.  A comma
outside strings at depth one ends a top-level element; its pieces come together as one
text, and elements are parsed and expanded like records.

So what has to fit a row is an element of the outermost container, not the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jsonloom.config import scratch_path
from jsonloom.functions.cells import INDEX_KEY, LAST_INDEX_KEY, parse_text
from jsonloom.functions.paths import segment_text
from jsonloom.functions.text import JSON_WHITESPACE, json_trim
from jsonloom.operators.expand import DEFAULT_MAX_DEPTH, expand_cells
from jsonloom.operators.records import INVALID
from jsonloom.sources.documents import without_mark

BRACKETS = {"[": "]", "{": "}"}


def _written(df: DataFrame, name: str, scratch: list[str] | None) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    if scratch is not None:
        scratch.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _pieces(spark: SparkSession, paths: str | list[str], wanted: Column | None) -> DataFrame:
    """Pieces with their unescaped quotes, and the change of depth if they start outside (even) or inside a string."""
    raw = spark.read.option("lineSep", ",").text(paths).select(
        F.col("_metadata.file_path").alias("doc_id"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("text"),
    )
    raw = raw if wanted is None else raw.where(wanted)
    # An escape never reaches over a comma: "\," is none.
    plain = F.replace(F.replace("text", F.lit("\\\\"), F.lit("__")), F.lit('\\"'), F.lit("__"))

    def depth(parity: int) -> Column:
        own = F.array_join(F.filter("parts", lambda _, i: i % 2 == parity), "")
        return _count(own, "[{") - _count(own, "]}")

    parts = raw.withColumn("parts", F.split(plain, '"', -1))
    return parts.select(
        "doc_id", "file_size", "block", "row", "text", (F.size("parts") - 1).alias("quotes"),
        depth(0).alias("even"), depth(1).alias("odd"),
    )


def _placed(
    spark: SparkSession, paths: str | list[str], scratch: list[str] | None, wanted: Column | None
) -> DataFrame:
    """Pieces with ``inside`` and ``depth`` at their ends."""
    split = Window.partitionBy("doc_id", "block").orderBy("row")
    before = split.rowsBetween(Window.unboundedPreceding, -1)
    upto = split.rowsBetween(Window.unboundedPreceding, 0)
    pieces = _pieces(spark, paths, wanted).withColumn("parity", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    as_is = F.when(F.col("parity") == 0, F.col("even")).otherwise(F.col("odd"))
    other = F.when(F.col("parity") == 0, F.col("odd")).otherwise(F.col("even"))
    pieces = pieces.withColumns({"d0": F.sum(as_is).over(upto), "d1": F.sum(other).over(upto)})
    pieces = _written(pieces, "pieces", scratch)
    last = lambda c: F.max_by(c, "row").alias(c)
    splits = pieces.groupBy("doc_id", "block").agg(F.sum("quotes").alias("q"), last("d0"), last("d1"))
    earlier = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("starts", F.coalesce(F.sum("q").over(earlier), F.lit(0)) % 2)
    change = F.when(F.col("starts") == 0, F.col("d0")).otherwise(F.col("d1"))
    splits = splits.select("doc_id", "block", "starts", F.coalesce(F.sum(change).over(earlier), F.lit(0)).alias("base"))
    splits = _written(splits, "piece-splits", scratch)
    depth = F.col("base") + F.when(F.col("starts") == 0, F.col("d0")).otherwise(F.col("d1"))
    inside = (F.col("starts") + F.col("parity") + F.col("quotes")) % 2 == 1
    placed = pieces.join(splits, ["doc_id", "block"])
    return placed.select("doc_id", "file_size", "block", "row", "text", inside.alias("inside"), depth.alias("depth"))


def elements(
    spark: SparkSession, paths: str | list[str], scratch: list[str] | None = None, wanted: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(documents, elements)`` of files that hold one JSON document each, those that ``wanted`` (on ``doc_id``) names.

    documents: ``doc_id, open`` (the outer bracket; null: no container, or none that ends
    where the file does).  elements: ``doc_id, block, row`` (their order), ``text``.
    """
    ends = (F.col("depth") == 1) & ~F.col("inside")
    split = Window.partitionBy("doc_id", "block").orderBy("row")
    placed = _placed(spark, paths, scratch, wanted).withColumn(
        "element", F.coalesce(F.sum(ends.cast("int")).over(split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    placed = _written(placed, "placed", scratch)
    order = F.struct("block", "row")
    trimmed = without_mark(F.col("text"))
    whole = placed.groupBy("doc_id").agg(
        F.min_by(F.left(F.ltrim(trimmed, F.lit(JSON_WHITESPACE)), F.lit(1)), order).alias("first"),
        F.max_by(F.right(F.rtrim("text", F.lit(JSON_WHITESPACE)), F.lit(1)), order).alias("last"),
        F.max_by(F.struct("depth", "inside"), order).alias("end"),
        F.count_if(F.col("depth") < 1).alias("closed"),
        # a comma at the end of a file would be one byte short; a byte order mark, if the reader takes it off, is three
        (F.max("file_size") - F.sum(F.octet_length("text") + 1) + 1).isin(0, 3).alias("all_read"),
        F.min(order).alias("head"),
        F.max(order).alias("tail"),
    )
    sound = F.col("all_read") & (F.col("end.depth") == 0) & ~F.col("end.inside") & (F.col("closed") == 1)
    pairs = F.lit(False)
    for a, b in BRACKETS.items():
        pairs = pairs | ((F.col("first") == a) & (F.col("last") == b))
    documents = whole.select("doc_id", F.when(sound & pairs, F.col("first")).alias("open"), "head", "tail")
    documents = _written(documents, "large-documents", scratch)
    # an element that goes over splits has a part in each of them
    counts = placed.groupBy("doc_id", "block").agg(F.count_if(ends).alias("n"))
    earlier = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("doc_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    counts = _written(counts, "element-counts", scratch)
    text = F.when(order == F.col("head"), F.substr(F.ltrim(trimmed, F.lit(JSON_WHITESPACE)), F.lit(2))).otherwise(F.col("text"))
    closed = F.rtrim(text, F.lit(JSON_WHITESPACE))
    text = F.when(order == F.col("tail"), F.left(closed, F.length(closed) - 1)).otherwise(text)
    parts = F.array_sort(F.collect_list(F.struct("block", "row", text.alias("text"))))
    found = (
        placed.join(counts, ["doc_id", "block"])
        .join(documents.where("open is not null").select("doc_id", "head", "tail"), "doc_id")
        .groupBy("doc_id", (F.col("earlier") + F.col("element")).alias("place"))
        .agg(parts.alias("parts"))
        .select("doc_id", "place", F.array_join(F.transform("parts", lambda p: p["text"]), ",").alias("text"))
    )
    return documents.select("doc_id", "open"), found


def _in_object_order(members: DataFrame) -> DataFrame:
    """Repeated keys in their first place with the last value; index keys first, by number.

    The rank is one window over a document's keys.
    """
    once = members.groupBy("doc_id", "key").agg(F.min("place").alias("place"), F.max_by("cell", "place").alias("cell"))
    number = F.when(F.col("key").rlike(INDEX_KEY), F.col("key").try_cast("bigint"))
    number = F.when(number <= LAST_INDEX_KEY, number)
    order = Window.partitionBy("doc_id").orderBy(number.isNull(), F.coalesce(number, F.col("place")))
    return once.withColumn("i", F.row_number().over(order) - 1)


def expand_large(
    spark: SparkSession,
    paths: str | list[str],
    max_depth: int = DEFAULT_MAX_DEPTH,
    levels: int | None = None,
    scratch: list[str] | None = None,
    wanted: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(nodes, failed)`` of files that hold one JSON object or array each, of any size.

    The nodes are those of :func:`jsonloom.operators.expand.expand`, but for the root,
    which is in ``nodes`` without its texts.  failed: ``doc_id, error``.  ``levels`` counts
    from the root.
    """
    documents, found = elements(spark, paths, scratch, wanted)
    opened = found.join(documents, "doc_id")
    blank = json_trim(F.col("text")) == ""
    closing = F.when(F.col("open") == "{", "}").otherwise("]")
    value = parse_text(F.concat("open", "text", closing))
    parsed = opened.select("doc_id", "place", "open", blank.alias("blank"), F.explode_outer(F.array(value)).alias("value"))
    one = F.get("value.children", F.lit(0))
    parsed = parsed.select(
        "doc_id", "place", "open", "blank", F.size("value.children").alias("n"), one["key"].alias("key"), one["cell"].alias("cell")
    )
    parsed = _written(parsed, "large-elements", scratch)
    # an element holds one value; a blank one is the whole of an empty container
    checked = parsed.groupBy("doc_id", "open").agg(
        F.count_if(F.coalesce(F.col("n"), F.lit(-1)) != 1).alias("wrong"), F.count("*").alias("n"), F.count_if("blank").alias("blanks")
    )
    good = (F.col("wrong") == 0) | ((F.col("n") == 1) & (F.col("blanks") == 1))
    roots = _written(checked.where(good).select("doc_id", "open"), "large-roots", scratch)
    failed = documents.join(roots.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(INVALID).alias("error"))
    values = parsed.where("n = 1").join(roots.select("doc_id"), "doc_id", "left_semi")
    members = _in_object_order(values.where("open = '{'")).select("doc_id", "i", "key", "cell", F.lit(True).alias("member"))
    items = values.where("open = '['").select(
        "doc_id", F.col("place").alias("i"), F.col("place").cast("string").alias("key"), "cell", F.lit(False).alias("member")
    )
    children = _written(members.unionByName(items), "large-children", scratch)
    none = F.array().cast("array<int>")
    rows = children.select(
        "doc_id",
        F.lit(1).cast("bigint").alias("line_number"),
        F.array(F.col("i").cast("int")).alias("ord"),
        F.array(F.lit("$"), F.col("key")).alias("path"),
        F.concat(F.lit("$"), segment_text(F.col("key"))).alias("path_text"),
        none.alias("layers"),
        "member",
        "cell",
    )
    below = expand_cells(rows, max_depth, None if levels is None else levels - 1, scratch)
    counts = roots.join(children.groupBy("doc_id").agg(F.count("*").cast("int").alias("k")), "doc_id", "left")
    kind = F.when(F.col("open") == "{", "object").otherwise("array")
    known = {
        "doc_id": F.col("doc_id"), "record_id": F.lit("record-1"), "source_line": F.lit(1).cast("bigint"), "ord": none,
        "path": F.array(F.lit("$")), "path_text": F.lit("$"), "depth": F.lit(0), "kind": kind, "n_children": F.coalesce("k", F.lit(0)),
        "was_stringified": F.lit(False), "expandable": F.lit(True), "restorable": F.lit(False), "member": F.lit(False),
        "layers": none, "stringified_chain": F.array().cast("array<string>"),
    }
    root = counts.select(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in below.schema.fields))
    return root.unionByName(below), failed
