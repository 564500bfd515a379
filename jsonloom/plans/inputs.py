"""Documents and lines that carry JSON inside strings, made from the tables.

Groups that become one text are bounded: forty consecutive events per blob,
sixteen consecutive turns per session part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOB_EVENTS = 40
SESSION_TURNS = 16
#: Rows of a table that one task expands at most.
TASK_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str | Column) -> DataFrame:
    """Columns of a table, spread over tasks of at most ``TASK_ROWS`` rows and over the cores.

    Expansion is work per row, and narrow, so a task's time goes by its rows: a split of
    short rows holds millions of them.  Their number comes from the files' footers.  A table
    whose splits are small and many enough is read without a shuffle.
    """
    whole = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = whole.select(*columns or ["*"])
    tasks = max(spark.sparkContext.defaultParallelism, -(-whole.count() // TASK_ROWS))
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def _event_text() -> Column:
    return F.to_json(F.struct(F.col("event_type").alias("event"), "user_id", "value", "props"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as one JSON Lines log; ``props`` is JSON in a string."""
    events = table(spark, sf_dir, "events", "event_id", "event_type", "user_id", "value", "props")
    return events.select(
        F.lit("events").alias("doc_id"),
        (F.col("event_id") + 1).alias("line_number"),
        _event_text().alias("text"),
    )


def double_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the event log with ``props`` encoded twice."""
    events = table(spark, sf_dir, "events", "event_id", "props")
    escaped = F.replace("props", F.lit('"'), F.lit('\\"'))
    twice = F.concat(F.lit('"'), escaped, F.lit('"'))
    return events.select(
        F.lit("events").alias("doc_id"),
        (F.col("event_id") + 1).alias("line_number"),
        F.to_json(F.struct(twice.alias("props"))).alias("text"),
    )


def event_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of forty event lines.

    Events whose id divides by 17 are cut off and so invalid, those whose id
    divides by 23 are followed by a blank line; lines end with CR LF where the id
    is even.  Every third blob has no invalid lines.
    """
    events = table(spark, sf_dir, "events", "event_id", "event_type", "user_id", "value", "props")
    event_id = F.col("event_id")
    blob = F.floor(event_id / BLOB_EVENTS).cast("bigint")
    line = _event_text()
    cut = (event_id % 17 == 0) & (blob % 3 != 0)
    bad = F.when(cut, F.left(line, F.length(line) - 1)).otherwise(line)
    end = F.when(event_id % 2 == 0, "\r\n").otherwise("\n")
    with_blank = F.concat(bad, F.when(event_id % 23 == 0, F.concat(F.lit("\n"), end)).otherwise(end))
    lines = events.select(blob.alias("doc_id"), "event_id", with_blank.alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "line")))
    return lines.groupBy("doc_id").agg(
        F.array_join(F.transform(ordered, lambda r: r["line"]), "").alias("text")
    )


def order_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per order with a stringified array of one to five steps,
    each of which holds a stringified note."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    count = (1 + F.col("o_orderkey") % 5).cast("int")

    def step(i: Column) -> Column:
        note = F.to_json(F.struct(F.col("o_custkey").alias("customer"), (i * 10).alias("rank")))
        return F.struct(i.alias("step"), note.alias("note"))

    items = F.to_json(F.transform(F.sequence(F.lit(1), count), step))
    return orders.select(
        F.col("o_orderkey").alias("doc_id"),
        F.to_json(
            F.struct("o_orderkey", F.col("o_orderstatus").alias("status"), items.alias("items"))
        ).alias("text"),
    )


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in parts of sixteen turns: a stringified array of messages
    whose payloads are stringified again."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    payload = F.to_json(F.struct("role", "turn", "text"))
    part = F.floor(F.col("turn") / SESSION_TURNS).cast("bigint")
    rows = turns.select("conv_id", part.alias("part"), "turn", payload.alias("payload"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "payload")))
    messages = F.to_json(F.transform(ordered, lambda m: F.struct(m["payload"].alias("payload"))))
    grouped = rows.groupBy("conv_id", "part").agg(messages.alias("messages"))
    return grouped.select(
        F.concat_ws("-", "conv_id", "part").alias("doc_id"),
        F.to_json(F.struct("conv_id", "part", "messages")).alias("text"),
    )


def document_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table as JSON records with the whole text of each."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    return docs.select("doc_id", F.to_json(F.struct("doc_id", "lang", "text")).alias("text"))


def keyed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with integer-like, repeated and plain keys, in awkward order."""
    parts = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand")
    size, key = F.col("p_size"), F.col("p_partkey")
    pieces = [
        F.lit('{"name":"'), "p_brand", F.lit('","'), (size + 100).cast("string"), F.lit('":1,"'),
        size.cast("string"), F.lit('":2,"0'), size.cast("string"), F.lit('":3,"name":"'),
        key.cast("string"), F.lit('"}'),
    ]
    return parts.select(key.alias("doc_id"), F.concat(*pieces).alias("text"))
