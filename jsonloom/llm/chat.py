"""Operator 9: chat formatting over a prefix tree.

A turn becomes `### role: text</turn>` and a line end.  A backslash goes in front of
backslashes and control strings inside texts, so the format can be read back.
Conversations that share initial turns share nodes of one tree: a prefix of turns is named
by a hash chained over it, and a node is a run of turns up to the next prefix where
conversations part or end, so the tree is built by grouping on names and a long
conversation of its own is one node.  Nodes come out once, depth first (a node's path is a prefix of its children's), as
tokens with a place in one global stream, position ids that count from the root, and
the intervals of the stream that hold its ancestors, which with the node itself are all
that it may attend to.  The loss mask covers the text of assistant turns.

A tree may hold a third of all conversations: nodes are sorted by range, places come
from sums by task, ancestors from joins, and equal conversations meet in one leaf, so no
tree is ever gathered.  A conversation's own turns are.

Rows of a conversation go by turn, then role and text; repeated rows are turns of their
own.  Null texts and roles are empty.  Rows with a null conv_id form one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from jsonloom.llm.common import shuffle_partitions, stored
from jsonloom.llm.packing import encoder

#: Fixed values of the template.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
LEARNED_ROLE = "assistant"
IN_TEXT = re.compile(r"\\|###|</turn>")
IN_ROLE = re.compile(r"\\|###|</turn>|:")
ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
END_OF_ROLE = re.compile(r"\\(?:\\|###|</turn>|:)|: ")
END_OF_TEXT = re.compile(r"\\(?:\\|###|</turn>)|</turn>\n")


def mark(text: str, what: re.Pattern) -> str:
    return what.sub(lambda m: "\\" + m[0], text)


def unmark(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation."""
    turns, at = [], 0

    def until(end: re.Pattern, start: int) -> tuple[str, int]:
        for m in end.finditer(text, start):
            if m[0][0] != "\\":
                return unmark(text[start : m.start()]), m.end()
        raise ValueError("a turn does not end")

    while at < len(text):
        if not text.startswith(OPEN, at):
            raise ValueError("a turn does not start")
        role, at = until(END_OF_ROLE, at + len(OPEN))
        said, at = until(END_OF_TEXT, at)
        turns.append((role, said))
    return turns


def chain_names(turns: Column) -> Column:
    """The name of each prefix of the turns: a hash of the name before, the role and the text."""

    def extend(names: Column, t: Column) -> Column:
        before = F.coalesce(F.try_element_at(names, F.lit(-1)), F.lit(""))
        size = F.length(t["role"]).cast("string")
        return F.array_append(
            names, F.substring(F.sha2(F.concat(before, size, F.lit(":"), t["role"], t["text"]), 256), 1, 32)
        )

    return F.aggregate(turns, F.array().cast("array<string>"), extend)


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns, names): the turns in order and the names of their prefixes."""
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return (
        rows.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .withColumn("names", chain_names(F.col("turns")))
    )


LOSS = "array<struct<start: int, end: int>>"
NODE = f"name string, path string, task int, place bigint, tokens array<int>, loss {LOSS}"


def emit(nodes: DataFrame, tokenizer: str) -> DataFrame:
    """Tokens of nodes that lie in depth-first order in their tasks, with places within the task."""
    out = to_arrow_schema(StructType.fromDDL(NODE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = batch.to_pylist()
            turns = [t for r in rows for t in r["turns"]]
            parts = [OPEN + mark(t["role"], IN_ROLE) + MIDDLE for t in turns]
            parts += [mark(t["text"], IN_TEXT) for t in turns] + [CLOSE]
            ids = [memoryview(x).cast("I").tolist() for x in encoder(tokenizer, plain=True).encode(parts)]
            heads, bodies, end = iter(ids), iter(ids[len(turns) :]), ids[-1]
            result = []
            for r in rows:
                tokens, loss = [], []
                for t in r["turns"]:
                    tokens += next(heads)
                    body = next(bodies)
                    if t["role"] == LEARNED_ROLE:
                        loss.append({"start": len(tokens), "end": len(tokens) + len(body)})
                    tokens += body + end
                result.append((r["name"], r["path"], task, place, tokens, loss))
                place += len(tokens)
            columns = zip(*result, strict=True) if result else [()] * len(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, type=f.type) for x, f in zip(columns, out, strict=True)], schema=out
            )

    return nodes.select("name", "path", "turns").mapInArrow(run, NODE)


def runs_of_turns(talks: DataFrame) -> DataFrame:
    """The nodes of the tree: name (of the last prefix), path (names from the root), turns."""
    last = F.element_at("names", -1).alias("last")
    once = stored(
        talks.groupBy(last).agg(F.first("names").alias("names"), F.first("turns").alias("turns")), "chat-distinct"
    )
    steps = once.select("last", F.posexplode("names").alias("i", "name"), "names").select(
        "last", "i", "name", F.try_element_at("names", F.greatest("i", F.lit(1))).alias("parent")
    )
    inner = steps.filter("i > 0").select("parent", "name").distinct()
    parting = inner.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("parent")
    cuts = parting.union(once.select("last")).distinct().toDF("name")
    ends = steps.join(cuts, "name", "left_semi").groupBy("last").agg(F.sort_array(F.collect_list("i")).alias("ends"))
    k = F.col("k")
    nodes = once.join(ends, "last").select("names", "turns", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.coalesce(F.try_element_at("ends", F.greatest(k, F.lit(1))), F.lit(-1)) + 1
    start = F.when(k > 0, start).otherwise(0)
    return (
        nodes.select(
            F.element_at("names", F.col("end") + 1).alias("name"),
            F.array_join(
                F.transform(F.slice("ends", F.lit(1), k + 1), lambda e: F.element_at(F.col("names"), e + 1)), ""
            ).alias("path"),
            F.slice("turns", start + 1, F.col("end") - start + 1).alias("turns"),
        )
        .groupBy("name")
        .agg(F.first("path").alias("path"), F.first("turns").alias("turns"))
    )


def format_tree(rows: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves).

    nodes: start, end (places in the stream), position (position id of the first token),
    attends (ancestors' intervals in the stream), tokens, loss (intervals of tokens under
    the loss mask).  leaves: conv_id, n_turns, leaf (start of its last node).
    """
    talks = stored(conversations(rows), "chat-conversations")
    ordered = runs_of_turns(talks)
    n = shuffle_partitions(rows.sparkSession)
    ordered = ordered.repartitionByRange(n, "path").sortWithinPartitions("path")
    placed = stored(emit(ordered, tokenizer), "chat-nodes")
    totals = placed.groupBy("task").agg(F.sum(F.size("tokens")).alias("total"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    bases = totals.select("task", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    start = (F.col("base") + F.col("place")).alias("start")
    spans = stored(
        placed.join(bases, "task").select("name", "path", start, (start + F.size("tokens")).alias("end")),
        "chat-places",
    )
    names = F.transform(
        F.sequence(F.lit(1), F.length("path") - 63, F.lit(32)), lambda i: F.substring(F.col("path"), i, F.lit(32))
    )
    above = (
        spans.filter(F.length("path") > 32)
        .select("name", F.explode(names).alias("above"))
        .join(spans.select(F.col("name").alias("above"), F.struct("start", "end").alias("interval")), "above")
        .groupBy("name")
        .agg(F.sort_array(F.collect_list("interval")).alias("attends"))
    )
    attends = F.coalesce("attends", F.array().cast("array<struct<start: bigint, end: bigint>>"))
    position = F.aggregate(attends, F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    nodes = stored(
        placed.select("name", "tokens", "loss")
        .join(spans.select("name", "start", "end"), "name")
        .join(above, "name", "left")
        .select("name", "start", "end", position.alias("position"), attends.alias("attends"), "tokens", "loss"),
        "chat-output",
    )
    last = talks.select("conv_id", F.size("names").cast("bigint").alias("n_turns"), F.element_at("names", -1).alias("name"))
    leaves = last.join(nodes.select("name", F.col("start").alias("leaf")), "name").drop("name")
    return nodes.drop("name"), leaves


DIGEST = "leaf bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(nodes: DataFrame, leaves: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of the conversations, from the tokens that their leaves attend to and the loss mask."""
    wanted = leaves.select("leaf").distinct()
    ends = nodes.join(wanted, nodes["start"] == wanted["leaf"], "left_semi")
    own = F.array(F.struct("start", "end"))
    seen = ends.select(F.col("start").alias("leaf"), F.explode(F.concat("attends", own)).alias("seen"))
    parts = (
        seen.select("leaf", F.col("seen.start").alias("start"))
        .join(nodes.select("start", "position", "tokens", "loss"), "start")
        .groupBy("leaf")
        .agg(F.sort_array(F.collect_list(F.struct("position", "tokens", "loss"))).alias("parts"))
    )

    schema = to_arrow_schema(StructType.fromDDL(DIGEST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(tokenizer, plain=True).tokenizer
        for batch in batches:
            out = []
            for leaf, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = library.decode([i for p in parts for i in p["tokens"]], skip_special_tokens=False)
                turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, said in read_turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                learned = 0
                for tokens, x in ((p["tokens"], x) for p in parts for x in p["loss"]):
                    said = unmark(library.decode(tokens[x["start"] : x["end"]], skip_special_tokens=False))
                    learned += len(said)
                    loss.update(said.encode())
                out.append((leaf, turns.hexdigest(), learned, loss.hexdigest(), len(text)))
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, type=f.type) for x, f in zip(columns, schema, strict=True)], schema=schema
            )

    return leaves.join(parts.mapInArrow(run, DIGEST), "leaf").drop("leaf")
