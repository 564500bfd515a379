"""Operator 11: prefix trie of conversations by vertical bitmaps.

Conversations go by range of ids into shards of some thousand.  A shard's index is
vertical: each (position, turn) has the bitset of the shard's conversations that hold the
turn there.  The trie comes out depth first: a node's bitset, intersected with the
postings of the next position, gives its children; popcounts are the numbers of members,
and the members that have no next turn are the node's end list.

Shards are merged by name, a 128-bit hash chained over the turns: a hot node is one row a
shard, not one a conversation.  What is summed over subtrees adds up over shards, too,
once every node has an owner, its smallest member: a conversation owns a tail of its own
path, so a second walk counts in every shard, with one conversation's bit for each node,
only what that shard's owners bring (leaves, and the one member that does not save
tokens).  Shards are ranges of ids, so an end list is a concatenation of the shards' lists
in order and is hashed as a stream.

Turns go by `turn` (null first), then role, then the text's first HEAD characters, then
its hash; repeated rows are turns of their own.  Null roles and texts are empty.  Rows
with a null conv_id belong to no conversation.  An empty table has no node, not even the
root.  A conversation's turns, 16 bytes and a count each, are one row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from jsonloom.llm.common import Scratch, arrow_map, shuffle_partitions

#: Characters of a text that order turns with equal `turn` and role.
HEAD = 64
#: Conversations and turns in a shard (a longer conversation, or block, is a shard of its own).
SHARD, SHARD_TURNS = 4096, 1 << 18
WIDTH = 16
ROOT = bytes(WIDTH)


@dataclass(frozen=True)
class Sharing:
    """A conversation starts with up to `most` - 1 turns of the first one of its block of ids.

    crc32(id) % most tells how many; the block of c begins at c - c % every.
    """

    every: int = 20
    most: int = 4

    def shared(self, conv_id: int) -> int:
        return zlib.crc32(str(conv_id).encode()) % self.most


def keyed_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, head, key, words) of each row: what is left of a text is its head and hash."""

    def run(conv_id, turn, role, text):
        roles, texts = ([x or "" for x in column.to_pylist()] for column in (role, text))
        keys, words = [], []
        for r, t in zip(roles, texts, strict=True):
            a, b = r.encode("utf-8", "surrogatepass"), t.encode("utf-8", "surrogatepass")
            keys.append(xxhash.xxh3_128_digest(b"%d:%b%b" % (len(a), a, b)))
            words.append(len(b.split()))
        return [conv_id, turn, roles, [t[:HEAD] for t in texts], keys, words]

    kinds = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    schema = "conv_id {}, turn {}, role string, head string, key binary, words int".format(*kinds)
    wanted = rows.filter("conv_id is not null").select("conv_id", "turn", "role", "text")
    return arrow_map(wanted, run, schema)


TALKS = "conv_id bigint, block bigint, part int, keys binary, words array<int>"


def talks_of(turns: DataFrame, sharing: Sharing | None) -> DataFrame:
    """One row per conversation, rebuilt by `sharing`; ranges of ids stay together in a `part`."""
    out = to_arrow_schema(StructType.fromDDL(TALKS))
    c = F.col("conv_id").cast("bigint")
    block = c - c % sharing.every if sharing else c
    ordered = (
        turns.withColumns({"conv_id": c, "block": block})
        .repartitionByRange(shuffle_partitions(turns.sparkSession), "block")
        .sortWithinPartitions(
            "block", F.col("conv_id") != F.col("block"), "conv_id", F.col("turn").asc_nulls_first(), "role", "head", "key"
        )
        .select("conv_id", "block", "key", "words")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        current, own, heads = None, [], (None, [])

        def rebuilt():
            nonlocal heads
            conv_id, block = current
            turns = own
            if sharing:
                if conv_id == block:
                    heads = (block, own[: sharing.most - 1])
                h = sharing.shared(conv_id)
                turns = (heads[1][:h] if heads[0] == block else []) + own[h:]
            return conv_id, block, part, b"".join(k for k, _ in turns), [n for _, n in turns]

        for batch in batches:
            found = []
            for conv_id, block, key, words in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (conv_id, block) != current:
                    if current:
                        found.append(rebuilt())
                    current, own = (conv_id, block), []
                own.append((key, words))
            if found:
                yield _batch(found, out)
        if current:
            yield _batch([rebuilt()], out)

    return ordered.mapInArrow(run, TALKS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


class Shard:
    """The vertical index of some conversations (id, keys, words, ...) and the trie that it holds."""

    def __init__(self, talks: list[tuple]):
        talks = sorted(talks)
        self.ids = [t[0] for t in talks]
        self.keys = [t[1] for t in talks]
        self.words = [t[2] for t in talks]
        self.postings: dict[tuple[int, bytes], int] = {}
        self.longer: list[int] = []
        for i, keys in enumerate(self.keys):
            bit = 1 << i
            n = len(keys) // WIDTH
            self.longer.extend([0] * (n - len(self.longer)))
            for d in range(n):
                self.longer[d] |= bit
                place = d, keys[d * WIDTH : d * WIDTH + WIDTH]
                self.postings[place] = self.postings.get(place, 0) | bit

    def nodes(self) -> list[tuple[bytes, int, int, int, int, int, int]]:
        """(name, place of the parent, depth, lowest member, members, bitset of ends, words), depth first."""
        found = []
        stack = [((1 << len(self.ids)) - 1, 0, ROOT, -1, 0)]
        while stack:
            bits, depth, name, parent, words = stack.pop()
            at = len(found)
            left = bits & self.longer[depth] if depth < len(self.longer) else 0
            found.append((name, parent, depth, low(bits), bits.bit_count(), bits ^ left, words))
            while left:
                i = low(left)
                key = self.keys[i][depth * WIDTH : depth * WIDTH + WIDTH]
                child = left & self.postings[depth, key]
                stack.append((child, depth + 1, xxhash.xxh3_128_digest(name + key), at, self.words[i][depth]))
                left ^= child
        return found

    def ends(self, bits: int) -> str:
        ids = []
        while bits:
            i = low(bits)
            ids.append(str(self.ids[i]))
            bits &= bits - 1
        return ",".join(ids)


def low(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def shards(batches: Iterator[pa.RecordBatch], size: int, *more: str) -> Iterator[list[tuple]]:
    """Conversations (conv_id, keys, words, more columns) by shard; a block, or a part's end, is not torn."""
    held, turns, last = [], 0, None
    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("part", "block", "conv_id", "keys", "words", *more))
        for part, block, *talk in zip(*columns, strict=True):
            full = len(held) >= size or turns >= SHARD_TURNS
            if held and (part != last[0] or (full and block != last[1])):
                yield held
                held, turns = [], 0
            held.append(tuple(talk))
            turns += len(talk[2])
            last = part, block
    if held:
        yield held


NODES = "name binary, parent binary, depth int, conv_id bigint, n bigint, first bigint, ends string"
SUMS = "name binary, saved bigint, leaves bigint"


def shard_nodes(talks: DataFrame, size: int = SHARD) -> DataFrame:
    """Each shard's nodes: smallest member, number of members, end list."""
    out = to_arrow_schema(StructType.fromDDL(NODES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in shards(batches, size):
            shard = Shard(held)
            nodes = shard.nodes()
            rows = [
                (name, nodes[up][0] if up >= 0 else None, depth, shard.ids[i], n, shard.ids[0], shard.ends(ends) if ends else None)
                for name, up, depth, i, n, ends, _ in nodes
            ]
            for k in range(0, len(rows), 10_000):
                yield _batch(rows[k : k + 10_000], out)

    return talks.mapInArrow(run, NODES)


def shard_sums(owned: DataFrame, size: int = SHARD) -> DataFrame:
    """Each shard's share of what is summed over the subtrees: saved tokens and leaves.

    Rows also have `since`, the depth from which a conversation owns its nodes (null: none),
    and `leaf`, whether its last node is a leaf and its own.
    """
    out = to_arrow_schema(StructType.fromDDL(SUMS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in shards(batches, size, "since", "leaf"):
            shard = Shard([t[:3] for t in held])
            since = {t[0]: t[3] for t in held}
            leaf = {t[0]: t[4] for t in held}
            nodes = shard.nodes()
            saved, leaves = [0] * len(nodes), [0] * len(nodes)
            for at in range(len(nodes) - 1, -1, -1):
                _, up, depth, i, n, ends, words = nodes[at]
                owner = shard.ids[i]
                owns = since[owner] is not None and since[owner] <= depth
                saved[at] += (n - owns) * words
                leaves[at] += bool(owns and leaf[owner] and ends >> i & 1)
                if up >= 0:
                    saved[up] += saved[at]
                    leaves[up] += leaves[at]
            rows = [(x[0], s, k) for x, s, k in zip(nodes, saved, leaves, strict=True)]
            for k in range(0, len(rows), 10_000):
                yield _batch(rows[k : k + 10_000], out)

    return owned.mapInArrow(run, SUMS)


def end_digests(parts: DataFrame) -> DataFrame:
    """SHA-256 of each node's end list, streamed over the shards' lists in order of ids."""
    schema = "name binary, ends_sha256 string"
    out = to_arrow_schema(StructType.fromDDL(schema))
    n = shuffle_partitions(parts.sparkSession)
    ordered = parts.filter("ends is not null").select("name", "first", "ends")
    ordered = ordered.repartition(n, "name").sortWithinPartitions("name", "first").select("name", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        for batch in batches:
            found = []
            for name, ends in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if name == current:
                    digest.update(b",")
                else:
                    if current is not None:
                        found.append((current, digest.hexdigest()))
                    current, digest = name, hashlib.sha256()
                digest.update(ends.encode())
            if found:
                yield _batch(found, out)
        if current is not None:
            yield _batch([(current, digest.hexdigest())], out)

    return ordered.mapInArrow(run, schema)


def trie(rows: DataFrame, sharing: Sharing | None = None, shard: int = SHARD) -> DataFrame:
    """One row per node: name, parent, conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = Scratch(rows.sparkSession)
    turns = scratch.store(keyed_turns(rows), "trie-turns")
    talks = scratch.store(talks_of(turns, sharing), "trie-talks")
    scratch.drop(turns)
    parts = scratch.store(shard_nodes(talks, shard), "trie-shards")
    merged = parts.groupBy("name").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs")
    )
    nodes = scratch.store(merged, "trie-nodes")
    children = nodes.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).filter("parent is not null")
    children = scratch.store(children.withColumnRenamed("parent", "name"), "trie-children")
    leaf = F.col("n_children").isNull()
    owners = nodes.join(children, "name", "left").groupBy("conv_id").agg(F.min("depth").alias("since"), F.max(leaf).alias("leaf"))
    sums = shard_sums(talks.join(scratch.store(owners, "trie-owners"), "conv_id", "left"), shard)
    # everything about a node comes together by name in one exchange
    facts = (
        nodes.unionByName(children, True)
        .unionByName(end_digests(parts), True)
        .unionByName(sums, True)
        .groupBy("name")
        .agg(
            *(F.max(c).alias(c) for c in ("parent", "depth", "conv_id", "n_convs", "n_children", "ends_sha256")),
            *(F.sum(c).alias(c) for c in ("saved", "leaves")),
        )
    )
    facts = scratch.store(facts, "trie-facts")
    parents = facts.filter("n_children is not null").select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    parents = scratch.store(parents, "trie-parents")
    none = hashlib.sha256(b"").hexdigest()
    found = facts.join(parents, "parent", "left").select(
        "name",
        "parent",
        "conv_id",
        F.col("depth").cast("bigint").alias("depth"),
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
    found = scratch.store(found, "trie")
    scratch.drop_all(found)
    return found


#: crc32 of a decimal number, bit by bit; the rest groups prefixes of whole turn lists.
ORACLE = r"""
WITH t AS (
    SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
k AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)),
        4294967295) % 4 AS h FROM t),
r AS (SELECT k.conv_id, list_concat(coalesce(p.own[1:k.h], []), k.own[k.h + 1:]) AS l
    FROM k LEFT JOIN t p ON p.conv_id = k.conv_id - k.conv_id % 20),
m AS (SELECT conv_id, d, l[1:d] AS pre, len(l) = d AS last FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM r)),
n AS (SELECT d, pre, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256,
        CASE WHEN d = 0 THEN 0 ELSE len([x FOR x IN string_split_regex(pre[d].t, '[\x20\x09-\x0D]+') IF x <> '']) END AS words
    FROM m GROUP BY d, pre),
c AS (SELECT a.d, a.pre, count(*) FILTER (WHERE b.d = a.d + 1) AS n_children, sum((b.n_convs - 1) * b.words)::BIGINT AS saved_tokens
    FROM n a JOIN n b ON b.d >= a.d AND b.pre[1:a.d] = a.pre GROUP BY a.d, a.pre),
v AS (SELECT a.d, a.pre, count(*) AS n_leaves FROM n a JOIN c b ON b.d >= a.d AND b.pre[1:a.d] = a.pre AND b.n_children = 0 GROUP BY a.d, a.pre)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, c.n_children, v.n_leaves, c.saved_tokens, n.ends_sha256
FROM n JOIN c USING (d, pre) JOIN v USING (d, pre) LEFT JOIN n p ON p.d = n.d - 1 AND p.pre = n.pre[1:n.d - 1]
"""
