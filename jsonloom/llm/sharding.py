"""Operator 12: uniform shuffle into shards by a hypergeometric communication matrix.

The rows lie in source blocks (a writing task's rows, a million at a time).  How many rows
each block sends to each shard is drawn first: a matrix whose rows sum to the blocks'
sizes and whose columns sum to the shards' sizes, distributed as in a uniform shuffle
(one hypergeometric draw after another, for what is left of a block and of the shards).
Then each block permutes its rows and deals them out by its row of the matrix, the rows
are exchanged, and each shard permutes what it got.  Shard sizes are exact: they differ by
at most one, however skewed the blocks are.

Both permutations are bijections of 0..n-1 that are computed at a single place (a keyed
Feistel network, walked until it falls into the range), so no block or shard is held in
memory, and a repeated task deals the same rows to the same places.

Placement never looks at the rows: null ids and texts, repeated rows and groups of equal
texts are rows like others, and a group of copies spreads over all shards.  A null text has
size 8 and the crc32 of nothing, 0.  An empty table has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jsonloom.llm.anchors import mixed
from jsonloom.llm.common import Scratch, arrow_map, shuffle_partitions

SHARDS = 24
SEED = 20_240_229
#: Rows of a source block (as bits of a place), and rounds of a permutation.
BLOCK_BITS, ROUNDS = 20, 6
#: Rows of a shard that the exchange keeps together.
SLOT_BITS = 20


class Permutation:
    """A bijection of 0..n-1 named by a key."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        rng = np.random.default_rng([SEED, key & (2**63 - 1), n])
        self.keys = rng.integers(0, 2**64, size=ROUNDS, dtype=np.uint64)

    def _once(self, x: np.ndarray) -> np.ndarray:
        bits, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> bits, x & mask
        for key in self.keys:
            left, right = right, left ^ (mixed(right + key) & mask)
        return (left << bits) | right

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = self._once(x.astype(np.uint64))
        while (outside := np.flatnonzero(out >= np.uint64(self.n))).size:
            out[outside] = self._once(out[outside])
        return out.astype(np.int64)


def hypergeometric(good: int, bad: int, drawn: int, rng: np.random.Generator) -> int:
    """How many of `drawn` rows are good: by inversion around the mode, for populations of any size.

    Probabilities relative to the mode's are products of exact ratios; beyond 40 standard
    deviations they are below the smallest double.
    """
    least, most = max(0, drawn - bad), min(good, drawn)
    if least == most:
        return least
    total = good + bad
    mode = min(max((good + 1) * (drawn + 1) // (total + 2), least), most)
    spread = (drawn * (good / total) * (bad / total) * max(total - drawn, 1) / max(total - 1, 1)) ** 0.5
    reach = int(40 * spread) + 40
    up = np.arange(mode, min(most, mode + reach), dtype=float)
    down = np.arange(mode, max(least, mode - reach), -1, dtype=float)
    rise = (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
    fall = down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
    weights = np.concatenate([np.cumprod(fall)[::-1], [1.0], np.cumprod(rise)])
    sums = np.cumsum(weights)
    return mode - len(down) + int(np.searchsorted(sums, rng.random() * sums[-1], side="right").clip(0, len(sums) - 1))


def communication_matrix(blocks: list[int], sizes: list[int], seed: int = SEED) -> np.ndarray:
    """Rows that each block sends to each shard; rows sum to the blocks, columns to the shards."""
    rng = np.random.default_rng(seed)
    left = list(sizes)
    matrix = np.zeros((len(blocks), len(sizes)), dtype=np.int64)
    for i, n in enumerate(blocks):
        others = sum(left)
        for j, size in enumerate(left):
            others -= size
            matrix[i, j] = k = hypergeometric(size, others, n, rng) if n else 0
            n -= k
        left = [a - int(b) for a, b in zip(left, matrix[i], strict=True)]
    return matrix


def shard_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (j < n % shards) for j in range(shards)]


def place(rows: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """The rows with shard and slot; the columns of `rows` keep their names."""
    kept = rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))
    at = F.monotonically_increasing_id()
    placed = scratch.store(kept.withColumn("at", at), "shard-rows")
    block = F.shiftright("at", BLOCK_BITS)
    counts = placed.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n")).orderBy("block").collect()
    # one row for each million rows or task: bounded by the tasks, whatever the rows hold
    sizes = shard_sizes(sum(r.n for r in counts), shards)
    matrix = communication_matrix([r.n for r in counts], sizes)
    before = np.cumsum(matrix, axis=0) - matrix
    spark = rows.sparkSession
    plan = spark.createDataFrame(
        [(r.block, r.n, a.tolist(), b.tolist()) for r, a, b in zip(counts, matrix, before, strict=True)],
        "block bigint, block_rows bigint, sends array<bigint>, before array<bigint>",
    )
    names = kept.columns

    def run(**columns):
        at = columns["at"].to_numpy(zero_copy_only=False)
        shard, slot = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        blocks = at >> BLOCK_BITS
        for b in np.unique(blocks):
            mine = np.flatnonzero(blocks == b)
            i = int(mine[0])
            n, sends, base = (columns[c][i].as_py() for c in ("block_rows", "sends", "before"))
            rank = Permutation(n, int(b))(at[mine] & ((1 << BLOCK_BITS) - 1))
            ends = np.cumsum(sends)
            shard[mine] = to = np.searchsorted(ends, rank, side="right")
            slot[mine] = np.array(base)[to] + rank - (ends[to] - np.array(sends)[to])
        for j in np.unique(shard):
            mine = np.flatnonzero(shard == j)
            slot[mine] = Permutation(sizes[j], -1 - int(j))(slot[mine])
        return [*(columns[c] for c in names), pa.array(shard.astype(np.int32)), pa.array(slot)]

    dealt = placed.withColumn("block", block).join(plan, "block")
    schema = StructType(list(kept.schema.fields)).add("shard", "integer").add("slot", "long")
    return arrow_map(dealt.select(*names, "at", "block_rows", "sends", "before"), run, schema).toDF(*rows.columns, "shard", "slot")


def exchanged(placed: DataFrame) -> DataFrame:
    """The rows dealt out to tasks by shard and stretch of slots, in order of slots."""
    n = shuffle_partitions(placed.sparkSession)
    return placed.repartition(n, "shard", F.shiftright("slot", SLOT_BITS)).sortWithinPartitions("shard", "slot")


def shuffle(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """All columns of the documents with `shard` and `slot`, exchanged; existing columns of these names go."""
    docs = docs.drop("shard", "slot")
    return exchanged(place(docs, shards, Scratch(docs.sparkSession)))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Shards as folders of Parquet files (shard=0, shard=1, ...), rows in order of slots within each file."""
    shuffle(docs, shards).write.partitionBy("shard").parquet(path)


def digests(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: texts stay where they are."""
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    return exchanged(place(rows, shards, Scratch(docs.sparkSession))).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


__all__ = ["Permutation", "communication_matrix", "digests", "hypergeometric", "place", "shuffle", "write_shards"]
