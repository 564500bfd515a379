"""Operator 8: nearest neighbours by a block matrix join.

Vectors are scaled to length one and quantised to int8, with the length of what the
quantisation loses.  Groups of candidate blocks meet blocks of queries; the product of
two int8 tiles gives every cosine up to a known error.  A pair survives if its highest
possible cosine reaches the lowest possible cosine of the query's k-th best in the
group, so no neighbour is ever lost.  Survivors are recomputed in double precision from
the original vectors, and bounded heaps merge the groups' results.

Block sizes are fixed, so a task holds one group and one query block however many
vectors there are.  Of equal vectors in a group the k + 1 with the smallest ids can be
neighbours; the others are left out of its tiles.

Vectors that are null, empty, zero or hold null or non-finite components take no part,
nor do rows with a null id.  Repeated rows (same id and vector) count once; rows that
share a query's id are not its candidates; vectors of another length are no candidates.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jsonloom.llm.common import shuffle_partitions, stored

#: Vectors in a block and in a group of candidate blocks; queries in a block.
BLOCK, GROUP, QUERY_BLOCK = 2_048, 8_192, 512
#: Room for rounding in the bounds.
SLACK = 1e-9


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>, row): each row that takes part, once."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # false for NaN: it is largest
    whole = vectors.select("vec_id", e.cast("array<double>").alias("embedding")).filter(
        F.col("vec_id").isNotNull() & fine & F.exists(e, lambda x: x != 0)
    )
    return whole.dropDuplicates(["vec_id", "embedding"]).withColumn("row", F.xxhash64("vec_id", "embedding"))


BLOCK_ROW = "block int, dim int, n int, ids binary, rows binary, codes binary, scale binary, lost binary"


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and lengths of what is lost, of vectors scaled to length one."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    unit = vectors / largest
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, lost


def blocks(frame: DataFrame, groups: int, size: int, equal: int | None) -> DataFrame:
    """Blocks of at most `size` vectors, in `groups` groups; `equal`: how many of equal vectors stay."""

    def build(key, rows):
        out: dict[str, list] = {n: [] for n in BLOCK_ROW.replace(",", "").split()[::2]}
        lengths = np.array(rows["embedding"].combine_chunks().value_lengths())
        ids, keys = rows["vec_id"].to_numpy(), rows["row"].to_numpy()
        for dim in np.unique(lengths):
            at = np.flatnonzero(lengths == dim)
            at = at[np.lexsort((keys[at], ids[at]))]
            flat = rows["embedding"].combine_chunks().take(pa.array(at)).flatten().to_numpy()
            vectors = flat.reshape(len(at), dim) + 0.0  # -0.0 becomes 0.0
            if equal:
                raw = vectors.view(np.dtype((np.void, 8 * int(dim)))).ravel()
                same = np.unique(raw, return_inverse=True)[1]
                order = np.argsort(same, kind="stable")
                first = np.searchsorted(same[order], same[order], side="left")
                stay = np.sort(order[np.arange(len(order)) - first < equal])
                at, vectors = at[stay], vectors[stay]
            codes, scale, lost = quantise(vectors)
            for a in range(0, len(at), size):
                part = slice(a, a + size)
                out["block"].append(len(out["block"]))
                out["dim"].append(int(dim))
                out["n"].append(len(at[part]))
                for name, array in (("ids", ids[at]), ("rows", keys[at]), ("codes", codes), ("scale", scale), ("lost", lost)):
                    out[name].append(np.ascontiguousarray(array[part]).tobytes())
        out["grp"] = [key[0].as_py()] * len(out["block"])
        return pa.table({n: pa.array(x, type=t) for (n, x), t in zip(out.items(), TYPES, strict=True)})

    grouped = frame.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    return grouped.groupBy("grp").applyInArrow(build, BLOCK_ROW + ", grp int")


TYPES = (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.int32())
SURVIVOR = "query_id bigint, query_row bigint, vec_id bigint, row bigint"


class Tile:
    """Arrays of a block's row."""

    def __init__(self, row: dict):
        self.dim, n = row["dim"], row["n"]
        self.ids, self.rows = (np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "rows"))
        # products of int8 stay whole numbers: up to 1,000 dimensions in float32, any in float64
        kind = np.float32 if self.dim <= 1000 else np.float64
        self.codes = np.frombuffer(row["codes"], dtype=np.int8).reshape(n, self.dim).astype(kind)
        self.scale, self.lost = (np.frombuffer(row[c], dtype=np.float64) for c in ("scale", "lost"))


def survivors(query_blocks: list[Tile], candidates: list[Tile], k: int) -> list[np.ndarray]:
    """query ids, query rows, candidate ids and rows of pairs that can be among the k best."""
    found: list[list[np.ndarray]] = [[], [], [], []]
    for q in query_blocks:
        lowest = np.full((len(q.ids), k), -np.inf)
        kept = []
        for c in candidates:
            if c.dim != q.dim:
                continue
            near = (q.codes @ c.codes.T).astype(np.float64) * q.scale[:, None] * c.scale
            error = q.lost[:, None] + (1 + q.lost)[:, None] * c.lost + SLACK
            own = q.ids[:, None] == c.ids
            low = np.where(own, -np.inf, near - error)
            both = np.concatenate([lowest, low], axis=1)
            lowest = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            high = near + error
            i, j = np.nonzero((high >= lowest.min(axis=1)[:, None]) & ~own)
            kept.append((i, c.ids[j], c.rows[j], high[i, j]))
        bar = lowest.min(axis=1)
        for i, ids, rows, high in kept:
            ok = high >= bar[i]
            for out, x in zip(found, (q.ids[i[ok]], q.rows[i[ok]], ids[ok], rows[ok]), strict=True):
                out.append(x)
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The k nearest of every query row: query_id, rank, vec_id, score (cosine)."""
    rows = stored(usable(vectors), "vectors")
    queries = rows.filter(is_query)
    groups = max(1, -(-rows.count() // GROUP))
    query_groups = max(1, -(-queries.count() // QUERY_BLOCK))
    left = stored(blocks(queries, query_groups, QUERY_BLOCK, None), "query-blocks")
    right = stored(blocks(rows, groups, BLOCK, k + 1), "vector-blocks")
    left = left.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumnRenamed("grp", "q")
    right = right.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1)))).withColumnRenamed("grp", "side")

    def meet(a, b):
        found = survivors([Tile(x) for x in a.to_pylist()], [Tile(x) for x in b.to_pylist()], k)
        return pa.table(dict(zip(("query_id", "query_row", "vec_id", "row"), found, strict=True)))

    pairs = left.groupBy("side", "q").cogroup(right.groupBy("side", "q")).applyInArrow(meet, SURVIVOR)
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    lengths = rows.select("vec_id", "row", "embedding", norm.alias("norm"))
    mine = lengths.toDF("query_id", "query_row", "query", "query_norm")
    scored = (
        pairs.join(lengths, ["vec_id", "row"])
        .join(mine, ["query_id", "query_row"])
        .select(
            "query_id",
            "query_row",
            "vec_id",
            (dot(F.col("query"), F.col("embedding")) / (F.col("query_norm") * F.col("norm"))).alias("score"),
        )
    )
    return merged(scored, k)


def merged(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query, by one bounded heap for each query of a task."""

    def run(batches):
        heaps: dict[tuple[int, int], list[tuple[float, int]]] = {}
        for batch in batches:
            for query, row, vec, score in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                heap = heaps.setdefault((query, row), [])
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                elif (score, -vec) > heap[0]:
                    heapq.heapreplace(heap, (score, -vec))
        out = [
            (query, rank, -vec, score)
            for (query, _), heap in heaps.items()
            for rank, (score, vec) in enumerate(sorted(heap, reverse=True), 1)
        ]
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, type=t) for x, t in zip(columns, kinds, strict=True)],
            names=["query_id", "rank", "vec_id", "score"],
        )

    dealt = scored.repartition(shuffle_partitions(scored.sparkSession), "query_id", "query_row")
    return dealt.mapInArrow(run, "query_id bigint, rank int, vec_id bigint, score double")


ORACLE = """
WITH v AS (
    SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
