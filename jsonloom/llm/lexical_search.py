"""Operator 13: ranked lexical search by exact inner products over sparse ball trees.

An item's score for a document is the inner product of two sparse vectors of integers: the
item's term weights and the document's saturated term frequencies.  One pass over the texts
keeps, for each document, its length and the terms that occur in any item at all (a bitmap
of fixed size tells nearly all others).  Then each task takes its documents some thousand
at a time and builds a ball tree over their vectors: a node has its centroid and the radius
of its ball, and parts by which of two far documents is nearer, or in halves along their
direction where one part would be small.

An item goes through the tree best bound first.  Of a ball no score is above
q.c + |q|r, with q cut to the terms that the ball holds; radius and bound are rounded up by
more than doubles can be off, so no document is lost.  A subtree whose bound is below the
item's k-th score so far is pruned, and leaves are scored in 64-bit integers.  The k-th
scores carry over from tree to tree of a task; the tasks' best are ranked per item.

Items come in blocks of even size, each a job over the document vectors; only a block is
sent to the tasks.

Every row of the items is an item of its own, with its own ranking, and every row of the
documents a document.  Null texts have no terms; documents without terms are not counted;
items without terms have no rows.  Ties go to the smaller doc_id, null ids last.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from jsonloom.llm.common import Scratch, arrow_map

BEST = 10
#: Documents and vector entries of a tree, documents of a leaf.
TREE, TREE_ENTRIES, LEAF = 4096, 1 << 20, 32
#: Items of a block, and terms of its items, on average.
BLOCK_ITEMS, BLOCK_TERMS = 512, 1 << 18
#: Bits of the bitmap of item terms, and those of one bitmap of Spark's aggregate.
BITMAP_BITS, BUCKET = 1 << 22, 1 << 15
#: Relative allowance for the rounding of doubles, far above what sums of TREE_ENTRIES numbers lose.
SAFE = 1e-9

#: Terms are runs of ASCII letters and digits and of everything beyond ASCII; A-Z are lower-cased.
_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
TERM_BYTES = bytes(x if x in _KEPT else 0x20 for x in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, terms): the distinct terms of each row, numbered by a frame that must be written once."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(item, item_id, text):
        return [item, item_id, [sorted(set(terms_of(t))) for t in text.to_pylist()]]

    rows = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    return arrow_map(rows, run, f"item bigint, item_id {kind}, terms array<binary>")


def term_bitmap(items: DataFrame) -> np.ndarray:
    """A bit for each hash of a term that some item has; its size is fixed."""
    terms = items.select(F.explode("terms").alias("term"))
    place = terms.select((F.crc32("term") % BITMAP_BITS + 1).alias("place"))
    rows = place.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    bitmap = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    for r in rows.collect():  # BITMAP_BITS / BUCKET rows at most
        part = np.frombuffer(r.bits, dtype=np.uint8)
        at = (r.bucket - 1) * BUCKET // 8
        bitmap[at : at + len(part)] = part
    return bitmap


class Known(dict):
    """Is a term's bit set?  Answers are remembered within a bound of bytes."""

    BYTES = 1 << 24

    def __init__(self, bitmap: np.ndarray):
        super().__init__()
        self.bitmap, self.held = bitmap, 0

    def __missing__(self, term: bytes) -> bool:
        place = zlib.crc32(term) % BITMAP_BITS
        found = bool(self.bitmap[place >> 3] >> (place & 7) & 1)
        self.held += len(term) + 150
        if self.held > self.BYTES:
            self.clear()
            self.held = len(term) + 150
        self[term] = found
        return found


def vectors(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with terms: all terms are counted, those of the bitmap kept."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n bigint, terms array<binary>, tfs array<bigint>"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(bitmap)
        for batch in batches:
            row, n, ends, terms, tfs = [], [], [0], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if found := terms_of(text):
                    counts = {t: k for t, k in Counter(found).items() if known[t]}
                    row.append(i)
                    n.append(len(found))
                    terms.extend(counts)
                    tfs.extend(counts.values())
                    ends.append(len(terms))
            ends = pa.array(ends, type=pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, type=t)) for x, t in ((terms, pa.binary()), (tfs, pa.int64()))]
            columns = [batch.column(0).take(pa.array(row, type=pa.int64())), pa.array(n, type=pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, out, strict=True)], schema=out)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def blocks_of(items: DataFrame, most: int = BLOCK_ITEMS) -> tuple[DataFrame, int]:
    """The written items with a block number by hash, and how many blocks their number and terms ask for."""
    total = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("terms")).alias("terms")).first()
    blocks = max(-(-total.n // most), -(-(total.terms or 0) // BLOCK_TERMS))
    return items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1)))), blocks


class Rows:
    """Sparse rows of non-negative integers."""

    def __init__(self, start: np.ndarray, cols: np.ndarray, vals: np.ndarray):
        self.start, self.cols, self.vals = start, cols, vals
        self.row = np.repeat(np.arange(len(start) - 1), np.diff(start))
        self.square = np.bincount(self.row, (vals.astype(float)) ** 2, minlength=len(start) - 1)

    def __len__(self) -> int:
        return len(self.start) - 1

    def take(self, rows: np.ndarray) -> Rows:
        size = (self.start[1:] - self.start[:-1])[rows]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[rows] - ends[:-1], size) + np.arange(ends[-1])
        return Rows(ends, self.cols[at], self.vals[at])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.vals * dense[self.cols], minlength=len(self))

    def exact(self, weights: np.ndarray) -> np.ndarray:
        """Inner products with integers, in 64-bit integers."""
        sums = np.concatenate([[0], np.cumsum(self.vals * weights[self.cols])])
        return sums[self.start[1:]] - sums[self.start[:-1]]


class Ball:
    """A node: documents' numbers and vectors at leaves, two halves above."""

    __slots__ = ("centre", "cols", "docs", "halves", "radius", "rows")

    def __init__(self, rows: Rows, docs: np.ndarray, width: int, dense: np.ndarray):
        n = len(rows)
        np.add.at(dense, rows.cols, rows.vals / n)
        self.cols = np.unique(rows.cols)
        self.centre = dense[self.cols].copy()
        size = float(self.centre @ self.centre)
        distance = rows.square - 2 * rows.dot(dense) + size
        allowance = SAFE * (rows.square + size)
        self.radius = float(np.sqrt(np.maximum(distance, 0) + allowance).max()) if n else 0.0
        dense[self.cols] = 0
        self.rows = self.docs = self.halves = None
        if n <= LEAF:
            self.rows, self.docs = rows, docs
            return
        a = int(np.argmax(distance))
        one = self._scatter(rows, a, dense)
        gap = rows.square - 2 * rows.dot(dense)
        dense[one] = 0
        b = int(np.argmax(gap))
        two = self._scatter(rows, b, dense)
        towards = rows.dot(dense)
        dense[two] = 0
        self._scatter(rows, a, dense)
        towards -= rows.dot(dense)
        dense[one] = 0
        near = towards > (rows.square[b] - rows.square[a]) / 2  # nearer to the second
        if not n // 16 <= near.sum() <= n - n // 16:
            near = np.zeros(n, dtype=bool)
            near[np.argsort(towards, kind="stable")[n // 2 :]] = True
        self.halves = [Ball(rows.take(part), docs[part], width, dense) for part in map(np.flatnonzero, (~near, near))]

    @staticmethod
    def _scatter(rows: Rows, i: int, dense: np.ndarray) -> np.ndarray:
        span = slice(rows.start[i], rows.start[i + 1])
        dense[rows.cols[span]] = rows.vals[span]
        return rows.cols[span]

    def bound(self, weights: np.ndarray) -> float:
        """No document below scores more."""
        q = weights[self.cols].astype(float)
        return (float(q @ self.centre) + math.sqrt(float(q @ q)) * self.radius) * (1 + SAFE) + 1


class Ranking:
    """The best documents of an item so far."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, best: int):
        self.terms, self.weights, self.best, self.heap = terms, weights, best, []

    @property
    def least(self) -> int:
        return self.heap[0][0] if len(self.heap) == self.best else 1

    def search(self, tree: Ball, ids: list, dense: np.ndarray) -> int:
        """Goes through a tree, best bound first; returns how many documents were scored."""
        dense[self.terms] = self.weights
        queue, count, scored = [(-tree.bound(dense), 0, tree)], 1, 0
        while queue:
            bound, _, ball = heapq.heappop(queue)
            if -bound < self.least:
                break
            if ball.halves is None:
                scores = ball.rows.exact(dense)
                scored += len(scores)
                for i in np.flatnonzero(scores >= self.least).tolist():
                    doc = ids[ball.docs[i]]
                    entry = (int(scores[i]), -doc if doc is not None else -math.inf)
                    if len(self.heap) < self.best:
                        heapq.heappush(self.heap, entry)
                    else:
                        heapq.heappushpop(self.heap, entry)
            else:
                for half in ball.halves:
                    heapq.heappush(queue, (-half.bound(dense), count, half))
                    count += 1
        dense[self.terms] = 0
        return scored


FOUND = "item bigint, item_id {}, doc_id {}, score bigint"


def best_of_tasks(found: DataFrame, block: list, n_docs: int, n_terms: int, best: int, ids: tuple[str, str]) -> DataFrame:
    """For one block of items, the best documents of each task."""
    schema = FOUND.format(*ids)
    out = to_arrow_schema(StructType.fromDDL(schema))
    vocabulary = sorted({t for r in block for t in r.terms})
    place = {t: i for i, t in enumerate(vocabulary)}
    items = [
        (r.item, r.item_id, np.array([place[t] for t in r.terms]), np.array([weight(n_docs, k) for k in r.dfs], dtype=np.int64))
        for r in block
    ]

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Rows]]:
        names = pa.array(vocabulary, type=pa.binary())
        for batch in batches:
            ids = batch.column(0).to_pylist()
            m = np.array([10 + 90 * n * n_docs // n_terms for n in batch.column(1).to_pylist()], dtype=np.int64)
            terms = batch.column(2)
            start = terms.offsets.to_numpy().astype(np.int64)
            at = slice(start[0], start[-1])
            cols = pc.index_in(terms.values[at], value_set=names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            tfs = batch.column(3).values.to_numpy()[batch.column(3).offsets[0].as_py() :][: len(cols)]
            row = np.repeat(np.arange(len(ids)), np.diff(start))
            vals = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m[row])
            known = cols >= 0
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[known], minlength=len(ids)))]).astype(np.int64)
            rows = Rows(ends, cols[known], vals[known])
            first = 0
            while first < len(ids):
                fit = int(np.searchsorted(ends, ends[first] + TREE_ENTRIES, side="right")) - 1
                last = min(len(ids), first + TREE, max(fit, first + 1))
                yield ids[first:last], rows.take(np.arange(first, last))
                first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rankings = [Ranking(terms, weights, best) for _, _, terms, weights in items]
        dense, exact = np.zeros(len(vocabulary)), np.zeros(len(vocabulary), dtype=np.int64)
        for names, rows in trees(batches):
            tree = Ball(rows, np.arange(len(rows)), len(vocabulary), dense)
            for ranking in rankings:
                ranking.search(tree, names, exact)
        rows = [
            (item, item_id, None if low == -math.inf else -low, score)
            for (item, item_id, _, _), ranking in zip(items, rankings, strict=True)
            for score, low in ranking.heap
        ]
        if rows:
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(columns, out, strict=True)], schema=out)

    return found.mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, best: int = BEST, items_in_block: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's highest-scoring documents with a score above 0."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    asked = scratch.store(item_terms(items), "search-items")
    found = scratch.store(vectors(docs, term_bitmap(asked)), "search-vectors")
    total = found.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    ids = tuple(x.schema[c].dataType.simpleString() for x, c in ((asked, "item_id"), (found, "doc_id")))
    df = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = scratch.store(df, "search-df")
    known = asked.select("item", "item_id", F.explode("terms").alias("term")).join(df, "term")
    pairs = F.sort_array(F.collect_list(F.struct("term", "df"))).alias("pairs")
    weighted = known.groupBy("item").agg(F.first("item_id").alias("item_id"), pairs)  # an item's own terms
    weighted = weighted.select("item", "item_id", F.col("pairs.term").alias("terms"), F.col("pairs.df").alias("dfs"))
    weighted, blocks = blocks_of(scratch.store(weighted, "search-weights"), items_in_block)
    tops = spark.createDataFrame([], FOUND.format(*ids))
    for number in range(blocks):
        block = weighted.filter(F.col("block") == number).collect()  # some BLOCK_ITEMS and BLOCK_TERMS
        tops = tops.union(scratch.store(best_of_tasks(found, block, total.n, total.l, best, ids), "search-best"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = tops.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT row_number() OVER () AS q, item_id, unnest(list_distinct(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS t
    FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n_all, sum(len(w))::BIGINT AS l_all FROM d WHERE len(w) > 0),
f AS (SELECT r, doc_id, len(w) AS n, t, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS t FROM d) GROUP BY ALL),
g AS (SELECT t, floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY t, n_all),
p AS (SELECT q, item_id, r, doc_id, sum(g.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_all) // l_all))))::BIGINT AS score
    FROM i JOIN f USING (t) JOIN g USING (t), s GROUP BY q, item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INT AS rank FROM p WHERE score > 0) WHERE rank <= 10
"""
