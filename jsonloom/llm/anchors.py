"""Repeated stretches of texts: sampled anchors, the blocks around them, and windows.

A text is a row of units (words or bytes).  Of the short seeds in a window the one with
the smallest hash is the window's anchor, so equal windows have equal anchors at equal
places, and neighbouring windows mostly share one.  An anchor's block is the stretch of
units of all windows that it is the anchor of; blocks follow each other through a text.

Only anchors that occur twice matter.  A block that occurred earlier (smaller doc_id,
then text_id, then place) settles all its windows at once.  What is left are blocks that are the first
of their kind although their anchor occurs in other blocks, too: the ends of repeated
stretches, whose windows are looked at one by one by the operators.

Rows travel as hashes and places; sums of products of two independent odd multipliers
make a block's identity 128 bits together with its anchor.  Counts and first places are
aggregates with partial sums, and joins on anchors are left to Spark's skew handling, so
no group of copies is gathered.

A text is known by its doc_id and text_id, 64 bits of its hash: different texts under one
doc_id (or under null ids) stay apart in marks, groups and joins.  A place in a text is one
number: the position, 8 bits from the position to the first window, 8 bits number of windows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jsonloom.llm.common import Scratch, arrow_map

ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Units of a text that are sampled together; longer texts go in overlapping stretches.
STRETCH = 1 << 20


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2^64, as many as are asked for."""

    def __init__(self, base: int):
        self.bases = (base, pow(base, -1, 1 << 64))
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) < n:
            size = max(n, 2 * len(self.tables[0]), 4096)
            for i, base in enumerate(self.bases):
                row = np.full(size, base, dtype=np.uint64)
                row[0] = 1
                self.tables[i] = np.multiply.accumulate(row)
        return self.tables


POWERS = [Powers(x) for x in ODD]


class Hashes:
    """Prefix polynomial hashes of a row of units; any stretch's hash takes two look-ups."""

    def __init__(self, units: np.ndarray, which: int):
        power, self.inverse = POWERS[which].upto(len(units) + 1)
        self.prefix = np.zeros(len(units) + 1, dtype=np.uint64)
        np.cumsum(units * power[: len(units)], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]

    def every(self, size: int) -> np.ndarray:
        """Hashes of all stretches of a size."""
        n = len(self.prefix) - size
        return (self.prefix[size:] - self.prefix[:-size]) * self.inverse[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == width else np.minimum(x[: len(x) - (width - size)], x[width - size :])


@dataclass(frozen=True)
class Sampling:
    """Units in a window and in a seed."""

    window: int
    seed: int

    @property
    def width(self) -> int:
        return self.window - self.seed + 1

    def __call__(self, units: np.ndarray) -> tuple[np.ndarray, ...]:
        """Position, first window, last window, anchor and block of each anchor of a text."""
        parts = []
        step = STRETCH - self.window
        for at in range(0, max(1, len(units) - self.window + 1), step):
            part = units[at : at + step + self.window - 1]
            if len(part) >= self.window:
                parts.append([x + at if i < 3 else x for i, x in enumerate(self.stretch(part))])
        if not parts:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def stretch(self, units: np.ndarray) -> list[np.ndarray]:
        seeds = mixed(Hashes(units, 0).every(self.seed))
        places = np.arange(len(seeds), dtype=np.uint64)
        low = np.uint64(STRETCH - 1)
        own = sliding_least((seeds & ~low) | places, self.width) & low
        change = np.flatnonzero(own[1:] != own[:-1])
        first = np.concatenate([[0], change + 1])
        last = np.concatenate([change, [len(own) - 1]])
        at = own[first].astype(np.int64)
        block = Hashes(units, 1).of(first, last + self.window)
        return [at, first, last, seeds[at].view(np.int64), mixed(block).view(np.int64)]


#: What tells texts apart.
TEXT = ("doc_id", "text_id")


def identified(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text_id, text, more columns) of documents."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text", *more)


def pack_places(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (at << 16) | ((at - first) << 8) | (last - first + 1)


def unpack_places(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, first windows and last windows of a text's places."""
    at = places >> 16
    first = at - ((places >> 8) & 0xFF)
    return at, first, first + (places & 0xFF) - 1


def take(column: pa.Array, counts: list[int]) -> pa.Array:
    """Each value as often as its count says."""
    return column.take(pa.array(np.repeat(np.arange(len(counts)), counts)))


@dataclass
class Repeats:
    """Settled blocks, and first blocks whose windows are to be looked at.

    settled: doc_id, text_id, place, source_id, source_text, source_place.  open: doc_id,
    text_id, place, key, blocks (how many different blocks the anchor has).
    """

    settled: DataFrame
    open: DataFrame


BLOCK = "doc_id {}, text_id bigint, place bigint, anchor bigint, block bigint"


def repeats(docs: DataFrame, units: Callable[[bytes], np.ndarray], sampling: Sampling, scratch: Scratch) -> Repeats:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(**columns):
        counts, places, anchors, blocks = [], [], [], []
        for text in columns["text"].to_pylist():
            raw = text.encode("utf-8", "surrogatepass") if text else b""
            at, first, last, anchor, block = sampling(units(raw))
            counts.append(len(at))
            places.append(pack_places(at, first, last))
            anchors.append(anchor)
            blocks.append(block)
        ids = [take(columns[n], counts) for n in TEXT]
        return [*ids, *(pa.array(np.concatenate(x)) for x in (places, anchors, blocks))]

    schema = BLOCK.format(kind)
    rows = scratch.store(arrow_map(identified(docs), run, schema), "anchors")
    return settle(rows, scratch)


def here() -> Column:
    return F.struct(*TEXT, "place")


def source() -> list[Column]:
    """The columns of the first occurrence `first`."""
    names = {"doc_id": "source_id", "text_id": "source_text", "place": "source_place"}
    return [F.col(f"first.{a}").alias(b) for a, b in names.items()]


def settle(rows: DataFrame, scratch: Scratch) -> Repeats:
    """What is repeated among blocks (doc_id, text_id, place, anchor, block), a table of `scratch` that goes."""
    # aggregates that are joined back are written first: Spark then splits the hot keys of such joins
    often = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    often = scratch.store(often, "often")
    again = scratch.store(rows.join(often, "anchor", "left_semi"), "repeated-anchors")
    scratch.drop(rows)
    scratch.drop(often)
    # another name for the anchor, by which Spark pre-aggregates anew instead of keeping hot anchors together
    key = F.bitwise_not("anchor").alias("key")
    firsts = scratch.store(
        again.groupBy(key, "block").agg(
            F.min(here()).alias("first"), F.count(F.lit(1)).alias("n")
        ),
        "first-blocks",
    )
    settled = scratch.store(
        again.select(*TEXT, "place", key, "block")
        .join(firsts.filter("n > 1").select("key", "block", "first"), ["key", "block"])
        .filter(~here().eqNullSafe(F.col("first")))
        .select(*TEXT, "place", *source()),
        "settled-blocks",
    )
    scratch.drop(again)
    several = scratch.store(
        firsts.groupBy("key").agg(F.count(F.lit(1)).alias("blocks")).filter("blocks > 1"), "open-anchors"
    )
    left = scratch.store(
        firsts.join(several, "key").select("first.*", "key", "blocks"), "open-blocks"
    )
    scratch.drop(firsts)
    return Repeats(settled, left)


def by_document(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows of each text as an array; the text's own length bounds it."""
    return rows.groupBy(*TEXT).agg(F.collect_set(F.struct(*columns)).alias("marks"))


def with_marks(docs: DataFrame, marks: DataFrame, how: str, *more: str) -> DataFrame:
    """(doc_id, text_id, text, more columns, marks) of documents; rows with a null doc_id meet, too."""
    found = marks.withColumnsRenamed({"doc_id": "marked", "text_id": "marked_text"})
    mine = identified(docs, *more)
    both = mine["doc_id"].eqNullSafe(found["marked"]) & (mine["text_id"] == found["marked_text"])
    return mine.join(found, both, how).drop("marked", "marked_text")


def windows_seen_before(windows: DataFrame, scratch: Scratch) -> DataFrame:
    """Of rows (low, high, doc_id, text_id, place), one for each window, those whose window starts earlier, too.

    low and high are two hashes of the window.  Returns the columns of `Repeats.settled`.
    """
    rows = scratch.store(windows, "windows")
    first = (
        rows.groupBy(F.bitwise_not("low").alias("key"), "high")
        .agg(F.min(here()).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("key", "high", "first")
    )
    first = scratch.store(first, "first-windows")
    found = (
        rows.withColumn("key", F.bitwise_not("low"))
        .join(first, ["key", "high"])
        .filter(~here().eqNullSafe(F.col("first")))
        .select(*TEXT, "place", *source())
    )
    found = scratch.store(found, "repeated-windows")
    scratch.drop(rows)
    scratch.drop(first)
    return found


def lists_of(marks: pa.Array, names: list[str]) -> list[dict[str, np.ndarray]]:
    """The numbers of each row's array of structs, as arrays by name (no nulls become 0)."""
    if isinstance(marks, pa.ChunkedArray):
        marks = marks.combine_chunks()
    offsets = marks.offsets.to_numpy()
    values = marks.values
    columns = {n: np.nan_to_num(values.field(n).to_numpy(zero_copy_only=False)).astype(np.int64) for n in names}
    valid = np.asarray(marks.is_valid())
    empty = {n: np.zeros(0, np.int64) for n in names}
    return [
        {n: c[offsets[i] : offsets[i + 1]] for n, c in columns.items()} if valid[i] else empty
        for i in range(len(marks))
    ]


def window_rows(
    docs: DataFrame, blocks: DataFrame, units_of: Callable[[bytes], np.ndarray], window: int
) -> DataFrame:
    """Two hashes of each window of the open blocks, with its text and place."""
    marked = with_marks(docs, by_document(blocks, "place"), "inner")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(**columns):
        counts, out = [], ([], [], [])
        marks = lists_of(columns["marks"], ["place"])
        for text, mark in zip(columns["text"].to_pylist(), marks, strict=True):
            raw = text.encode("utf-8", "surrogatepass") if text else b""
            _, first, last = unpack_places(mark["place"])
            size = last - first + 1
            starts = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            counts.append(len(starts))
            if len(starts):
                units = units_of(raw)
                for k in (0, 1):
                    out[k].append(Hashes(units, k).of(starts, starts + window).view(np.int64))
                out[2].append(pack_places(starts, starts, starts))
        ids = [take(columns[n], counts) for n in TEXT]
        return [*ids, *(pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out)]

    return arrow_map(marked, run, f"doc_id {kind}, text_id bigint, low bigint, high bigint, place bigint")


def covered_by(first: np.ndarray, last: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n units the windows first..last of each span cover."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, np.minimum(last + window, n), -1)
    return np.cumsum(steps[:n]) > 0


def factors(covered: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the maximal runs of covered units."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
