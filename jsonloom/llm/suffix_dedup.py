"""Operator 10: exact substring dedup over bytes by a hash-compared suffix sort.

Anchors and blocks (`anchors`) settle the insides of repeated stretches and leave open
blocks, the ends of stretches.  Their contexts (at most 2 * WINDOW - SEED bytes each) are
dealt by anchor.  A task sorts the suffixes that start at the anchors by merging: two
suffixes are compared through their common extension, which a binary search over prefix
polynomial hashes finds in logarithmic time.  Neighbours' common extensions (the LCP
array) tell, for every distance from window to anchor, which suffixes agree to the
window's end; prefix hashes tell which agree from the window's start to the anchor.  What
agrees in both is one window: all but its earliest occurrence are removed.  Bytes are
then compared; if a hash has collided, the task repeats with another multiplier.

An anchor in more than GROUP_BLOCKS different blocks is not gathered.  Its blocks are cut
into parts of STEP distances; the windows of a part share some bytes on both sides of the
anchor, which make a longer, rarer anchor, and parts are settled like blocks.  What is
still above the bound then goes window by window through an aggregate keyed by two hashes,
which is as exact (128 bits).

The result is exact: a byte goes if a WINDOW-byte string that covers it starts earlier,
too (smaller doc_id, or same document, earlier start), on the input; null doc_ids come
first, and rows that share a doc_id are one document, different texts of it ordered and
told apart by 64 bits of their hash.  Null texts have no bytes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jsonloom.llm.anchors import (
    BLOCK,
    TEXT,
    Hashes,
    Sampling,
    by_document,
    covered_by,
    factors,
    lists_of,
    mixed,
    pack_places,
    repeats,
    settle,
    take,
    unpack_places,
    window_rows,
    windows_seen_before,
    with_marks,
)
from jsonloom.llm.common import Scratch, arrow_map, shuffle_partitions

WINDOW, SEED = 100, 16
SAMPLING = Sampling(window=WINDOW, seed=SEED)
#: Most different blocks of an anchor that one task sorts, and open blocks in a bucket.
GROUP_BLOCKS, BUCKET_BLOCKS = 512, 20_000
#: Distances from window to anchor in a part of a block.
STEP = 11
BYTE_HASHES = mixed(np.arange(1, 257, dtype=np.uint64))


def byte_units(raw: bytes) -> np.ndarray:
    return BYTE_HASHES[np.frombuffer(raw, dtype=np.uint8)]


class Suffixes:
    """Suffixes start[i] .. start[i] + length[i] of a buffer, compared by hashes."""

    def __init__(self, buffer: np.ndarray, start: np.ndarray, length: np.ndarray, which: int):
        self.buffer, self.start, self.length = buffer, start, length
        self.hashes = Hashes(BYTE_HASHES[buffer], which)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes i and j, by binary search."""
        a, b = self.start[i], self.start[j]
        low = np.zeros(len(i), dtype=np.int64)
        high = np.minimum(self.length[i], self.length[j])
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.hashes.of(a, a + middle) == self.hashes.of(b, b + middle)
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Is suffix i in front of suffix j?  Equal ones go by number, shorter ones first."""
        n = self.common(i, j)
        last = len(self.buffer) - 1
        x = self.buffer[np.minimum(self.start[i] + n, last)].astype(np.int64)
        y = self.buffer[np.minimum(self.start[j] + n, last)].astype(np.int64)
        x = np.where(n == self.length[i], -1, x)
        y = np.where(n == self.length[j], -1, y)
        return np.where(x == y, i < j, x < y)

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within their groups (numbers in ascending order), by merging runs."""
        n = len(group)
        order = np.arange(n)
        first = np.searchsorted(group, group, side="left")
        end = np.searchsorted(group, group, side="right")
        run = 1
        active = np.flatnonzero(end - first > run)
        while len(active):
            run_start = first[active] + (active - first[active]) // run * run
            is_left = (run_start - first[active]) // run % 2 == 0
            pair = np.where(is_left, run_start, run_start - run)  # where the two runs start
            other = np.where(is_left, run_start + run, pair)
            low = np.minimum(other, end[active])
            high = np.minimum(other + run, end[active])
            other = low.copy()
            mine = order[active]
            while True:  # how many of the other run are in front
                todo = np.flatnonzero(low < high)
                if not len(todo):
                    break
                middle = (low[todo] + high[todo]) >> 1
                before = self.less(order[middle], mine[todo])
                low[todo] = np.where(before, middle + 1, low[todo])
                high[todo] = np.where(before, high[todo], middle)
            new = order.copy()
            new[pair + (active - run_start) + (low - other)] = mine
            order, run = new, 2 * run
            active = active[end[active] - first[active] > run]
        return order


def repeated_windows(
    group: np.ndarray, rank: np.ndarray, buffer: np.ndarray, offset: np.ndarray, before: np.ndarray, size: np.ndarray, which: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """(row, distance) of windows that an earlier row of the group holds, too.

    Rows are sorted by group; row i's context is buffer[offset : offset + size] with the
    anchor `before` bytes in.  A window starts `distance` bytes in front of the anchor.
    """
    anchor = offset + before
    suffixes = Suffixes(buffer, anchor, size - before, which)
    order = suffixes.sort(group)
    lcp = np.zeros(len(order), dtype=np.int64)
    same = group[order[1:]] == group[order[:-1]]
    lcp[1:][same] = suffixes.common(order[1:][same], order[:-1][same])
    least = before - (size - WINDOW)  # the block's last window starts so far in front of the anchor
    rows, distances, runs = [], [], []
    for d in range(SAMPLING.width):
        own = (least[order] <= d) & (d <= before[order])
        if own.any():
            rows.append(order[own])
            distances.append(np.full(int(own.sum()), d))
            runs.append(np.cumsum(lcp < WINDOW - d)[own])  # suffixes that agree to the window's end
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, d, run = np.concatenate(rows), np.concatenate(distances), np.concatenate(runs)
    left = suffixes.hashes.of(anchor[row] - d, anchor[row])
    by = np.lexsort((rank[row], left, run, d))
    row, d, run, left = row[by], d[by], run[by], left[by]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (run[1:] != run[:-1]) | (left[1:] != left[:-1])
    source = row[np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))]
    row, d, source = row[~new], d[~new], source[~new]
    if not equal_bytes(buffer, anchor, row, source, d):
        if which:
            raise ValueError("both hashes collided")
        return repeated_windows(group, rank, buffer, offset, before, size, 1)
    return row, d


def equal_bytes(buffer: np.ndarray, anchor: np.ndarray, row: np.ndarray, source: np.ndarray, d: np.ndarray) -> bool:
    """Do the windows of each (row, source) agree byte by byte?  One comparison for all distances of a pair."""
    if not len(row):
        return True
    by = np.lexsort((d, source, row))
    row, source, d = row[by], source[by], d[by]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (source[1:] != source[:-1])]))
    last = np.concatenate([new[1:], [len(row)]]) - 1
    start, length = -d[last], d[last] - d[new] + WINDOW
    for at in range(0, len(new), 50_000):
        k = slice(at, at + 50_000)
        step = np.arange(int(length[k].max()))
        inside = step < length[k][:, None]
        limit = len(buffer) - 1
        x = buffer[np.minimum((anchor[row[new[k]]] + start[k])[:, None] + step, limit)]
        y = buffer[np.minimum((anchor[source[new[k]]] + start[k])[:, None] + step, limit)]
        if ((x != y) & inside).any():
            return False
    return True


def parts_of_blocks(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Open blocks cut into parts, each with a longer anchor: rows like those of sampled blocks."""
    marked = with_marks(docs, by_document(blocks, "place", "key"), "inner")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(**columns):
        counts, places, anchors, found = [], [], [], []
        for text, mark in zip(columns["text"].to_pylist(), lists_of(columns["marks"], ["place", "key"]), strict=True):
            raw = text.encode("utf-8", "surrogatepass") if text else b""
            key = mark["key"].view(np.uint64)
            at, first, last = unpack_places(mark["place"])
            before = len(places)
            if len(at):
                units = byte_units(raw)
                hashes = [Hashes(units, k) for k in (0, 1)]
                for part in range(-(-SAMPLING.width // STEP)):
                    near, far = part * STEP, min(part * STEP + STEP, SAMPLING.width) - 1
                    low, high = np.maximum(at - last, near), np.minimum(at - first, far)
                    own = low <= high
                    if own.any():
                        x, low, high = at[own], low[own], high[own]
                        shared = hashes[0].of(x - near, x + WINDOW - far)
                        places.append(pack_places(x, x - high, x - low))
                        anchors.append(mixed(shared + mixed(key[own] + np.uint64(part))).view(np.int64))
                        found.append(mixed(hashes[1].of(x - high, x - low + WINDOW)).view(np.int64))
            counts.append(sum(map(len, places[before:])))
        ids = [take(columns[n], counts) for n in TEXT]
        return [*ids, *(pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (places, anchors, found))]

    return arrow_map(marked, run, BLOCK.format(kind))


def contexts(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """The bytes of open blocks with their anchors' keys, texts and places."""
    marked = with_marks(docs, by_document(blocks, "place", "key"), "inner")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(**columns):
        counts, keys, places, parts = [], [], [], []
        for text, mark in zip(columns["text"].to_pylist(), lists_of(columns["marks"], ["place", "key"]), strict=True):
            raw = text.encode("utf-8", "surrogatepass") if text else b""
            _, first, last = unpack_places(mark["place"])
            counts.append(len(first))
            keys.append(mark["key"])
            places.append(mark["place"])
            parts.extend(raw[a : b + WINDOW] for a, b in zip(first.tolist(), last.tolist(), strict=True))
        ids = [take(columns[n], counts) for n in TEXT]
        return [*ids, *(pa.array(np.concatenate(x)) for x in (places, keys)), parts]

    return arrow_map(marked, run, f"doc_id {kind}, text_id bigint, place bigint, key bigint, context binary")


def sorted_out(rows: DataFrame, buckets: int) -> DataFrame:
    """Places of repeated windows among contexts, bucket by bucket; an anchor's rows share a bucket."""
    kind = rows.schema["doc_id"].dataType

    def run(table):
        key = table["key"].to_numpy()
        place = table["place"].to_numpy()
        by = np.argsort(key, kind="stable")
        table = table.take(pa.array(by))
        key, place = key[by], place[by]
        order = pa.compute.sort_indices(
            table, sort_keys=[(n, "ascending") for n in (*TEXT, "place")], null_placement="at_start"
        ).to_numpy()
        rank = np.empty(len(key), dtype=np.int64)
        rank[order] = np.arange(len(key))
        parts = table["context"].to_pylist()
        size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        buffer = np.frombuffer(b"".join(parts), dtype=np.uint8)
        row, d = repeated_windows(key, rank, buffer, np.cumsum(size) - size, (place >> 8) & 0xFF, size)
        by = np.lexsort((-d, row))
        row, d = row[by], d[by]
        start = np.ones(len(row), dtype=bool)
        start[1:] = (row[1:] != row[:-1]) | (d[1:] != d[:-1] - 1)
        begin = np.flatnonzero(start)
        last = np.concatenate([begin[1:], [len(row)]]) - 1 if len(row) else begin
        at = place[row[begin]] >> 16
        found = table.select(TEXT).take(pa.array(row[begin]))
        return found.append_column("place", pa.array(pack_places(at, at - d[begin], at - d[last]), type=pa.int64()))

    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").applyInArrow(
        lambda table: run(table), f"doc_id {kind.simpleString()}, text_id bigint, place bigint"
    )


def duplicate_places(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, marks): places of all repeated windows of each text."""
    scratch = Scratch(docs.sparkSession)
    found = repeats(docs, byte_units, SAMPLING, scratch)
    few, many = (F.col("blocks") <= GROUP_BLOCKS), (F.col("blocks") > GROUP_BLOCKS)
    cut = settle(scratch.store(parts_of_blocks(docs, found.open.filter(many)), "parts"), scratch)
    gathered = found.open.filter(few).union(cut.open.filter(few))
    rows = scratch.store(contexts(docs, gathered), "contexts")
    buckets = max(shuffle_partitions(docs.sparkSession), -(-rows.count() // BUCKET_BLOCKS))
    ends = scratch.store(sorted_out(rows, buckets), "sorted-windows")
    scratch.drop(rows)
    single = windows_seen_before(window_rows(docs, cut.open.filter(many), byte_units, WINDOW), scratch)
    places = [x.select(*TEXT, "place") for x in (found.settled, cut.settled, ends, single)]
    return by_document(reduce(DataFrame.union, places), "place")


SPAN = "array<struct<start: bigint, end: bigint>>"


def spans_of(raw: bytes, places: np.ndarray) -> list[tuple[int, int]]:
    """Maximal removed runs of bytes."""
    _, first, last = unpack_places(places)
    return factors(covered_by(first, last, len(raw), WINDOW)) if len(first) else []


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, kept (bytes), spans (removed bytes)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(**columns):
        n, kept, removed = [], [], []
        for text, mark in zip(columns["text"].to_pylist(), lists_of(columns["marks"], ["place"]), strict=True):
            raw = text.encode("utf-8", "surrogatepass") if text else b""
            spans = spans_of(raw, mark["place"])
            n.append(len(raw))
            kept.append(without(raw, spans))
            removed.append([{"start": a, "end": b} for a, b in spans])
        return [columns["doc_id"], n, kept, removed]

    return arrow_map(
        with_marks(docs, duplicate_places(docs), "left"), run, f"doc_id {kind}, n_bytes bigint, kept binary, spans {SPAN}"
    )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of `dedup`."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return dedup(docs).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def cut_texts(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with repeated bytes cut out of `text`.

    A character goes if all its bytes do.  `n_chars`, where there is one, becomes the new length.
    """

    def run(**columns):
        texts = []
        for text, mark in zip(columns["text"].to_pylist(), lists_of(columns["marks"], ["place"]), strict=True):
            if text:
                raw = text.encode("utf-8", "surrogatepass")
                whole = []
                for a, b in spans_of(raw, mark["place"]):
                    while a < b and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    whole.append((a, b))
                text = without(raw, whole).decode("utf-8", "replace")
            texts.append(text)
        return [columns["others"], pa.array(texts, type=pa.string())]

    others = F.struct(*(c for c in docs.columns if c != "text"))
    marked = with_marks(docs.withColumn("others", others), duplicate_places(docs), "left", "others")
    kind = marked.schema["others"].dataType.simpleString()
    out = arrow_map(marked.select("others", "text", "marks"), run, f"others {kind}, text string")
    picked = {c: F.col("text") if c == "text" else F.col(f"others.`{c}`") for c in docs.columns}
    if "n_chars" in picked:
        picked["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(x.alias(c) for c, x in picked.items()))
