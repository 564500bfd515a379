"""Operator 3: substring dedup by relative Lempel-Ziv parsing.

The reference of a text is everything before it: the corpus is cut into blocks around
sampled anchors (`anchors`), and the index of blocks says of each block where the same
words stand first; the windows of blocks that are the first of their kind although their
anchor occurs in others are looked up one by one, so that repeats are found that begin or
end inside a block.

A text is parsed from left to right.  A factor starts at the first window that the
reference holds and the factor before does not reach; of the places that hold it the one
is taken from which most windows follow on in the same order, block after block.  A
factor's words are those of its windows, so it is never shorter than WINDOW words.  Where
a factor ends, the windows that cross its end are looked at, too: the next factor starts
with the first of them that stands somewhere in the reference.  Factors, which overlap
there, are the duplicate spans.

The result is exact: a word goes if a window of WINDOW consecutive words that covers it
starts earlier, too (smaller doc_id, or same document, earlier start), on the input.
Null doc_ids come first.  Rows that share a doc_id are one document: equal rows have the
same result, different texts are ordered and told apart by 64 bits of their hash.  Null
texts have no words.
"""

from __future__ import annotations


import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jsonloom.llm.anchors import (
    Sampling,
    by_document,
    covered_by,
    factors,
    lists_of,
    repeats,
    unpack_places,
    window_rows,
    windows_seen_before,
    with_marks,
)
from jsonloom.llm.common import Scratch, arrow_map

WINDOW = 20
SAMPLING = Sampling(window=WINDOW, seed=5)
#: Bytes of word hashes that a Python worker keeps; beyond it the memo starts anew.
MEMO_BYTES = 1 << 24


class WordHashes(dict):
    """Hashes of words, remembered within a task and a bound of bytes."""

    #: What an entry takes beside the word's own bytes.
    ENTRY = 170

    def __init__(self):
        super().__init__()
        self.held, self.task = 0, None

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        size = len(word) + self.ENTRY
        if self.held + size <= MEMO_BYTES:
            self.held += size
            self[word] = found
        return found

    def begin(self, task: int | None) -> None:
        """Starts anew when full and in each new task, for workers are used again."""
        if task != self.task or self.held > MEMO_BYTES - (1 << 16):
            self.clear()
            self.held, self.task = 0, task


_memo = WordHashes()


def word_units(raw: bytes) -> np.ndarray:
    words = raw.split()
    context = TaskContext.get()
    _memo.begin(context.taskAttemptId() if context else None)
    return np.fromiter(map(_memo.__getitem__, words), dtype=np.uint64, count=len(words))


SPAN = "array<struct<start: int, end: int>>"


def parse(first: np.ndarray, last: np.ndarray, source: np.ndarray, shift: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy factors (first window, last window, a mark of the source) of a text's marks.

    A mark says that windows first..last stand, in this order, in the source at places moved by shift.
    """
    order = np.lexsort((last, first, shift, source))
    runs: list[list[int]] = []  # marks that follow each other in one source: first and last window, a mark
    before = None
    for i in order.tolist():
        place, a, b = (source[i], shift[i]), int(first[i]), int(last[i])
        if place == before and a <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b, i])
            before = place
    runs.sort()
    out, k, done, best = [], 0, -1, None
    while True:
        while k < len(runs) and runs[k][0] <= done + 1:  # the runs that begin up to the next window
            if best is None or runs[k][1] > best[1]:
                best = runs[k]
            k += 1
        if best is not None and best[1] > done:
            out.append((done + 1, best[1], best[2]))
            done = best[1]
        elif k < len(runs):
            done = runs[k][0] - 1
        else:
            return out


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, kept (text of the kept words), spans (removed words), factors.

    A factor has the words start..end, and the document and word where its source starts.
    """
    scratch = Scratch(docs.sparkSession)
    found = repeats(docs, word_units, SAMPLING, scratch)
    ends = windows_seen_before(window_rows(docs, found.open, word_units, WINDOW), scratch)
    both = found.settled.unionByName(ends).withColumn("source", F.xxhash64("source_id", "source_text"))
    marks = by_document(both, "place", "source", "source_place", "source_id")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(**columns):
        n, kept, spans, parsed = [], [], [], []
        column = columns["marks"]
        lists, places = lists_of(column, ["place", "source", "source_place"]), column.offsets.to_pylist()
        ids = column.values.field("source_id")
        for k, (text, mark) in enumerate(zip(columns["text"].to_pylist(), lists, strict=True)):
            raw = text.encode("utf-8", "surrogatepass") if text else b""
            words = raw.split()
            _, first, last = unpack_places(mark["place"])
            _, there, _ = unpack_places(mark["source_place"])
            found = parse(first, last, mark["source"], there - first)
            starts, ends = (np.array([x[i] for x in found], dtype=np.int64) for i in (0, 1))
            cut = factors(covered_by(starts, ends, len(words), WINDOW)) if found else []
            n.append(len(words))
            parsed.append(
                [
                    {"start": a, "end": b + WINDOW, "source_id": ids[places[k] + i].as_py(), "source_start": int(there[i] - first[i]) + a}
                    for a, b, i in found
                ]
            )
            spans.append([{"start": a, "end": b} for a, b in cut])
            for a, b in reversed(cut):
                del words[a:b]
            kept.append(b" ".join(words).decode("utf-8", "replace"))
        return [columns["doc_id"], n, kept, spans, parsed]

    factor = f"array<struct<start: int, end: int, source_id: {kind}, source_start: int>>"
    schema = f"doc_id {kind}, n_words bigint, kept string, spans {SPAN}, factors {factor}"
    return arrow_map(with_marks(docs, marks, "left"), run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of `dedup`."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return dedup(docs).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


