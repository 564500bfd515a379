"""Operator 6: packing of tokenised documents by fitted patterns.

Texts become token ids in one narrow pass; a document longer than CAPACITY is cut, so
that only its first piece may be short.  What is packed is the histogram of piece
lengths, at most CAPACITY numbers however large the corpus is:

1. patterns of up to three lengths that fill a sequence are enumerated,
2. non-negative least squares fits how often each is used to the histogram,
3. the counts are rounded down, and
4. what is left is packed best fit, longest lengths first, again by counts.

The plan (patterns with their counts) goes to the tasks.  Every piece has a rank among
the pieces of its length: its rank within the task that wrote it, plus what earlier
tasks wrote of that length.  The rank names the sequence and the place in it, so
documents are never gathered or sorted.

A null or empty text is the end token alone.  Repeated rows are packed each; null ids
are kept.  Special tokens' strings in texts become the special tokens, as the library has it.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from jsonloom.llm.common import stored

CAPACITY = 2048
END_TOKEN = 0
#: Rounds of the least squares, partners tried for each first length of a triple, and the
#: most unused places in an enumerated pattern.
FIT_ROUNDS, PARTNERS, MOST_WASTE = 300, 10, 16

#: Fixed value: how byte-level vocabularies cut a text into the parts that are merged.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of the texts that are encoded by the library as well, in each call.
CHECKED_CHARS = 2_000


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies.

    Printable ones of Latin-1 stand for themselves, the others in turn for those from U+0100 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(0x100) if x not in own]
    return {chr(x): x for x in own} | {chr(0x100 + i): x for i, x in enumerate(rest)}


class ByteEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, as the tokenizers library gives them.

    Where the vocabulary's ids are its merges' ranks, tiktoken does the merging, several
    times as fast; texts with added tokens' strings, and other vocabularies, go to the
    library.  Some texts of each call go both ways; a difference fails the job.  With
    `plain`, special tokens' strings are ordinary text.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        tokens = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [x.content for x in tokens if not (plain and x.special)]
        self.fast = self.ranked()

    def ranked(self):
        """The vocabulary as byte strings with ranks, None if its ids are not in the order of its merges."""
        import tiktoken

        model = json.loads(self.tokenizer.to_str())
        cut, model = model["pre_tokenizer"], model["model"]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if model["type"] != "BPE" or not plain or any((cut or {}).get(k) != v for k, v in level.items()):
            return None
        alphabet = byte_alphabet()
        added = self.tokenizer.get_added_tokens_decoder()
        words = {w: i for w, i in model["vocab"].items() if i not in added}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        in_order = all(words.get(w) == 256 + i for i, w in enumerate(merges)) and len(words) == 256 + len(merges)
        if not in_order or any(c not in alphabet for w in words for c in w):
            return None
        ranks = {bytes(alphabet[c] for c in w): i for w, i in words.items()}
        return tiktoken.Encoding("ranked", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})

    def library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def one(self, text: str) -> bytes:
        if self.fast is None or any(x in text for x in self.added):
            return self.library([text])[0]
        return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        left = CHECKED_CHARS
        for text in texts:
            ids = self.one(text)
            if self.fast is not None and len(text) <= left:
                left -= max(len(text), 100)
                if self.library([text])[0] != ids:
                    raise ValueError("ids differ from the tokenizers library's")
            yield ids


_encoders: dict[tuple[str, bool], ByteEncoder] = {}


def encoder(path: str, plain: bool = False) -> ByteEncoder:
    """One encoder for each vocabulary, way with special tokens and Python worker."""
    if (path, plain) not in _encoders:
        _encoders[path, plain] = ByteEncoder(path, plain)
    return _encoders[path, plain]


def pieces(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and its writing task and rank there.

    The frame must be written once before it is used twice: ranks belong to the tasks that wrote it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, end = TaskContext.get().partitionId(), np.array([END_TOKEN], dtype="<u4").tobytes()
        ranks = [0] * (CAPACITY + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = encoder(tokenizer).encode([x or "" for x in batch.column(1).to_pylist()])
            row, rows = [], []
            for i, data in enumerate(ids):
                data += end
                view = memoryview(data)
                n = len(data) // 4
                start, piece = 0, 0
                while start < n:
                    length = (n - 1) % CAPACITY + 1 if not start else CAPACITY
                    crc = zlib.crc32(view[4 * start : 4 * (start + length)])
                    row.append(i)
                    rows.append((piece, start, length, crc, ranks[length]))
                    ranks[length] += 1
                    start, piece = start + length, piece + 1
            piece, start, length, crc, rank = zip(*rows, strict=True)
            columns = [batch.column(0).take(pa.array(row)), piece, start, length, crc, [task] * len(rows), rank]
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(columns, out, strict=True)],
                schema=out,
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns of one to three lengths that leave at most MOST_WASTE places; rows padded with 0."""
    found = [(int(x), 0, 0) for x in present if capacity - x <= MOST_WASTE]
    short = [int(x) for x in present if x < capacity]

    def largest(room: int) -> int:
        k = bisect_right(short, room)
        return short[k - 1] if k else 0

    for a in reversed(short):
        b = largest(capacity - a)
        if b and b <= a and capacity - a - b <= MOST_WASTE:
            found.append((a, b, 0))
        k = bisect_right(short, min(a, capacity - a - 1))
        for j in sorted({int(x) for x in np.linspace(0, k - 1, PARTNERS)} if k else ()):
            b = short[j]
            c = largest(capacity - a - b)
            if c and c <= b and capacity - a - b - c <= MOST_WASTE:
                found.append((a, b, c))
    return np.array(sorted(set(found), reverse=True), dtype=np.int64).reshape(-1, 3)


def non_negative_fit(rows: np.ndarray, target: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """x >= 0 that makes the lengths used by x patterns come near the target, by accelerated projected gradient."""
    uses = np.zeros(len(target))
    np.add.at(uses, rows.ravel(), 1)
    # a bound of the largest eigenvalue of the normal matrix: 3 uses a pattern times the uses of a length
    step = 1 / (3 * max(1.0, uses[1:].max()))
    x = ahead = np.zeros(len(rows))
    momentum = 1.0
    for _ in range(rounds):
        miss = np.bincount(rows.ravel(), weights=np.repeat(ahead, 3), minlength=len(target)) - target
        miss[0] = 0
        new = np.maximum(0, ahead - step * miss[rows].sum(axis=1))
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / after * (new - x)
        x, momentum = new, after
    return x


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Packs a histogram: ([(length, times), ...], repeats), longest first, each filled with the longest that fit."""
    left = {int(x): int(counts[x]) for x in np.flatnonzero(counts)}
    lengths, plan = sorted(left), []
    while lengths:
        room, used, at = capacity, [], len(lengths)
        while room and (k := bisect_right(lengths, room, 0, at)):
            length = lengths[k - 1]
            times = min(room // length, left[length])
            used.append((length, times))
            room, at = room - times * length, k - 1
        repeats = min(left[x] // n for x, n in used)
        for x, n in used:
            left[x] -= n * repeats
            if not left[x]:
                lengths.remove(x)
        plan.append((used, repeats))
    return plan


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns with repeats that use up the histogram exactly."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan = []
    rows = patterns(np.flatnonzero(counts), capacity)
    if len(rows):
        wanted = np.floor(non_negative_fit(rows, counts.astype(float)) + 1e-6).astype(np.int64)
        for i in np.argsort(-wanted, kind="stable"):
            used = [(int(x), int((rows[i] == x).sum())) for x in dict.fromkeys(rows[i]) if x]
            repeats = min(int(wanted[i]), *(int(counts[x]) // n for x, n in used))
            if repeats > 0:
                plan.append((used, repeats))
                for x, n in used:
                    counts[x] -= n * repeats
    return plan + best_fit(counts, capacity)


class Places:
    """Sequence and offset of the r-th piece of a length under a plan."""

    SPAN = 1 << 50  # more than the pieces of a length

    def __init__(self, plan: list[tuple[list[tuple[int, int]], int]]):
        ranks: dict[int, int] = {}
        rows, slots, sequence = [], [], 0
        for used, repeats in plan:
            offset = 0
            for length, times in used:
                rank = ranks.get(length, 0)
                rows.append((length * self.SPAN + rank, sequence, times, len(slots)))
                slots.extend(offset + k * length for k in range(times))
                ranks[length], offset = rank + times * repeats, offset + times * length
            sequence += repeats
        self.sequences = sequence
        rows.sort()
        self.start, self.base, self.times, self.slot = np.array(rows, dtype=np.int64).reshape(-1, 4).T.copy()
        self.slots = np.array(slots, dtype=np.int64)

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length * self.SPAN + rank
        i = np.searchsorted(self.start, key, side="right") - 1
        copy, slot = np.divmod(key - self.start[i], self.times[i])
        return self.base[i] + copy, self.slots[self.slot[i] + slot]


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = stored(pieces(docs, tokenizer), "pieces")
    counts = stored(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most CAPACITY rows
    places = Places(plan_packing({r.length: r.n for r in histogram}))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    picked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"],
            )

    schema = picked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return picked.mapInArrow(run, schema)
