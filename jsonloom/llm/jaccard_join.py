"""Operator 7: Jaccard join of word n-gram sets with vertical partitioning.

A global order puts rare n-grams first: by the estimate of a count sketch of fixed size
over all documents, then by hash.  (Any order gives right results; this one keeps common
n-grams out of the prefixes.)  Two sets link only if their first few n-grams share one,
so documents that share prefix n-grams are candidates, under length and position bounds.

The order is cut into fragments of equal weight.  A candidate pair's overlap is counted
in each fragment by itself, and the partial counts are summed per pair.

Equal sets are one class from the start.  Candidates come in rounds: first each class
with one leader of each of its n-grams, the most central class and then others; at last,
with the components of those links known, only pairs that lie in different components,
so a group of near copies costs its size and not its square.  No link between components is lost.

Each set has a bitmap of some bits per n-gram, in which each n-gram flips one bit.  Two bitmaps differ in
no more bits than their sets in n-grams, so most candidates that do not link are left out before sets are fetched.

Sets are named by 128 bits, two sums of hashes.  A pair's sets are fetched without moving
texts: a bitmap of the wanted ids, of bounded size, goes to the scan.  Null texts and texts without words have empty sets and link with nothing; repeated
rows are equal sets; the component of documents that all have null ids is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from jsonloom.llm.anchors import mixed
from jsonloom.llm.common import AT_ONCE, Scratch, arrow_map, shuffle_partitions, slices
from jsonloom.llm.components import components
from jsonloom.llm.substring_dedup import word_units

#: Counters of the sketch (a power of two), and the parts it travels in.
SKETCH_BITS, SKETCH_PARTS = 20, 64
#: Fragments that the global order is cut into.
FRAGMENTS = 4
#: Rounds in which each group's sets are compared with one leader of the group, before
#: the sets of different components are compared with each other.
LED_ROUNDS = 3
LEVEL_BITS = 8
#: Bits of the bitmap for each wanted id, its most bits, and those of one bitmap of Spark's aggregate.
BITS_EACH, MOST_BITS, BUCKET = 16, 1 << 27, 1 << 15


@dataclass(frozen=True)
class Join:
    """Words in an n-gram, and the least similarity in percent."""

    words: int = 5
    percent: int = 80

    def grams(self, text: str | None) -> np.ndarray:
        """Hashes of the distinct n-grams of a text; fewer words make one n-gram."""
        raw = text.encode("utf-8", "surrogatepass").lower() if text else b""  # bytes: A-Z only
        units = word_units(raw)
        n = min(self.words, len(units))
        if not n:
            return np.zeros(0, np.uint64)
        h = np.full(len(units) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            h = mixed(h + units[i : len(units) - n + 1 + i])
        return np.unique(h)

    def name(self, grams: np.ndarray) -> bytes:
        """16 bytes for a set of n-grams; two independent sums, whatever the order."""
        lanes = (np.add.reduce(mixed(grams)), np.add.reduce(mixed(~grams))) if len(grams) else (0, 0)
        return b"".join(int(x).to_bytes(8, "big") for x in lanes)

    def parities(self, grams: np.ndarray) -> bytes:
        """A bitmap of at least 64 and at least as many bits as n-grams, a power of two: how many n-grams fall on a bit, modulo 2."""
        bits = 1 << max(6, (len(grams) - 1).bit_length())
        flips = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
        return np.packbits((flips & 1).astype(np.uint8), bitorder="little").tobytes()

    def prefix(self, n: int) -> int:
        """N-grams of which two linked sets share one, of a set of n."""
        return n - (-(-self.percent * n // 100)) + 1

    def long_enough(self, n: Column, m: Column) -> Column:
        return 100 * F.least(n, m) >= self.percent * F.greatest(n, m)

    def enough(self, common: Column, n: Column, m: Column) -> Column:
        return (100 + self.percent) * common >= self.percent * (n + m)


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps of `parities` differ, the larger folded to the size of the smaller."""
    u, v = (np.frombuffer(b, dtype="<u8") for b in (x, y))
    while len(u) != len(v):
        if len(u) > len(v):
            u = u[: len(u) // 2] ^ u[len(u) // 2 :]
        else:
            v = v[: len(v) // 2] ^ v[len(v) // 2 :]
    return int(np.bitwise_count(u ^ v).sum())


FIRST = "doc_id {}, digest bigint, n bigint, name binary, bits binary, part int, counts binary"


def first_pass(docs: DataFrame, join: Join) -> DataFrame:
    """A row for each document (size and name of its set), and each task's sketch in parts."""
    ddl = FIRST.format(docs.schema["doc_id"].dataType.simpleString())
    out = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in (part for whole in batches for part in slices(whole, AT_ONCE)):
            sets = [join.grams(x) for x in batch.column("text").to_pylist()]
            for g in sets:
                np.add.at(sketch, (g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            columns = [
                batch.column("doc_id"),
                batch.column("digest"),
                pa.array(list(map(len, sets)), type=pa.int64()),
                pa.array([join.name(g) for g in sets], type=pa.binary()),
                pa.array([join.parities(g) if len(g) else None for g in sets], type=pa.binary()),
                pa.nulls(len(sets), pa.int32()),
                pa.nulls(len(sets), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=out)
        if sketch.any():
            parts = np.split(sketch.astype(np.uint32), SKETCH_PARTS)
            none = pa.nulls(SKETCH_PARTS, out.field("doc_id").type)
            zero = pa.nulls(SKETCH_PARTS, pa.int64())
            numbers = pa.array(range(SKETCH_PARTS), type=pa.int32())
            yield pa.RecordBatch.from_arrays(
                [none, zero, zero, *[pa.nulls(SKETCH_PARTS, pa.binary())] * 2, numbers, pa.array([x.tobytes() for x in parts])],
                schema=out,
            )

    return docs.select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(run, ddl)


class Order:
    """The global order of n-grams: a rank whose high bits are the sketch's level."""

    def __init__(self, counts: np.ndarray):
        levels = np.minimum(np.log2(counts.astype(float) + 1) * 8, (1 << LEVEL_BITS) - 1)
        self.levels = levels.astype(np.uint8)
        weight = np.bincount(self.levels, weights=counts, minlength=1 << LEVEL_BITS)
        # fragments: equal shares of all n-grams; within a level, hashes are even
        total, cuts = np.cumsum(weight), []
        for k in range(1, FRAGMENTS):
            want = total[-1] * k / FRAGMENTS
            level = int(np.searchsorted(total, want))
            share = (want - (total[level] - weight[level])) / max(weight[level], 1)
            cuts.append((level << (64 - LEVEL_BITS)) + int(min(share, 0.999999) * (1 << (64 - LEVEL_BITS))))
        self.cuts = np.array(cuts, dtype=np.uint64)

    def ranks(self, grams: np.ndarray) -> np.ndarray:
        """Ranks of n-grams, smallest first; the rank names the n-gram (56 of its 64 bits and the level)."""
        level = self.levels[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
        rest = mixed(grams) >> np.uint64(LEVEL_BITS)
        return np.sort((level << np.uint64(64 - LEVEL_BITS)) | rest)


def sketch_of(rows: DataFrame) -> np.ndarray:
    """The sketch over all tasks: a fixed number of counters, whatever the input."""
    parts = rows.filter(F.col("part").isNotNull()).select("part", "counts")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(counts, dtype=np.uint32).astype(np.int64)
                sums[part] = sums[part] + x if part in sums else x
        arrays = [pa.array(sums, type=pa.int32()), pa.array([x.tobytes() for x in sums.values()], type=pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "counts"])

    dealt = parts.repartition(min(SKETCH_PARTS, shuffle_partitions(rows.sparkSession)), "part")
    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), dtype=np.int64)
    for r in dealt.mapInArrow(add, "part int, counts binary").collect():
        out[r.part] += np.frombuffer(r.counts, dtype=np.int64)
    return out.ravel()


def prefixes(docs: DataFrame, join: Join, order: Order) -> DataFrame:
    """(gram, name, n, at): the n-grams of each document's prefix and their places in the order."""

    def run(**columns):
        names, ranks = [], []
        for text in columns["text"].to_pylist():
            grams = join.grams(text)
            if len(grams):
                names.append(join.name(grams))
                ranks.append((order.ranks(grams)[: join.prefix(len(grams))], len(grams)))
        sizes = [len(r) for r, _ in ranks]
        gram = np.concatenate([np.zeros(0, np.uint64), *(r for r, _ in ranks)]).view(np.int64)
        which = pa.array(np.repeat(np.arange(len(names), dtype=np.int32), sizes))
        name = pa.DictionaryArray.from_arrays(which, pa.array(names, type=pa.binary())).cast(pa.binary())
        n = np.repeat(np.array([n for _, n in ranks], dtype=np.int32), sizes)
        at = np.concatenate([np.zeros(0, np.int32), *(np.arange(k, dtype=np.int32) for k in sizes)])
        return [pa.array(gram), name, pa.array(n), pa.array(at)]

    return arrow_map(docs.select("text"), run, "gram bigint, name binary, n int, at int", AT_ONCE)


def among(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in `wanted`, and some few others: rows stay where they are.

    A bitmap of the keys' hashes goes to the rows; it has a bounded size, beyond which more others pass.
    """
    spark = rows.sparkSession
    n = wanted.count()
    bits = BUCKET
    while bits < min(n * BITS_EACH, MOST_BITS):
        bits *= 2
    place = (F.pmod(F.xxhash64(key), F.lit(bits)) + 1).alias("place")
    parts = wanted.select(place).groupBy(F.bitmap_bucket_number("place").alias("bucket"))
    parts = parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()  # MOST_BITS at most
    longs = [np.frombuffer(r.bits, dtype="<i8").tolist() for r in parts]
    bitmap = F.broadcast(spark.createDataFrame(list(zip([r.bucket for r in parts], longs)), "bucket bigint, longs array<bigint>"))
    at = F.bitmap_bit_position("place")
    placed = rows.withColumn("place", place).withColumn("bucket", F.bitmap_bucket_number("place"))
    bit = F.getbit(F.get("longs", F.shiftright(at, 6).cast("int")), (at % 64).cast("int"))
    return placed.join(bitmap, "bucket").filter(bit == 1).select(*rows.columns)


def segments(docs: DataFrame, wanted: DataFrame, join: Join, order: Order) -> DataFrame:
    """(name, fragment, grams): the sets of the wanted documents, cut at the fragments' borders."""

    def run(**columns):
        names, fragments, out = [], [], []
        for text in columns["text"].to_pylist():
            grams = join.grams(text)
            if not len(grams):
                continue
            name, ranks = join.name(grams), order.ranks(grams)
            for k, part in enumerate(np.split(ranks, np.searchsorted(ranks, order.cuts))):
                if len(part):
                    names.append(name)
                    fragments.append(k)
                    out.append(part.view(np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
        values = pa.array(np.concatenate([np.zeros(0, np.int64), *out]))
        return [names, fragments, pa.ListArray.from_arrays(pa.array(offsets), values)]

    found = arrow_map(among(docs.select("doc_id", "text"), wanted, "doc_id").select("text"), run, "name binary, fragment int, grams array<bigint>", AT_ONCE)
    return found.join(wanted.select("name").distinct(), "name", "left_semi")


def close(pairs: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b, n, m) that may link by their bitmaps: sets differ in at least as many n-grams as bitmaps in bits."""

    def run(**columns):
        x, y = columns.pop("mine").to_pylist(), columns.pop("other").to_pylist()
        n, m = (columns[k].to_numpy().astype(np.int64) for k in "nm")
        differ = np.fromiter(map(apart, x, y), dtype=np.int64, count=len(x))
        may = (100 + join.percent) * ((n + m - differ) // 2) >= join.percent * (n + m)
        return [columns[k].filter(pa.array(may)) for k in ("a", "b", "n", "m")]

    mine = classes.select(F.col("name").alias("a"), F.col("bits").alias("mine"))
    other = classes.select(F.col("name").alias("b"), F.col("bits").alias("other"))
    both = pairs.join(mine, "a").join(other, "b").select("a", "b", "n", "m", "mine", "other")
    return arrow_map(both, run, "a binary, b binary, n int, m int", AT_ONCE)


def linked(pairs: DataFrame, parts: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b, n, m) that link: partial overlaps by fragment, summed per pair."""
    mine = parts.select(F.col("name").alias("a"), "fragment", F.col("grams").alias("mine"))
    other = parts.select(F.col("name").alias("b"), "fragment", F.col("grams").alias("other"))
    partial = pairs.join(mine, "a").join(other, ["b", "fragment"])
    common = F.size(F.array_intersect("mine", "other")).alias("common")
    counted = partial.select("a", "b", "n", "m", "fragment", common)
    return (
        counted.dropDuplicates(["a", "b", "fragment"])  # repeated rows bring a set twice
        .groupBy("a", "b", "n", "m")
        .agg(F.sum("common").alias("common"))
        .filter(join.enough(F.col("common"), F.col("n"), F.col("m")))
    )


def candidate(join: Join) -> Column:
    """Can the sets (n, at) and (m, place) link if this is the first n-gram they share?"""
    n, m = F.col("n"), F.col("m")
    return join.long_enough(n, m) & join.enough(F.least(n - F.col("at"), m - F.col("place")), n, m)


def with_components(docs: DataFrame, join: Join) -> DataFrame:
    """One row per document: doc_id, n (size of its set), component_id (smallest linked doc_id).

    digest (hash of the text) and root (a number of the component, null for empty sets) follow.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.store(first_pass(docs, join), "sets")
    order = Order(sketch_of(rows))
    sets = rows.filter(F.col("part").isNull()).select("doc_id", "digest", "n", "name")
    named = rows.filter("part is null and n > 0").groupBy("name")
    classes = scratch.store(named.agg(F.min("doc_id").alias("doc_id"), F.first("bits").alias("bits")), "classes")

    # one document of each class will do: copies share n-grams with each other only
    firsts = among(docs.select("doc_id", "text"), classes, "doc_id")
    all_prefixes = scratch.store(prefixes(firsts, join, order), "prefixes")
    # aggregates that are joined back are written first: Spark then splits the hot keys of such joins
    code = F.shiftleft(F.col("n").cast("bigint"), 32) + F.col("at")
    often = all_prefixes.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.min(code).alias("lo"), F.max(code).alias("hi"))
    two = {"n": F.shiftright("lo", 32), "at": F.col("lo") % (1 << 32), "m": F.shiftright("hi", 32), "place": F.col("hi") % (1 << 32)}
    # n-grams that several sets have; of just two, if they can link by it
    often = often.filter("k > 1").withColumns(two).filter((F.col("k") > 2) | candidate(join)).select("gram")
    often = scratch.store(often, "common-grams")
    again = among(all_prefixes, often, "gram").join(often, "gram", "left_semi").groupBy(F.bitwise_not("gram").alias("gram"), "name")
    shared = scratch.store(again.agg(F.first("n").alias("n"), F.first("at").alias("at")), "shared-prefixes")
    scratch.drop(all_prefixes)
    scratch.drop(often)
    # The most central set of a group leads it: the one with the largest share of common prefix n-grams.
    weight = shared.groupBy("name").agg((1000 * F.count(F.lit(1)) / F.first("n")).cast("int").alias("weight"))
    weight = scratch.store(weight, "weights")
    bare, shared = shared, scratch.store(shared.join(weight, "name"), "weighted-prefixes")
    scratch.drop(bare)
    scratch.drop(weight)

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.store(close(pairs, classes, join), "close-pairs")
        if pairs.isEmpty():
            return pairs
        names = pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct()
        wanted = scratch.store(names.join(classes, "name").select("name", "doc_id"), "wanted")
        parts = scratch.store(segments(docs, wanted, join, order), "segments")
        scratch.drop(wanted)
        links = scratch.store(linked(pairs, parts, join), name)
        scratch.drop(parts)
        return links

    def rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
        """The prefix rows with the component of each set, of n-grams that still lie in several."""
        if roots is None:
            rows = rows.withColumn("root", F.col("name"))
        else:
            rows = rows.join(roots.toDF("name", "root"), "name", "left").withColumn("root", F.coalesce("root", "name"))
        rows = scratch.store(rows, "rooted")
        sizes = rows.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("k"))
        open_grams = sizes.groupBy("gram").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", "k").alias("major"))
        open_grams = scratch.store(open_grams.filter("roots > 1").select("gram", "major"), "open-grams")
        left = scratch.store(rows.join(open_grams, "gram"), "open-prefixes")
        scratch.drop(rows)
        scratch.drop(open_grams)
        return left

    def fresh(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
        pairs = pairs.filter(candidate(join)).select("a", "b", "n", "m").distinct()
        if tried is None:
            return pairs
        done = tried.select(F.col("a").alias("x"), F.col("b").alias("y"))
        same = (F.least("a", "b") == F.least("x", "y")) & (F.greatest("a", "b") == F.greatest("x", "y"))
        return pairs.join(done, same, "left_anti")

    links, tried, near = None, None, None
    for turn in range(LED_ROUNDS):
        here = rooted(shared, near)
        rank = F.struct(F.col("weight") if turn == 0 else F.xxhash64("name", F.lit(turn)), "name")
        leaders = here.groupBy("gram").agg(F.max_by(F.struct("n", "name", "at", "root"), rank).alias("leader"))
        leaders = scratch.store(leaders, "leaders")
        led = (
            here.join(leaders, "gram")
            .filter(F.col("root") != F.col("leader.root"))
            .select(
                F.col("name").alias("a"), F.col("leader.name").alias("b"), "n", "at",
                F.col("leader.n").alias("m"), F.col("leader.at").alias("place"),
            )
        )
        pairs = scratch.store(fresh(led, tried), "led-pairs")
        # By this n-gram the leader has met all the others: what is left are pairs without it.
        # N-grams that lie in one component stay in one.
        scratch.drop(shared)
        met = here.join(leaders, "gram").filter(F.col("name") != F.col("leader.name"))
        shared = scratch.store(met.select("gram", "name", "n", "at", "weight"), "unled-prefixes")
        scratch.drop(leaders)
        scratch.drop(here)
        found = checked(pairs, "led-links").select("a", "b")
        links = found if links is None else links.union(found)
        tried = pairs if tried is None else tried.union(pairs)
        near = scratch.store(components(links, scratch), "led-components")

    # what is left: pairs of different components that share a prefix n-gram
    here = rooted(shared, near)
    few = here.select("gram", F.col("name").alias("a"), "n", "at", F.col("root").alias("own"), "major")
    few = few.filter("own <> major")
    rest = here.select("gram", F.col("name").alias("b"), F.col("n").alias("m"), F.col("at").alias("place"), F.col("root").alias("far"))
    twice = (F.col("far") != F.col("major")) & (F.col("b") < F.col("a"))  # both in `few`: once is enough
    met = few.join(rest, "gram").filter((F.col("own") != F.col("far")) & ~twice & candidate(join))
    second = scratch.store(fresh(met, tried), "second-pairs")
    scratch.drop(here)
    more = checked(second, "second-links")
    root = near.toDF("node", "root")
    bridges = (
        more.select("a", "b")
        .join(root.toDF("a", "ra"), "a", "left").join(root.toDF("b", "rb"), "b", "left")
        .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    )
    over = scratch.store(components(bridges, scratch), "second-components")
    final = (
        classes.select("name", "doc_id")
        .join(root.toDF("name", "r1"), "name", "left").withColumn("r1", F.coalesce("r1", "name"))
        .join(over.toDF("r1", "r2"), "r1", "left").withColumn("root", F.coalesce("r2", "r1"))
    )
    final = scratch.store(final.select("name", "doc_id", "root"), "roots")
    smallest = scratch.store(final.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    component = final.join(smallest, "root").select("name", "component_id", "root")
    return sets.join(component, "name", "left").select(
        "doc_id",
        "n",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "digest",
        "root",
    )


def keep_one(docs: DataFrame, join: Join) -> DataFrame:
    """The documents, all columns, one of each component: the one with the smallest id.

    Documents with empty sets are no duplicates; repeated rows (same id and text) count once.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.store(with_components(docs, join), "components")
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("first")
    grouped = found.filter("root is not null").groupBy("root").agg(smallest).select("first.doc_id", "first.digest")
    stay = grouped.union(found.filter("root is null").select("doc_id", "digest")).distinct().toDF("stays", "as")
    same = docs["doc_id"].eqNullSafe(stay["stays"]) & (F.xxhash64(docs["text"]) == stay["as"])
    kept = docs.join(stay, same, "left_semi")
    repeated = found.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


ORACLE = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
    FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [list_aggregate(w, 'string_agg', ' ')]
        ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS n, b.n AS m, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id
        AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM o WHERE 100 * c >= 90 * (n + m - c)),
r AS (SELECT doc_id AS x, doc_id AS z FROM d UNION SELECT l.y, r.z FROM r JOIN l ON r.x = l.x)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, z AS component_id
FROM s JOIN (SELECT x AS doc_id, min(z) AS z FROM r GROUP BY x) USING (doc_id)
"""
