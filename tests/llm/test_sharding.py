import zlib
from collections import Counter

import numpy as np

from jsonloom.llm.sharding import Permutation, communication_matrix, digests, hypergeometric, shuffle, write_shards


def test_permutations_are_bijections():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        for key in (0, 1, -3):
            assert sorted(Permutation(n, key)(np.arange(n)).tolist()) == list(range(n))
    first = Permutation(3, 0)
    seen = Counter(tuple(Permutation(4, k)(np.arange(4)).tolist()) for k in range(4800))
    assert len(seen) == 24 and max(seen.values()) < 2.2 * min(seen.values())
    assert first(np.array([1])) == first(np.arange(3))[1]  # places are computed one by one


def test_draws_follow_the_law():
    rng = np.random.default_rng(5)
    mine = [hypergeometric(30, 70, 20, rng) for _ in range(20_000)]
    theirs = rng.hypergeometric(30, 70, 20, 20_000)
    assert abs(np.mean(mine) - 6) < 0.05 and abs(np.var(mine) - np.var(theirs)) < 0.15
    huge = [hypergeometric(10**12, 23 * 10**12, 10**6, rng) for _ in range(300)]  # beyond what libraries draw
    assert abs(np.mean(huge) - 10**6 / 24) < 60
    assert hypergeometric(5, 0, 3, rng) == 3 and hypergeometric(0, 9, 3, rng) == 0


def test_matrix_sums():
    blocks, sizes = [100, 0, 1, 5000, 7], [1703, 1703, 1702]
    matrix = communication_matrix(blocks, sizes)
    assert matrix.sum(axis=1).tolist() == blocks and matrix.sum(axis=0).tolist() == sizes and (matrix >= 0).all()


def rows_of(frame, n=1003):
    rows = [(i, None if i % 97 == 0 else "copy" if i % 3 == 0 else f"té {i}", "en", "s", 1) for i in range(n)]
    return frame([*rows, (None, "x", None, None, None), (None, "x", None, None, None), (7, "y" * 300_000, "", "", 0)]), n + 3


def test_sizes_slots_and_spread(spark, frame):
    df, n = rows_of(frame)
    rows = digests(df.withColumnRenamed("id", "slot").repartition(3)).collect()
    assert len(rows) == n and Counter(r.doc_id for r in rows)[None] == 2
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    sizes = [len(v) for v in shards.values()]
    assert sorted(shards) == list(range(24)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    texts = {i: t for i, t, *_ in df.collect()}
    for r in rows:
        if r.doc_id is not None and r.doc_id != 7:
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    copies = Counter(r.shard for r in rows if r.text_crc32 == zlib.crc32(b"copy"))
    assert len(copies) == 24  # a group of copies spreads over all shards
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.15


def test_whole_rows_and_files(spark, frame, tmp_path):
    df, n = rows_of(frame, 60)
    out = shuffle(df.withColumn("shard", df.doc_id), 5)
    assert sorted(map(repr, out.drop("shard", "slot").collect())) == sorted(map(repr, df.collect()))
    write_shards(df, str(tmp_path / "shards"), 5)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [12, 12, 13, 13, 13]


def test_empty(spark, frame):
    assert digests(rows_of(frame)[0].limit(0)).collect() == []
