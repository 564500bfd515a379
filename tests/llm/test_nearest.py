import numpy as np
from pyspark.sql import functions as F

from jsonloom.llm.nearest import Tile, nearest, quantise, survivors

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, row string"


def brute(rows, k=5):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine[(i, tuple(v))] = np.array(v, dtype=np.float32).astype(float)
    out = {}
    for (q, qv), a in fine.items():
        if q % 50 == 0:
            near = [
                (-(a @ b) / np.sqrt((a @ a) * (b @ b)), i) for (i, _), b in fine.items() if i != q and len(a) == len(b)
            ]
            out.setdefault(q, []).append([(i, -s) for s, i in sorted((round(s, 12), i) for s, i in near)[:k]])
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(5, 16))
    vectors = [(i, (centres[i % 5] + rng.normal(size=16) * rng.choice([0.01, 0.5])).tolist()) for i in range(700)]
    vectors += [(1000 + i, centres[0].tolist()) for i in range(150)]  # equal vectors: ties go to small ids
    vectors += [(2000, None), (2001, []), (2050, [0.0] * 16), (2051, [None] + [1.0] * 15), (2052, [float("nan")] * 16)]
    vectors += [(2053, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (100, vectors[100][1])]
    df = spark.createDataFrame([(i, v, 1, "a", "b") for i, v in vectors], SCHEMA).repartition(5)
    got = {}
    for r in nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute(vectors)
    assert set(got) == set(want)
    for q, lists in want.items():
        assert sorted(got[q]) == list(range(1, len(lists[0]) + 1))
        for rank, (vec, score) in enumerate(lists[0], 1):
            assert abs(got[q][rank][1] - score) < 1e-9
            assert got[q][rank][0] == vec or abs(dict(lists[0]).get(got[q][rank][0], score) - score) < 1e-9
    assert [x[0] for x in sorted(got[1000].values(), key=lambda x: (-x[1], x[0]))][:1] != [1000]
    assert nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(40, 24)), rng.normal(size=(900, 24))

    def tile(vectors):
        codes, scale, lost = quantise(vectors)
        ids = np.arange(len(vectors), dtype=np.int64)
        raw = {"ids": ids, "rows": ids, "codes": codes, "scale": scale, "lost": lost}
        return Tile({"dim": 24, "n": len(vectors)} | {k: v.tobytes() for k, v in raw.items()})

    q, c = tile(a), tile(b)
    q.ids = q.ids + 10_000
    qi, _, ci, _ = survivors([q], [c], 5)
    exact = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    kept = set(zip((qi - 10_000).tolist(), ci.tolist(), strict=True))
    for i in range(40):
        assert all((i, int(j)) in kept for j in np.argsort(-exact[i])[:5])
    assert len(kept) < 0.2 * exact.size
