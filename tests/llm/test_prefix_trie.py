import hashlib
import zlib

import pytest

from jsonloom.llm.prefix_trie import Shard, Sharing, trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, name int"


def brute(rows, sharing):
    talks = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in talks.items()}
    if sharing:
        first = {c: int(c - (abs(c) % 20) * (1 if c >= 0 else -1)) for c in talks}
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in talks}
        talks = {c: talks.get(first[c], [])[: h[c]] + v[h[c] :] for c, v in talks.items()}
    members = {}
    for c, v in talks.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    out = []
    for node, who in members.items():
        below = [x for x in members if x[: len(node)] == node]
        ends = sorted(c for c in who if len(talks[c]) == len(node))
        out.append(
            (
                min(who),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(who),
                sum(len(x) == len(node) + 1 for x in below),
                sum(not any(y[: len(x)] == x and len(y) > len(x) for y in below) for x in below),
                sum((len(members[x]) - 1) * len(x[-1][1].encode().split()) for x in below if x),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def got(spark, rows, sharing, shard):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    found = trie(df, sharing, shard).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
    return sorted(map(tuple, found.collect()), key=repr)


def corpus():
    rows = []
    for c in range(-45, 260):
        if c % 11 == 3:
            continue  # blocks without their first conversation, too
        n = (c * 7) % 6
        for turn in range(n):
            said = f"w{(c // 40) % 3} x\ty{turn}" if turn < 2 else f"own {c % 5} {turn} words\xa0here"
            rows.append((c, turn, ["user", "assistant"][turn % 2], said))
    rows += [(1000 + i, t, "user", f"same {t}") for i in range(90) for t in range(3)]  # copies in several shards
    rows += [(5000, None, None, None), (5000, 1, "user", ""), (5000, 1, "assistant", "tie"), (5000, 1, "user", "")]
    rows += [(5001, None, "", ""), (None, 0, "user", "nobody's"), (5020, 0, "user", "é " * 5000)]
    return rows


@pytest.mark.parametrize("shard", [7, 4096])
@pytest.mark.parametrize("sharing", [None, Sharing()])
def test_against_brute_force(spark, sharing, shard):
    rows = corpus()
    assert got(spark, rows, sharing, shard) == brute(rows, sharing)


def test_empty_and_turnless(spark):
    assert got(spark, [], Sharing(), 8) == []
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 2)
    rows = [(lone, 0, "user", "a b"), (lone, 1, "user", "c")]  # both turns go, and no conversation shares any
    assert got(spark, rows, Sharing(), 8) == brute(rows, Sharing())


def test_bitmaps_are_vertical():
    a, b, c = (bytes([x]) * 16 for x in (1, 2, 3))
    shard = Shard([(9, a + b, [1, 1]), (3, a + c, [1, 1]), (5, a, [1])])
    assert shard.ids == [3, 5, 9]
    assert shard.postings[0, a] == 0b111 and shard.postings[1, b] == 0b100
    nodes = shard.nodes()
    assert [(depth, n, shard.ends(ends)) for _, _, depth, _, n, ends, _ in nodes] == [(0, 3, ""), (1, 3, "5"), (2, 1, "9"), (2, 1, "3")]
