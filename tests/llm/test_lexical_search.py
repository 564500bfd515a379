import math
import re
from collections import Counter

import numpy as np
import pytest

from jsonloom.llm import lexical_search
from jsonloom.llm.lexical_search import Ball, Ranking, Rows, search, terms_of, weight

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(x.lower() if "A" <= x <= "Z" else x for x in text or ""))


def brute(docs, items, best=10):
    bags = [(i, Counter(split(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_all, l_all = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n_all // l_all
            s = sum(
                math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m))
                for t in set(split(text))
                if t in b
            )
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(scores)[:best], 1)]
    return sorted(out, key=repr)


def corpus():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)] + ["É", "naïve", "K9", "ǅ", "日本"]
    pick = lambda k: [words[min(int(rng.exponential(40)), len(words) - 1)] for _ in range(k)]
    docs = [(i, " ".join(pick(rng.integers(1, 60)))) for i in range(900)]
    docs += [(2000 + i, "copy of W1 w2\x00w3-w3_日本") for i in range(120)]  # ties go to small ids
    docs += [(3000, None), (3001, ""), (3002, "--- ,,"), (None, "w1 w2"), (5, docs[5][1]), (3003, " ".join(pick(60_000)))]
    items = [(i, " ".join(pick(12))) for i in range(25)]
    items += [(90, "copy"), (91, None), (92, "?!"), (93, "unheard of"), (None, "w5 w6"), (0, "w7"), (94, "W1 w1 É é naïve")]
    return docs, items


@pytest.mark.parametrize("blocks", [512, 4])
def test_against_brute_force(spark, monkeypatch, blocks):
    docs, items = corpus()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, rank string, item_id int").repartition(4)
    asked = spark.createDataFrame([(*d, "x") for d in items], "item_id bigint, text string, score string").repartition(2)
    found = search(df, asked, items_in_block=blocks)
    assert sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == brute(docs, items)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert search(df, asked).collect() == []
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert search(spark.createDataFrame([(1, "a")], df.schema), none).collect() == []


def test_terms():
    assert terms_of("Ab-c_D é\x7fÀ9") == [x.encode() for x in split("Ab-c_D é\x7fÀ9")]
    assert weight(10, 10) == math.floor(1000 * math.log(22 / 21))


def test_trees_prune_and_stay_exact():
    rng = np.random.default_rng(9)
    width, n = 400, 3000
    start = np.arange(n + 1) * 20
    group = rng.integers(0, 20, n)  # documents on twenty topics
    cols = np.concatenate([np.sort(rng.choice(20, 20, replace=False)) + 20 * g for g in group])
    rows = Rows(start, cols, rng.integers(1, 10**6, len(cols)))
    dense = np.zeros(width)
    tree = Ball(rows, np.arange(n), width, dense)
    assert not dense.any()
    whole = np.zeros((n, width), dtype=np.int64)
    whole[rows.row, rows.cols] = rows.vals
    scored = 0
    for g in range(20):
        terms, weights = np.arange(20 * g, 20 * g + 8), rng.integers(1, 30_000, 8)
        ranking = Ranking(terms, weights, 10)
        scored += ranking.search(tree, list(range(n)), np.zeros(width, dtype=np.int64))
        scores = whole[:, terms] @ weights
        want = sorted(range(n), key=lambda i: (-scores[i], i))[:10]
        assert [-i for _, i in sorted(ranking.heap, reverse=True)] == want
    assert scored < 20 * n / 4
    assert lexical_search.SAFE > 0
