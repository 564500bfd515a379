import random

import numpy as np

from jsonloom.llm.common import AT_ONCE, Scratch, arrow_map
from jsonloom.llm.jaccard_join import Join, apart, keep_one, with_components


def brute(texts, words, percent):
    """{doc_id: component} of {doc_id: text}."""
    sets = {}
    for doc, text in texts.items():
        w = (text or "").encode().lower().split()
        n = min(words, len(w))
        sets[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    docs = list(texts)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in docs}


def near_copies(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(50)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 120))] for _ in range(8)]
    line = [rng.choice(vocabulary) for _ in range(12)]
    texts = {}
    for doc in range(n):
        if rng.random() < 0.7:
            words = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary).upper()
        else:
            words = line + [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        texts[doc] = rng.choice([" ", "\n"]).join(words)
    return texts | {n: "", n + 1: None, n + 2: "one two", n + 3: "ONE two", n + 4: "one", n + 5: "İ x y z", n + 6: "i x y z"}


def test_against_brute_force(spark, frame):
    for words, percent in ((3, 90), (5, 80)):
        texts = near_copies(words, 250)
        df = frame([(d, t, None, None, None) for d, t in texts.items()]).repartition(3)
        got = {r.doc_id: r.component_id for r in with_components(df, Join(words, percent)).collect()}
        assert got == brute(texts, words, percent)


def test_one_stays(spark, frame):
    words = " ".join(f"x{i}" for i in range(40))
    rows = [(5, words), (3, words), (3, words), (None, words), (9, None), (9, None), (None, ""), (7, "other text")]
    df = frame([(*r, None, None, None) for r in rows])
    got = sorted(((r.doc_id, r.text) for r in keep_one(df, Join()).collect()), key=str)
    assert got == sorted([(3, words), (9, None), (None, ""), (7, "other text")], key=str)
    assert keep_one(df, Join()).columns == df.columns
    assert keep_one(df.limit(0), Join()).count() == 0


def test_a_collision_of_one_hash(frame):
    class Weak(Join):
        def name(self, grams):
            return bytes(8) + super().name(grams)[8:]  # the first of the two hashes is always the same

    texts = near_copies(5, 60)
    df = frame([(d, t, None, None, None) for d, t in texts.items()])
    got = {r.doc_id: r.component_id for r in with_components(df, Weak(3, 80)).collect()}
    assert got == brute(texts, 3, 80)


def test_leaders_leave_the_ngrams_whose_sets_they_have_met(frame, monkeypatch):
    """Three sets share a common n-gram and do not link: after two leaders nothing is left to compare."""
    left, store = [], Scratch.store

    def counted(self, df, name):
        out = store(self, df, name)
        if name == "open-prefixes":
            left.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "store", counted)
    texts = ["a b c d", "a b e f", "a b g h"]
    found = with_components(frame([(i, t, None, None, None) for i, t in enumerate(texts)]), Join(words=1, percent=50)).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(0, 0), (1, 1), (2, 2)]
    assert left[0] == 3 and left[2:] == [0, 0]


def test_texts_become_ngrams_in_bounded_parts(spark):
    seen = spark.range(2100, numPartitions=1).selectExpr("concat_ws(' ', id, id + 1, id + 2) as text")
    counts = arrow_map(seen, lambda text: [[len(text)]], "n bigint", AT_ONCE)
    assert sorted(r.n for r in counts.collect()) == [100, 500, 500, 500, 500]
    # the operator's passes go by parts: one document more than a part holds, none is lost
    docs = spark.range(AT_ONCE + 1, numPartitions=1).selectExpr("id as doc_id", "concat('a b c ', id % 2) as text")
    found = with_components(docs, Join(words=3, percent=100)).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(d, d % 2) for d in range(AT_ONCE + 1)}


def test_bitmaps_never_say_more_than_the_sets_differ():
    rng = np.random.default_rng(1)
    for n, m, both in ((1, 1, 0), (1, 1, 1), (64, 65, 60), (500, 530, 400), (1000, 1100, 1000), (40, 5000, 0), (3000, 3000, 2990)):
        grams = np.unique(rng.integers(0, 1 << 63, n + m - both, dtype=np.uint64))
        x, y = grams[:n], grams[n - both :]
        differ = apart(Join().parities(x), Join().parities(y))
        assert differ <= len(x) + len(y) - 2 * both
        assert (differ == 0) == (n == m == both)
        assert len(Join().parities(x)) * 8 >= n
    assert apart(Join().parities(x), Join().parities(x)) == 0


def test_only_sets_that_may_link_are_fetched(frame, monkeypatch):
    """Pairs of texts share rare words but not enough: they are candidates whose sets are not fetched; copies have no rows of n-grams."""
    rows, store = {}, Scratch.store

    def counted(self, df, name):
        out = store(self, df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(Scratch, "store", counted)
    rng = random.Random(7)
    pool = [f"p{i}" for i in range(2000)]
    texts = [" ".join([*(f"h{d // 2}x{i}" for i in range(60)), *rng.sample(pool, 340)]) for d in range(30)]
    texts += [" ".join(f"c{i}" for i in range(400))] * 30
    texts += [" ".join([*(f"n{i}" for i in range(400)), f"end{d}"]) for d in range(3)]
    found = with_components(frame([(i, t, None, None, None) for i, t in enumerate(texts)]), Join(words=1, percent=80)).collect()
    assert {r.doc_id: r.component_id for r in found} == {d: d if d < 30 else 30 if d < 60 else 60 for d in range(63)}
    assert sum(rows["led-pairs"]) >= 15  # candidates by their prefixes
    assert sum(rows["close-pairs"]) <= 3 and sum(rows.get("segments", [0])) <= 3 * 4 * 4  # of the near copies only
    assert rows["prefixes"][0] == 34 * Join(1, 80).prefix(400)  # of each class once
