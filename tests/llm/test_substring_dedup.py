import hashlib
import random

import numpy as np

from jsonloom.llm.substring_dedup import WINDOW, dedup, digests, parse


def brute(rows, window=WINDOW):
    """Of (doc_id, text) with distinct ids: words, kept words."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        words = (text or "").encode().split()
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = True
            seen.add(key)
        out[doc] = (len(words), [w for w, g in zip(words, gone, strict=True) if not g])
    return out


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "the", "\x85x"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(15, 60))] for _ in range(8)]
    rows = []
    for doc in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.5:
                p = list(rng.choice(passages))
                if rng.random() < 0.5 and p:
                    p[rng.randrange(len(p))] = f"e{doc}"
                words += p[rng.randint(0, 5) :]
            else:
                words += [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        rows.append((doc * 3, rng.choice([" ", "  ", "\n", "\t"]).join(words)))
    rows += [(7, rows[3][1]), (8, rows[3][1]), (10, "a " * 300), (11, "a b " * 200), (13, None), (14, ""), (None, rows[5][1])]
    return rows


def test_against_brute_force(spark, frame):
    for seed in range(2):
        rows = texts(seed, 150)
        df = frame([(*r, None, None, None) for r in rows]).repartition(3)
        want = brute(rows)
        got = {r.doc_id: r for r in dedup(df).collect()}
        assert len(got) == len(want)
        for doc, (n, kept) in want.items():
            assert (got[doc].n_words, got[doc].kept.encode()) == (n, b" ".join(kept)), doc
        words = {doc: (text or "").encode().split() for doc, text in rows}
        place = lambda doc, at: (doc is not None, doc or 0, at)
        for doc, r in got.items():
            covered, ended = set(), 0
            for f in r.factors:  # each is a copy of an earlier place, at least a window long
                assert f.end - f.start >= WINDOW and place(f.source_id, f.source_start) < place(doc, f.start)
                source = words[f.source_id][f.source_start : f.source_start + f.end - f.start]
                assert words[doc][f.start : f.end] == source
                assert f.end > ended and (f.start >= ended - WINDOW + 1)  # greedy: windows are taken once
                covered |= set(range(f.start, f.end))
                ended = f.end
            assert covered == {i for s in r.spans for i in range(s.start, s.end)}
    by = {r.doc_id: r for r in digests(df).collect()}
    for doc, (n, kept) in want.items():
        assert by[doc].n_removed == n - len(kept)
        assert by[doc].kept_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()


def test_repeated_rows_and_empty_table(spark, frame):
    text = " ".join(f"x{i}" for i in range(50))
    df = frame([(1, text, None, None, None)] * 3 + [(2, text, None, None, None), (2, "y " + text, None, None, None)])
    got = sorted((r.doc_id, len(r.kept.split())) for r in dedup(df).collect())
    assert got == [(1, 50), (1, 50), (1, 50), (2, 0), (2, 1)]
    assert dedup(df.limit(0)).count() == 0


def test_different_texts_under_null_ids(spark, frame):
    # some thousand texts share the null id: each keeps its own words, whatever was repeated in the others
    copy = " ".join(f"c{k}" for k in range(40))
    texts = [f"{copy} " + " ".join(f"t{i}.{k}" for k in range(30)) for i in range(1500)]
    texts += [" ".join(f"u{i}.{k}" for k in range(25 + i % 40)) for i in range(1500)]
    df = frame([(None, t, None, None, None) for t in texts]).repartition(4)
    got = sorted(r.kept for r in dedup(df).collect())
    own = [t.removeprefix(f"{copy} ") for t in texts]
    whole = [t for t in texts[:1500] if t in set(got)]
    assert len(whole) == 1  # the first of the copies
    own[texts.index(whole[0])] = whole[0]
    assert got == sorted(own)


def test_greedy_factors():
    at = lambda *x: np.array(x, dtype=np.int64)
    # blocks that follow on in one source are one factor; the longest at the place wins
    assert parse(at(0, 5, 3), at(4, 9, 6), at(1, 1, 2), at(7, 7, 0)) == [(0, 9, 0)]
    assert parse(at(0, 5, 3), at(4, 9, 16), at(1, 1, 2), at(7, 8, 0)) == [(0, 4, 0), (5, 16, 2)]
    assert parse(at(2, 20), at(4, 22), at(1, 1), at(0, 0)) == [(2, 4, 0), (20, 22, 1)]
    assert parse(at(), at(), at(), at()) == []
