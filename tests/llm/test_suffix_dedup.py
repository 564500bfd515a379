import hashlib
import random

import numpy as np
import pytest

from jsonloom.llm import suffix_dedup
from jsonloom.llm.suffix_dedup import WINDOW, Suffixes, cut_texts, dedup, digests


def brute(rows, window=WINDOW):
    """Of (doc_id, text) with distinct ids: bytes and which of them go."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - window + 1):
            key = raw[i : i + window]
            if key in seen:
                gone[i : i + window] = True
            seen.add(key)
        out[doc] = (raw, gone)
    return out


def texts(seed, n):
    rng = random.Random(seed)

    def prose(k):
        return "".join(rng.choice("abcdeé \n") for _ in range(k))

    passages = [prose(rng.randint(80, 400)) for _ in range(8)]
    rows = []
    for doc in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.6:
                p = rng.choice(passages)[rng.randint(0, 9) :]
                if rng.random() < 0.5:
                    at = rng.randrange(len(p))
                    p = p[:at] + "XYZ" + p[at + 1 :]
                parts.append(p)
            else:
                parts.append(prose(rng.randint(0, 200)))
        rows.append((doc * 3, "".join(parts)))
    return rows + [(7, rows[3][1]), (8, rows[3][1]), (10, "a" * 700), (11, "ab" * 400), (13, None), (14, ""), (None, rows[5][1])]


@pytest.mark.parametrize("most", [512, 3])
def test_against_brute_force(spark, frame, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "GROUP_BLOCKS", most)  # 3: most anchors go window by window
    rows = texts(most, 120)
    df = frame([(*r, None, None, None) for r in rows]).repartition(3)
    want = brute(rows)
    got = {r.doc_id: r for r in dedup(df).collect()}
    assert len(got) == len(want)
    for doc, (raw, gone) in want.items():
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        assert (got[doc].n_bytes, bytes(got[doc].kept)) == (len(raw), kept), doc
        assert [(s.start, s.end) for s in got[doc].spans] == suffix_dedup.factors(gone)
    by = {r.doc_id: r for r in digests(df).collect()}
    for doc, (raw, gone) in want.items():
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        assert by[doc].kept_sha256 == hashlib.sha256(kept).hexdigest()
        assert by[doc].n_removed == gone.sum() and by[doc].n_spans == len(suffix_dedup.factors(gone))


def test_suffix_sort():
    rng = np.random.default_rng(4)
    buffer = rng.integers(97, 99, 3000).astype(np.uint8)
    start = np.sort(rng.integers(0, 2900, 300))
    length = np.minimum(rng.integers(1, 100, 300), 3000 - start)
    group = np.sort(rng.integers(0, 20, 300))
    got = Suffixes(buffer, start, length, 0).sort(group)
    key = lambda i: (group[i], bytes(buffer[start[i] : start[i] + length[i]]), i)
    assert got.tolist() == sorted(range(300), key=key)


def test_collision_is_found(monkeypatch):
    # a first hash that always agrees: the bytes tell, and the second hash decides
    real = suffix_dedup.Hashes

    class Weak(real):
        def __init__(self, units, which):
            super().__init__(units if which else units * np.uint64(0), which)

    monkeypatch.setattr(suffix_dedup, "Hashes", Weak)
    a, b = b"x" * 84 + b"anchor-of-16byte" + b"y" * 84, b"z" * 84 + b"anchor-of-16byte" + b"w" * 84
    buffer = np.frombuffer(a + b + a, dtype=np.uint8)
    n = np.full(3, 184)
    row, d = suffix_dedup.repeated_windows(np.zeros(3, int), np.arange(3), buffer, np.arange(3) * 184, np.full(3, 84), n)
    assert set(row.tolist()) == {2} and len(d) == 85


def test_cut_texts(spark, frame):
    text = "é" * 40 + " ".join(str(i * i) for i in range(30, 60))
    df = frame([(1, text, "en", "s", 9), (2, "q" + text + "tail", None, None, None), (3, None, "x", None, 0)])
    got = {r.doc_id: r for r in cut_texts(df).collect()}
    assert cut_texts(df).columns == df.columns
    assert got[1].text == text and got[1].lang == "en" and got[1].kept == "z" and got[1].n_chars == len(text)
    assert got[2].text == "qtail" and got[2].n_chars == 5 and got[3].text is None
    assert cut_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [512, 3])
def test_different_texts_under_null_ids(spark, frame, monkeypatch, most):
    # some thousand texts share the null id: each keeps its own bytes, whatever was repeated in the others
    monkeypatch.setattr(suffix_dedup, "GROUP_BLOCKS", most)
    copy = "".join(f"{k * k:x}/" for k in range(500, 560))
    own = ["".join(f"<{i}.{k}>" for k in range(20)) for i in range(1000, 2500)]  # numbers of one length
    clean = ["".join(f"[{i}.{k}]" for k in range(20 + i % 30)) for i in range(1500)]
    texts = [copy + x for x in own] + clean
    df = frame([(None, t, None, None, None) for t in texts]).repartition(4)
    got = [bytes(r.kept).decode() for r in dedup(df).collect()]
    assert sorted(x for x in got if x[0] == "[") == sorted(clean)
    cut = [x for x in got if x[0] != "["]
    assert sum(x.startswith(copy) for x in cut) == 1  # the first of the copies
    # the first bytes of a number may go with the copy, as they are the same elsewhere
    assert sorted(x[-len(own[0]) :].split(">", 1)[1] for x in cut) == sorted(x.split(">", 1)[1] for x in own)
