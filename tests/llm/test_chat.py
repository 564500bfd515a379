import hashlib
import random

import public_tokenizers
import pytest

from jsonloom.llm.chat import IN_ROLE, IN_TEXT, format_tree, mark, read_back, read_turns, unmark

FILE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, start bigint"


def brute(rows):
    talks = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        talks.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = {}
    for conv, turns in talks.items():
        said = "".join(t for r, t in turns if r == "assistant")
        formatted = "".join(f"### {mark(r, IN_ROLE)}: {mark(t, IN_TEXT)}</turn>\n" for r, t in turns)
        every = "".join(f"{r}\n{t}\n" for r, t in turns)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (every, said)]
        out[conv] = (len(turns), digest[0], len(said), digest[1], len(formatted))
    return out


def test_marks_are_reversible():
    rng = random.Random(3)
    bits = ["\\", "###", "#", "</turn>", "<", "\n", ":", " ", "a", ": ", "é", "### user: "]
    for _ in range(2000):
        turns = [("".join(rng.choices(bits, k=rng.randint(0, 6))), "".join(rng.choices(bits, k=rng.randint(0, 9)))) for _ in range(3)]
        text = "".join(f"### {mark(r, IN_ROLE)}: {mark(t, IN_TEXT)}</turn>\n" for r, t in turns)
        assert read_turns(text) == turns
        assert unmark(mark(turns[0][1], IN_TEXT)) == turns[0][1]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = ["hello", "", None, "### x </turn>\n\\", "long text " * 3000, "é\n\nß  z", "yes", "no"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 6)):
            role = "user" if turn % 2 == 0 else "assistant"
            rows.append((conv, turn, role, "hello" if turn < 2 else rng.choice(texts), "p", 5))
    rows += [(900 + k, t, "user" if t % 2 == 0 else "assistant", f"same {t}", "p", 5) for k in range(40) for t in range(4)]
    rows += [(950, t, "user" if t % 2 == 0 else "assistant", f"turn {t}", "p", 5) for t in range(300)]
    rows += [(None, 0, "user", "a", "p", 5), (77, None, None, "b", "p", 5), (77, 1, "assistant", "c", "p", 5), (77, 1, "assistant", "c", "p", 5)]
    return rows


def test_against_brute_force(spark, rows):
    nodes, leaves = format_tree(spark.createDataFrame(rows, SCHEMA), FILE)
    got = {
        r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars)
        for r in read_back(nodes, leaves, FILE).collect()
    }
    assert got == brute(rows)
    out = sorted(nodes.collect(), key=lambda r: r.start)
    # one gapless stream, shared turns once, parents before children, positions follow ancestors
    at = 0
    for r in out:
        assert r.start == at and r.end == at + len(r.tokens)
        at = r.end
        assert r.position == sum(x.end - x.start for x in r.attends)
        assert all(x.end <= r.start for x in r.attends)
    talks = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        talks.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    prefixes = {tuple(t[: i + 1]) for t in talks.values() for i in range(len(t))}
    children = {}
    for p in prefixes:
        children.setdefault(p[:-1], set()).add(p)
    ends = {tuple(t) for t in talks.values()}
    assert len(out) == sum(p in ends or len(children[p]) > 1 for p in prefixes)
    assert sum(len(x.loss) for x in out) == sum(p[-1][0] == "assistant" for p in prefixes)


def test_empty_table(spark):
    nodes, leaves = format_tree(spark.createDataFrame([], SCHEMA), FILE)
    assert read_back(nodes, leaves, FILE).count() == 0
