import random
import zlib

import numpy as np
import public_tokenizers

from jsonloom.llm.packing import CAPACITY, Places, encoder, non_negative_fit, pack, plan_packing

FILE = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def test_chunks_encode_like_the_library():
    rng = random.Random(2)
    bits = [*" \n\taé1.'\xa0", "the", "'s", "　", "  ", "<|endoftext|>", "123", "\r\n", "😀", "\x1c", "\x85"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(3000)]
    for plain in (False, True):
        e = encoder(FILE, plain)
        assert e.fast is not None and list(e.encode(texts)) == e.library(texts)
    every = [f"a{chr(c)}b1 {chr(c)}{chr(c)} {chr(c)}'s" for c in range(0x3400) if not 0xD800 <= c < 0xE000]
    assert [e.one(x) for x in every] == e.library(every)
    other = encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert other.fast is None and list(other.encode(texts[:50])) == other.library(texts[:50])


def test_plans_use_up_histograms():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 300, 20_000):
        lengths = np.minimum(np.maximum(1, rng.lognormal(5.5, 1, n).astype(int)), CAPACITY)
        histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        plan = plan_packing(histogram)
        left = dict(histogram)
        for used, repeats in plan:
            assert 0 < sum(length * times for length, times in used) <= CAPACITY and repeats > 0
            for length, times in used:
                left[length] -= times * repeats
        assert not any(left.values())
        assert sum(r for _, r in plan) <= np.ceil(lengths.sum() / CAPACITY) + max(2, 0.01 * n / 10)
        places = Places(plan)
        seen = set()
        for length, count in histogram.items():
            sequence, offset = places(np.full(count, length), np.arange(count))
            assert (offset + length <= CAPACITY).all()
            seen |= set(zip(sequence.tolist(), offset.tolist(), strict=True))
        assert len(seen) == n


def test_fit_is_non_negative_and_near():
    rows = np.array([(1500, 548, 0), (1024, 1024, 0), (1000, 600, 448)])
    target = np.zeros(CAPACITY + 1)
    for row, n in zip(rows, (30, 20, 10), strict=True):
        for x in row:
            target[x] += n * (x > 0)
    x = non_negative_fit(rows, target, 2000)
    assert (x >= 0).all() and np.allclose(x, (30, 20, 10), atol=0.1)


def test_rows(frame):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "x"]) for _ in range(rng.randint(0, 900)))) for i in range(40)]
    rows += [(50, "long text " * 4000), (51, None), (52, ""), (53, "same"), (53, "same"), (None, "null id")]
    out = pack(frame([(*r, None, None, None) for r in rows]), FILE).toPandas()
    for doc, text in rows:
        mine = out[out.doc_id == doc] if doc is not None else out[out.doc_id.isna()]
        ids = np.array(ids_of(text), dtype="<u4")
        n = len(ids)
        if doc != 53:
            assert mine.length.sum() == n and sorted(mine.piece) == list(range(-(-n // CAPACITY)))
        for p in mine.itertuples():
            assert p.length == CAPACITY or p.piece == 0
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    assert len(out[out.doc_id == 53]) == 2
    ordered = out.sort_values(["sequence_id", "offset"])
    want = ordered.groupby("sequence_id").length.cumsum() - ordered.length
    assert (want == ordered.offset).all() and ordered.groupby("sequence_id").length.sum().max() <= CAPACITY
    assert pack(frame([(1, "x", None, None, None)]).limit(0), FILE).count() == 0


def test_special_tokens_strings_encode_like_the_library(frame):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\n<|endoftext|> y"]
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    assert all(50256 in ids for ids in want.values())
    for r in pack(frame([(i, x, None, None, None) for i, x in enumerate(texts)]), FILE).collect():
        ids = np.array(want[r.doc_id], dtype="<u4")
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    plain = encoder(FILE, plain=True)
    assert list(plain.encode(texts)) == plain.library(texts) and 50256 not in np.frombuffer(b"".join(plain.encode(texts)), "<u4")
